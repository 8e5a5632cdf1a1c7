"""Session helpers: sensible defaults for a local run, and the shared folder for cut lineage on a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller's own session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan spread over all cores before work that is heavy for its input; unchanged where the scan has parts enough, as any large one does.

    For scans alone (with their projections and filters): counting the parts of a join or an aggregate would run it.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where it is unset, a temporary folder in local mode (as in tests), else an error: executors would not see it."""
    sc = spark.sparkContext
    if given := sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
    atexit.register(shutil.rmtree, sc.getCheckpointDir().removeprefix("file:"), True)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the cluster's shared folder. The files go with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
