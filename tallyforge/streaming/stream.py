"""The pipeline over files that keep arriving.

Repeats are merged by greatest multiplicity in foreachBatch, against the log so far: dropping duplicates within a watermark
would lose true repeats within one paste. Weeks are emitted when they have closed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyforge.operators.messages import merge_log
from tallyforge.sources import versions
from tallyforge.sources.readers import BLOCKS

#: 1970-01-01 was a Thursday; weeks that begin on Monday start four days later.
MONDAY = "4 days"


def stream_blocks(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """JSON lines of blocks as they arrive; read files go to the archive if one is given."""
    r = spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", 16)
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return r.json(folder)


def weekly_totals(facts: DataFrame, ts: str = "ts", late: str = "14 days") -> DataFrame:
    """(week, chant, total, n) of a stream of facts; in append mode a week comes out once it has closed."""
    w = facts.withWatermark(ts, late).groupBy(F.window(ts, "7 days", "7 days", MONDAY).alias("w"), "chant").agg(F.sum("count").alias("total"), F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("week"), "chant", "total", "n")


def merging_writer(messages: DataFrame, log: str, checkpoint: str) -> DataStreamWriter:
    """Merges each micro-batch of dated messages into the log: generations of a table, the newest named by a published version.

    A batch that fails between the two leaves the version, and so the log, as it was; the generation before the newest stays for readers.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cols = ["src_idx", "msg_date", "seconds", "sender", "body", "lines", "seq"]
        state = versions.latest(spark, f"{log}/versions")
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if state is not None and state["query"] == query and state["batch"] >= batch_id:
            return  # delivered again after its version was published
        now = None if state is None else spark.read.parquet(f"{log}/{state['table']}")
        both = batch.select(cols) if now is None else now.select(cols).unionByName(batch.select(cols))
        table = f"g{batch_id}-{uuid.uuid4().hex[:8]}"
        merge_log(both).write.mode("errorifexists").parquet(f"{log}/{table}")
        versions.publish(spark, f"{log}/versions", {"query": query, "batch": batch_id, "table": table, "before": None if state is None else state["table"]})
        if state is not None and state["before"]:
            versions.remove(spark, f"{log}/{state['before']}")

    return messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current_log(spark: SparkSession, log: str) -> DataFrame | None:
    """The newest generation, or None before the first; a log that cannot be read is an error."""
    state = versions.latest(spark, f"{log}/versions")
    return None if state is None else spark.read.parquet(f"{log}/{state['table']}")
