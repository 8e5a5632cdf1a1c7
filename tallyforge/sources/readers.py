"""Typed readers of the pipeline's inputs. A missing file or folder gives an empty table."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BLOCKS = "id long, envelope_date string, sender string, text string"
FACTS = "date string, chant string, count long"
RECORDS = "id long, envelope_date string, text string, segments array<struct<t:string,role:string>>"
STORE = "sender string, envelope_date string, text string, reason string"
CORRECTIONS = "sender string, envelope_date string, text string, corrected_text string, reason string"
LINES = "path string, line_no int, line string"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_no, line) of text files, whatever their line ends. A file is one row, so its lines keep their order."""
    try:
        d = spark.read.text(paths, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], LINES)
    lines = F.split(F.regexp_replace("value", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)
    return d.select(F.col("_metadata.file_path").alias("path"), F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def inbox(folder: str, given: list[str] | None = None) -> list[str]:
    """Given files, else the folder's *.txt in any case, sorted."""
    return list(given) if given else sorted(p for p in glob.glob(os.path.join(folder, "*")) if p.lower().endswith(".txt") and os.path.isfile(p))


def with_source(lines: DataFrame, paths: list[str]) -> DataFrame:
    """Adds src_idx: the place of the path among the sources."""
    order = lines.sparkSession.createDataFrame([(os.path.abspath(p), i) for i, p in enumerate(paths)], "_p string, src_idx int")
    return lines.withColumn("_p", F.regexp_replace("path", "^file:(//)?", "")).join(order, "_p", "left").drop("_p")


def read_jsonl(spark: SparkSession, path: str, schema: str = BLOCKS) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str = FACTS) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_store(spark: SparkSession, path: str, schema: str = STORE) -> DataFrame:
    """A store of exceptions; none if the file is missing."""
    return read_json_array(spark, path, schema) if os.path.exists(path) else spark.createDataFrame([], schema)


def read_state(path: str) -> dict:
    """State with defaults: since, generated."""
    state = {"since": None, "generated": []}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            state |= json.load(f)
    return state


def threshold(default: int = 100) -> int:
    """The gate's threshold: RECONCILE_MIN, else the default."""
    return int(os.environ.get("RECONCILE_MIN", default))
