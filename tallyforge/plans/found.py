"""Queries of the general problems: mixed timestamps, implausible counts, packed fields. Each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.operators.packed import report_items
from tallyforge.operators.spikes import implausible_counts
from tallyforge.operators.timestamps import normalise_moments


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_moments(spark.read.parquet(f"{d}/blocks.parquet"), spark.read.parquet(f"{d}/sender_zones.parquet"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_counts(spark.read.parquet(f"{d}/extracted.parquet"), spark.read.parquet(f"{d}/blocks.parquet"), spark.read.parquet(f"{d}/chant_list.parquet"), spark.read.parquet(f"{d}/chant_variants.parquet")).select("msg_id", "seq").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return report_items(spark.read.parquet(f"{d}/blocks.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p3_found": p3_found, "p5_found": p5_found}
