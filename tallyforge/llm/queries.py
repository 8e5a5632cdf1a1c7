"""Queries of the problems of language; each reads its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bpe import encode_corpus
from tallyforge.llm.canon import canonical_chants
from tallyforge.llm.dedup import RepeatIndex, repeats
from tallyforge.llm.forms import odd_fields
from tallyforge.llm.leak import leaks
from tallyforge.llm.level import reading_levels
from tallyforge.llm.pii import personal_information
from tallyforge.session import shared_folder


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{d}/blocks.parquet"))


def p2_new_batch(spark: SparkSession, d: str) -> DataFrame:
    """The last batch against an index of all before it: the same rows that p2_found has of it."""
    b = spark.read.parquet(f"{d}/blocks.parquet").where("src_idx is not null")
    last = b.agg(F.max("src_idx")).first()[0]
    index = RepeatIndex(spark, f"{shared_folder(spark)}/repeat-index-{uuid.uuid4().hex[:8]}")
    index.accept(b.where(F.col("src_idx") < F.lit(last)), look=False)
    return index.accept(b.where(F.col("src_idx") == F.lit(last)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_information(spark.read.parquet(f"{d}/blocks.parquet"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return odd_fields(spark.read.parquet(f"{d}/blocks.parquet"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_chants(*(spark.read.parquet(f"{d}/{t}") for t in ("extracted.parquet", "blocks.parquet", "review.parquet", "chant_list.parquet", "chant_variants.parquet")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{d}/documents.parquet"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")).where("level = 3").select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_new_batch, p4_found, p6_found, p7_found, p8_ids, p9_found, p10_found)}
SQL: dict[str, str] = {}
