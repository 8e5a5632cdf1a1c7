"""Checks: labelled records, and the two-way reconciliation of facts with their source.

Nulls count as absent values; empty tables reconcile as clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T

CONTENT, DROPPED, OPEN = ["chant-label", "count"], ["filler", "name", "date", "greeting", "phone", "list-marker", "other"], ["uncertain"]


def bag_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, missed, extra): copies in `a` beyond those in `b`, and the other way round; rows without a difference left out."""
    x = a.groupBy(*keys).agg(F.count("*").alias("_a")).withColumn("_b", F.lit(0).cast("long"))
    y = b.groupBy(*keys).agg(F.count("*").alias("_b")).withColumn("_a", F.lit(0).cast("long"))
    d = x.unionByName(y).groupBy(*keys).agg((F.sum("_a") - F.sum("_b")).alias("_d")).where("_d <> 0")
    return d.select(*keys, F.greatest("_d", F.lit(0)).alias("missed"), F.greatest(-F.col("_d"), F.lit(0)).alias("extra"))


def reconcile(source: DataFrame, facts: DataFrame, threshold: int = 100) -> DataFrame:
    """(date, value) bags -> (date, missed, extra, worst, status): CLEAN dates are left out, FAIL where a value reaches the threshold, else PASS."""
    d = bag_difference(source.where("value is not null"), facts.where("value is not null"), ["date", "value"])
    return d.groupBy("date").agg(F.sum("missed").alias("missed"), F.sum("extra").alias("extra"), F.max("value").alias("worst")).withColumn("status", F.when(F.col("worst") >= threshold, "FAIL").otherwise("PASS"))


def render_bags(diff: DataFrame, side: str, threshold: int = 100) -> DataFrame:
    """(date, text): values as VxC by value, significant ones marked."""
    v = diff.where(F.col(side) > 0).select("date", "value", F.concat(F.col("value").cast("string"), F.lit("x"), F.col(side).cast("string"), F.when(F.col("value") >= threshold, "*").otherwise("")).alias("t"))
    return v.groupBy("date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "t"))), lambda x: x["t"]), ", ").alias(side))


def gate(diff: DataFrame, threshold: int = 100) -> str:
    """CLEAN, PASS or FAIL of a whole report, in one action."""
    r = diff.agg(F.count("*").alias("n"), F.max("value").alias("v")).first()
    return "CLEAN" if not r.n else "FAIL" if r.v >= threshold else "PASS"


def source_bag(blocks: DataFrame, year: int = 2026) -> DataFrame:
    """(date, value): every number that the blocks' texts report."""
    return blocks.select(T.norm_date(F.col("envelope_date"), year).alias("date"), F.explode(T.numbers_in(F.col("text"), T.year_of(F.col("envelope_date"), year))).alias("value"))


def fact_bag(facts: DataFrame, year: int = 2026) -> DataFrame:
    return facts.select(T.norm_date(F.col("date"), year).alias("date"), F.col("count").alias("value"))


def record_flags(records: DataFrame, date_range: tuple[int, int] = (2020, 2030)) -> DataFrame:
    """(id, text, segments[t, role]) -> (id, level, code, message): roles, reconstruction, number census, count shape, plausibility."""
    s, valid = F.col("segments"), CONTENT + DROPPED + OPEN
    nums: Column = T.digit_runs(F.col("text"))
    own = T.digit_runs(F.array_join(F.transform(s, lambda x: x["t"]), " "))
    flag = lambda when, level, code, msg: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), msg.cast("string").alias("message")))
    counts = F.filter(s, lambda x: x["role"] == "count")
    per = lambda test, level, code: F.transform(F.filter(s, test), lambda x: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), x["t"].alias("message")))
    year_like = F.transform(F.filter(counts, lambda x: F.exists(T.digit_runs(x["t"]), lambda n: n.between(*date_range))), lambda x: F.struct(F.lit("soft").alias("level"), F.lit("year-like-count").alias("code"), x["t"].alias("message")))
    odd_date = F.transform(F.filter(s, lambda x: (x["role"] == "date") & F.exists(T.digit_runs(x["t"]), lambda n: n.between(100, 1999) | (n > 2099))), lambda x: F.struct(F.lit("soft").alias("level"), F.lit("odd-number-in-date").alias("code"), x["t"].alias("message")))
    shape = F.transform(F.filter(counts, lambda x: F.size(T.digit_runs(x["t"])) != 1), lambda x: F.struct(F.lit("hard").alias("level"), F.lit("count-shape").alias("code"), x["t"].alias("message")))
    times = lambda a, v: F.size(F.filter(a, lambda x: x.eqNullSafe(v)))
    # as bags: a number that stands twice in the text and once in the segments differs too
    odd = F.filter(F.transform(F.array_distinct(F.concat(nums, own)), lambda v: F.when(times(nums, v) != times(own, v), F.format_string("%s: %d in text, %d in segments", F.coalesce(v.cast("string"), F.lit("too large")), times(nums, v), times(own, v)))), lambda x: x.isNotNull())
    whole = F.array_compact(
        F.array(
            flag(T.without_space(F.array_join(F.transform(s, lambda x: x["t"]), "")) != T.without_space(F.col("text")), "hard", "reconstruction", F.lit("segments differ from text")),
            flag(F.array_sort(nums) != F.array_sort(own), "hard", "number-census", F.array_join(odd, ", ")),
        )
    )
    flags = F.concat(per(lambda x: ~x["role"].isin(valid), "hard", "bad-role"), per(lambda x: x["role"] == "uncertain", "hard", "uncertain"), whole, shape, year_like, odd_date)
    return records.select("id", F.explode(flags).alias("f")).select("id", "f.level", "f.code", "f.message")


def has_hard(flags: DataFrame) -> bool:
    return flags.where(F.lower("level") == "hard").limit(1).count() > 0
