"""Totals and profiles of facts (msg_id, seq, date, chant, count).

Rows without a chant or count are left out; the date 'Unknown' counts in totals over all dates and not by date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(facts: DataFrame) -> DataFrame:
    return facts.where("chant is not null and chant <> '' and count is not null")


def totals(facts: DataFrame, by: list[str]) -> DataFrame:
    return usable(facts).groupBy(*by).agg(F.sum("count").alias("total"), F.count("*").alias("n"))


def daily_expressions(facts: DataFrame) -> DataFrame:
    """(date, chant, expr, first_seen): counts of a day and label joined with +, in order of arrival."""
    g = usable(facts).groupBy("date", "chant").agg(F.array_sort(F.collect_list(F.struct("msg_id", "seq", "count"))).alias("v"))
    return g.select("date", "chant", F.array_join(F.transform("v", lambda x: x["count"].cast("string")), "+").alias("expr"), F.struct(F.get("v", F.lit(0))["msg_id"].alias("msg_id"), F.get("v", F.lit(0))["seq"].alias("seq")).alias("first_seen"))


def summary_expressions(facts: DataFrame) -> DataFrame:
    """(chant, part, expr): a label's days in order of first arrival; the writer joins the parts with +, so no label's list is built in one task."""
    d = daily_expressions(facts)
    first = d.groupBy("date").agg(F.min("first_seen").alias("day_seen"))
    return d.join(first, "date").select("chant", F.struct("day_seen.msg_id", "day_seen.seq").alias("part"), "expr")


def ordered_labels(facts: DataFrame, order: DataFrame) -> list[str]:
    """Labels present, in report order, then the others by first arrival. One small action, before a pivot."""
    first = usable(facts).groupBy("chant").agg(F.min(F.struct("msg_id", "seq")).alias("f"))
    o = order.groupBy("chant").agg(F.min("ord").alias("ord"))
    return [r.chant for r in first.join(o, "chant", "left").orderBy(F.col("ord").asc_nulls_last(), "f").select("chant").collect()]


def column_names(labels: list[str], taken: tuple[str, ...] = ("date",)) -> list[str]:
    """Labels as column names: one that equals an earlier name but for case gets a number, as such columns can be neither told apart nor written."""
    seen, out = {x.lower() for x in taken}, []
    for x in labels:
        name, n = x, 1
        while name.lower() in seen:
            n += 1
            name = f"{x} ({n})"
        seen.add(name.lower())
        out.append(name)
    return out


def daily_pivot(facts: DataFrame, labels: list[str]) -> DataFrame:
    """date x label totals, zero where there is none; columns in the order of `labels`, named by column_names."""
    p = usable(facts).where("date <> 'Unknown'").groupBy("date").pivot("chant", labels).agg(F.sum("count")).toDF("date", *[f"_{i}" for i in range(len(labels))])
    return p.select("date", *[F.coalesce(f"_{i}", F.lit(0).cast("long")).alias(x) for i, x in enumerate(column_names(labels))])


def wide_totals(facts: DataFrame, labels: list[str]) -> DataFrame:
    """One row, a column for each label, zero where there is none."""
    return usable(facts).groupBy().pivot("chant", labels).agg(F.sum("count")).na.fill(0)


def profile(facts: DataFrame, by: list[str]) -> DataFrame:
    """Number, least, greatest and distinct counts of each group."""
    return usable(facts).groupBy(*by).agg(F.count("*").alias("n"), F.min("count").alias("least"), F.max("count").alias("greatest"), F.countDistinct("count").alias("kinds"))


def digit_lengths(facts: DataFrame, by: list[str]) -> DataFrame:
    return usable(facts).groupBy(*by, F.length(F.col("count").cast("string")).alias("digits")).agg(F.count("*").alias("n"))


def most_common(facts: DataFrame, by: list[str], k: int = 6) -> DataFrame:
    """The k commonest counts of each group; ties by first encounter in order of (date, count). Ranked after counting."""
    c = usable(facts).groupBy(*by, "count").agg(F.count("*").alias("n"), F.min(F.struct("date", "count")).alias("f"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "f"))).where(F.col("rank") <= k).drop("f")


def filtered(facts: DataFrame, blocks: DataFrame, sender: str | None = None, contains: str | None = None, chant: str | None = None) -> DataFrame:
    """Facts of a sender, of texts that contain a string, of a label."""
    b = blocks
    if sender is not None:
        b = b.where(F.trim("sender") == sender.strip())
    if contains is not None:
        b = b.where(F.contains("text", F.lit(contains)))
    f = facts if chant is None else facts.where(F.col("chant") == chant)
    return f.join(b.select(F.col("id").alias("msg_id")), "msg_id", "left_semi")
