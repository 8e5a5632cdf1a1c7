"""Lines to messages, messages to one log, log to weeks.

Order is always carried by explicit columns (src_idx, line_no, seq). A null line belongs to no message.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T


def sessionize(lines: DataFrame, unglue: bool = True, notices_close: bool = False) -> DataFrame:
    """(path, line_no, line) -> one row per message: path, msg_no, time, date, sender, body, lines, first_line.

    A header opens a message and later lines belong to it; lines before the first header are dropped. With
    `notices_close`, a dated line without a sender ends the message, and what follows it is dropped up to the next header.
    """
    d = lines.where("line is not null").select("path", "line_no", T.strip_leading_bidi(F.col("line")).alias("line"))
    if unglue:
        d = d.select("path", "line_no", F.posexplode(T.split_glued(F.col("line"))).alias("part", "line"))
    else:
        d = d.withColumn("part", F.lit(0))
    d = d.select("path", "line_no", "part", "line", F.inline(F.array(F.struct(T.header(F.col("line")).alias("h")))))
    d = d.withColumn("notice", T.is_notice(F.col("line")) if notices_close else F.lit(False))
    w = Window.partitionBy("path").orderBy("line_no", "part").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("group", F.sum((F.col("h").isNotNull() | F.col("notice")).cast("int")).over(w)).where("group > 0")
    body = F.coalesce(F.col("h.text"), F.col("line"))
    g = d.groupBy("path", "group").agg(F.array_sort(F.collect_list(F.struct("line_no", "part", body.alias("body"), "line"))).alias("l"), F.min_by("h", F.struct("line_no", "part")).alias("h"))
    g = g.where("h is not null")
    no = F.row_number().over(Window.partitionBy("path").orderBy("group")) - 1
    return g.select("path", no.cast("long").alias("msg_no"), "h.time", "h.date", "h.sender", T.strip(F.array_join("l.body", "\n")).alias("body"), F.col("l.line").alias("lines"), F.element_at("l.line_no", 1).alias("first_line"))


def preamble(lines: DataFrame) -> DataFrame:
    """Lines (path, line_no, line, ...) before the first header of their file; of files without one all."""
    head = T.strip_leading_bidi(F.col("line"))
    first = lines.where(F.exists(T.split_glued(head), lambda x: T.header(x).isNotNull())).groupBy("path").agg(F.min("line_no").alias("_first"))
    return lines.join(first, "path", "left").where("_first is null or line_no < _first").drop("_first")


def as_blocks(messages: DataFrame) -> DataFrame:
    """(id, envelope_date, sender, text)."""
    return messages.select(F.col("msg_no").alias("id"), F.col("date").alias("envelope_date"), "sender", F.col("body").alias("text"))


def bag_union(rows: DataFrame, identity: list[str], source: str, order: list[str]) -> DataFrame:
    """Of each identity as many copies as the source with most has; a copy comes from the first source that has it.

    Adds `occ`, the copy's number. Copies are counted, never brought together: an identity that a third of all rows share is
    one row for each source before the window. Equal copies of a source stand where its first stands.
    """
    rest = [c for c in rows.columns if c not in (*identity, source)]
    counted = rows.groupBy(*identity, source).agg(F.count("*").alias("_n"), F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    before = F.coalesce(F.max("_n").over(Window.partitionBy(*identity).orderBy(source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = counted.withColumn("_m", before).where("_n > _m")
    return new.select(*identity, source, "_r.*", F.explode(F.sequence(F.col("_m") + 1, F.col("_n"))).alias("occ"))


#: Bodies that begin alike for so many characters are searched together; shorter ones are looked up among all beginnings.
HEAD = 8


def continued(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body, lo, hi) of distinct bodies, lo and hi their least and greatest source -> those that another of the same keys begins with, with lo and hi of all such.

    Among bodies in order those that begin with one follow it at once, so one pass with a stack of open beginnings finds them,
    without comparing pairs. The pass is spread by keys and by the first HEAD characters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list] = []  # key, body, lo and hi of what continues it, of itself too
        out: list[tuple] = []

        def close() -> None:
            k, b, lo, hi, own = stack.pop()
            if lo is not None:
                out.append((*k, b, lo, hi))
                own = (min(lo, own[0]), max(hi, own[1]))
            if stack:  # what continues this one continues the one below
                x = stack[-1]
                x[2], x[3] = (own[0], own[1]) if x[2] is None else (min(x[2], own[0]), max(x[3], own[1]))

        for d in batches:
            for *k, b, lo, hi in zip(*(d[c] for c in [*keys, "body", "lo", "hi"])):
                while stack and not (stack[-1][0] == k and b.startswith(stack[-1][1])):
                    close()
                stack.append([k, b, None, None, (lo, hi)])
            yield pd.DataFrame(out, columns=[*keys, "body", "lo", "hi"])
            out.clear()
        while stack:
            close()
        yield pd.DataFrame(out, columns=[*keys, "body", "lo", "hi"])

    size = F.length("body")
    head = F.left("body", F.lit(HEAD))
    d = bodies.select(*keys, "body", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    long = d.where(size >= HEAD).repartition(*[F.col(k) for k in keys], head).sortWithinPartitions(*keys, "body").mapInPandas(run, ", ".join([f"{k} string" for k in keys] + ["body string", "lo long", "hi long"]))
    starts = d.where(size > 1).select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.least(size - 1, F.lit(HEAD - 1))), lambda n: F.left("body", n))).alias("body"), "lo", "hi")
    short = starts.groupBy(*keys, "body").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    empty = d.where(size > 0).groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*keys, F.lit("").alias("body"), "lo", "hi")
    return long.unionByName(short).unionByName(empty)


def drop_truncated(rows: DataFrame, key: list[str], source: str, body: str = "body") -> DataFrame:
    """Without rows whose body is a proper beginning of a longer one with the same key from another source. A null body is kept; null keys are equal."""
    k = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"_k{i}") for i, c in enumerate(key)]
    names = [f"_k{i}" for i in range(len(key))]
    b = rows.where(F.col(body).isNotNull()).select(*k, F.col(body).alias("body"), F.col(source).alias("_s")).groupBy(*names, "body").agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    cut = continued(b, names).select(*[F.col(n).alias(f"_c{n}") for n in names], F.col("body").alias("_b"), "lo", "hi")
    # some longer copy comes from another source unless all of them come from this row's own
    on = (F.col(body) == F.col("_b")) & ((F.col("lo") != F.col(source)) | (F.col("hi") != F.col(source)))
    for n in names:
        on = on & (F.col(n) == F.col(f"_c{n}"))
    return rows.select("*", *k).join(cut, on, "left_anti").drop(*names)


def merge_log(messages: DataFrame) -> DataFrame:
    """Messages of all pastes (src_idx, msg_date, seconds, sender, body, seq) to one ordered log without repeats or cut copies."""
    union = bag_union(messages, ["msg_date", "seconds", "sender", "body"], "src_idx", ["seq"])
    kept = drop_truncated(union, ["msg_date", "seconds", "sender"], "src_idx")
    return kept.orderBy("msg_date", "seconds", "src_idx", "seq", "occ")


def dated(messages: DataFrame, src_idx: Column, default_year: int | None = 2026, month_first: bool = False) -> DataFrame:
    """Sessions with a parsed date and time; unreadable ones are left out."""
    return messages.select(src_idx.cast("int").alias("src_idx"), "path", T.parse_date(F.col("date"), default_year, month_first).alias("msg_date"), T.seconds_of_day(F.col("time")).alias("seconds"), "sender", "body", "lines", F.col("msg_no").alias("seq")).where("msg_date is not null and seconds is not null")


def with_week(rows: DataFrame, date: str, first_weekday: int = 0) -> DataFrame:
    """Adds week_start and week_label."""
    return rows.withColumn("week_start", T.week_start(F.col(date), first_weekday)).withColumn("week_label", T.week_label(F.col("week_start")))


def since(rows: DataFrame, date: str, floor: str | None) -> DataFrame:
    """Static floor: rows from that day on; None keeps all."""
    return rows if floor is None else rows.where(F.col(date) >= F.to_date(F.lit(floor)))


def closed_weeks(rows: DataFrame, today: str, include_current: bool = False) -> DataFrame:
    """Weeks that ended before the week of `today`."""
    return rows if include_current else rows.where(F.col("week_start") < T.week_start(F.to_date(F.lit(today))))


def writable_weeks(weeks: DataFrame, processed: DataFrame, existing: DataFrame, generated: DataFrame, overwrite: bool = False) -> DataFrame:
    """Weeks that may be written: not processed, and not there by hand (there, but not generated) unless `overwrite`."""
    w = weeks.join(processed.select("week_label"), "week_label", "left_anti")
    by_hand = existing.select("week_label").join(generated.select("week_label"), "week_label", "left_anti")
    return w if overwrite else w.join(by_hand, "week_label", "left_anti")
