"""Sinks: logs, weekly files, JSON, summaries. Outputs appear whole or not at all; order is explicit."""

from __future__ import annotations

import json
import os
import shutil
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import report
from tallyforge.operators.quality import gate


def write_text(lines: DataFrame, path: str, order: list[str]) -> None:
    """One text file in order, by way of a rename. `lines` has a column line; rows stream to the driver's disk, not its memory."""
    tmp = path + ".tmp"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(tmp, "w", encoding="utf-8", newline="\n") as f:
        for r in lines.orderBy(*order).select("line").toLocalIterator():
            f.write(r.line + "\n")
    os.replace(tmp, path)


def write_log(messages: DataFrame, path: str) -> None:
    """The merged log's original lines."""
    rows = messages.select("msg_date", "seconds", "src_idx", "seq", "occ", F.posexplode("lines").alias("k", "line"))
    write_text(rows, path, ["msg_date", "seconds", "src_idx", "seq", "occ", "k"])


def consume(paths: list[str], keep: bool = False, archive: str | None = None) -> None:
    """Read files out of the inbox: moved to the archive, with a time stamp on a clash."""
    for p in [] if keep else paths:
        to = archive or os.path.join(os.path.dirname(p), "processed")
        os.makedirs(to, exist_ok=True)
        name = os.path.basename(p)
        if os.path.exists(os.path.join(to, name)):
            stem, ext = os.path.splitext(name)
            name = f"{stem}-{int(time.time())}{ext}"
        shutil.move(p, os.path.join(to, name))


def write_weeks(messages: DataFrame, path: str) -> None:
    """A partition for each week; only the partitions in the data are replaced."""
    messages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_label").parquet(path)


def write_week_files(messages: DataFrame, folder: str) -> None:
    """A text file for each week, in one pass over the messages in order; each appears whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    rows = messages.select("week_start", "week_label", "msg_date", "seconds", "seq", F.posexplode("lines").alias("k", "line"))
    f, name = None, None

    def close() -> None:
        if f:
            f.close()
            os.replace(os.path.join(folder, name + ".tmp"), os.path.join(folder, name))

    for r in rows.orderBy("week_start", "msg_date", "seconds", "seq", "k").select("week_label", "line").toLocalIterator():
        if r.week_label != name:
            close()
            name = r.week_label
            f = open(os.path.join(folder, name + ".tmp"), "w", encoding="utf-8", newline="\n")
        f.write(r.line + "\n")
    close()


def write_jsonl(rows: DataFrame, path: str, order: str = "id") -> None:
    rows.orderBy(order).write.mode("overwrite").json(path)


def write_json_array(rows: DataFrame, path: str, order: list[str]) -> None:
    """A JSON array, streamed row by row."""
    tmp = path + ".tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(rows.orderBy(*order).toLocalIterator()):
            f.write((",\n  " if i else "\n  ") + json.dumps(r.asDict(), ensure_ascii=False))
        f.write("\n]\n")
    os.replace(tmp, path)


def write_review(review: DataFrame, path: str) -> None:
    """Lines by message, in the order of the cascade's steps."""
    write_text(review.select("msg_id", "step", F.concat(F.lit("["), "level", F.lit("] #"), F.col("msg_id").cast("string"), F.lit(" "), "code", F.lit(": "), F.coalesce("message", F.lit(""))).alias("line")), path, ["msg_id", "step"])


def write_state(state: dict, path: str) -> None:
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(state | {"generated": sorted(state.get("generated", []))}, f, indent=2, sort_keys=True)
    os.replace(path + ".tmp", path)


class GateError(RuntimeError):
    """The reconciliation gate failed; nothing was written."""


def write_report(facts: DataFrame, order: DataFrame, out: str, diff: DataFrame | None = None, threshold: int = 100, all_labels: bool = False) -> None:
    """summary.txt, summary.csv and daily_breakdown.csv, unless the gate fails. all_labels: also those without a fact."""
    if diff is not None and gate(diff, threshold) == "FAIL":
        raise GateError("source and facts differ by significant values")
    os.makedirs(out, exist_ok=True)
    labels = [r.chant for r in order.orderBy("ord").select("chant").collect()] if all_labels else report.ordered_labels(facts, order)
    place = {x: i for i, x in enumerate(labels)}
    parts = report.summary_expressions(facts)
    rank = facts.sparkSession.createDataFrame(list(place.items()) or [("", 0)], "chant string, ord int")
    with open(os.path.join(out, "summary.txt.tmp"), "w", encoding="utf-8") as f:
        last = None
        for r in parts.join(rank, "chant").orderBy("ord", "part").select("chant", "expr").toLocalIterator():
            f.write(("" if last is None else "\n") + f"{r.chant} ={r.expr}" if r.chant != last else f"+{r.expr}")
            last = r.chant
        f.write("\n")
    os.replace(os.path.join(out, "summary.txt.tmp"), os.path.join(out, "summary.txt"))
    report.wide_totals(facts, labels).coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(out, "summary.csv"))
    report.daily_pivot(facts, labels).orderBy("date").coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(out, "daily_breakdown.csv"))
