"""Command line: python -m tallyforge.cli COMMAND ... Exit codes: 0, 1 for a failed gate or an open item, 2 for usage."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import lexicon, messages, quality, report, resolve
from tallyforge.functions.text import simplify
from tallyforge.session import cut_lineage, local_session
from tallyforge.sources import readers, writers


def ingest(spark: SparkSession, a) -> int:
    """Pastes into one log: greatest multiplicity, cut copies dropped, ordered by time."""
    paths = readers.inbox(a.inbox, a.files)
    sources = ([a.chatlog] if os.path.exists(a.chatlog) else []) + paths
    if not sources:
        print("no files to ingest")
        return 0
    lines = readers.with_source(readers.read_lines(spark, sources), sources)
    idx = lines.select("path", "src_idx").distinct()
    sessions = messages.sessionize(lines).join(idx, "path")
    dated = cut_lineage(messages.dated(sessions, F.col("src_idx"), a.year))
    log = cut_lineage(messages.merge_log(dated))
    came = {r.src_idx: r.n for r in dated.groupBy("src_idx").agg(F.count("*").alias("n")).collect()}
    preamble = {r.src_idx: r.n for r in messages.preamble(lines).groupBy("src_idx").agg(F.count("*").alias("n")).collect()}
    old = came.get(0, 0) if os.path.exists(a.chatlog) else 0
    for i, p in enumerate(sources):
        print(f"{p}: {came.get(i, 0)} messages, {preamble.get(i, 0)} lines before the first")
    span = log.agg(F.count("*").alias("n"), F.min("msg_date").alias("first"), F.max("msg_date").alias("last")).first()
    print(f"{span.n - old} new, {sum(came.values()) - span.n} copies left out, {span.n} in all" + (f", {span.first} to {span.last}" if span.n else ""))
    if not a.dry_run and span.n:
        writers.write_log(log, a.chatlog)
        writers.consume([p for p in paths if p not in (a.files or [])], a.keep)
    return 0


def split_weeks(spark: SparkSession, a) -> int:
    """The log by week; closed weeks only, hand-made and processed ones left alone; 1 if there is nothing in range."""
    state = readers.read_state(a.state)
    m = messages.dated(messages.sessionize(readers.read_lines(spark, a.source)), F.lit(0), a.year, a.month_first)
    floor = a.since or state["since"]
    every = cut_lineage(messages.with_week(m, "msg_date", a.week_start))
    w = messages.since(every, "msg_date", floor)
    table = lambda names: spark.createDataFrame([(n,) for n in names], "week_label string")
    listing = lambda d: [n for n in os.listdir(d) if n.endswith(".txt")] if os.path.isdir(d) else []
    count = {r.week_label: (r.week_start, r.n) for r in w.groupBy("week_label", "week_start").agg(F.count("*").alias("n")).collect()}
    if not count:
        print("no messages in range")
        return 1
    closed = messages.closed_weeks(w, a.today or date.today().isoformat(), a.include_current).select("week_label", "week_start").distinct()
    open_ = set(count) - {r.week_label for r in closed.collect()}
    done, there = listing(os.path.join(a.out, "processed")), listing(a.out)
    names = [r.week_label for r in messages.writable_weeks(closed, table(done), table(there), table(state["generated"]), a.overwrite).orderBy("week_start").collect()]
    for n in sorted(count, key=lambda n: count[n][0]):
        why = "write" if n in names else "in progress" if n in open_ else "already processed" if n in done else "made by hand, kept"
        print(f"{n}: {count[n][1]} messages, {why}")
    if not a.dry_run:
        writers.write_week_files(w.where(F.col("week_label").isin(names)), a.out)
        writers.write_state({"since": floor, "generated": sorted({*state["generated"], *names})}, a.state)
    left = every.count() - sum(n for _, n in count.values())
    print(f"{len(names)} weeks {'to write' if a.dry_run else 'written'}, {len(count) - len(names)} skipped, {left} messages before the floor")
    return 0


def split_blocks(spark: SparkSession, a) -> int:
    """Lines to message blocks, notices taken out."""
    m = messages.sessionize(readers.read_lines(spark, a.source), unglue=False, notices_close=True)
    writers.write_jsonl(messages.as_blocks(m), a.out)
    return 0


class Config:
    """What the folder of settings holds: dictionary, rules, decisions, stores, templates and their fixes; each may be missing."""

    def __init__(self, spark: SparkSession, folder: str):
        p = lambda n: os.path.join(folder, n)
        self.dictionary = lexicon.read_dictionary(spark, p("mappings.json"))
        self.rules = lexicon.read_rules(spark, p("rules.json"))
        self.decisions = lexicon.read_decisions(spark, p("decisions.json"))
        self.duplicates, self.non_reports = (readers.read_store(spark, p(n)) for n in ("known_duplicates.json", "non_chant_messages.json"))
        self.corrections = readers.read_store(spark, p("text_corrections.json"), readers.CORRECTIONS)
        self.templates = readers.read_store(spark, p("templates.json"), "sender string, slot int, chant string")
        self.fixes = readers.read_store(spark, p("template_fixes.json"), "sender string, chant string, bad long, good long")
        self.repair = [r.sender for r in readers.read_store(spark, p("repair_senders.json"), "sender string").collect()]

    def live(self, blocks: DataFrame) -> DataFrame:
        return resolve.live_messages(blocks, self.duplicates, self.non_reports, self.corrections, self.templates, self.repair)


def build_extracted(spark: SparkSession, a) -> int:
    """Blocks to facts and, if asked for, a review; 1 if anything stays open."""
    c = Config(spark, a.config)
    facts, review = resolve.build(readers.read_jsonl(spark, a.blocks), c.dictionary, c.duplicates, c.non_reports, c.corrections, c.templates, c.fixes, c.decisions, c.rules, repair_senders=c.repair, keep=cut_lineage)
    writers.write_json_array(facts.select("date", "chant", "count", "msg_id", "seq"), a.extracted, ["msg_id", "seq"])
    if a.review:
        writers.write_review(review, a.review)
    n = {r.level: r.n for r in review.groupBy("level").agg(F.count("*").alias("n")).collect()}
    print(f"{n.get('INFO', 0)} notes, {n.get('HARD', 0)} open")
    return int(quality.has_hard(review))


def _diff(spark: SparkSession, a) -> DataFrame:
    c = Config(spark, a.config)
    source = resolve.reported_bag(c.live(readers.read_jsonl(spark, a.blocks)), c.templates, c.fixes)
    return cut_lineage(quality.bag_difference(source, quality.fact_bag(readers.read_json_array(spark, a.extracted)), ["date", "value"]))


def _report(d: DataFrame, t: int) -> tuple[DataFrame, str]:
    """(n, line) of what differs by date, in order, and the verdict that closes it."""
    lines = quality.render_bags(d, "missed", t).join(quality.render_bags(d, "extra", t), "date", "full")
    lines = lines.select(F.struct(F.lit(0).alias("end"), "date").alias("n"), F.concat_ws(" ", F.col("date"), F.concat(F.lit("MISSED "), "missed"), F.concat(F.lit("EXTRA "), "extra")).alias("line"))
    verdict = quality.gate(d, t)
    total = d.agg(F.coalesce(F.sum("missed"), F.lit(0)).alias("m"), F.coalesce(F.sum("extra"), F.lit(0)).alias("e"), F.countDistinct("date").alias("d")).first()
    said = {"CLEAN": "every number of the source is in the facts and the other way round", "PASS": f"only values under {t} differ", "FAIL": f"values from {t} on, marked *, differ"}[verdict]
    end = d.sparkSession.createDataFrame([((1, ""), f"{verdict}: {said}; {total.m} missed, {total.e} extra, on {total.d} dates")], "n struct<end:int,date:string>, line string")
    return lines.unionByName(end), verdict


def reconcile(spark: SparkSession, a) -> int:
    """Source against facts, both ways; 1 if the gate fails."""
    lines, verdict = _report(_diff(spark, a), readers.threshold())
    if a.report:
        writers.write_text(lines, a.report, ["n"])
    else:
        for r in lines.orderBy("n").toLocalIterator():
            print(r.line)
    print(verdict)
    return int(verdict == "FAIL")


def aggregate(spark: SparkSession, a) -> int:
    """Summaries; with blocks behind the gate, and with its report and inputs archived beside them."""
    facts = readers.read_json_array(spark, a.extracted, "date string, chant string, count long, msg_id long, seq int")
    order = spark.createDataFrame([(c, i) for i, c in enumerate(a.order.split("|"))] if a.order else [], "chant string, ord int")
    if not a.blocks:
        print("no blocks given: gate skipped, inputs not archived", file=sys.stderr)
    else:
        lines, verdict = _report(_diff(spark, a), readers.threshold())
        if verdict == "FAIL":
            for r in lines.orderBy("n").toLocalIterator():
                print(r.line)
            print("gate failed, nothing written", file=sys.stderr)
            return 1
        writers.write_text(lines, os.path.join(a.out, "reconcile_report.txt"), ["n"])
        shutil.copy2(a.blocks, os.path.join(a.out, "blocks.jsonl")) if os.path.isfile(a.blocks) else shutil.copytree(a.blocks, os.path.join(a.out, "blocks.jsonl"), dirs_exist_ok=True)
        shutil.copy2(a.extracted, os.path.join(a.out, "extracted.json"))
    writers.write_report(facts, order, a.out)
    return 0


def resolve_blocks(spark: SparkSession, a) -> int:
    """Resolves blocks alone, without stores or templates, and prints what stays open."""
    c = Config(spark, a.config)
    r = cut_lineage(resolve.resolve(readers.read_jsonl(spark, a.blocks), c.dictionary, c.decisions, c.rules))
    n = r.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0)).alias("pairs"), F.count_if(F.col("pairs").isNull()).alias("open")).first()
    print(f"{n.pairs} facts, {n.open} open messages")
    _print(r.where("pairs is null").select("id", F.coalesce("error", F.lit("")).alias("error")), "id")
    return 0


def pair(spark: SparkSession, a) -> int:
    """Pairs of labelled records, or what keeps them from pairing."""
    r = readers.read_jsonl(spark, a.records, readers.RECORDS).select("id", F.inline(F.array(F.struct(resolve.stream_of_segments(F.col("segments")).alias("s")))))
    p = r.select("id", resolve.pair_stream(F.col("s")).alias("p"), resolve.pair_error(F.col("s")).alias("error"))
    good = p.where("p is not null").select("id", F.posexplode("p").alias("pos", "x")).select("id", "pos", F.col("x.label").alias("label"), F.col("x.count").alias("count"), F.lit(None).cast("string").alias("error"))
    _print(good.unionByName(p.where("p is null").select("id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("count"), "error")), "id", "pos")
    return 0


def _looked_up(spark: SparkSession, phrases: list[str], look) -> int:
    d = spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "n int, phrase string").withColumn("key", simplify(F.col("phrase")))
    _print(d.join(look(d.select("key").distinct()), "key", "left").select("n", "phrase", "canonical"), "n")
    return 0


def normalize(spark: SparkSession, a) -> int:
    """What the dictionary knows phrases as."""
    c = Config(spark, a.config)
    return _looked_up(spark, a.phrases, lambda keys: lexicon.lookup(keys, c.dictionary))


def compose(spark: SparkSession, a) -> int:
    """What the compositional rules make of phrases."""
    rules = Config(spark, a.config).rules
    return _looked_up(spark, a.phrases, lambda keys: lexicon.compose(keys, *rules) if rules else keys.withColumn("canonical", F.lit(None).cast("string")))


def _print(d: DataFrame, *order: str) -> None:
    """Every row on standard output, in order, fields between tabs; rows stream through the driver."""
    flat = lambda x: "" if x is None else str(x).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    print("\t".join(d.columns))
    for r in d.orderBy(*order).toLocalIterator():
        print("\t".join(map(flat, r)))


def count_profile(spark: SparkSession, a) -> int:
    """Profile of a sender's counts, every distinct count included."""
    facts = readers.read_json_array(spark, a.extracted, "date string, chant string, count long, msg_id long, seq int")
    f = report.filtered(facts, readers.read_jsonl(spark, a.blocks), a.sender, a.contains, a.chant)
    for d, by in ((report.profile(f, ["chant"]), []), (report.digit_lengths(f, ["chant"]), ["digits"]), (report.most_common(f, ["chant"]), ["rank"]), (report.usable(f).select("chant", "count").distinct(), ["count"])):
        _print(d, "chant", *by)
    return 0


def classify_verify(spark: SparkSession, a) -> int:
    """Checks of labelled records; 1 if one is hard."""
    flags = quality.record_flags(readers.read_jsonl(spark, a.records, readers.RECORDS))
    _print(flags, "id", "code", "level", "message")
    return int(quality.has_hard(flags))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyforge")
    s = p.add_subparsers(dest="command", required=True)

    def add(f, *args, **options):
        q = s.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        q.set_defaults(run=f)
        for x in args:
            q.add_argument(x, nargs="?" if x in ("report", "review") else "*" if x == "phrases" else None)
        for k, v in options.items():
            q.add_argument("--" + k.replace("_", "-"), **({"action": "store_true"} if v is False else {"default": v, "type": type(v) if v is not None else str}))
        return q

    add(ingest, inbox="raw/inbox", chatlog="raw/chatlog.txt", year=2026, dry_run=False, keep=False).add_argument("files", nargs="*")
    add(split_weeks, "source", out="inputs", year=2026, since=None, week_start=0, month_first=False, include_current=False, today=None, dry_run=False, overwrite=False, state="state.json")
    add(split_blocks, "source", "out")
    add(build_extracted, "blocks", "extracted", "review", config="config")
    add(reconcile, "blocks", "extracted", "report", config="config")
    add(aggregate, "extracted", "out", config="config", order=None).add_argument("blocks", nargs="?")
    add(resolve_blocks, "blocks", config="config")
    add(pair, "records")
    add(normalize, "phrases", config="config")
    add(compose, "phrases", config="config")
    add(count_profile, "extracted", "blocks", sender=None, contains=None, chant=None)
    add(classify_verify, "records")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    return a.run(SparkSession.getActiveSession() or local_session(), a)


if __name__ == "__main__":
    sys.exit(main())
