"""Messages to facts: atoms, labels, pairing, templates, and the cascade with its review side-output.

A message either resolves as a whole or is flagged; a number is never dropped silently. Null texts resolve to nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators.lexicon import classify_phrases
from tallyforge.session import cut_lineage

PAIRS = "array<struct<label:string,count:long>>"


def pair_stream(s: Column) -> Column:
    """array<struct<k, l, n>> -> pairs (label, count), two items at a time in either order; null if any pair does not hold."""
    half = F.floor(F.size(s) / 2).cast("int")
    idx = F.when(half > 0, F.sequence(F.lit(0), half - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(s, i.cast("int"))
    ok = (F.size(s) % 2 == 0) & F.forall(idx, lambda i: at(2 * i)["k"] != at(2 * i + 1)["k"])
    return F.when(ok, F.transform(idx, lambda i: F.struct(F.coalesce(at(2 * i)["l"], at(2 * i + 1)["l"]).alias("label"), F.coalesce(at(2 * i)["n"], at(2 * i + 1)["n"]).alias("count"))))


def pair_error(s: Column) -> Column:
    """What keeps a stream from pairing: two of a kind at a place, or a last item without partner; null if it pairs."""
    half = F.floor(F.size(s) / 2).cast("int")
    idx = F.when(half > 0, F.sequence(F.lit(0), half - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(s, i.cast("int"))
    bad = F.filter(idx, lambda i: at(2 * i)["k"] == at(2 * i + 1)["k"])
    return F.when(F.size(bad) > 0, F.concat(F.lit("two in a row at "), (2 * F.get(bad, F.lit(0))).cast("string"))).when(F.size(s) % 2 == 1, F.concat(F.lit("dangling item at "), (F.size(s) - 1).cast("string")))


def without_trailing_label(s: Column) -> Column:
    """Pairs of a stream whose only fault is a last label without a count; else null."""
    return F.when((F.size(s) >= 2) & (F.element_at(s, -1)["k"] == "L"), pair_stream(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))))


def carry_forward(s: Column) -> Column:
    """One label first, and only that: every number is its; else null."""
    labels = F.array_distinct(F.transform(F.filter(s, lambda x: x["k"] == "L"), lambda x: x["l"]))
    nums = F.filter(s, lambda x: x["k"] == "N")
    return F.when((F.size(labels) == 1) & (F.size(nums) > 0) & (F.get(s, F.lit(0))["k"] == "L"), F.transform(nums, lambda x: F.struct(F.get(labels, F.lit(0)).alias("label"), x["n"].alias("count"))))


def resolve(messages: DataFrame, dictionary: DataFrame, decisions: DataFrame | None = None, rules=None, year: int = 2026, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, envelope_date, text, *carry), ids unique -> (id, *carry, stream, pairs, error, dropped): pairs are null if unresolved."""
    # generators keep the optimiser from copying the atoms, the stream and the pairs into every place that reads them
    atoms = T.atoms(F.col("text"), T.year_of(F.col("envelope_date"), year))
    # read twice, for the distinct phrases and for the streams
    m = cut_lineage(messages.select("id", *carry, F.inline(F.array(F.struct(atoms.alias("_atoms"))))))
    a = m.select("id", *carry, F.posexplode_outer("_atoms").alias("pos", "a")).select("id", *carry, "pos", "a.kind", "a.value", F.col("a.text").alias("phrase"))
    labels = classify_phrases(a.where("kind = 'phrase'").select("phrase"), dictionary, decisions, rules)
    # numbers match no phrase: a key of their own, by id, keeps them from meeting in one task as nulls would
    key = F.when(F.col("kind") == "phrase", F.col("phrase")).otherwise(F.concat(F.lit("\u0000"), F.col("id").cast("string")))
    j = a.withColumn("_k", key).join(labels.withColumnRenamed("phrase", "_k"), "_k", "left")
    none = F.coalesce("labels", F.array().cast("array<string>"))
    item = F.when(F.col("kind") == "num", F.array(F.struct(F.lit("N").alias("k"), F.lit(None).cast("string").alias("l"), F.col("value").alias("n")))).otherwise(F.transform(none, lambda x: F.struct(F.lit("L").alias("k"), x.alias("l"), F.lit(None).cast("long").alias("n"))))
    g = j.groupBy("id").agg(*[F.first(c).alias(c) for c in carry], F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("items")))), lambda x: x["items"])).alias("stream"), F.collect_set(F.when((F.col("kind") == "phrase") & (F.size(none) == 0), F.col("phrase"))).alias("dropped"))
    c = F.col("stream")
    pairs = F.coalesce(pair_stream(c), without_trailing_label(c), carry_forward(c)).cast(PAIRS)
    out = g.select("*", F.inline(F.array(F.struct(pairs.alias("pairs"), pair_error(c).alias("error")))))
    return out.withColumn("error", F.when(F.col("pairs").isNull(), F.col("error")))


def with_template(messages: DataFrame, templates: DataFrame, repair_senders: list[str] | None = None, year: int = 2026) -> DataFrame:
    """Adds `_slots` (null for senders without a template) and `_numbers` of those with one: as many numbers as slots fit."""
    size = templates.groupBy(T.strip(F.col("sender")).alias("_ts")).agg(F.count("*").cast("int").alias("_slots"))
    t = F.when(T.strip(F.col("sender")).isin(repair_senders or []), T.repair_infix(F.col("text"))).otherwise(F.col("text"))
    m = messages.join(size, T.strip(F.col("sender")) == F.col("_ts"), "left").drop("_ts")
    return m.withColumn("_numbers", F.when(F.col("_slots").isNotNull(), T.numbers_in(t, T.year_of(F.col("envelope_date"), year))))


_FITS = "_slots is not null and coalesce(size(_numbers) = _slots, false)"


def slotted(fitting: DataFrame, templates: DataFrame, fixes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Messages that fit their template -> (id, *carry, seq, chant, count): the n-th number is the n-th slot's; `fixes` (sender, chant, bad, good) put known slips right."""
    n = fitting.select("id", *carry, T.strip(F.col("sender")).alias("sender"), F.posexplode("_numbers").alias("_p", "count")).withColumn("slot", F.col("_p") + 1)
    j = n.join(templates.select(T.strip(F.col("sender")).alias("sender"), "slot", "chant"), ["sender", "slot"])
    f = fixes.select(T.strip(F.col("sender")).alias("sender"), "chant", F.col("bad").alias("count"), "good")
    return j.join(f, ["sender", "chant", "count"], "left").select("id", *carry, F.col("slot").cast("int").alias("seq"), "chant", F.coalesce("good", "count").alias("count"))


def template_pairs(messages: DataFrame, templates: DataFrame, fixes: DataFrame, repair_senders: list[str] | None = None, year: int = 2026) -> DataFrame:
    """(id, sender, envelope_date, text) of senders with a template -> (id, seq, chant, count) of the messages that fit it."""
    return slotted(with_template(messages, templates, repair_senders, year).where(_FITS), templates, fixes)


def store_key(sender: Column, date: Column, text: Column, year: int = 2026) -> list[Column]:
    return [T.strip(sender).alias("_ks"), T.norm_date(date, year).alias("_kd"), T.strip(text).alias("_kt")]


def with_store(messages: DataFrame, store: DataFrame, value: str, name: str, year: int = 2026) -> DataFrame:
    """Adds `name`: the store's `value` for the same sender, date and text; null if there is none. `_in_<name>` says whether there is."""
    k = ["_ks", "_kd", "_kt"]
    s = store.select(*store_key(F.col("sender"), F.col("envelope_date"), F.col("text"), year), F.col(value).alias(name)).groupBy(*k).agg(F.min(name).alias(name)).withColumn(f"_in_{name}", F.lit(True))
    return messages.select("*", *store_key(F.col("sender"), F.col("envelope_date"), F.col("text"), year)).join(s, k, "left").drop(*k).withColumn(f"_in_{name}", F.coalesce(f"_in_{name}", F.lit(False)))


def with_stores(messages: DataFrame, duplicates: DataFrame, non_reports: DataFrame, corrections: DataFrame, year: int = 2026) -> DataFrame:
    """Adds `_dup`, `_non` and `_fix`, structs of what the stores hold for the same sender, date and text (reason; corrected text and reason), null where nothing. One join."""
    k = ["_ks", "_kd", "_kt"]
    keys = store_key(F.col("sender"), F.col("envelope_date"), F.col("text"), year)
    reason = F.coalesce("reason", F.lit(""))
    tagged = duplicates.select(*keys, F.lit("dup").alias("_s"), F.struct(reason.alias("reason"), F.lit("").alias("text")).alias("_v"))
    tagged = tagged.unionByName(non_reports.select(*keys, F.lit("non").alias("_s"), F.struct(reason.alias("reason"), F.lit("").alias("text")).alias("_v")))
    tagged = tagged.unionByName(corrections.select(*keys, F.lit("fix").alias("_s"), F.struct(reason.alias("reason"), F.coalesce("corrected_text", F.lit("")).alias("text")).alias("_v")))
    one = tagged.groupBy(*k).agg(*[F.min(F.when(F.col("_s") == s, F.col("_v"))).alias(f"_{s}") for s in ("dup", "non", "fix")])
    return messages.select("*", *keys).join(one, k, "left").drop(*k)


def live_messages(blocks: DataFrame, duplicates: DataFrame, non_reports: DataFrame, corrections: DataFrame, templates: DataFrame, repair_senders: list[str] | None = None, year: int = 2026) -> DataFrame:
    """(id, envelope_date, sender, text as corrected, date) of every block, with `_dup`, `_non`, `_fix`, `_slots` and `_numbers`; excluded ones are those with `_dup` or `_non`."""
    m = with_stores(blocks.select("id", "envelope_date", "sender", "text"), duplicates, non_reports, corrections, year)
    m = m.withColumn("text", F.when(F.col("_fix").isNotNull(), F.col("_fix.text")).otherwise(F.col("text"))).withColumn("date", T.norm_date(F.col("envelope_date"), year))
    return with_template(m, templates, repair_senders, year)


def build(
    blocks: DataFrame, dictionary: DataFrame, duplicates: DataFrame, non_reports: DataFrame, corrections: DataFrame, templates: DataFrame, fixes: DataFrame, decisions: DataFrame | None = None, rules=None, year: int = 2026,
    repair_senders: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda d: d,
) -> tuple[DataFrame, DataFrame]:
    """(facts, review). Exclusions first, then corrections, then templates, then resolution; what stays open is flagged HARD.

    `review` has a column `step`, the cascade's order within a message. `keep` is applied to the messages and to what was
    resolved, for callers that read both results and want that work done once.
    """
    m = keep(live_messages(blocks, duplicates, non_reports, corrections, templates, repair_senders, year))
    live = m.where("_dup is null and _non is null")
    note = lambda d, step, level, code, msg: d.select(F.col("id").alias("msg_id"), F.lit(step).alias("step"), F.lit(level).alias("level"), F.lit(code).alias("code"), msg.alias("message"))
    review = note(m.where("_dup is not null"), 0, "INFO", "known-duplicate", F.col("_dup.reason"))
    review = review.unionByName(note(m.where("_dup is null and _non is not null"), 1, "INFO", "non-chant", F.col("_non.reason")))
    review = review.unionByName(note(live.where("_fix is not null"), 2, "INFO", "text-correction", F.col("_fix.reason")))
    review = review.unionByName(note(live.where(f"_slots is not null and not ({_FITS})"), 3, "INFO", "template-shape", F.lit("off template")))
    tpl = slotted(live.where(_FITS), templates, fixes, ("date",))
    r = keep(resolve(live.where(f"not ({_FITS})"), dictionary, decisions, rules, year, ("date",)))
    facts = r.where("pairs is not null").select("id", "date", F.posexplode("pairs").alias("_p", "p")).select("id", "date", (F.col("_p") + 1).alias("seq"), F.col("p.label").alias("chant"), F.col("p.count").alias("count"))
    review = review.unionByName(note(r.where("pairs is null"), 4, "HARD", "unresolved", F.coalesce("error", F.lit(""))))
    return tpl.unionByName(facts).select(F.col("id").alias("msg_id"), "seq", "date", "chant", "count"), review


def reported_bag(messages: DataFrame, templates: DataFrame, fixes: DataFrame, year: int = 2026) -> DataFrame:
    """(date, value) of what live_messages report: the template's own counts where a message fits it, else every number of its text."""
    live = messages.where("_dup is null and _non is null")
    own = slotted(live.where(_FITS), templates, fixes, ("date",)).select("date", F.col("count").alias("value"))
    rest = live.where(f"not ({_FITS})").select("date", F.explode(T.numbers_in(F.col("text"), T.year_of(F.col("envelope_date"), year))).alias("value"))
    return own.unionByName(rest)


def stream_of_segments(segments: Column) -> Column:
    """Labelled segments (t, role) to a stream: labels stripped, the digits of a count read as one number."""
    kept = F.filter(segments, lambda s: s["role"].isin("chant-label", "count"))
    return F.transform(kept, lambda s: F.struct(F.when(s["role"] == "count", "N").otherwise("L").alias("k"), F.when(s["role"] != "count", T.strip(s["t"])).alias("l"), F.when(s["role"] == "count", F.regexp_replace(s["t"], r"\P{Nd}+", "").try_cast("long")).alias("n")))


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
