"""Dictionary and compositional rules as tables, and the resolution of phrases against them.

The compositional rules are compiled away: every optional slot is expanded, so that a sequence of word classes is looked up
rather than matched. Phrases repeat heavily; each distinct one is resolved once. Lookups are joins that the planner may
broadcast when the lexicon is small. Null and blank phrases resolve to nothing.
"""

from __future__ import annotations

import itertools
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import nfc, simplify

#: The most optional slots of a pattern: each doubles the sequences that it is expanded to.
MAX_OPTIONAL = 12


def dictionary(spellings: DataFrame) -> DataFrame:
    """(spelling, canonical[, ord]) -> (key, canonical): keyed by simplified form; the last one wins a clash."""
    d = spellings.where("spelling is not null and canonical is not null")
    o = F.col("ord") if "ord" in d.columns else F.lit(0)
    return d.withColumn("_o", o).withColumn("key", simplify(F.col("spelling"))).where("key <> ''").groupBy("key").agg(F.max_by("canonical", F.struct("_o", "canonical")).alias("canonical"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of canonical -> list of spellings."""
    with open(path, encoding="utf-8") as f:
        rows = [(s, c, i) for i, (c, s) in enumerate((c, s) for c, v in json.load(f).items() if not c.startswith("_") for s in [c, *v])]
    return dictionary(spark.createDataFrame(rows, "spelling string, canonical string, ord int"))


def parse_pattern(pattern: str) -> list[tuple[str, bool]]:
    """Classes of a pattern and whether each is optional."""
    return [(t.rstrip("?"), t.endswith("?")) for t in pattern.split()]


def sequences(pattern: str) -> set[str]:
    """Every class sequence that a pattern takes."""
    slots = parse_pattern(pattern)
    if sum(o for _, o in slots) > MAX_OPTIONAL:
        raise ValueError(f"{pattern!r} has more than {MAX_OPTIONAL} optional slots")
    picks = itertools.product(*[((c,), ()) if o else ((c,),) for c, o in slots])
    return {" ".join(x for p in pick for x in p) for pick in picks} - {""}


def compile_rules(spark: SparkSession, tokens: dict[str, list[str]], patterns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(word, class) and (sequence, canonical); a word of two classes is an error, a sequence of two canonicals resolves to nothing."""
    words = spark.createDataFrame([(w, c) for c, v in tokens.items() for w in v], "spelling string, class string").withColumn("word", simplify(F.col("spelling"))).where("word <> '' and not contains(word, ' ')").select("word", "class").distinct()
    clash = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"the word {clash[0].word!r} has two classes")
    seqs: dict[str, set[str]] = {}
    for canonical, p in patterns.items():
        for s in sequences(p):
            seqs.setdefault(s, set()).add(canonical)
    return words, spark.createDataFrame([(s, next(iter(c))) for s, c in seqs.items() if len(c) == 1], "sequence string, canonical string")


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]] | None:
    """Compositional rules of a JSON file (tokens, chants, drop): words, sequences and connectives; None if the file is missing."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    drop = spark.createDataFrame([(w,) for w in d.get("drop", [])], "w string").select(simplify(F.col("w")).alias("w")).collect()
    return *compile_rules(spark, d["tokens"], d["chants"]), [r.w for r in drop]


def read_decisions(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, canonical) of the decisions with role chant in a JSON file, by key as filed; None if the file is missing."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return spark.createDataFrame([(k, v["canonical"]) for k, v in d.items() if isinstance(v, dict) and v.get("role") == "chant" and v.get("canonical")], "key string, canonical string")


def compose(phrases: DataFrame, words: DataFrame, seqs: DataFrame, drop: list[str], key: str = "key") -> DataFrame:
    """distinct (key) -> (key, canonical) by class sequence: every word must have a class, connectives left out."""
    w = phrases.select(key).distinct().select(key, F.posexplode(F.filter(F.split(key, " "), lambda x: ~x.isin(drop) & (x != ""))).alias("pos", "word"))
    c = w.join(words, "word", "left").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "class"))), lambda x: x["class"]), " ").alias("sequence"), F.count_if(F.col("class").isNull()).alias("unknown"))
    return c.where("unknown = 0").join(seqs, "sequence").select(key, "canonical")


def lookup(keys: DataFrame, dictionary: DataFrame, decisions: DataFrame | None = None, composed: DataFrame | None = None) -> DataFrame:
    """(key) ⟕ three levels: dictionary, then decisions, then composed; the first that knows the key gives its canonical. One join, whatever the levels."""
    levels = [x.select("key", F.struct(F.lit(i).alias("level"), F.col("canonical").alias("c")).alias("_b")) for i, x in enumerate((dictionary, decisions, composed)) if x is not None]
    known = levels[0]
    for x in levels[1:]:
        known = known.unionByName(x)
    if len(levels) > 1:
        known = known.groupBy("key").agg(F.min("_b").alias("_b"))
    return keys.join(known, "key", "left").withColumn("canonical", F.col("_b.c")).drop("_b")


def longest_key(dictionary: DataFrame, decisions: DataFrame | None = None, rules: tuple[DataFrame, DataFrame, list[str]] | None = None) -> int:
    """Words of the longest key or class sequence that anything could be found under. One small action."""
    keys = [x.select("key") for x in (dictionary, decisions) if x is not None] + ([rules[1].select(F.col("sequence").alias("key"))] if rules else [])
    every = keys[0]
    for x in keys[1:]:
        every = every.unionByName(x)
    return every.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 0


def classify_phrases(phrases: DataFrame, dictionary: DataFrame, decisions: DataFrame | None = None, rules: tuple[DataFrame, DataFrame, list[str]] | None = None) -> DataFrame:
    """distinct (phrase) -> (phrase, labels): a greedy longest-first cover of the whole phrase, else its leftmost longest span, else none.

    Spans are looked up as long as any entry is, connectives and words that leave nothing in a key not counted.
    """
    longest = longest_key(dictionary, decisions, rules)
    d = phrases.where("phrase is not null").distinct().withColumn("words", F.split(nfc(F.col("phrase")), " "))
    # each word's part of a key is worked out once; a span's key is its words' parts together
    parts = F.transform("words", lambda w: simplify(w, compose=False))
    weight = lambda p: F.size(F.filter(F.split(p, " "), lambda w: (w != "") & ~w.isin(rules[2] if rules else [])))
    d = d.select("phrase", F.inline(F.array(F.struct(parts.alias("parts")))))
    sums = F.aggregate("parts", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + weight(p))))
    d = d.select("phrase", F.size("parts").alias("n"), "parts", F.inline(F.array(F.struct(sums.alias("sums")))))
    reach = F.size(F.filter("sums", lambda x: x <= F.get("sums", F.col("start") - 1) + longest)) - F.col("start")
    spans = d.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("start")).select("phrase", "n", "parts", "start", F.explode(F.when(reach > 0, F.sequence(F.lit(1), reach))).alias("len"))
    key = F.array_join(F.filter(F.slice("parts", F.col("start"), F.col("len")), lambda w: w != ""), " ")
    # the generator keeps the key from being computed anew in each filter
    spans = spans.select("phrase", "n", "start", "len", F.inline(F.array(F.struct(key.alias("key"))))).where("key <> ''")
    composed = compose(spans, *rules) if rules else None
    hits = lookup(spans, dictionary, decisions, composed).where("canonical is not null")
    per_start = hits.groupBy("phrase", "n", "start").agg(F.max(F.struct("len", "canonical")).alias("h"))
    g = per_start.groupBy("phrase", "n").agg(F.map_from_entries(F.collect_list(F.struct("start", "h"))).alias("m"), F.max_by(F.col("h.canonical"), F.struct(F.col("h.len"), -F.col("start"))).alias("longest"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.col("n")),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, i: F.when((s.at == i) & F.col("m")[i].isNotNull(), F.struct((i + F.col("m")[i]["len"]).cast("int").alias("at"), F.concat(s.out, F.array(F.col("m")[i]["canonical"])).alias("out"))).otherwise(s),
    )
    t = g.withColumn("w", walk)
    return d.select("phrase").join(t.select("phrase", F.when(F.col("w.at") == F.col("n") + 1, F.col("w.out")).otherwise(F.array("longest")).alias("labels")), "phrase", "left").select("phrase", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def classes_of(word: Column, table: dict[str, str]) -> Column:
    """Class of a word from a small fixed table, as an expression."""
    return F.coalesce(*[F.when(word == w, F.lit(c)) for w, c in table.items()]) if table else F.lit(None).cast("string")
