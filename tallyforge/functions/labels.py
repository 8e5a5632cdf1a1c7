"""Label keys: free spellings of a report label reduced to a key, and to the nearest entry of a bounded list.

Native expressions only. A null label gives a null key; a blank one gives ''.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.chars import fold_col, py_key

# Courtesy words that may stand before or after a label and carry no meaning.
HONORIFICS = ["ji", "pak", "mubarak", "shareef", "sharif", "shri", "e", "ye", "जी", "पाक", "शरीफ", "मुबारक", "श्री", "جی", "پاک", "شریف", "مبارک", "شری"]
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
#: Entries of a reference list that one expression compares.
SHARD = 1_000


def label_key(col: Column) -> Column:
    """Folded, lower case, letters only, without courtesy words, words in alphabetical order, joined without spaces."""
    words = F.split(F.trim(F.regexp_replace(F.lower(fold_col(col)), r"[^\p{L}\p{M}]+", " ")), " ")
    return F.array_join(F.array_sort(F.filter(words, lambda w: ~w.isin(HONORIFICS))), "")


def plain_key(col: Column) -> Column:
    """As `label_key`, words in their own order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(fold_col(col)), r"[^\p{L}\p{M}]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(HONORIFICS)), "")


def reversed_key(col: Column) -> Column:
    """As `plain_key`, words from last to first."""
    words = F.split(F.trim(F.regexp_replace(F.lower(fold_col(col)), r"[^\p{L}\p{M}]+", " ")), " ")
    return F.array_join(F.reverse(F.filter(words, lambda w: ~w.isin(HONORIFICS))), "")


def _keys(label: str) -> tuple[str, str]:
    """Python twins of `label_key` and `plain_key`, for the entries of a list."""
    words = [w for w in _NO_LETTER.sub(" ", py_key(label)).split() if w not in HONORIFICS]
    return "".join(sorted(words)), "".join(words)


def nearest_labels(labels: DataFrame, entries: list[tuple[str, str]], most: float = 0.34) -> DataFrame:
    """distinct (label) -> (label, canonical): the entry at least edit distance, if within `most` of the key's length, else the key itself.

    `entries` are (spelling, canonical) of a reference list; they are compared inside expressions, SHARD at a time.
    """
    k, p, q = F.col("_k"), F.col("_p"), F.col("_q")
    if not entries:
        return labels.select("label", label_key(F.col("label")).alias("canonical"))
    refs = [F.struct(F.lit(c).alias("c"), F.lit(k).alias("k"), F.lit(p).alias("p")) for c, k, p in sorted({(c, *_keys(x)) for x, c in entries})]
    best = lambda some: F.array_min(F.transform(F.array(*some), lambda r: F.struct(F.least(F.levenshtein(k, r.k), F.levenshtein(p, r.p), F.levenshtein(q, r.p)).alias("d"), r.c.alias("c"))))
    # the generator keeps the optimiser from copying the key expressions into the comparison with every entry
    d = labels.select("label", F.inline(F.array(F.struct(label_key(F.col("label")).alias("_k"), plain_key(F.col("label")).alias("_p"), reversed_key(F.col("label")).alias("_q")))))
    bests = F.array(*[best(refs[i : i + SHARD]) for i in range(0, len(refs), SHARD)])
    d = d.select("label", "_k", F.array_min(bests).alias("_b"))
    return d.select("label", F.when(F.col("_b.d") <= F.length("_k") * most, F.col("_b.c")).otherwise(k).alias("canonical"))
