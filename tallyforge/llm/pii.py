"""Personal information in free text, found by a character-level BiLSTM-CRF and replaced by typed placeholders.

The tagger (tagger.py) is trained in numpy from labelled spans (pii_train.py); its weights are kept beside this
module. Texts are read in plain form (look-alikes, widths and accents folded, invisible characters left out), with a way
back to the places in the text. Longer texts are read in overlapping windows, whose emissions are blended by their
distance from the window's edge and decoded together, so that a span is found once wherever windows meet.
An exact check follows: spans are cut to whole words and must have the shape of their kind.

Defined results: null, empty and blank fields have no spans; a piece that stands in a field twice gives one row; the
text around the placeholders is unchanged; repeated rows come out once.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.chars import ACCENTS, DIGITS, INVISIBLE, LOOKALIKES, MARKS, SPACES, URDU, WIDE
from tallyforge.llm.tagger import Tagger, pad
from tallyforge.session import spread

KINDS = ["phone", "email", "id_number", "address", "name"]
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")
WINDOW, OVERLAP, BATCH = 192, 64, 256
FIELD = {"text": "\x01", "sender": "\x02"}

_PLAIN = {**WIDE, **DIGITS, **LOOKALIKES, **URDU, **ACCENTS, **{c: " " for c in SPACES}, **{c: "" for c in INVISIBLE + MARKS}}


def plain(text: str) -> tuple[str, list[int]]:
    """Lower-case plain form and, for each of its characters, the place in the text."""
    if text.isascii():
        return text.lower(), list(range(len(text)))
    out, at = [], []
    for i, c in enumerate(text):
        c = _PLAIN.get(c, c)
        c = ACCENTS.get(c, c).lower()
        if c:
            out.append(c[0])
            at.append(i)
    return "".join(out), at


_DIGIT = regex.compile(r"[0-9]")


def shaped(s: str) -> str:
    """All digits look alike to the tagger."""
    return _DIGIT.sub("0", s)


# what a piece of each kind must look like, on plain text; of the matches near a span, the one that overlaps it most is the piece
_CHECK = {
    "phone": regex.compile(r"(?<![\w.])(?:\+?[0-9]{1,4}[ .-]?)?(?:\([0-9]{2,5}\)[ .-]?)?[0-9][0-9 .-]{5,13}[0-9](?![\w])"),
    "email": regex.compile(r"(?<![\w.+-])[\w.+-]+ ?(?:@|\[at\]|\(at\)) ?[\w-]+(?:(?: ?\[dot\] ?|\(dot\)|\.)[\w-]+)+"),
    "id_number": regex.compile(r"(?<![\w])(?:[a-z]{2,6}[0-9]{3,9}[a-z]?|[a-z][0-9]{6,9}|[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w])"),
    "address": regex.compile(r"(?<![\w/])(?:\p{L}[\p{L}\p{M}.]* (?:[\p{L}\p{M}.]+ )?)?[0-9][^\n;|]*[\p{L}\p{M}]"),
    "name": regex.compile(r"(?<![\p{L}\p{M}])[\p{L}\p{M}]{2,}(?:['’-][\p{L}\p{M}]+)? +[\p{L}\p{M}]{2,}(?:['’-][\p{L}\p{M}]+)?(?![\p{L}\p{M}])"),
}
_NEAR = 16
_LEAST_DIGITS = {"phone": 8}


def checked(kind: str, s: str, begin: int, end: int) -> tuple[int, int] | None:
    """The piece of its kind's shape that a span overlaps, or None; names and addresses may only be cut to whole words."""
    word = lambda c: c.isalnum() or unicodedata.category(c)[0] == "M"
    while begin > 0 and word(s[begin - 1]) and word(s[begin]):
        begin -= 1
    while end < len(s) and word(s[end - 1]) and word(s[end]):
        end += 1
    lo, hi = (begin, end) if kind in ("name", "address") else (max(0, begin - _NEAR), min(len(s), end + _NEAR))
    best, most = None, 0
    for m in _CHECK[kind].finditer(s, lo, hi, overlapped=kind == "name"):
        shared = min(end, m.end()) - max(begin, m.start())
        if shared > most and len(_DIGIT.findall(m[0])) >= _LEAST_DIGITS.get(kind, 0):
            best, most = m.span(), shared
    if best is None or kind == "name" and best[1] - best[0] < 0.6 * (end - begin):
        return None
    return best


@lru_cache(maxsize=1)
def load(path: str = MODEL) -> Tagger:
    z = np.load(path, allow_pickle=False)
    return Tagger(str(z["chars"]), TAGS, int(z["dim"]), int(z["hidden"]), params={k: z[k] for k in z.files if k not in ("chars", "dim", "hidden")})


def save(tagger: Tagger, path: str = MODEL) -> None:
    np.savez_compressed(path, chars=np.array(tagger.chars), dim=tagger.dim, hidden=tagger.hidden, **{k: v.astype(np.float16) for k, v in tagger.p.items()})


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n characters."""
    if n <= WINDOW:
        return [(0, n)]
    step = WINDOW - OVERLAP
    return [(b, min(n, b + WINDOW)) for b in range(0, n - OVERLAP, step)]


def tag(tagger: Tagger, texts: list[str]) -> list[np.ndarray]:
    """Tags of every character of shaped texts (with their field mark first)."""
    parts = [(i, b, e) for i, t in enumerate(texts) for b, e in windows(len(t))]
    parts.sort(key=lambda x: x[2] - x[1])
    whole: dict[int, np.ndarray] = {}
    weight: dict[int, np.ndarray] = {}
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
    for k in range(0, len(parts), BATCH):
        own = parts[k : k + BATCH]
        x, mask = pad([tagger.codes(texts[i][b:e]) for i, b, e in own])
        em = tagger.emissions(x, mask)
        single = [j for j, (i, b, e) in enumerate(own) if len(texts[i]) <= WINDOW]
        if single:
            for j, tags in zip(single, tagger.decode(em[:, single], np.array([own[j][2] - own[j][1] for j in single]))):
                out[own[j][0]] = tags
        for j in sorted(set(range(len(own))) - set(single)):
            i, b, e = own[j]
            n = len(texts[i])
            if i not in whole:
                whole[i], weight[i] = np.zeros((n, len(TAGS)), np.float32), np.zeros(n, np.float32)
            edge = np.minimum(np.arange(e - b) + 1 if b else np.full(e - b, WINDOW), (np.arange(e - b)[::-1] + 1) if e < n else np.full(e - b, WINDOW)).astype(np.float32)
            whole[i][b:e] += em[: e - b, j] * edge[:, None]
            weight[i][b:e] += edge
    for i, w in whole.items():
        out[i] = tagger.decode((w / weight[i][:, None])[:, None, :], np.array([len(w)]))[0]
    return out


def spans(tagger: Tagger, values: list[str], fields: list[str]) -> list[list[tuple[str, int, int]]]:
    """(kind, begin, end) of every piece of personal information, in order, not overlapping."""
    plains = [plain(v) for v in values]
    tags = tag(tagger, [FIELD.get(f, "\x01") + shaped(p) for (p, _), f in zip(plains, fields)])
    out = []
    for v, (p, at), t in zip(values, plains, tags):
        found, j, t = [], 0, t[1:]
        while j < len(p):
            k = int(t[j])
            if k == 0:
                j += 1
                continue
            kind, e = (k - 1) // 2, j + 1
            while e < len(p) and int(t[e]) == 2 * kind + 2:
                e += 1
            if (s := checked(KINDS[kind], p, j, e)) and (not found or at[s[0]] >= found[-1][2]):
                end = at[s[1] - 1] + 1
                while end < len(v) and v[end] in MARKS:
                    end += 1
                found.append((KINDS[kind], at[s[0]], end))
            j = max(e, s[1] if s else e)
        out.append(found)
    return out


def personal_spans(rows: DataFrame) -> DataFrame:
    """(id, field, value) -> (id, field, kind, piece) of every piece found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = load()
        for b in batches:
            got = spans(tagger, list(b["value"]), list(b["field"]))
            flat = [(i, f, k, v[s:e]) for i, f, v, x in zip(b["id"], b["field"], b["value"], got) for k, s, e in x]
            yield pd.DataFrame(flat, columns=["id", "field", "kind", "piece"]).astype({"id": "int64"})

    return rows.mapInPandas(run, "id long, field string, kind string, piece string")


def personal_information(blocks: DataFrame) -> DataFrame:
    """(id, field, kind, value) of every piece in text and sender. A sender's name is read once, however often it sends."""
    b = spread(blocks.select(F.col("id").cast("long").alias("id"), "sender", "text")).where("id is not null")
    has = r"[\p{L}\p{N}]"
    texts = personal_spans(b.where(F.col("text").rlike(has)).select("id", F.lit("text").alias("field"), F.col("text").alias("value")))
    who = b.where(F.col("sender").rlike(has)).select("sender").distinct()
    # parts fixed before the model: small values, much work, so packing them by size would leave it to one task
    spark = b.sparkSession
    found = _with_source(who.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    senders = b.select("id", "sender").join(found, "sender").select("id", F.lit("sender").alias("field"), "kind", "piece")
    return texts.unionByName(senders).withColumnRenamed("piece", "value").distinct()


def _with_source(who: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = load()
        for b in batches:
            v = list(b["sender"])
            flat = [(s, k, s[x:y]) for s, got in zip(v, spans(tagger, v, ["sender"] * len(v))) for k, x, y in got]
            yield pd.DataFrame(flat, columns=["sender", "kind", "piece"], dtype=object)

    return who.mapInPandas(run, "sender string, kind string, piece string")


def masked(values: DataFrame, column: str = "text", field: str = "text") -> DataFrame:
    """Adds `<column>_masked`: the field with each piece replaced by <KIND>, the rest unchanged; null stays null."""

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = load()
        for b in batches:
            out = [x if isinstance(x, str) else None for x in b]
            at = [i for i, x in enumerate(out) if x and x.strip()]
            for i, got in zip(at, spans(tagger, [out[i] for i in at], [field] * len(at))):
                v = out[i]
                for k, s, e in reversed(got):
                    v = f"{v[:s]}<{k.upper()}>{v[e:]}"
                out[i] = v
            yield pd.Series(out, dtype=object)

    return values.withColumn(column + "_masked", mask(F.col(column)))
