"""Reading level of documents: every sentence is classified, and the sentences' levels make the document's.

The sentence model is a regularised softmax over hashed words and character n-grams (averaged over the words) and a
few measures of form; it is linear, so each distinct word's share is computed once. A document is described by the
distribution of its sentences' levels, from which a second softmax, fitted on documents that the sentence model did
not see, gives calibrated level probabilities.

Fitting takes at most `bound` labelled documents, chosen by a hash of their id; everything is scored.
Defined results: null and blank texts get no level; labels that are null or of no known level are left out, a document's
repeated labels are averaged (rounded half up); without labels nothing gets a level; repeated rows come out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.chars import fold
from tallyforge.session import spread

LEVELS = 3
SLOTS = 1 << 15
MAX_WORDS = 300_000
SENTENCE = regex.compile(r"[.!?।۔؟\n\r]+")
WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*|\p{N}+")
FORM = 6


def slots(word: str) -> list[int]:
    """Slots of a word and of its character n-grams; words and n-grams have tables of their own."""
    w = f"<{word}>".encode()
    chars = f"<{word}>"
    grams = {chars[i : i + n] for n in (2, 3, 4) for i in range(len(chars) - n + 1)}
    return [crc32(w) % SLOTS] + [SLOTS + crc32(g.encode()) % SLOTS for g in sorted(grams)]


def sentences(text: str) -> list[tuple[list[str], list[float]]]:
    """(words, measures of form) of every sentence that has a word."""
    out = []
    for s in SENTENCE.split(fold(text)):
        w = ["0" if x[0].isdigit() else x.lower() for x in WORD.findall(s)]
        if w:
            n = len(w)
            out.append((w, [1.0, np.log(n), n / 20, (s.count(",") + s.count("،") + s.count(";")) / n * 5, sum(map(len, w)) / n / 6, w.count("0") / n]))
    return out


@dataclass
class Model:
    table: np.ndarray  # slots x levels
    form: np.ndarray  # measures x levels
    document: np.ndarray  # description x levels
    words: dict[str, np.ndarray] = field(default_factory=dict)

    def word(self, w: str) -> np.ndarray:
        v = self.words.get(w)
        if v is None:
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            s = slots(w)
            v = self.words[w] = self.table[s[0]] + self.table[s[1:]].mean(axis=0)
        return v

    def sentence_levels(self, text: str) -> np.ndarray | None:
        s = sentences(text)
        if not s:
            return None
        z = np.array([np.mean([self.word(w) for w in ws], axis=0) for ws, _ in s]) + np.array([f for _, f in s]) @ self.form
        return softmax(z)

    def levels(self, text: str | None) -> np.ndarray | None:
        """Probabilities of the levels of a document."""
        p = self.sentence_levels(text) if isinstance(text, str) else None
        return None if p is None else softmax(describe(p)[None] @ self.document)[0]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def describe(p: np.ndarray) -> np.ndarray:
    """A document by its sentences: mean, shares of likeliest level, quartiles of the highest and lowest level, number."""
    share = np.bincount(p.argmax(axis=1), minlength=LEVELS) / len(p)
    q = np.quantile(p, [0.25, 0.5, 0.75], axis=0)
    return np.concatenate(([1.0], p.mean(axis=0), share, q[:, 0], q[:, 2], np.log(np.clip(p.mean(axis=0), 1e-4, 1)), [np.log(len(p)) / 4]))


def _adam(params: list[np.ndarray], grads, steps: int, rate: float) -> None:
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, grads(), m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)


def fit_sentences(docs: list[list[tuple[list[str], list[float]]]], y: np.ndarray, steps: int = 80, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    vocab: dict[str, int] = {}
    tokens, starts, forms, labels, weights = [], [], [], [], []
    for s, level in zip(docs, y):
        for w, f in s:
            starts.append(len(tokens))
            tokens += [vocab.setdefault(x, len(vocab)) for x in w]
            forms.append(f)
            labels.append(level)
            weights.append(1 / len(s))
    tokens, starts, forms, labels = np.array(tokens), np.array(starts), np.array(forms), np.array(labels)
    counts = np.diff(np.append(starts, len(tokens)))
    owner = np.repeat(np.arange(len(starts)), counts)
    weights = np.array(weights) / len(docs)
    each = [slots(w) for w in vocab]
    own = np.array([s[0] for s in each])
    grams = np.concatenate([s[1:] for s in each])
    n_grams = np.array([len(s) - 1 for s in each])
    g_start, g_owner = np.concatenate(([0], np.cumsum(n_grams)[:-1])), np.repeat(np.arange(len(each)), n_grams)
    table, form = np.zeros((2 * SLOTS, LEVELS)), np.zeros((FORM, LEVELS))

    def grads():
        word = table[own] + np.add.reduceat(table[grams], g_start) / n_grams[:, None]
        z = np.add.reduceat(word[tokens], starts) / counts[:, None] + forms @ form
        d = softmax(z)
        d[np.arange(len(d)), labels] -= 1
        d *= weights[:, None]
        per = d / counts[:, None]
        gt, gw = np.empty_like(table), np.empty((len(each), LEVELS))
        for k in range(LEVELS):
            gw[:, k] = np.bincount(tokens, per[owner, k], len(each))
            gt[:, k] = np.bincount(own, gw[:, k], 2 * SLOTS) + np.bincount(grams, (gw[:, k] / n_grams)[g_owner], 2 * SLOTS)
        return gt + penalty * table, forms.T @ d + penalty * form

    _adam([table, form], grads, steps, 0.08)
    return table, form


def fit(texts: list[str], y: np.ndarray) -> Model:
    """Sentence models on halves describe the other half for the document model; the final sentence model sees all."""
    docs = [sentences(t) for t in texts]
    has = [i for i, d in enumerate(docs) if d]
    docs, y, texts = [docs[i] for i in has], np.asarray(y)[has], [texts[i] for i in has]
    half = np.arange(len(docs)) % 2
    seen = np.zeros((len(docs), len(describe(np.ones((1, LEVELS)) / LEVELS))))
    for h in (0, 1):
        at = np.flatnonzero(half != h)
        if len(at) == 0:
            at = np.arange(len(docs))
        part = Model(*fit_sentences([docs[i] for i in at], y[at]), np.zeros(0))
        for i in np.flatnonzero(half == h):
            seen[i] = describe(part.sentence_levels(texts[i]))
    table, form = fit_sentences(docs, y)
    document = np.zeros((seen.shape[1], LEVELS))

    def grads():
        d = softmax(seen @ document)
        d[np.arange(len(d)), y] -= 1
        return (seen.T @ d / len(d) + 1e-3 * document,)

    _adam([document], grads, 600, 0.05)
    return Model(table.astype(np.float32), form, document)


def labelled(documents: DataFrame, labels: DataFrame, bound: int) -> tuple[list[str], np.ndarray]:
    """At most `bound` labelled texts, chosen by a hash of the id, and their levels from 0."""
    one = labels.where(F.col("level").between(1, LEVELS) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.floor(F.avg("level") + 0.5).cast("int").alias("level"))
    # `bound` ids at most, so that they may be broadcast: no text is shuffled
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = documents.where("text is not null and trim(text) <> ''").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "level")
    rows = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("level").alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "level").collect()
    return [r.text for r in rows], np.array([r.level - 1 for r in rows], dtype=int)


def reading_levels(documents: DataFrame, labels: DataFrame, bound: int = 4_000) -> DataFrame:
    """(doc_id, level, p1, p2, p3) of every document with a word in it."""
    texts, y = labelled(documents, labels, bound)
    model = fit(texts, y) if len(texts) >= 2 * LEVELS else None

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [model.levels(t) if model else None for t in b["text"]]
            at = [i for i, x in enumerate(p) if x is not None]
            q = np.array([p[i] for i in at]).reshape(-1, LEVELS)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[at], "level": q.argmax(axis=1) + 1, **{f"p{k + 1}": q[:, k] for k in range(LEVELS)}})

    return spread(documents.select("doc_id", "text")).where("doc_id is not null and text is not null").mapInPandas(score, "doc_id long, level int, p1 double, p2 double, p3 double").dropDuplicates(["doc_id", "level"])
