"""Evaluation texts leaking into a corpus, by greedy string tiling.

Words of corpus and items are compared after folding look-alikes, case, accents, punctuation and spacing.
Seeds of four shared words, with one word of any kind in their middle, are found with a running Karp-Rabin hash over whole
batches; each seed's diagonal is read for the longest matches in which words that differ stand alone (at least PIECE shared ones between), and these are
marked longest first, so that none overlap. A document leaks an item if a match of at least `run` of its words, or all of
it, is there; tiles that cover at least `coverage` of the item, in any order, count as all of it.

Items are a held-out set, not a corpus: they are sent to the workers in shards of at most SHARD_WORDS words, one
pass over the corpus for each shard, so what is sent is bounded whatever their number.

Defined results: null and blank texts and items never leak; equal items are reported each; repeated rows come out once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.chars import py_key
from tallyforge.session import spread

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
SHARD_WORDS = 400_000


def words(text: str) -> list[str]:
    return WORD.findall(py_key(text))


def rolling(codes: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of the codes at the places `shape` counted from every place on."""
    n = len(codes) - shape[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in shape:
            h = h * BASE + codes[k : k + n].astype(np.uint64)
    return h


#: Shared words in a row that a single replaced word may part: fewer are chance, or a text put in other words.
PIECE = 3


def bridged(same: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the longest stretches of a diagonal made of pieces of PIECE shared words or more, single words that differ between them."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
    b, e = edge[::2], edge[1::2]
    long = e - b >= PIECE
    b, e = b[long], e[long]
    new = np.flatnonzero(np.concatenate(([True], b[1:] - e[:-1] != 1))) if len(b) else b
    return [(int(b[i]), int(e[j - 1])) for i, j in zip(new, [*new[1:], len(b)])]


class Index:
    """The items' words as codes, and the hashes of their seeds in order.

    A seed is four shared words with one word of any kind in their middle: every stretch that `bridged` makes of more than four
    words holds one. Items too short for a seed are looked for whole.
    """

    SEED = (0, 1, 3, 4)
    SPAN = SEED[-1] + 1

    def __init__(self, items: list[tuple[int, str]]):
        self.code, self.of, codes, self.start = {}, [], [], [0]
        for item, text in items:
            w = words(text)
            codes += [self.code.setdefault(x, len(self.code) + 1) for x in w]
            self.of.append(item)
            self.start.append(len(codes))
        self.codes = np.array(codes, dtype=np.int64)
        self.owner = np.repeat(np.arange(len(self.of)), np.diff(self.start))
        h = rolling(self.codes, self.SEED)
        at = np.flatnonzero(self.owner[: len(h)] == self.owner[self.SPAN - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
        order = np.argsort(h[at], kind="stable")
        self.hash, self.at = h[at][order], at[order]
        self.short = [k for k in range(len(self.of)) if 0 < self.start[k + 1] - self.start[k] < self.SPAN]

    def tiles(self, doc: np.ndarray, owner: int, diagonals: list[int]) -> list[tuple[int, int, int]]:
        """Tiles (place in document, place in item, length) of an item on the given diagonals: the longest is marked first, and none overlap."""
        item, found = self.codes[self.start[owner] : self.start[owner + 1]], []
        for g in diagonals:
            a, z = max(0, g), min(len(doc), g + len(item))
            found += [(b - e, a + b, a + b - g) for b, e in bridged(doc[a:z] == item[a - g : z - g]) if e - b >= self.SPAN]
        heapq.heapify(found)
        in_doc, in_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
        while found:
            n, d, i = heapq.heappop(found)
            free = ~(in_doc[d : d - n] | in_item[i : i - n])
            if free.all():
                in_doc[d : d - n] = in_item[i : i - n] = True
                out.append((d, i, -n))
                continue
            # what is left of a match may still be marked in its turn
            edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
            for b, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if e - b >= self.SPAN:
                    heapq.heappush(found, (b - e, d + b, i + b))
        return out

    def leaks(self, texts: list[str | None], run: int, coverage: float) -> Iterator[tuple[int, int]]:
        """(place of the text, item id) of every leak."""
        rows, lengths, code = [], [], self.code
        for t in texts:
            w = [code.get(x, 0) for x in words(t)] if isinstance(t, str) and t else []
            rows += w
            rows += [0] * self.SPAN  # parts the texts; no item has it
            lengths.append(len(w) + self.SPAN)
        codes = np.array(rows, dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        h = rolling(codes, self.SEED)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        at = np.flatnonzero(hi > lo)
        times = (hi - lo)[at]
        p = np.repeat(at, times)
        q = self.at[np.repeat(lo[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        true = np.ones(len(p), bool)
        for k in self.SEED:
            true &= codes[p + k] == self.codes[q + k]
        p, q = p[true], q[true]
        doc, owner = np.searchsorted(begin, p, "right") - 1, self.owner[q]
        start = np.array(self.start, dtype=np.int64)
        by: dict[tuple[int, int], list[int]] = {}
        if len(p):
            seeds, count = np.unique(np.stack((doc, owner, (p - begin[doc]) - (q - start[owner])), axis=1), axis=0, return_counts=True)
            pair, inverse = np.unique(seeds[:, :2], axis=0, return_inverse=True)
            size = (start[1:] - start[:-1])[seeds[:, 1]]
            # a stretch of n words holds (n - 4) / 5 seeds or more, so tiles of n words in all have n / 9 or more between them:
            # pairs with fewer cannot leak, and without enough for coverage only a diagonal with enough for a run matters
            enough = np.bincount(inverse.reshape(-1), count, len(pair))[inverse.reshape(-1)] * 9 >= coverage * size
            may = enough | (count * 5 + 4 >= np.minimum(run, size))
            for d, o, g in seeds[may].tolist():
                by.setdefault((d, o), []).append(g)
        for (d, o), diagonals in by.items():
            size = int(start[o + 1] - start[o])
            tiles = self.tiles(codes[begin[d] : begin[d + 1] - self.SPAN], o, diagonals)
            if any(n >= min(run, size) for *_, n in tiles) or tiles and sum(n for *_, n in tiles) >= coverage * size:
                yield d, self.of[o]
        for k in self.short:
            item = self.codes[self.start[k] : self.start[k + 1]]
            same = np.ones(max(0, len(codes) - len(item) + 1), bool)
            for j, c in enumerate(item):
                same &= codes[j : j + len(same)] == c
            for d in np.unique(np.searchsorted(begin, np.flatnonzero(same), "right") - 1).tolist():
                yield d, self.of[k]


def leaks(self, texts: list[str | None], run: int, coverage: float) -> Iterator[tuple[int, int]]:
        """(place of the text, item id) of every leak."""
        rows, lengths, code = [], [], self.code
        for t in texts:
            w = [code.get(x, 0) for x in words(t)] if isinstance(t, str) and t else []
            rows += w
            rows += [0]  # parts the texts; no item has it
            lengths.append(len(w) + 1)
        codes = np.array(rows, dtype=np.int64)
        h = rolling(codes, self.seed)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        begin = np.concatenate(([0], np.cumsum(lengths)))
        hits: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for p in np.flatnonzero(hi > lo):
            doc = int(np.searchsorted(begin, p, "right")) - 1
            for q in self.at[lo[p] : hi[p]]:
                if (codes[p : p + self.seed] == self.codes[q : q + self.seed]).all():
                    owner = int(self.owner[q])
                    hits.setdefault(doc, {}).setdefault(owner, []).append((int(p - begin[doc]), int(q - self.start[owner])))
        for doc, by in hits.items():
            # fewer seeds than the shortest leak has can be left aside: a run of n words with replaced words has one at least each other tile
            for owner, tiles in self.tiles(codes[begin[doc] : begin[doc + 1]], by):
                size = self.start[owner + 1] - self.start[owner]
                if longest_run(tiles) >= min(run, size) or sum(n for *_, n in tiles) >= max(coverage * size, self.seed):
                    yield doc, self.of[owner]


def longest_run(tiles: list[tuple[int, int, int]]) -> int:
    """Words of the longest run of tiles on one diagonal that single replaced words part."""
    best, ends = 0, {}
    for d, i, n in sorted(tiles):
        length = ends.pop((d - 1, i - 1), 0)
        length = length + 1 + n if length else n
        ends[d + n, i + n] = length
        best = max(best, length)
    return best


def leaks(documents: DataFrame, items: DataFrame, run: int = 18, coverage: float = 0.9) -> DataFrame:
    """(doc_id, item_id) of every document that contains an item, or `run` of its words."""
    out = None
    shard: list[tuple[int, str]] = []
    size = 0

    def search(shard: list[tuple[int, str]]) -> DataFrame:
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(shard)
            for b in batches:
                got = list(index.leaks(list(b["text"]), run, coverage))
                ids = b["doc_id"].to_numpy()
                yield pd.DataFrame({"doc_id": [ids[d] for d, _ in got], "item_id": [i for _, i in got]}, dtype="int64")

        return spread(documents.select("doc_id", "text")).where("doc_id is not null and text is not null and length(text) > 0").mapInPandas(find, "doc_id long, item_id long")

    rows = items.where("text is not null and item_id is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        n = len(words(r.text))
        if shard and size + n > SHARD_WORDS:
            out = search(shard) if out is None else out.unionByName(search(shard))
            shard, size = [], 0
        if n:
            shard, size = [*shard, (r.item_id, r.text)], size + n
    if shard or out is None:
        out = search(shard) if out is None else out.unionByName(search(shard))
    return out.distinct()
