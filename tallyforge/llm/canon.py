"""Free-typed values to the entries of a reference list: a trie searched with a Levenshtein automaton.

The trie holds, for every entry and every known spelling of it (alias paths, in whatever script), the words joined in either order.
The automaton of a query is determinised lazily: a state is the row of edit distances cut off above the limit. Trie and
automaton are walked together, so that every entry within a length-dependent distance is found and no other is
visited beyond it. A match must also hold word by word, so a long second word cannot carry a strange first one.

Values are compared after folding look-alikes, case and doubled or long vowels, without courtesy words.
Defined results: null gives no match; blank or strange values give UNMATCHED; ties go to the entry first in the list;
an empty list leaves everything UNMATCHED; repeated rows come out once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.chars import py_key
from tallyforge.functions.labels import HONORIFICS

UNMATCHED = "UNMATCHED"
#: Spellings of the list that a worker holds at a time, and values that it remembers.
SHARD, MAX_SEEN = 50_000, 200_000
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
_LONG = [("ee", "i"), ("ea", "i"), ("oo", "u"), ("w", "v"), ("ph", "f"), ("q", "k")]
_DOUBLE = regex.compile(r"(\p{L})\1+")
_SKIP = {regex.sub(r"(\p{L})\1+", r"\1", h.replace("ee", "i").replace("ea", "i").replace("oo", "u")) for h in HONORIFICS} | set(HONORIFICS)


def sound(word: str) -> str:
    """One spelling for long vowels and doubled letters."""
    for a, b in _LONG:
        word = word.replace(a, b)
    return _DOUBLE.sub(r"\1", word)


def value_words(value: str, raw: bool = False) -> list[str]:
    """Words that carry meaning; raw: with their vowels as typed."""
    return [w if raw else s for w in _NO_LETTER.sub(" ", py_key(value)).split() if w not in HONORIFICS and (s := sound(w)) not in _SKIP]


def limit(length: int) -> int:
    """Edits allowed by length."""
    return 0 if length < 3 else 1 if length <= 4 else 2 if length <= 8 else 3 if length <= 12 else 4


class Automaton:
    """Levenshtein automaton of one word: states are cut-off rows of distances, made when first reached."""

    def __init__(self, word: str, most: int):
        self.word, self.most, self.moves = word, most, {}
        self.start = tuple(min(i, most + 1) for i in range(len(word) + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        k = (state, c if c in self.word else "")
        if (to := self.moves.get(k)) is None:
            row = [min(state[0] + 1, self.most + 1)]
            for i, w in enumerate(self.word):
                row.append(min(row[i] + 1, state[i + 1] + 1, state[i] + (w != c), self.most + 1))
            to = self.moves[k] = tuple(row)
        return to


def prefix_edits(word: str, text: str) -> list[int]:
    """Edits (neighbours swapped count as one) between a word and each prefix of a text."""
    rows = [list(range(len(word) + 1))]
    for j, c in enumerate(text):
        row = [j + 1]
        for i, w in enumerate(word):
            d = min(rows[-1][i + 1] + 1, row[i] + 1, rows[-1][i] + (w != c))
            if i and j and w == text[j - 1] and word[i - 1] == c:
                d = min(d, rows[-2][i - 1] + 1)
            row.append(d)
        rows.append(row)
    return [r[-1] for r in rows]


class Matcher:
    """A trie of entries and their known spellings, each joined in either order of its words; `first` is the place of its first entry in the whole list."""

    def __init__(self, entries: Iterable[str], aliases: Iterable[tuple[str, str]] = (), raw: bool = False, first: int = 0):
        entries, aliases, self.raw = list(entries), sorted(aliases), raw
        #: Asked where folded vowels leave too little of a short word.
        self.second = None if raw else Matcher(entries, (), True, first)
        self.trie: dict = {}
        self.order: dict[str, int] = {}
        #: Words of the longest path, letters of the shortest.
        self.most_words, self.least = 1, 1 << 20
        for e in entries:
            self.order.setdefault(e, first + len(self.order))
            self._put(e, e)
        for spelling, e in aliases:
            if e in self.order:
                self._put(spelling, e)

    def _put(self, spelling: str, entry: str) -> None:
        w = value_words(spelling, self.raw)
        for words in {tuple(w), tuple(reversed(w))}:
            if words:
                at = self.trie
                for c in "".join(words):
                    at = at.setdefault(c, {})
                at.setdefault("", set()).add((entry, words))
                self.most_words, self.least = max(self.most_words, len(words)), min(self.least, sum(map(len, words)))

    def search(self, query: str) -> list[tuple[int, str]]:
        """(distance, entry) of every entry within reach of a joined, folded query, nearest first."""
        most = limit(len(query))
        m = Automaton(query, most)
        found: dict[str, int] = {}
        stack = [(self.trie, m.start)]
        while stack:
            node, state = stack.pop()
            for c, to in node.items():
                if c == "":
                    if state[-1] <= most:
                        for entry, words in to:
                            if state[-1] < found.get(entry, most + 1) and (state[-1] == 0 or self.word_by_word(query, words)):
                                found[entry] = state[-1]
                elif min(s := m.step(state, c)) <= most:
                    stack.append((to, s))
        return sorted(((d, e) for e, d in found.items()), key=lambda x: (x[0], self.order[x[1]]))

    @staticmethod
    def word_by_word(query: str, words: tuple[str, ...]) -> bool:
        """Whether the query can be cut into parts each within its own word's limit."""
        ends = {0}
        for w in words:
            most = 2 if len(w) > 3 else 1
            nxt = set()
            for b in ends:
                nxt.update(b + n for n, d in enumerate(prefix_edits(w, query[b : b + len(w) + most])) if d <= most)
            ends = nxt
        return len(query) in ends

    def matches(self, value: str | None) -> list[tuple[int, int, str]]:
        """(pass, distance, entry) of every entry within reach of a value, nearest first; pass 1 is the search of vowels as typed."""
        q = "".join(value_words(value, self.raw)) if value else ""
        hits = [(int(self.raw), d, e) for d, e in self.search(q)] if q else []
        return self.second.matches(value) if not hits and q and self.second else hits

    def matches_inside(self, text: str | None) -> list[tuple[int, int, str]]:
        """As `matches`, of the words of a longer text: of any words that follow each other, as many as the longest entry has."""
        found: dict[str, int] = {}
        for run in regex.split(r"\p{N}+", py_key(text)) if text else ():
            w = value_words(run, self.raw)
            for i in range(len(w)):
                for q in dict.fromkeys("".join(w[i : i + k]) for k in range(1, self.most_words + 1)):
                    if len(q) + limit(len(q)) >= self.least:
                        for d, e in self.search(q):
                            found[e] = min(d, found.get(e, d))
        hits = [(int(self.raw), d, e) for e, d in sorted(found.items(), key=lambda x: (x[1], self.order[x[0]]))]
        return self.second.matches_inside(text) if not hits and self.second else hits

    def best(self, value: str | None, inside: bool = False) -> tuple[int, int, int, str] | None:
        """(pass, distance, place in the list, entry) of the nearest entry, or None."""
        hits = self.matches_inside(value) if inside else self.matches(value)
        return min((p, d, self.order[e], e) for p, d, e in hits) if hits else None

    def match(self, value: str | None) -> tuple[int, str]:
        """(distance, entry) of a value; UNMATCHED at a large distance."""
        b = self.best(value)
        return (b[1], b[3]) if b else (1 << 20, UNMATCHED)

    def match_inside(self, text: str | None) -> str:
        b = self.best(text, True)
        return b[3] if b else UNMATCHED


def matchers_of(chant_list: DataFrame, chant_variants: DataFrame) -> list[Matcher]:
    """Matchers of the list and its known spellings, SHARD spellings each: what is sent to a worker at a time is bounded, however long the list."""
    entries = chant_list.where("chant is not null").groupBy("chant").agg(F.min("ord").alias("ord"))
    known = chant_variants.where("key is not null and canonical is not null").groupBy(F.col("canonical").alias("chant")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    out, own, aliases, first, size = [], [], [], 0, 0
    for r in entries.join(known, "chant", "left").orderBy("ord", "chant").toLocalIterator():
        if size >= SHARD:
            out.append(Matcher(own, aliases, first=first))
            own, aliases, first, size = [], [], first + len(own), 0
        own.append(r.chant)
        aliases += [(k, r.chant) for k in r["keys"] or ()]
        size += 1 + len(r["keys"] or ())
    return [*out, Matcher(own, aliases, first=first)]


def _hits(matcher: Matcher, inside: bool):
    @F.pandas_udf("struct<pass:int,distance:int,place:int,entry:string>")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for b in batches:
            out = []
            for v in b:
                if v not in seen:
                    if len(seen) >= MAX_SEEN:
                        seen.clear()
                    seen[v] = matcher.best(v if isinstance(v, str) else None, inside) or (9, 1 << 20, 1 << 30, UNMATCHED)
                out.append(seen[v])
            yield pd.DataFrame(out, columns=["pass", "distance", "place", "entry"]).astype({"pass": "int32", "distance": "int32", "place": "int32"})

    return hit


def canonical_values(values: DataFrame, matchers: list[Matcher], value: str = "value", inside: bool = False) -> DataFrame:
    """Adds `canonical`: the entry meant by each value, or by the words of a longer text; of several shards' the nearest."""
    hits = [_hits(m, inside)(F.col(value)) for m in matchers]
    return values.withColumn("canonical", (hits[0] if len(hits) == 1 else F.least(*hits))["entry"])


def all_matches(values: DataFrame, matchers: list[Matcher], value: str = "value", inside: bool = False) -> DataFrame:
    """(value, canonical, distance, rank) of every entry within a value's reach, one row each; values with none have no row. Distinct values are searched once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for v in b["value"]:
                hits = [(p, d, m.order[e], e) for m in matchers for p, d, e in (m.matches_inside(v) if inside else m.matches(v))]
                least = min((h[0] for h in hits), default=0)
                rows += [(v, e, d, i + 1) for i, (_, d, _, e) in enumerate(sorted(h for h in hits if h[0] == least))]
            yield pd.DataFrame(rows, columns=["value", "canonical", "distance", "rank"]).astype({"distance": "int32", "rank": "int32"})

    return values.where(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct().mapInPandas(run, "value string, canonical string, distance int, rank int")


def canonical_chants(extracted: DataFrame, blocks: DataFrame, review: DataFrame, chant_list: DataFrame, chant_variants: DataFrame) -> DataFrame:
    """(msg_id, seq, canonical) of rows not letter for letter in the list, and of blocks whose label was not resolved."""
    m = matchers_of(chant_list, chant_variants)
    listed = chant_list.where("chant is not null").select("chant").distinct()
    # copies of a spelling are counted into one before the list is asked, and each distinct one is searched once
    spellings = extracted.where("chant is not null").select("chant").distinct().join(listed, "chant", "left_anti")
    cores = spellings.sparkSession.sparkContext.defaultParallelism
    known = canonical_values(spellings.repartition(max(cores, int(spellings.sparkSession.conf.get("spark.sql.shuffle.partitions")))), m, "chant")
    typed = extracted.where("chant is not null and msg_id is not null").select("msg_id", "seq", "chant")
    rows = typed.join(known, "chant").select("msg_id", "seq", "canonical")
    open_ = review.where("code = 'unresolved' and msg_id is not null").select("msg_id").distinct()
    texts = blocks.select(F.col("id").alias("msg_id"), "text").join(open_, "msg_id", "left_semi")
    rest = canonical_values(texts, m, "text", inside=True).select("msg_id", F.lit(1).alias("seq"), "canonical")
    return rows.unionByName(rest).distinct()
