"""New batches checked for repeats against everything accepted before, with immutable suffix arrays.

A message repeats an earlier one if sender, calendar date and numbers agree and its wording is nearly the same.
Each batch becomes one immutable segment: its records' text one after another, and a suffix array over the starts of
words, in order of the record's key and then of the text. The substrings of a new batch are looked up by binary search,
hits are extended to the longest match, and what the matches cover of a record is added up. Segments are merged
logarithmically, so a record is merged again only log(batches) times and history is never indexed anew.

A record is filed under its key (sender, date, numbers) and, as a later copy may be cut short, under the key of
every prefix of its numbers; a new record is looked up under its own key alone. So work is spread by a key that only copies
share. Letter-for-letter copies within one batch are one record; those of other batches are found by the arrays like
any repeat. `repeats` runs all batches of a table in order; `RepeatIndex` keeps segments in a shared folder and takes
batches as they come. Both search and merge with the same `History`.

What the order and the matches leave out: suffixes are in order by their first DEPTH bytes, which is all that a search
for LEAST bytes needs; matches under LEAST bytes, or that begin within a word, do not count as covered.

Defined results: blocks with a null or blank sender or text, or without a readable date, never repeat and are never
repeated; repeats within one batch are new; ties go to the smallest id; repeated rows come out once; a copy cut
short before its first number is no repeat.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.chars import BEYOND_ASCII, DIGITS, INVISIBLE, fold_col, sender_key
from tallyforge.operators.packed import UNIT
from tallyforge.operators.timestamps import written_day
from tallyforge.session import cut_lineage, spread
from tallyforge.sources import versions

#: Bytes of a suffix that are kept in order beyond the key, and the least bytes of a match.
DEPTH, LEAST = 24, 8
PAD = b"\n" * DEPTH
#: Keys with at most so many entries are broadcast (16 bytes each); more are joined by a shuffle.
FEW_KEYS = 2_000_000
#: Entries of a key from which its look-ups are spread over several tasks.
HOT = 20_000
ENTRY = "key long, salt int, src int, id long, own boolean, look boolean, ftext string"


def key_bytes(keys: np.ndarray) -> np.ndarray:
    """[n, 8] bytes in the order of the keys."""
    return (np.asarray(keys, np.int64).astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)


class Segment:
    """Records of one or more batches: keys, texts, ids, which are filed under their own key, and the suffix array."""

    def __init__(self, ids, keys, own, texts: list[bytes], order: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, self.keys, self.own, self.texts = np.asarray(ids, np.int64), np.asarray(keys, np.int64), np.asarray(own, bool), texts
        padded = [t + PAD for t in texts]
        size = np.array([len(t) for t in padded], dtype=np.int64)
        base = np.cumsum(size) - size
        blob = np.frombuffer(b"".join(padded), dtype=np.uint8)
        if order is None:
            letter = (blob != 32) & (blob != PAD[0])
            start = letter & np.concatenate(([True], ~letter[:-1])) if len(blob) else letter
            place = np.flatnonzero(start)
            self.owner = np.searchsorted(base, place, "right") - 1
            self.at = place - base[self.owner]
        else:
            self.owner, self.at = order
        n = len(self.owner)
        text = blob[(base[self.owner] + self.at)[:, None] + np.arange(DEPTH)] if n else np.zeros((0, DEPTH), np.uint8)
        self.suffix = np.ascontiguousarray(np.concatenate((key_bytes(self.keys)[self.owner], text), axis=1)).view(f"S{8 + DEPTH}").reshape(-1)
        if order is None:
            o = np.argsort(self.suffix, kind="stable")
            self.suffix, self.owner, self.at = self.suffix[o], self.owner[o], self.at[o]

    def __len__(self) -> int:
        return len(self.texts)

    def merged(self, other: Segment) -> Segment:
        """Both segments' records; the sorted arrays are merged, not sorted anew."""
        where = np.searchsorted(self.suffix, other.suffix, side="right") + np.arange(len(other.suffix))
        mine = np.ones(len(self.suffix) + len(other.suffix), bool)
        mine[where] = False
        out = []
        for a, b in ((self.owner, other.owner + len(self)), (self.at, other.at)):
            c = np.empty(len(mine), dtype=np.int64)
            c[mine], c[where] = a, b
            out.append(c)
        both = lambda k: np.concatenate((getattr(self, k), getattr(other, k)))
        return Segment(both("ids"), both("keys"), both("own"), self.texts + other.texts, (out[0], out[1]))

    def part(self, chosen: np.ndarray) -> Segment:
        """The chosen records alone; their order is kept."""
        place = np.cumsum(chosen) - 1
        kept = chosen[self.owner]
        return Segment(self.ids[chosen], self.keys[chosen], self.own[chosen], [t for t, c in zip(self.texts, chosen) if c], (place[self.owner[kept]], self.at[kept]))

    def seeds(self, key: int, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By word of the text: its place, and the records of the same key and the places in them at which `LEAST` bytes agree."""
        head = key_bytes([key]).tobytes()
        lo, hi = np.searchsorted(self.suffix, np.array([head, head + b"\xff" * DEPTH]), "left")
        if lo == hi:
            return
        padded, near, starts = text + PAD, self.suffix[lo:hi], word_starts(text)
        q = np.array([[head + padded[p : p + LEAST], head + padded[p : p + LEAST] + b"\xff"] for p in starts], dtype=f"S{9 + LEAST}").reshape(-1, 2)
        a, b = np.searchsorted(near, q[:, 0], "left"), np.searchsorted(near, q[:, 1], "left")
        for k in np.flatnonzero(b > a):
            yield starts[k], self.owner[lo + a[k] : lo + b[k]], self.at[lo + a[k] : lo + b[k]]

    def coverage(self, key: int, text: bytes) -> Iterator[tuple[int, int, int, bool]]:
        """(record, bytes of the text that matches cover, bytes of the record, whether a match begins both).

        At each word not yet covered the match that shifts least against the one before is taken, and made as long as it goes.
        """
        found: dict[int, list] = {}
        for p, owners, places in self.seeds(key, text):
            state = [found.get(r) for r in owners.tolist()] if len(owners) < 64 else None
            reach = np.array([x[0] if x else 0 for x in state]) if state is not None else np.array([found[r][0] if r in found else 0 for r in range(len(self))])[owners]
            fresh = np.flatnonzero(reach < p + LEAST)
            if not len(fresh):
                continue
            shift = {r: found[r][1] if r in found else 0 for r in set(owners[fresh].tolist())}
            best: dict[int, tuple[int, int]] = {}
            for r, q in zip(owners[fresh].tolist(), places[fresh].tolist()):
                c = (abs(p - q - shift[r]), q)
                if r not in best or c < best[r]:
                    best[r] = c
            for r, (_, q) in best.items():
                old = self.texts[r]
                n = extended(text, p, old, q)
                x = found.setdefault(r, [0, 0, np.zeros(len(text), bool), np.zeros(len(old), bool), False])
                x[0], x[1] = p + n, p - q
                x[2][p : p + n] = True
                x[3][q : q + n] = True
                x[4] |= p == 0 and q == 0
        for r, (_, _, a, b, start) in found.items():
            yield r, int(a.sum()), int(b.sum()), start

    def packed(self) -> bytes:
        f = io.BytesIO()
        np.savez_compressed(f, ids=self.ids, keys=self.keys, own=self.own, sizes=np.array([len(t) for t in self.texts], dtype=np.int64), blob=np.frombuffer(b"".join(self.texts), dtype=np.uint8), owner=self.owner.astype(np.int32), at=self.at.astype(np.int32))
        return f.getvalue()

    @staticmethod
    def unpacked(payload: bytes) -> Segment:
        z = np.load(io.BytesIO(payload), allow_pickle=False)
        blob, ends = z["blob"].tobytes(), np.cumsum(z["sizes"])
        return Segment(z["ids"], z["keys"], z["own"], [blob[e - s : e] for s, e in zip(z["sizes"], ends)], (z["owner"].astype(np.int64), z["at"].astype(np.int64)))


def word_starts(text: bytes) -> list[int]:
    out, space = [], True
    for i, c in enumerate(text):
        if c == 32:
            space = True
        elif space:
            out.append(i)
            space = False
    return out


def extended(new: bytes, p: int, old: bytes, q: int) -> int:
    """Bytes that agree from a place on."""
    n, step = 0, 256
    while step:
        a = new[p + n : p + n + step]
        if len(a) == step and a == old[q + n : q + n + step]:
            n += step
        else:
            step //= 2
    return n


def is_repeat(new: bytes, old: bytes, same_numbers: bool, a: int, b: int, start: bool, share: float) -> bool:
    """With the same numbers the matches must cover `share` of either text; a copy cut short must begin alike and be covered wholly but for its edge."""
    if same_numbers:
        return max(a / max(1, len(new)), b / max(1, len(old))) >= share
    return start and len(new) < len(old) and a >= len(new) - LEAST


class History:
    """Segments of one part of the keys, largest first."""

    def __init__(self, segments: list[Segment] | None = None):
        self.segments = segments or []

    def earliest(self, key: int, text: bytes, share: float) -> int | None:
        best = None
        for s in self.segments:
            for r, a, b, start in s.coverage(key, text):
                i = int(s.ids[r])
                if (best is None or i < best) and is_repeat(text, s.texts[r], bool(s.own[r]), a, b, start, share):
                    best = i
        return best

    def add(self, s: Segment) -> None:
        self.segments.append(s)
        while len(self.segments) > 1 and len(self.segments[-2]) <= 2 * len(self.segments[-1]):
            b = self.segments.pop()
            self.segments[-1] = self.segments[-1].merged(b)


def texts_of(b: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in b["ftext"]]


def _run(history: History, pdf: pd.DataFrame, share: float) -> list[tuple[int, int]]:
    """(id, first_id); batches in order: look up, then add."""
    found = []
    for _, b in pdf.groupby("src", sort=True):
        texts = texts_of(b)
        if history.segments:
            for i, k, t, own, look in zip(b["id"], b["key"], texts, b["own"], b["look"]):
                if own and look and (first := history.earliest(k, t, share)) is not None:
                    found.append((i, first))
        history.add(Segment(b["id"], b["key"], b["own"], texts))
    return found


def folded_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold_col(text)), r"[\s\p{Cc}]+", " "), rf"(?<= |[0-9]){UNIT}(?= |$)", "x"))


def prepared(blocks: DataFrame) -> DataFrame:
    """(id, src, keys, text): blocks with a sender, a readable date and a text; `keys` are those of the prefixes of its numbers, its own last."""
    t = F.col("text")
    plain = F.when(t.rlike(BEYOND_ASCII), F.translate(t, "".join(DIGITS) + INVISIBLE, "".join(DIGITS.values()))).otherwise(t)
    b = spread(blocks.select("id", "src_idx", "sender", "envelope_date", "text")).where(F.col("id").isNotNull() & F.col("src_idx").isNotNull() & t.rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]"))
    # the generator keeps the optimiser from working out sender and numbers again for the filter
    once = F.inline(F.array(F.struct(sender_key(F.col("sender")).alias("sender"), F.regexp_extract_all(plain, F.lit(r"[0-9]+"), F.lit(0)).alias("_n"))))
    d = b.select(F.col("id").cast("long").alias("id"), F.col("src_idx").cast("int").alias("src"), written_day(F.col("envelope_date")).alias("day"), "text", once).where("sender <> '' and day is not null")
    # a text without its numbers is no copy: of the prefixes the empty one is left out, unless it is all there is
    size = F.size("_n")
    keys = F.transform(F.sequence(F.least(size, F.lit(1)), size), lambda k: F.xxhash64("sender", "day", F.array_join(F.slice("_n", 1, k), " ")))
    return d.select("id", "src", keys.alias("keys"), "text")


def entries_of(rows: DataFrame) -> DataFrame:
    """Rows (id, src, keys, text) -> (key, own) with their rows, one for each key."""
    return rows.select("id", "src", "text", F.element_at("keys", -1).alias("own_key"), F.posexplode("keys").alias("_p", "key"), F.size("keys").alias("_k")).withColumn("own", F.col("_p") == F.col("_k") - 1).drop("_p", "_k")


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, c): keys under which there is more than one entry, at least one of them its own; counted before anything is brought together."""
    return entries_of(rows).groupBy("key").agg(F.count("*").alias("c"), F.max("own").alias("o")).where("c > 1 and o").select("key", "c")


def records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, src, own_key, ftext, keys), one for each text, key and batch; (id, rep): the other copies of the batch and the record they stand in)."""
    same = ["src", "own_key", "ftext"]
    r = rows.select("id", "src", F.element_at("keys", -1).alias("own_key"), folded_text(F.col("text")).alias("ftext"), "keys", "kept")
    one = r.groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("_c"), F.first("keys").alias("keys"), F.first("kept").alias("kept"))
    copies = r.select("id", *same).join(one.where("_c > 1").select(*same, F.col("id").alias("rep")), same).where("id <> rep").select("id", "rep").distinct()
    return one.select("id", "src", "own_key", "ftext", "keys", "kept"), copies


def filed(one: DataFrame, hot: int = HOT) -> DataFrame:
    """Records -> entries under the keys in `kept` [key, c]; the look-ups of a key with more than `hot` entries are spread over salts, each with all that is filed."""
    e = one.select("id", "src", "ftext", "own_key", F.inline("kept")).select("*", (F.col("key") == F.col("own_key")).alias("own"))
    salts = F.ceil(F.col("c") / hot).cast("int")
    e = e.select("*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return e.select("key", "salt", "src", "id", "own", (F.pmod(F.xxhash64("id"), salts) == F.col("salt")).alias("look"), "ftext")


def search_in_order(entries: DataFrame, share: float, per_block: int) -> DataFrame:
    """Entries -> (rep, first_id). Each task reads its keys in order and handles whole keys, about `per_block` entries at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_run(History(), pdf, share), columns=["rep", "first_id"], dtype="int64")

        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size < per_block:
                continue
            d = pd.concat(held, ignore_index=True)
            k, s = d["key"].to_numpy(), d["salt"].to_numpy()
            ends = np.flatnonzero((k[1:] != k[:-1]) | (s[1:] != s[:-1]))
            if len(ends):
                yield out(d.iloc[: ends[-1] + 1])
                d = d.iloc[ends[-1] + 1 :]
            held, size = [d], len(d)
        if held:
            yield out(pd.concat(held, ignore_index=True))

    e = entries.repartition("key", "salt").sortWithinPartitions("key", "salt", "src", "id")
    return e.mapInPandas(run, "rep long, first_id long")


def with_copies(best: DataFrame, copies: DataFrame) -> DataFrame:
    """(first_id, id) of records and of the other copies of their batch."""
    best = best.groupBy("rep").agg(F.min("first_id").alias("first_id"))
    return best.select("first_id", F.col("rep").alias("id")).unionByName(copies.join(best, "rep").select("first_id", "id")).where("first_id < id").distinct()


def repeats(blocks: DataFrame, share: float = 0.75, per_block: int = 20_000, few_keys: int = FEW_KEYS, hot: int = HOT) -> DataFrame:
    """(first_id, id) of every block that repeats one of an earlier batch; first_id is the earliest that it repeats.

    First the keys alone are kept and counted; only rows with a key that others share go on, with their text. `per_block` bounds how
    many entries a task holds at a time, but for a single key's.
    """
    # the keys, 8 bytes each, are kept; the text is read again for rows that go on, told apart by its hash should an id be there twice
    rows = cut_lineage(prepared(blocks).select("id", "src", "keys", F.xxhash64("text").alias("_h")))
    shared = cut_lineage(shared_keys(rows.withColumn("text", F.lit(None).cast("string"))))
    side = F.broadcast(shared) if shared.count() <= few_keys else shared
    kept = rows.select("*", F.explode("keys").alias("key")).join(side, "key").groupBy("id", "src", "_h").agg(F.first("keys").alias("keys"), F.collect_set(F.struct("key", "c")).alias("kept"))
    text = blocks.where("text is not null").select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("_h"), "text").join(kept, ["id", "_h"])
    # read twice, for the records and for the other copies of a batch
    one, copies = records(cut_lineage(text.select("id", "src", "text", "keys", "kept").distinct()))
    return with_copies(search_in_order(filed(one, hot), share, per_block), copies)


class RepeatIndex:
    """Accepted messages as immutable segments in a shared folder, extended a batch at a time.

    A batch's records become one segment, written once; a segment is written again only when it is merged with a younger one
    not much smaller, so log(batches) times. A segment is a folder of parts by key; the number of parts grows with its records.
    A look-up reads only the parts that the batch's keys fall in. What is there is named by a published version, so a
    batch is accepted whole or not at all.
    """

    PARTS = "part long, n long, payload binary"

    def __init__(self, spark, path: str, per_part: int = 4_096, share: float = 0.75):
        self.spark, self.path, self.per_part, self.share = spark, path, per_part, share

    def segments(self) -> list[dict]:
        """Live segments, oldest and largest first: name, n (entries), parts."""
        state = versions.latest(self.spark, f"{self.path}/versions")
        return state["segments"] if state else []

    def _write(self, parts: DataFrame, count: int) -> dict:
        name = f"s-{uuid.uuid4().hex[:12]}"
        parts.write.partitionBy("part").parquet(f"{self.path}/{name}")
        n = self._read(name).agg(F.sum("n")).first()[0] or 0
        return {"name": name, "n": int(n), "parts": count}

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.PARTS).parquet(f"{self.path}/{name}")

    def _parts_for(self, n: int) -> int:
        return 1 << max(0, (n // self.per_part)).bit_length()

    def accept(self, batch: DataFrame, look: bool = True) -> DataFrame:
        """(first_id, id) of the blocks that repeat ones accepted before; then they are accepted too.

        A batch is the rows of one src_idx. Rows of several may be loaded at once with look=False, which looks nothing up.
        """
        every = F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(1).alias("c")))
        one, copies = records(prepared(batch).withColumn("kept", every))
        entries = cut_lineage(filed(one))
        found = self.spark.createDataFrame([], "rep long, first_id long")
        live = self.segments()
        for s in live if look else []:
            found = found.unionByName(self._look_up(entries.where("own"), s))
        found = cut_lineage(found)
        n = entries.count()
        if n:
            self._publish([*live, self._write(self._indexed(entries, self._parts_for(n)), self._parts_for(n))])
        return with_copies(found, copies)

    def _indexed(self, entries: DataFrame, parts: int) -> DataFrame:
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            s = Segment(pdf["id"], pdf["key"], pdf["own"], texts_of(pdf))
            return pd.DataFrame([(key[0], len(s), s.packed())], columns=["part", "n", "payload"])

        return entries.withColumn("part", F.pmod("key", F.lit(parts))).groupBy("part").applyInPandas(run, self.PARTS)

    def _look_up(self, own: DataFrame, segment: dict) -> DataFrame:
        share = self.share

        def run(_: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(new):
                for payload in old["payload"]:
                    h = History([Segment.unpacked(payload)])
                    out += [(i, f) for i, k, t in zip(new["id"], new["key"], texts_of(new)) if (f := h.earliest(k, t, share)) is not None]
            return pd.DataFrame(out, columns=["rep", "first_id"], dtype="int64")

        own = own.withColumn("part", F.pmod("key", F.lit(segment["parts"])))
        # at most so many numbers as the segment has parts; they prune its folders
        touched = [r.part for r in own.select("part").distinct().collect()]
        old = self._read(segment["name"]).where(F.col("part").isin(touched))
        return own.groupBy("part").cogroup(old.groupBy("part")).applyInPandas(run, "rep long, first_id long")

    def _publish(self, live: list[dict]) -> None:
        """Merges from the young end until each segment is more than twice the next, then names what is live."""
        gone = []
        while len(live) > 1 and live[-2]["n"] <= 2 * live[-1]["n"]:
            a, b = live[-2:]
            gone += [a["name"], b["name"]]
            live = [*live[:-2], self._merge(a, b)]
        versions.publish(self.spark, f"{self.path}/versions", {"segments": live})
        for name in gone:
            versions.remove(self.spark, f"{self.path}/{name}")

    def _merge(self, a: dict, b: dict) -> dict:
        parts = max(a["parts"], b["parts"], self._parts_for(a["n"] + b["n"]))

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                for payload in d["payload"]:
                    s = Segment.unpacked(payload)
                    at = np.mod(s.keys, parts)
                    own = [s.part(at == p) for p in np.unique(at)]
                    yield pd.DataFrame([(int(np.mod(x.keys[0], parts)), len(x), x.packed()) for x in own], columns=["part", "n", "payload"])

        def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            h = [Segment.unpacked(p) for p in pdf.sort_values("n", ascending=False)["payload"]]
            s = h[0]
            for x in h[1:]:
                s = s.merged(x)
            return pd.DataFrame([(key[0], len(s), s.packed())], columns=["part", "n", "payload"])

        both = self._read(a["name"]).unionByName(self._read(b["name"])).mapInPandas(split, self.PARTS)
        return self._write(both.groupBy("part").applyInPandas(join, self.PARTS), parts)
