"""Mixed timestamp notations and zones to one unambiguous form.

Every string is reduced to a character-class shape mask; each distinct mask is mapped to a parser once and kept. A
string that is a date as a whole is masked as a whole. In a longer text the spans made of nothing but numbers, month, day
and zone names and what stands between them are masked, with a character before and a word after; a span's mask is mapped to the
notations that it holds, and hits that are no possible moment are passed over. A mask holds all that the patterns look
at, so what a mask is mapped to does not depend on the string that showed it first. All strings of one notation are then
converted together, with numpy calendar arithmetic and zone transition tables of one release (`zones.VERSION`).

Defined results: null, blank, unreadable and impossible values give no row; a date without a year takes
`default_year`; the day comes before the month unless that is impossible; a time without a zone takes the
row's home zone, else `default_zone`; a date without a time comes out as the plain date.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import zones
from tallyforge.functions.chars import fold, sender_key
from tallyforge.session import spread

MONTHS = {m: i // 2 + 1 for i, m in enumerate("jan january feb february mar march apr april may may jun june jul july aug august sep september oct october nov november dec december".split())} | {"sept": 9}
DAYS = "mon monday tue tuesday wed wednesday thu thursday fri friday sat saturday sun sunday tues thur thurs".split()
_ABBR = "|".join(sorted((a for a in zones.ABBREVIATIONS if a != "Z"), key=len, reverse=True))
_MON = "|".join(sorted(MONTHS, key=len, reverse=True))
_DOW = "|".join(sorted(DAYS, key=len, reverse=True))
_OFF = r"[+-]\d\d:?\d\d"
_REGION = r"[A-Z][A-Za-z]+(?:/[A-Z][A-Za-z_]+)+"
_ZONE = rf"(?:\s*[\[(]?(?:(?:UTC|GMT)\s?(?P<off2>[+-]\d\d?(?::?\d\d)?)|(?P<off>{_OFF})|(?P<abbr>Z|{_ABBR})\b|(?P<region>{_REGION}))[\])]?)?"
_TIME = r"(?P<h>\d{1,2})(?P<tsep>[:.h])(?P<mi>\d\d)(?:(?P=tsep)(?P<s>\d\d)(?:[.,]\d{1,9})?)?(?:\s?(?P<ap>[APap])\.?[Mm]\b\.?)?"
_NUM = r"(?P<a>\d{1,2})\s?(?P<sep>[./-])\s?(?P<b>\d{1,2})\s?(?P=sep)\s?(?P<y>\d{4}|\d\d)"
_ISO = r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})"
_NAMED = rf"(?:(?:(?i:{_DOW}))\.?,?\s)?(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s-](?P<mon>(?i:{_MON}))\.?,?[\s-](?P<y>\d{{4}}|\d\d)"
_MDY = rf"(?:(?:(?i:{_DOW}))\.?,?\s)?(?P<mon>(?i:{_MON}))\.?\s(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s(?P<y>\d{{4}})"
_JOIN = r"(?:T|,?\s|\s@\s|,?\sat\s)"
_EPOCH = r"(?P<epoch>\d{13}|\d{10})"

#: Date followed by a time of day, tried in this order.
DATED = [rf"{d}{_JOIN}{_TIME}{_ZONE}" for d in (_ISO, _NUM, _NAMED, _MDY)]
#: Time of day followed by a date.
TIMED = [rf"\[?{_TIME}{_ZONE}(?:,?\s|\son\s){d}\]?" for d in (_NUM, _ISO, _NAMED, _MDY)]
#: Dates alone.
PLAIN = [_ISO, _NUM, r"(?P<a>\d{1,2})(?P<sep>[./-])(?P<b>\d{1,2})", _NAMED, _MDY, r"(?P<y>20\d\d)(?P<m>\d\d)(?P<d>\d\d)"]
WHOLE = [re.compile(rf"\s*(?:{p})\s*") for p in [*DATED, *TIMED, *PLAIN, _EPOCH]]
#: Where a text states a moment; digits and letters must not go on before or after it.
INSIDE = [re.compile(rf"(?<![\w+/.:-])(?:{p})(?![\d:]|[.,/-]\d)") for p in [*DATED, *TIMED]] + [re.compile(rf"(?<!\w)(?:ts|ms|epoch|t|unix|timestamp)\s?[=:]?\s?{_EPOCH}(?!\d)")]

_WORD = re.compile(r"[A-Za-z]+|\d+")
#: Bounds what a worker remembers; beyond it the memory starts afresh.
MAX_MASKS = 50_000
#: Masks longer than this are not remembered, only worked out.
LONG_MASK = 300
#: Parts into which a sender's rows are spread for the join with its zone.
SALTS = 16


def mask(s: str) -> str:
    """Shape of `s`: digit runs by length, month and day names, day halves and zones by class.

    It holds all that the patterns look at, so that strings of one mask fit the same patterns at the same tokens: eight digits
    that begin with 20, UTC and GMT apart from other zones, the words before a count of seconds, and whether a word begins
    with a capital, as regions do.
    """

    def shape(m: re.Match) -> str:
        w = m[0]
        if w[0].isdigit():
            return "20dddddd" if len(w) == 8 and w.startswith("20") else "9" * len(w) if len(w) < 15 else "9+"
        low = w.lower()
        if low in ("am", "pm"):
            return "<half>" if w[0].islower() else "<HALF>"
        if len(w) < 3 or w in ("epoch", "unix", "timestamp"):
            return w
        kind = "mon" if low in MONTHS else "day" if low in DAYS else w if w in ("UTC", "GMT") else "zone" if w in zones.ABBREVIATIONS else "w"
        return f"<{kind.upper() if w[0].isupper() and kind.islower() else kind}>"

    return _WORD.sub(shape, s)


def days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * ((m + 9) % 12) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _ints(g: list[dict], k: str, default: int = 0) -> np.ndarray:
    return np.array([int(x[k]) if x.get(k) else default for x in g], dtype=np.int64)


def _offset(s: str) -> int:
    t = s[1:].replace(":", "")
    return (-1 if s[0] == "-" else 1) * (int(t[:-2] if len(t) > 2 else t) * 60 + (int(t[-2:]) if len(t) > 2 else 0)) * 60


def convert(parts: list[dict], homes: list[str | None], default_year: int, default_zone: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(readable, has a time, UTC seconds or day number * 86400, day number as written) of strings that one notation fits.

    A count of seconds since 1970 has no written date; it counts as the date in its home zone.
    """
    n, first = len(parts), parts[0]
    if "epoch" in first:
        v = np.array([int(x["epoch"]) // (1000 if len(x["epoch"]) == 13 else 1) for x in parts], dtype=np.int64)
        wall = v.copy()
        for z in {h or default_zone for h in homes}:
            if t := zones.table(z):
                at = np.array([(h or default_zone) == z for h in homes])
                # offsets by UTC: a wall threshold less the larger offset is the moment of the change
                utc_at = t[0] - np.maximum(t[1][1:], t[1][:-1])
                wall[at] = v[at] + t[1][np.searchsorted(utc_at, v[at], side="right")]
        return np.ones(n, bool), np.ones(n, bool), v, wall // 86400
    y = _ints(parts, "y", default_year)
    y = np.where(np.array([len(x.get("y") or "") == 2 for x in parts]), y + 2000, y)
    if "a" in first:
        a, b = _ints(parts, "a"), _ints(parts, "b")
        swap = (b > 12) & (a <= 12)
        d, m = np.where(swap, b, a), np.where(swap, a, b)
    else:
        d = _ints(parts, "d")
        m = np.array([MONTHS[x["mon"].lower()] for x in parts], dtype=np.int64) if "mon" in first else _ints(parts, "m")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 1, 12) - 1] + (leap & (m == 2))
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= last)
    day = days(y, m, d)
    if "h" not in first:
        return ok, np.zeros(n, bool), day * 86400, day
    h, mi, s = _ints(parts, "h"), _ints(parts, "mi"), _ints(parts, "s")
    half = np.array([(x.get("ap") or "-").lower() for x in parts])
    ok &= np.where(half == "-", h < 24, (h >= 1) & (h <= 12)) & (mi < 60) & (s < 61)
    h = np.where(half == "-", h, h % 12 + np.where(half == "p", 12, 0))
    wall = day * 86400 + h * 3600 + mi * 60 + s
    utc = wall.copy()
    by: dict[str | int, list[int]] = {}
    for i, x in enumerate(parts):
        o = x.get("off") or x.get("off2")
        z = _offset(o) if o else zones.ABBREVIATIONS[x["abbr"]] * 60 if x.get("abbr") else x.get("region") or homes[i] or default_zone
        by.setdefault(z, []).append(i)
    for z, at in by.items():
        if isinstance(z, int):
            utc[at] = wall[at] - z
        elif (u := zones.to_utc(wall[at], z)) is not None:
            utc[at] = u
        elif (u := zones.to_utc(wall[at], default_zone)) is not None:
            utc[at] = u
    return ok, np.ones(n, bool), utc, day


class Reader:
    """Maps masks to parsers, once each, and converts many strings at a time."""

    def __init__(self, default_year: int = 2026, default_zone: str = "Asia/Kolkata"):
        self.year, self.zone = default_year, default_zone
        #: Mask of a whole string -> its pattern or None; mask of a span -> the patterns that it holds.
        self.whole: dict[str, re.Pattern | None] = {}
        self.held: dict[str, list[re.Pattern]] = {}

    def _parser(self, s: str) -> re.Pattern | None:
        shape = mask(s)
        if shape not in self.whole:
            found = next((p for p in WHOLE if p.fullmatch(s)), None)
            if len(shape) > LONG_MASK:
                return found
            if len(self.whole) >= MAX_MASKS:
                self.whole.clear()
            self.whole[shape] = found
        return self.whole[shape]

    def _holds(self, span: str, lead: int) -> list[re.Pattern]:
        """Patterns that a span holds; its first `lead` characters stand before it."""
        shape = f"{lead}{mask(span)}"
        if (found := self.held.get(shape)) is None:
            found = [p for p in INSIDE if p.search(span, lead)]
            if len(shape) <= LONG_MASK:
                if len(self.held) >= MAX_MASKS:
                    self.held.clear()
                self.held[shape] = found
        return found

    def read(self, values: list[str | None], homes: list[str | None], inside: bool = False) -> tuple[list[str | None], list[int | None]]:
        """UTC strings (or plain dates) and written day numbers; None where there is none. inside: the moment stands in a longer text."""
        out: list[str | None] = [None] * len(values)
        written: list[int | None] = [None] * len(values)
        todo = [(i, fold(v), 0) for i, v in enumerate(values) if isinstance(v, str)]
        while todo:  # again only for texts whose first hit is an impossible moment
            groups: dict[re.Pattern, tuple[list[int], list[dict], list[tuple[int, str, int]]]] = {}
            for i, s, start in todo:
                if inside:
                    hit, p, begin = self._inside(s, start)
                else:
                    s = " ".join(s.split())
                    p = self._parser(s)
                    hit, begin = p and p.fullmatch(s), 0
                if hit:
                    g = groups.setdefault(p, ([], [], []))
                    g[0].append(i)
                    g[1].append(hit.groupdict())
                    g[2].append((i, s, begin + 1))
            todo = []
            for at, parts, rest in groups.values():
                ok, timed, sec, day = convert(parts, [homes[i] for i in at], self.year, self.zone)
                text = np.datetime_as_string(sec.astype("datetime64[s]"), unit="s")
                for j, i in enumerate(at):
                    if ok[j]:
                        out[i] = f"{text[j]}Z" if timed[j] else str(text[j][:10])
                        written[i] = int(day[j])
                    elif inside:
                        todo.append(rest[j])
        return out, written

    def _inside(self, s: str, start: int = 0) -> tuple[re.Match | None, re.Pattern | None, int]:
        """The first moment from `start` on that fits a notation, and where it begins; where two begin at one place, the longer."""
        if not _MAYBE.search(s, start):
            return None, None, 0
        for m in SPAN.finditer(s):
            if m.end() <= start or not _MAYBE.search(m[0]):
                continue
            off, lead = max(0, m.start() - 1), min(1, m.start())
            span = s[off : TAIL.match(s, m.end()).end()]
            best: tuple[re.Match | None, re.Pattern | None] = (None, None)
            for p in self._holds(span, lead):
                h = p.search(span, max(lead, start - off))
                if h and (best[0] is None or (h.start(), -h.end()) < (best[0].start(), -best[0].end())):
                    best = h, p
            if best[0]:
                return *best, off + best[0].start()
        return None, None, 0


_MAYBE = re.compile(r"\d[:.h]\d\d|\d{10}")
TAIL = re.compile(r"[A-Za-z]*.?", re.DOTALL)
#: What a moment is made of: numbers, names of months, days and zones, and what stands between them.
SPAN = re.compile(
    rf"(?:{_REGION}|\d+(?:(?:st|nd|rd|th|h|T|Z|[APap]\.?[Mm]|UTC|GMT|{_ABBR})(?![A-Za-z]))?|[\s.,:/+@()\[\]=-]"
    rf"|(?<![A-Za-z])(?:(?i:{_DOW}|{_MON})|UTC|GMT|Z|{_ABBR}|[APap]\.?[Mm]|at|on|ts|ms|t|epoch|unix|timestamp)(?![A-Za-z]))+"
)


def moments(rows: DataFrame, default_year: int = 2026, default_zone: str = "Asia/Kolkata") -> DataFrame:
    """(id, field, value, inside, home_zone) -> (id, field, utc): one row for each readable value.

    All processes must have the same release of the zone database; a differing one is an error, not a differing result.
    """
    release = zones.VERSION

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if zones.VERSION != release:
            raise RuntimeError(f"zone database {zones.VERSION} here, {release} on the driver")
        reader = Reader(default_year, default_zone)
        for b in batches:
            homes = [h if isinstance(h, str) else None for h in b["home_zone"]]
            utc = np.array([None] * len(b), dtype=object)
            for inside in (False, True):
                at = np.flatnonzero(b["inside"].to_numpy() == inside)
                if len(at):
                    utc[at], _ = reader.read([b["value"].iat[i] for i in at], [homes[i] for i in at], inside)
            keep = pd.notna(utc)
            yield pd.DataFrame({"id": b["id"][keep], "field": b["field"][keep], "utc": utc[keep]})

    return rows.mapInPandas(run, "id long, field string, utc string")


def written_day(col: Column) -> Column:
    """Days since 1970-01-01 of the calendar date as written, in whatever notation; null if unreadable. dd/mm/yyyy stays in the JVM."""

    @F.pandas_udf("int")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader()
        for b in batches:
            v = [x if isinstance(x, str) else None for x in b]
            yield pd.Series(pd.array(reader.read(v, [None] * len(v))[1], dtype="Int32"))

    plain = col.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$") & (F.substring(col, 4, 2) <= "12")
    return F.when(plain, F.datediff(F.try_to_timestamp(col, F.lit("dd/MM/yyyy")).cast("date"), F.lit("1970-01-01"))).otherwise(read(F.when(~plain, col)))


def with_home_zone(rows: DataFrame, sender_zones: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds home_zone by the sender's folded name. The zone table grows with the data, so the planner picks the join; a sender's rows are spread by id over `salts` copies of its zone."""
    z = sender_zones.select(sender_key(F.col("sender")).alias("_zk"), F.col("home_zone").alias("_hz")).where("_zk <> '' and _hz is not null").groupBy("_zk").agg(F.min("_hz").alias("home_zone"))
    z = z.select("_zk", "home_zone", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_zs"))
    return rows.withColumn("_zk", sender_key(F.col("sender"))).withColumn("_zs", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(z, ["_zk", "_zs"], "left").drop("_zk", "_zs")


def normalise_moments(blocks: DataFrame, sender_zones: DataFrame, default_year: int = 2026, default_zone: str = "Asia/Kolkata") -> DataFrame:
    """(id, field, utc) of every envelope_date not yet dd/mm/yyyy and every moment stated in a text. Repeated rows come out once."""
    b = spread(blocks.select(F.col("id").cast("long").alias("id"), "sender", "envelope_date", "text"))
    env = b.where(F.col("envelope_date").isNotNull() & (F.trim("envelope_date") != "") & ~(F.col("envelope_date").rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$") & (F.substring("envelope_date", 4, 2) <= "12"))).select("id", "sender", F.lit("envelope_date").alias("field"), F.col("envelope_date").alias("value"), F.lit(False).alias("inside"))
    txt = b.where(F.col("text").rlike(r"\p{Nd}{2}[\p{Nd}\p{Cf}\p{Mn}]*[^\p{L}\p{Nd}]|\p{Nd}{10}|\p{Nd}{2}$|\p{Nd}T")).select("id", "sender", F.lit("text").alias("field"), F.col("text").alias("value"), F.lit(True).alias("inside"))
    return moments(with_home_zone(env.unionByName(txt), sender_zones), default_year, default_zone).dropDuplicates()
