"""Timestamps, packed fields and spikes, on small fixtures and against plainer computations."""

import math
import random
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import zones
from tallyforge.operators.packed import report_items, unpack
from tallyforge.operators.spikes import esd_limit, implausible_counts, spikes
from tallyforge.operators.timestamps import WHOLE, Reader, mask, normalise_moments

CASES = [
    ("2026-01-04T22:18:13Z", "2026-01-04T22:18:13Z"),
    ("2026-01-06T17:51:57.999+01:00", "2026-01-06T16:51:57Z"),
    ("Mon, 05 Jan 2026 00:17:19 +0530", "2026-01-04T18:47:19Z"),
    ("09/01/2026, 3:02 AM", "2026-01-08T21:32:00Z"),
    ("07/01/2026, 5:31 a.m.", "2026-01-07T00:01:00Z"),
    ("12/01/2026, 12:17 a.m.", "2026-01-11T18:47:00Z"),
    ("04/13/2026", "2026-04-13"),
    ("१०/०१/२०२६", "2026-01-10"),
    ("12 / 01 / 2026", "2026-01-12"),
    ("08/01", "2026-01-08"),
    ("20260105", "2026-01-05"),
    ("Wed 07-Jan-26", "2026-01-07"),
    ("Jan 08, 2026", "2026-01-08"),
    ("1781793086", "2026-06-18T14:31:26Z"),
    ("31/02/2026", None),
    ("00/00/2026", None),
    ("29/02/2026", None),
    ("kal", None),
    ("", None),
    (None, None),
]
MOMENTS = [
    ("shuru 25 Oct 2026, 01:30 Europe/London", "2026-10-25T00:30:00Z"),  # twice: the first
    ("shuru 2026-03-29 01:30 [Europe/London]", "2026-03-29T01:30:00Z"),  # skipped: the offset before
    ("waqt [6:10 p.m., 25/05/2026]", "2026-05-25T12:40:00Z"),
    ("sent ts 1772848645", "2026-03-07T01:57:25Z"),
    ("recorded 4 Oct 2026 00h45", "2026-10-03T19:15:00Z"),
    ("x 19/07/2026 09:20 AEST", "2026-07-18T23:20:00Z"),
    ("call: 1491420186", None),
    ("dinank 9/6/2026 kohsar paath 3129 martaba", None),
    ("phone 2026-13-45 10:00", None),
]


def test_notations():
    assert Reader().read([c for c, _ in CASES], [None] * len(CASES))[0] == [w for _, w in CASES]
    assert Reader().read([c for c, _ in MOMENTS], [None] * len(MOMENTS), True)[0] == [w for _, w in MOMENTS]


@pytest.mark.parametrize(
    "junk, good, want",
    [
        ("31122026", "20260105", "2026-01-05"), ("12345678", "20260105", "2026-01-05"), ("2026-01-05 10:00 asia/kolkata", "2026-01-05 10:00 Asia/Kolkata", "2026-01-05T04:30:00Z"),
        ("2026-01-05 10:00 IST+5:30", "2026-01-05 10:00 UTC+5:30", "2026-01-05T04:30:00Z"), ("2026-01-05 10:00 Asia/may", "2026-01-05 10:00 Asia/May", "2026-01-05T04:30:00Z"),
    ],
)
def test_an_unreadable_string_does_not_spoil_its_likes(junk, good, want):
    assert Reader().read([junk, good], [None, None])[0] == [None, want]
    assert Reader().read([good, junk], [None, None])[0] == [want, None]


def test_an_impossible_moment_in_a_text_is_passed_over():
    texts = ["from 31/02/2026 10:00 to 5/1/2026 10:30 IST", "x 2026-13-45 10:00, 30/02/2026 11:00, then [6:10 p.m., 25/05/2026] end", "25:10 05/01/2026 and 31/02/2026 10:00", "31/02/2026 10:00 05/03/2026"]
    assert Reader().read(texts, [None] * 4, True)[0] == ["2026-01-05T05:00:00Z", "2026-05-25T12:40:00Z", None, "2026-03-05T04:30:00Z"]


def test_strings_of_one_mask_fit_the_same_patterns():
    r, fits = random.Random(1), {}
    tokens = "1 12 2026 20260105 31122026 1772848645 1772848645000 05 Jan jan MAY sept Mon sunday am PM a p m T Z IST EST UTC GMT utc Asia asia Kolkata kolkata New York st th at on h T at".split()
    starts = ["", "", "2026-01-05 10:00 ", "5/1/2026 10:00", "10:00 ", "5 Jan 2026", "Mon, ", "10:00 am IST "]
    for _ in range(60_000):
        s = r.choice(starts) + "".join(r.choice(tokens) + r.choice(["", "", " ", "-", "/", ":", ".", ", ", "+", "_"]) for _ in range(r.randint(1, 4)))
        s = " ".join(s.split()) + r.choice(["", "", "]", ")"])
        fit = tuple(i for i, p in enumerate(WHOLE) if p.fullmatch(s))
        assert fits.setdefault(mask(s), (fit, s))[0] == fit, (s, fits[mask(s)])


@pytest.mark.parametrize("zone", ["Europe/London", "America/New_York", "Australia/Sydney", "Asia/Dubai"])
def test_zone_tables_agree_with_the_library(zone):
    import numpy as np

    r = random.Random(zone)
    wall = [datetime(2026, r.randint(1, 12), r.randint(1, 28), r.randint(0, 23), r.randint(0, 59)) for _ in range(500)] + [datetime(2026, m, d, h, 30) for m in (3, 4, 10, 11) for d in range(1, 29) for h in (0, 1, 2, 3)]
    want = [int(w.replace(tzinfo=ZoneInfo(zone)).timestamp()) for w in wall]
    got = zones.to_utc(np.array([int(w.replace(tzinfo=timezone.utc).timestamp()) for w in wall]), zone)
    assert got.tolist() == want
    assert zones.to_utc(np.array([0]), "No/Where") is None


def test_home_zone_and_plain_dates(spark, blocks_of):
    b = blocks_of([(1, "09/01/2026, 3:02 AM", "A​b  C", "x"), (2, "09/01/2026", "A", None), (3, "01/13/2026", None, ""), (1, "09/01/2026, 3:02 AM", "A​b  C", "x")])
    z = spark.createDataFrame([("ab c", "Europe/London"), (None, "Asia/Dubai"), ("q", None)], "sender string, home_zone string")
    got = {tuple(r) for r in normalise_moments(b.withColumn("field", F.lit(1)).withColumn("home_zone", F.lit("?")), z).collect()}
    assert got == {(1, "envelope_date", "2026-01-09T03:02:00Z"), (3, "envelope_date", "2026-01-13")}
    assert normalise_moments(b.limit(0), z.limit(0)).count() == 0


def test_packed_fields(spark, blocks_of):
    rows = [
        (1, None, None, '21,10, 26 Ookpura\n"2542 Sabah Tasbeeh| mubarak"|1661 Gulzar Paath Pak|990 Shabnam Tasbeeh'),
        (2, None, None, "aaj ki ginti: mala neelam=3171; parbat paath=5521\nwaqt २५/०९/२०२६ १०:०१ IST"),
        (3, None, None, "Sabah Mala 392 martba Mehtab Mantra 843 bar"),
        (4, None, None, "Sabah Mala 392\ncall: +91-12076-50446"),
        (5, None, None, None),
        (6, None, None, "  \n "),
        (7, None, None, "a b 1; 0 c 2; 'd, e 3'"),
        (8, None, None, "7376 Gulzar Paath ; -7846 जैतून वजीफ"),
    ]
    got = {}
    for r in report_items(blocks_of(rows)).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.value)
    assert got == {1: ["2542 Sabah Tasbeeh| mubarak", "1661 Gulzar Paath Pak", "990 Shabnam Tasbeeh"], 2: ["mala neelam=3171", "parbat paath=5521"], 7: ["a b 1", "d, e 3"], 8: ["7376 Gulzar Paath", "-7846 जैतून वजीफ"]}
    u = unpack(spark.createDataFrame([("x; 'a; b' ;; y",), ("one",), ("",), (None,)], "text string")).collect()
    assert [(r.pos, r.piece) for r in u] == [(1, "x"), (2, "'a; b'"), (3, "y"), (1, "one")]


def test_split_and_restore_keep_every_character(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "b", " ", ";", ",", "'", '"', "“", "”", "1", "\n", "", ""]) for _ in range(r.randint(0, 25))) for _ in range(200)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {}
    for x in unpack(d, delimiters="[;,\\n]").collect():
        got.setdefault(x.id, []).append(x.piece)
    for i, t in enumerate(texts):
        assert "".join("".join(got.get(i, [])).split(" ")) == "".join(c for c in _outside(t) if c not in " "), t


def _outside(t):
    """Brute force: the text without the delimiters that no quote encloses."""
    import regex

    q = regex.compile(r"\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|(?<![\p{L}\p{M}\p{Nd}])['‘][^'’\n]+['’](?![\p{L}\p{M}\p{Nd}])")
    out, at = [], 0
    for m in q.finditer(t):
        out += [c for c in t[at : m.start()] if c not in ";,\n"] + [c for c in m[0] if c != "\n"]
        at = m.end()
    return out + [c for c in t[at:] if c not in ";,\n"]


def test_esd_limit_grows_with_n():
    assert 2.2 < esd_limit(15, 1, 0.05) < 2.8 < esd_limit(100, 1, 0.05) < 3.6
    assert esd_limit(4, 1, 0.05) == math.inf


def test_spikes_runs_and_range(spark):
    r = random.Random(5)
    rows = [("s", "a", i, 1, r.randint(700, 1300)) for i in range(80)] + [("s", "a", 200, 1, 9900), ("s", "a", 201, 1, 40), ("s", "a", 202, 1, -5)]
    rows += [("s", "a", 300 + i, 1, 1000) for i in range(12)] + [("c", "b", i, 1, 50) for i in range(40)]
    rows += [("t", "a", i, 1, int(1000 * 1.03**i)) for i in range(60)]
    d = spark.createDataFrame([(*x, datetime(2026, 1, 1).date()) for x in rows + [rows[0]] + [("s", "a", 900, 1, None), ("", "a", 901, 1, -1)]], "source string, label string, row long, part int, value long, day date")
    for chunk in (50_000, 5):
        got = {(x.row, x.why) for x in spikes(d, chunk=chunk).collect()}
        assert got == {(200, "spike"), (201, "spike"), (202, "range")} | {(300 + i, "stuck") for i in range(12)}
    assert spikes(d.limit(0)).count() == 0


def test_counts_by_sender(spark, blocks_of):
    b = blocks_of([(i, "01/01/2026", "A​ b" if i % 2 else "a B", "x") for i in range(30)] + [(100 + i, None, "few", "x") for i in range(5)])
    e = spark.createDataFrame([(i, 1, "SABAH MALA" if i % 3 else "sabh mala", 100 + i) for i in range(30)] + [(30, 1, "SABAH MALA", 7), (5, 2, "sabah malaa", 9000), (6, 2, None, None), (100, 1, "x", -4)], "msg_id long, seq int, chant string, count long")
    lst = spark.createDataFrame([(1, "SABAH MALA")], "ord int, chant string")
    var = spark.createDataFrame([("सबाह माला", "SABAH MALA")], "key string, canonical string")
    assert {(r.msg_id, r.seq) for r in implausible_counts(e.withColumn("label", F.lit(1)), b, lst, var).collect()} == {(5, 2)}


def test_spans_hold_what_whole_texts_do():
    """Moments found by the masks of spans are those that every notation, tried on the whole text, finds; whatever came before."""
    import random

    from tallyforge.operators import timestamps as ts

    rnd, reader = random.Random(3), ts.Reader()
    parts = "12 03 2026 26 10:30 9.45 7h15 am PM p.m. at on T @ , . / - : + IST UTC GMT +05:30 Asia/Kolkata Foo/Bar foo March may sept Monday tue st nd th ( ) [ ] x ké क ts= epoch 1768000000 1768000000123 Z ZZ 12/03/2026 2026-03-12 \n".split(" ")

    def whole(s):
        hits = [(m.start(), -m.end(), i, m) for i, p in enumerate(ts.INSIDE) if (m := p.search(s))]
        return min(hits, key=lambda h: h[:3])[3] if hits and ts._MAYBE.search(s) else None

    for _ in range(20_000):
        s = "".join(rnd.choice(parts) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(2, 9)))
        a, (b, _, begin) = whole(s), reader._inside(s)
        assert (a and (a.start(), a.groupdict())) == (b and (begin, b.groupdict())), s


def test_envelope_values_in_any_order_and_of_any_length():
    from tallyforge.operators.timestamps import Reader

    values = ["12/03/2026 10:00 foo/bar", "12/03/2026 10:00 Asia/Tokyo", " " * 200 + "12 March 2026 10:00", "31122026", "20260105", "2050-07-01 12:00 Europe/London", "1850-01-01 00:00 UTC", "0000-01-01 10:00"]
    want = [None, "2026-03-12T01:00:00Z", "2026-03-12T04:30:00Z", None, "2026-01-05", "2050-07-01T11:00:00Z", "1850-01-01T00:00:00Z", None]
    for turn in (1, -1):
        assert Reader().read(values[::turn], [None] * len(values))[0][::turn] == want


def test_placeholders_of_last_resort(spark):
    """A text that holds all the private pairs, and runs of them, still comes apart and together rightly."""
    from tallyforge.operators.packed import PRIVATE, unpack

    private = "".join(x for p in PRIVATE for x in p)
    text = f'a{private};"x;{PRIVATE[0][0] * 3}"{PRIVATE[0][0]};b "p,q""r" c'
    got = [r.piece for r in unpack(spark.createDataFrame([(text,)], "text string")).orderBy("pos").collect()]
    assert got == [f"a{private}", f'"x;{PRIVATE[0][0] * 3}"{PRIVATE[0][0]}', 'b "p,q""r" c']
