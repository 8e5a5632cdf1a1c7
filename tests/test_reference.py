"""Reference operators on small fixtures, and every query with SQL against DuckDB over the smallest tables."""

import glob
import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyforge.functions import text as T
from tallyforge.operators import lexicon, messages, quality, report, resolve
from tallyforge.sources import readers, writers

DATA = "/root/testdata/sf0.001"


def one(spark, value, *exprs):
    return spark.createDataFrame([value], "text string, ref int").select(*exprs).first()


@pytest.mark.parametrize(
    "text, ref, want",
    [
        ("9, 4 26 x 100", 2026, [100]), ("9, 4 26 x 100", 2027, [100]), ("9, 4 26 x 100", 2029, [9, 4, 26, 100]), ("x 11 13 26 y", 2026, [11, 13, 26]), ("x 41 4 26 y", 2026, [41, 4, 26]),
        ("x 40 9 10 26 y 5", 2026, [40, 9, 10, 26, 5]), ("40 9 10 26 x", 2026, [40]), ("1. sabah 12\n2) shaam 13", 2026, [12, 13]), ("दुरूद एक बार, sau martba", None, [1, 100]), ("15 sau bar", None, [15]), ("१२१ बार", None, [121]),
        ("dinank 23 2026 x 5", None, [5]), ("07-04026 x 5", None, [5]), ("", 2026, []), ("99999999999999999999 x", None, [None]), ("list 100 200 1 4 26 end", 2026, [100, 200]),
    ],
)
def test_numbers_in(spark, text, ref, want):
    assert one(spark, (text, ref), T.numbers_in(F.col("text"), F.col("ref")).alias("n")).n == want


def test_phrases_and_keys(spark):
    a = one(spark, ("Yaseen Sharif nafisa bi durood Sharif 500 martaba, bismillah", None), T.atoms(F.col("text"), F.col("ref")).alias("a")).a
    assert [x.text if x.kind == "phrase" else x.value for x in a] == ["Yaseen Sharif", "durood Sharif", 500, "bismillah"]
    k = lambda s: one(spark, (s, None), T.simplify(F.col("text")).alias("k")).k
    assert k("  Durood-SHARIF 12 ") == "durood sharif" and k("दुरूद") == "दरद" and k("کیف") == k("كيف") and k("éa") == "éa"


@pytest.mark.parametrize("line, want", [("[4:48 am, 08/04/2026] A B: x: y", ("4:48 am", "08/04/2026", "A B", "x: y")), ("08/04, 6:13 pm - A: z", ("6:13 pm", "08/04", "A", "z")), ("08/04/2026, 9:49 am - A left", None), ("hello", None)])
def test_headers(spark, line, want):
    r = one(spark, (line, None), T.header(F.col("text")).alias("h"), T.is_notice(F.col("text")).alias("n"))
    assert (tuple(r.h) if r.h else None) == want and r.n == ("left" in line)


def test_times_dates_weeks(spark):
    t = lambda s: one(spark, (s, None), T.seconds_of_day(F.col("text")).alias("t")).t
    assert [t("12:05 am"), t("12:05 p.m."), t("11:49:30 PM"), t("x")] == [300, 43500, 85770, None]
    d = lambda s, **k: one(spark, (s, None), T.parse_date(F.col("text"), **k).alias("d")).d
    assert d("1.4.26") == date(2026, 4, 1) and d("31/02/2026") is None and d("24/02") == date(2026, 2, 24) and d("4/1/26", month_first=True) == date(2026, 4, 1) and d("24/02", default_year=None) is None
    w = spark.createDataFrame([(date(2026, 4, 8),), (date(2026, 3, 31),), (date(2025, 12, 31),)], "d date").select(T.week_label(T.week_start(F.col("d"))).alias("w"), T.week_start(F.col("d"), 6).alias("s")).collect()
    assert [r.w for r in w] == ["06-to-12-Apr-2026.txt", "30-Mar-to-05-Apr-2026.txt", "29-Dec-2025-to-04-Jan-2026.txt"] and w[0].s == date(2026, 4, 5)


def test_sessions_and_glue(spark):
    lines = ["junk", "[4:48 am, 08/04/2026] A: one [5:00 am, 08/04/2026] B: two", " more", "08/04/2026, 9:49 am - A left", "lost", "[6:00 am, 08/04/2026] A: end"]
    d = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], readers.LINES)
    got = [(r.sender, r.body) for r in messages.sessionize(d, notices_close=True).orderBy("msg_no").collect()]
    assert got == [("A", "one"), ("B", "two\n more".replace("\n more", "\n more")), ("A", "end")]
    assert messages.sessionize(d.limit(0)).count() == 0


def test_merge_keeps_greatest_multiplicity(spark):
    rows = [(0, "a"), (1, "a"), (1, "a"), (1, "ab"), (1, "b"), (2, "b"), (0, "bc"), (1, "bc d")]
    d = spark.createDataFrame([(s, date(2026, 1, 1), 5, "x", b, [b], i) for i, (s, b) in enumerate(rows)], "src_idx int, msg_date date, seconds int, sender string, body string, lines array<string>, seq int")
    assert sorted(r.body for r in messages.merge_log(d).collect()) == ["a", "ab", "bc d"]
    one_paste = d.where("src_idx = 1")
    assert sorted(r.body for r in messages.merge_log(one_paste).collect()) == ["a", "a", "ab", "b", "bc d"]


def test_truncated_bodies_against_brute_force(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.choice(["x", None]), r.randint(0, 2), None if i % 50 == 7 else "".join(r.choice("ab") for _ in range(r.choice([0, 1, 2, 5, 7, 8, 9, 12])))) for i in range(300)]
    rows += [(1000 + i, "y", i % 2, "abcdefgh" * 3 + "ij"[: i % 3]) for i in range(12)]
    d = spark.createDataFrame(rows, "id int, k string, s int, body string")
    want = {i for i, k, s, b in rows if b is None or not any(k == k2 and s2 != s and b2 is not None and len(b2) > len(b) and b2.startswith(b) for _, k2, s2, b2 in rows)}
    assert {x.id for x in messages.drop_truncated(d, ["k"], "s").collect()} == want
    assert messages.drop_truncated(d.limit(0), ["k"], "s").count() == 0


def test_pairing(spark):
    item = lambda x: ("L", x, None) if isinstance(x, str) else ("N", None, x)
    streams = [["a", 121, "b", 30], [5, "a", 6, "b"], ["a", "b", 1, 2], ["a", 1, "b"], [], ["a", 1, 2, 3], [1]]
    d = spark.createDataFrame([(i, [item(x) for x in s]) for i, s in enumerate(streams)], "id int, s array<struct<k:string,l:string,n:bigint>>")
    s = F.col("s")
    r = d.select("id", resolve.pair_stream(s).alias("p"), resolve.without_trailing_label(s).alias("t"), resolve.carry_forward(s).alias("c"), resolve.pair_error(s).alias("e")).orderBy("id").collect()
    f = lambda p: None if p is None else [tuple(x) for x in p]
    assert [f(x.p) for x in r] == [[("a", 121), ("b", 30)], [("a", 5), ("b", 6)], None, None, [], None, None]
    assert f(r[3].t) == [("a", 1)] and f(r[5].c) == [("a", 1), ("a", 2), ("a", 3)] and r[2].c is None and "two in a row" in r[2].e and "dangling" in r[3].e


def test_cascade(spark):
    dic = lexicon.dictionary(spark.createDataFrame([("durood sharif", "DAROOD"), ("kalma sharif", "KALMA"), ("kalma", "K")], "spelling string, canonical string"))
    b = spark.createDataFrame([(1, "13/03", "A", "Durood Sharif 121 martba kalma Sharif 30"), (2, "13/03", "A", "unknown thing 50"), (3, "13/03", "A", "dup"), (4, "13/03", "T", "x 50 y 7"), (5, None, None, None), (6, "1/1/2026", "A", "kalma shrif 4")], readers.BLOCKS)
    dup = spark.createDataFrame([(" A", "13/03/2026", "dup ", "why")], readers.STORE)
    cor = spark.createDataFrame([("A", "1/1/2026", "kalma shrif 4", "kalma sharif 5", None)], readers.CORRECTIONS)
    tpl = spark.createDataFrame([("T", 1, "P"), ("T", 2, "Q")], "sender string, slot int, chant string")
    fix = spark.createDataFrame([("T", "P", 50, 500)], "sender string, chant string, bad long, good long")
    facts, review = resolve.build(b, dic, dup, dup.limit(0), cor, tpl, fix)
    assert {tuple(r) for r in facts.collect()} == {(1, 1, "13/03/2026", "DAROOD", 121), (1, 2, "13/03/2026", "KALMA", 30), (4, 1, "13/03/2026", "P", 500), (4, 2, "13/03/2026", "Q", 7), (6, 1, "1/1/2026", "KALMA", 5)}
    assert {(r.msg_id, r.level, r.code) for r in review.collect()} == {(3, "INFO", "known-duplicate"), (2, "HARD", "unresolved"), (6, "INFO", "text-correction")}


def test_greedy_tiling_and_rules(spark):
    dic = lexicon.dictionary(spark.createDataFrame([("a", "A"), ("a b", "AB"), ("b c", "BC"), ("c", "C")], "spelling string, canonical string"))
    p = spark.createDataFrame([("a b c",), ("x a b",), ("a b c d",), ("zz",)], "phrase string")
    assert {r.phrase: r.labels for r in lexicon.classify_phrases(p, dic).collect()} == {"a b c": ["AB", "C"], "x a b": ["AB"], "a b c d": ["AB"], "zz": []}
    assert lexicon.sequences("A? B C?") == {"B", "A B", "B C", "A B C"}
    with pytest.raises(ValueError):
        lexicon.compile_rules(spark, {"X": ["a"], "Y": ["a"]}, {})
    words, seqs = lexicon.compile_rules(spark, {"S": ["surah", "sura"], "K": ["kauser"], "Q": ["q"]}, {"ONE": "S? K", "TWO": "Q", "THREE": "Q"})
    keys = spark.createDataFrame([("sura e kauser",), ("q",), ("kauser x",)], "key string")
    assert [tuple(r) for r in lexicon.compose(keys, words, seqs, ["e"]).collect()] == [("sura e kauser", "ONE")]


def test_reconcile_and_flags(spark):
    s = spark.createDataFrame([("d", 5), ("d", 5), ("d", 200), ("e", 1)], "date string, value long")
    f = spark.createDataFrame([("d", 5), ("d", 7), ("e", 1), ("e", None)], "date string, value long")
    assert [tuple(r) for r in quality.reconcile(s, f).collect()] == [("d", 2, 1, 200, "FAIL")]
    assert quality.gate(quality.bag_difference(s, s, ["date", "value"])) == "CLEAN"
    rec = spark.createDataFrame([(1, "a 12 b", [("a", "chant-label"), (" 12", "count"), (" b", "name")]), (2, "a 12", [("a", "x"), ("1 2", "count")]), (3, "a 2025", [("a", "uncertain"), ("2025", "count")])], "id long, text string, segments array<struct<t:string,role:string>>")
    got = {(r.id, r.level, r.code) for r in quality.record_flags(rec).collect()}
    assert got == {(2, "hard", "bad-role"), (2, "hard", "number-census"), (2, "hard", "count-shape"), (3, "hard", "uncertain"), (3, "soft", "year-like-count")}


def test_bag_differences_all_compares_every_number(spark, tmp_path):
    texts = [("d", "a 5 b 12 c 1234567890 d ١٢١ e 007 f 99999999999999999999"), ("d", "g 5"), ("e", "no number"), ("f", "h 300")]
    spark.createDataFrame(texts, "envelope_date string, text string").write.parquet(str(tmp_path / "blocks.parquet"))
    facts = [("d", 5), ("d", 1234567890), ("d", 121), ("d", 8), ("d", None), ("e", -4), ("f", 300)]
    spark.createDataFrame(facts, "date string, count long").write.parquet(str(tmp_path / "extracted.parquet"))
    got = {tuple(x) for x in entry.queries()["bag_differences_all"](spark, str(tmp_path)).collect()}
    assert got == {("d", 5, 1, 0, False), ("d", 12, 1, 0, False), ("d", 7, 1, 0, False), ("d", 8, 0, 1, False), ("d", None, 1, 0, True), ("e", -4, 0, 1, False)}


def test_report_files(spark, tmp_path):
    f = spark.createDataFrame([(1, 1, "02/01", "B", 3), (1, 2, "02/01", "A", 4), (2, 1, "01/01", "B", 5), (3, 1, "Unknown", "C", 6), (4, 1, "01/01", None, 6)], "msg_id long, seq int, date string, chant string, count long")
    order = spark.createDataFrame([("A", 1), ("B", 2), ("Z", 3)], "chant string, ord int")
    writers.write_report(f, order, str(tmp_path))
    assert (tmp_path / "summary.txt").read_text() == "A =4\nB =3+5\nC =6\n"
    assert [r.asDict() for r in report.daily_pivot(f, ["A", "B"]).orderBy("date").collect()] == [{"date": "01/01", "A": 0, "B": 5}, {"date": "02/01", "A": 4, "B": 3}]
    bad = spark.createDataFrame([("d", 500, 1, 0)], "date string, value long, missed long, extra long")
    with pytest.raises(writers.GateError):
        writers.write_report(f, order, str(tmp_path / "no"), bad)
    assert not (tmp_path / "no").exists()


def test_daily_pivot_all_has_every_label(spark, tmp_path):
    rows = [(1, 1, "01/01", "B", 3), (1, 2, "01/01", "free b", 4), (2, 1, "02/01", "Free B", 5), (2, 2, "02/01", "date", 6), (2, 3, "02/01", "a.b `c`", 7), (3, 1, "Unknown", "A", 8), (3, 2, None, "B", 1)]
    spark.createDataFrame(rows, "msg_id long, seq int, date string, chant string, count long").write.parquet(str(tmp_path / "extracted.parquet"))
    spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "ord int, chant string").write.parquet(str(tmp_path / "chant_list.parquet"))
    got = entry.queries()["daily_pivot_all"](spark, str(tmp_path))
    assert got.columns == ["date", "A", "B", "free b", "Free B (2)", "date (2)", "a.b `c`"]
    got.write.parquet(str(tmp_path / "out"))
    assert [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).orderBy("date").collect()] == [("01/01", 0, 3, 4, 0, 0, 0), ("02/01", 0, 0, 0, 5, 6, 7)]


def test_commands_print_every_row(spark, tmp_path, capsys):
    from tallyforge import cli

    (tmp_path / "r.jsonl").write_text("".join(json.dumps({"id": i, "text": f"a {i}\tb", "segments": [{"t": f"a {i}\tb", "role": "uncertain"}]}) + "\n" for i in range(1200)))
    assert cli.main(["classify-verify", str(tmp_path / "r.jsonl")]) == 1
    assert capsys.readouterr().out.splitlines() == ["id\tlevel\tcode\tmessage", *(f"{i}\thard\tuncertain\ta {i}\\tb" for i in range(1200))]
    facts = [{"date": "01/01/2026", "chant": f"C{i:02}", "count": 10**k, "msg_id": 1, "seq": 1} for i in range(26) for k in range(7)]
    (tmp_path / "e.json").write_text(json.dumps(facts))
    (tmp_path / "b.jsonl").write_text(json.dumps({"id": 1, "envelope_date": "01/01/2026", "sender": "S", "text": "t"}) + "\n")
    assert cli.main(["count-profile", str(tmp_path / "e.json"), str(tmp_path / "b.jsonl")]) == 0
    out = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    at = [i for i, x in enumerate(out) if x[0] == "chant"] + [len(out)]
    assert [b - a - 1 for a, b in zip(at, at[1:])] == [26, 26 * 7, 26 * 6, 26 * 7]
    assert out[at[1] + 1 : at[2]] == [[f"C{i:02}", str(k + 1), "1"] for i in range(26) for k in range(7)]
    assert out[at[2] + 1 : at[3]] == [[f"C{i:02}", str(10**k), "1", str(k + 1)] for i in range(26) for k in range(6)]


def test_lines_and_log(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"[4:48 am, 08/04/2026] A: one\r\n two\r[5:00 am, 08/04/2026] B: x\n")
    paths = readers.inbox(str(tmp_path))
    lines = readers.read_lines(spark, paths)
    assert [r.line for r in lines.orderBy("line_no").collect()] == ["[4:48 am, 08/04/2026] A: one", " two", "[5:00 am, 08/04/2026] B: x"]
    d = messages.dated(messages.sessionize(readers.with_source(lines, paths)), F.lit(0))
    writers.write_log(messages.merge_log(d), str(tmp_path / "log.txt"))
    assert (tmp_path / "log.txt").read_text().count("\n") == 3
    assert readers.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_stream_of_batches(spark, tmp_path):
    from tallyforge.streaming import stream

    schema = "src_idx int, msg_date date, seconds int, sender string, body string, lines array<string>, seq int"
    rows = lambda s, bodies: spark.createDataFrame([(s, date(2026, 1, 1), 5, "x", b, [b], i) for i, b in enumerate(bodies)], schema)
    rows(0, ["a"]).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows(1, ["a", "a", "b"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.merging_writer(src, str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.body for r in stream.current_log(spark, str(tmp_path / "log")).collect()) == ["a", "a", "b"]


def test_log_survives_a_failure_between_its_two_writes(spark, tmp_path, monkeypatch):
    from tallyforge.sources import versions
    from tallyforge.streaming import stream

    schema = "src_idx int, msg_date date, seconds int, sender string, body string, lines array<string>, seq int"
    rows = lambda s, bodies: spark.createDataFrame([(s, date(2026, 1, 1), 5, "x", b, [b], i) for i, b in enumerate(bodies)], schema)
    log, cp, folder = (str(tmp_path / x) for x in ("log", "cp", "in"))
    run = lambda: stream.merging_writer(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), log, cp).trigger(availableNow=True).start().awaitTermination(120)
    bodies = lambda: sorted(r.body for r in stream.current_log(spark, log).collect())
    assert stream.current_log(spark, log) is None
    rows(0, ["a"]).coalesce(1).write.parquet(folder)
    run()
    rows(1, ["a", "b"]).coalesce(1).write.mode("append").parquet(folder)

    def killed(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", killed)
        with pytest.raises(Exception):
            run()
    assert bodies() == ["a"]
    run()
    assert bodies() == ["a", "b"]
    next((tmp_path / "log" / "versions").glob("v*2.json")).write_text("{")
    with pytest.raises(Exception):
        stream.current_log(spark, log).collect()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if k in entry.reference.SQL])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in rows)
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want)


def test_commands_end_to_end(spark, tmp_path, capsys):
    """Paste to log to weeks to blocks to facts to summaries, with exit codes."""
    from tallyforge import cli

    p = lambda *x: str(tmp_path.joinpath(*x))
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.txt").write_text("hello\n[4:48 am, 08/04/2026] A: sabah mala 500 bar\n[5:00 am, 08/04/2026] T: 100 and 7\n[6:00 am, 09/04/2026] B: shri kohsar jaap 30\n[7:00 am, 20/04/2026] B: later 1\n")
    assert cli.main(["ingest", "--inbox", p("inbox"), "--chatlog", p("log.txt")]) == 0
    out = capsys.readouterr().out
    assert "4 messages, 1 lines before the first" in out and "4 new, 0 copies left out, 4 in all, 2026-04-08 to 2026-04-20" in out
    assert cli.main(["split-weeks", p("log.txt"), "--out", p("weeks"), "--state", p("state.json"), "--today", "2026-04-22"]) == 0
    assert sorted(f.name for f in (tmp_path / "weeks").iterdir()) == ["06-to-12-Apr-2026.txt"] and "in progress" in capsys.readouterr().out
    assert cli.main(["split-weeks", p("log.txt"), "--out", p("weeks"), "--state", p("state2.json"), "--since", "2027-01-01"]) == 1
    week = p("weeks", "06-to-12-Apr-2026.txt")
    assert cli.main(["split-blocks", week, p("blocks")]) == 0
    (tmp_path / "config").mkdir()
    put = lambda n, v: (tmp_path / "config" / n).write_text(json.dumps(v, ensure_ascii=False))
    put("mappings.json", {"SABAH MALA": ["sabah mala"]})
    put("rules.json", {"drop": ["e"], "tokens": {"SHRI": ["shri"], "K": ["kohsar"], "J": ["jaap"]}, "chants": {"KOHSAR JAAP": "SHRI? K J"}})
    put("decisions.json", {"anything": {"role": "name"}})
    put("templates.json", [{"sender": "T", "slot": 1, "chant": "X"}, {"sender": "T", "slot": 2, "chant": "Y"}])
    assert cli.main(["build-extracted", p("blocks"), p("e.json"), "--config", p("config")]) == 0
    facts = json.loads((tmp_path / "e.json").read_text())
    assert [(f["chant"], f["count"]) for f in facts] == [("SABAH MALA", 500), ("X", 100), ("Y", 7), ("KOHSAR JAAP", 30)]
    assert cli.main(["reconcile", p("blocks"), p("e.json"), "--config", p("config")]) == 0
    assert "CLEAN" in capsys.readouterr().out
    assert cli.main(["aggregate", p("e.json"), p("out"), p("blocks"), "--config", p("config")]) == 0
    assert {"reconcile_report.txt", "blocks.jsonl", "extracted.json", "summary.txt"} <= {f.name for f in (tmp_path / "out").iterdir()}
    (tmp_path / "bad.json").write_text(json.dumps(facts[1:]))
    assert cli.main(["aggregate", p("bad.json"), p("no"), p("blocks"), "--config", p("config")]) == 1 and not (tmp_path / "no").exists()
    capsys.readouterr()
    assert cli.main(["resolve-blocks", p("blocks"), "--config", p("config")]) == 0 and "2 facts, 1 open messages" in capsys.readouterr().out
    assert cli.main(["compose", "Shri e Kohsar jaap", "nothing", "--config", p("config")]) == 0 and "Shri e Kohsar jaap\tKOHSAR JAAP" in capsys.readouterr().out
    assert cli.main(["normalize", "Sabah-MALA", "--config", p("config")]) == 0 and "Sabah-MALA\tSABAH MALA" in capsys.readouterr().out
    (tmp_path / "r.jsonl").write_text(json.dumps({"id": 1, "text": "a 5", "segments": [{"t": "a", "role": "chant-label"}, {"t": " 5", "role": "count"}]}) + "\n" + json.dumps({"id": 2, "text": "a", "segments": [{"t": "a", "role": "chant-label"}]}) + "\n")
    assert cli.main(["pair", p("r.jsonl")]) == 0 and "1\t0\ta\t5\t" in capsys.readouterr().out
    assert cli.main(["nothing"]) == 2
