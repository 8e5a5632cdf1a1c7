"""Operators of language: against brute force, exact round trips and held-out accuracy, with nulls, empties, ties and repeats."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions.chars import py_key
from tallyforge.llm import bpe, canon, dedup, forms, leak, level, pii, tagger

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.vocabulary_path()), reason="needs the public vocabulary")


# --- p2 ---------------------------------------------------------------------------------------------------------------


def test_repeats(blocks_of):
    long = "dinank 5/1/2026 neelam mala 4331 baar parbat paath 6811 martba"
    rows = [
        (1, "05/01/2026", "A  b", long, 0), (2, "5 Jan 2026", "a​ B", long + "\n(edited)", 1), (3, "05/01/2026", "A b", long.replace("6811", "6812"), 1), (4, "06/01/2026", "A b", long, 1),
        (5, "05/01/2026", "A b", "dinank 5/1/2026 neelam mala 4331 baar parbat", 2), (6, "05/01/2026", "C", long, 2), (7, "05/01/2026", "D", "same day text", 3), (8, "05/01/2026", "D", "same day text", 3),
        (9, "05/01/2026", "D", "Same  day text", 4), (10, None, "D", "same day text", 5), (11, "05/01/2026", None, "same day text", 5), (12, "05/01/2026", "D", None, 5), (13, "05/01/2026", "D", " ", 5), (14, "05/01/2026", "A b", long.replace("baar", "martaba"), 6),
    ]
    b = blocks_of(rows)
    want = {(1, 2), (1, 5), (7, 9), (1, 14)}
    assert {tuple(r) for r in dedup.repeats(b.unionByName(b).withColumn("key", F.lit(1))).collect()} == want
    assert {tuple(r) for r in dedup.repeats(b, per_block=1, few_keys=0, hot=1).collect()} == want
    assert dedup.repeats(b.limit(0)).count() == 0


def test_a_text_again_repeats_what_came_in_its_first_batch(blocks_of):
    h = "dinank 5/1/2026 neelam mala 4331 baar parbat paath 6811 martba"
    g = h + " (edited)"
    rows = [(5, "05/01/2026", "A", h, 0), (9, "05/01/2026", "A", g, 0), (11, "05/01/2026", "A", g, 1), (12, "05/01/2026", "A", g, 3), (13, "05/01/2026", "B", g, 0), (14, "05/01/2026", "B", g, 2)]
    assert {tuple(r) for r in dedup.repeats(blocks_of(rows)).collect()} == {(5, 11), (5, 12), (13, 14)}
    assert {tuple(r) for r in dedup.repeats(blocks_of([*rows, (1, "05/01/2026", "A", h, -1)])).collect()} == {(1, 5), (1, 9), (1, 11), (1, 12), (13, 14)}


def test_index_takes_batches_one_at_a_time(spark, blocks_of, tmp_path):
    t = ["register 1 sabah mala 500 bar", "register 2 neelam mala 70 bar darya jaap 80 bar"]
    index = dedup.RepeatIndex(spark, str(tmp_path), per_part=1)
    assert index.accept(blocks_of([(1, "01/01/2026", "A", t[0], 0), (2, "01/01/2026", "A", t[1], 0)])).count() == 0
    assert {tuple(r) for r in index.accept(blocks_of([(3, "01/01/2026", "A", t[1] + " forwarded", 1), (4, "02/01/2026", "A", t[0], 1)])).collect()} == {(2, 3)}
    assert {tuple(r) for r in index.accept(blocks_of([(5, "01/01/2026", "A", "register 2 neelam mala 70 bar darya", 2), (6, "02/01/2026", "a", t[0], 2)])).collect()} == {(2, 5), (4, 6)}
    assert index.accept(blocks_of([(9, "02/01/2026", "a", t[0], 3)]).limit(0)).count() == 0


def test_an_accepted_segment_is_not_written_again(spark, blocks_of, tmp_path):
    """Small batches after a large one: what a batch writes does not depend on what was accepted before."""
    index = dedup.RepeatIndex(spark, str(tmp_path), per_part=64)
    text = lambda i: f"register {i} sabah mala {i * 7 + 3} bar"
    index.accept(blocks_of([(i, "01/01/2026", "A", text(i), 0) for i in range(400)]))
    first = index.segments()[0]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / first["name"]).rglob("*.parquet")}
    for k in range(1, 4):
        got = index.accept(blocks_of([(400 + 10 * k + i, "01/01/2026", "A", text(40 * k + i) + " again", k) for i in range(10)]))
        assert {tuple(r) for r in got.collect()} == {(40 * k + i, 400 + 10 * k + i) for i in range(10)}
        assert index.segments()[0] == first and sum(s["n"] for s in index.segments()[1:]) == 20 * k
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / first["name"]).rglob("*.parquet")}
    live = {s["name"] for s in index.segments()}
    assert {p.name for p in tmp_path.iterdir()} == live | {"versions"} and len(live) <= 3


def test_suffix_arrays_find_every_common_substring():
    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 3)) for _ in range(8)).encode() for _ in range(40)]
    a = dedup.Segment(np.arange(20), np.ones(20, np.int64), np.ones(20, bool), texts[:20])
    s = a.merged(dedup.Segment(np.arange(20, 40), np.ones(20, np.int64), np.ones(20, bool), texts[20:]))
    assert (s.suffix[:-1] <= s.suffix[1:]).all()
    for q in texts[:5]:
        got = {}
        for p, owners, places in s.seeds(1, q):
            for i, o in zip(owners.tolist(), places.tolist()):
                got.setdefault(i, set()).add((p, o))
        for i, t in enumerate(texts):
            pad = t + dedup.PAD
            want = {(p, o) for p in dedup.word_starts(q) for o in dedup.word_starts(t) if (q + dedup.PAD)[p : p + dedup.LEAST] == pad[o : o + dedup.LEAST]}
            assert got.get(i, set()) == want
    assert not list(s.seeds(2, texts[0]))
    for q in (b"sabah mala " * 20_000, b"x" + b"sabah mala " * 20_000):  # long texts that repeat themselves
        (r, a, b, _), = dedup.Segment([1], [1], [True], [b"sabah mala " * 20_000]).coverage(1, q)
        assert a >= len(q) - 12


# --- p4 ---------------------------------------------------------------------------------------------------------------


def test_gradients_are_right():
    t = tagger.Tagger("abc", ["O", "B", "I"], dim=3, hidden=2)
    for k in t.p:
        t.p[k] = t.p[k].astype(np.float64)
    x, mask = tagger.pad([[2, 3, 4, 2], [3, 2]])
    mask = mask.astype(np.float64)
    y, _ = tagger.pad([[0, 1, 2, 0], [1, 2]])
    _, g = t.loss_and_grads(x, mask, y)
    r = np.random.default_rng(0)
    for k, a in t.p.items():
        i = tuple(r.integers(0, n) for n in a.shape)
        keep, e = a[i], 1e-3
        a[i] = keep + e
        up = t.loss_and_grads(x, mask, y)[0]
        a[i] = keep - e
        down = t.loss_and_grads(x, mask, y)[0]
        a[i] = keep
        assert abs((up - down) / (2 * e) - g[k][i]) < 2e-3, k


def test_decoding_is_the_best_path():
    import itertools

    t = tagger.Tagger("a", ["O", "B", "I"], dim=2, hidden=2)
    r = np.random.default_rng(1)
    t.p["move"], t.p["start"] = r.normal(size=(3, 3)).astype(np.float32), r.normal(size=3).astype(np.float32)
    e = r.normal(size=(5, 2, 3)).astype(np.float32)
    for b, n in ((0, 5), (1, 3)):
        score = lambda s: t.p["start"][s[0]] + sum(e[i, b, k] for i, k in enumerate(s)) + sum(t.p["move"][p, q] for p, q in zip(s, s[1:]))
        assert tuple(t.decode(e, np.array([5, 3]))[b]) == max(itertools.product(range(3), repeat=n), key=score)


def test_personal_spans(spark, blocks_of):
    text = "22/05/2026 janab Nuvrin Tanolti se sabah mala 1191 martaba\nkyc: ZQ0555288 ; call - +91-12076-50446\nmail n-velekhar@reg.example.org\naddress: Makan no. 226, Nimkund Road, Palkund"
    rows = [(1, None, "Zar​mun Lohrolti Sérbagh", text), (2, None, "+92 100 0128486", None), (3, None, "Tárganj Halqa 37", "Sabah Mala 5379 bar"), (4, None, None, ""), (5, None, "Markaz Register Desk", "  "), (2, None, "+92 100 0128486", None)]
    got = {tuple(r) for r in pii.personal_information(blocks_of(rows)).collect()}
    assert got == {
        (1, "text", "name", "Nuvrin Tanolti"), (1, "text", "id_number", "ZQ0555288"), (1, "text", "phone", "+91-12076-50446"), (1, "text", "email", "n-velekhar@reg.example.org"),
        (1, "text", "address", "Makan no. 226, Nimkund Road, Palkund"), (1, "sender", "name", "Zar​mun Lohrolti"), (2, "sender", "phone", "+92 100 0128486"),
    }
    m = pii.masked(spark.createDataFrame([(text,), (None,), ("",)], "text string")).collect()
    assert m[0].text_masked.startswith("22/05/2026 janab <NAME> se sabah mala 1191 martaba\nkyc: <ID_NUMBER> ; call - <PHONE>\nmail <EMAIL>\naddress: <ADDRESS>") and m[1].text_masked is None and m[2].text_masked == ""


def test_windows_are_reconciled():
    filler = "sabah mala 392 martba kohsar paath 431 bar " * 12
    text = filler + "janab Nuvrin Tanolti se " + filler + "\ncall - +91-12076-50446"
    got = pii.spans(pii.load(), [text], ["text"])[0]
    assert [(k, text[s:e]) for k, s, e in got] == [("name", "Nuvrin Tanolti"), ("phone", "+91-12076-50446")]


# --- p6, p7 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "odd, plain",
    [("Ｈａｌｑａ ５２", "Halqa 52"), ("neel⁠am ala", "neelam ala"), ("Tárganj", "Tárganj"), ("A b　c", "A b c"), ("Nimwаra", "Nimwara"), ("Μala Ηalqa", "Mala Halqa"), ("مرتبه", "مرتبہ"), ("a​́x", "áx")],
)
def test_one_form(odd, plain):
    assert forms.one_form(odd) == plain and forms.one_form(plain) == plain


@pytest.mark.parametrize("same", [None, "", " ", "Доброе утро", "Καλημέρα", "१२३ ٤٥", "“x” ‘y’", "👩‍👩‍👧 🙏", "फ़िरदौस", "a\tb\nc\r\n", "naïve façade"])
def test_what_is_left_alone(same):
    assert forms.one_form(same) == same


@pytest.mark.parametrize("odd, form", [("ɢo GO", "go GO"), ("հello", "hello"), ("a\u3164b", "ab"), ("x\U000e0041y", "xy"), ("e\u200b\u0301", "é"), ("चि\u200dरग", "चिरग"), ("sa\u200cbah", "sabah"), ("क\u094d\u200dष", "क\u094d\u200dष"), ("می\u200cدانم", "می\u200cدانم"), ("صبا\u200cح", "صباح"), ("🏴\U000e0067\U000e0062\U000e007f", "🏴\U000e0067\U000e0062\U000e007f"), ("ᏴOB", "BOB")])
def test_further_scripts_fillers_and_joiners(odd, form):
    assert forms.one_form(odd) == form and forms.one_form(form) == form


def test_odd_fields(blocks_of):
    b = blocks_of([(1, None, "A​", "x"), (2, None, None, "Halqа"), (3, None, "", None), (1, None, "A​", "x")]).withColumn("value", F.lit(1))
    assert {tuple(r) for r in forms.odd_fields(b).collect()} == {(1, "sender"), (2, "text")}


LIST = ["SABAH TASBEEH", "SABAH MALA", "MEHTAB TASBEEH", "NEELAM MALA", "KOHSAR PAATH", "KOHSAR JAAP"]


def test_automaton_agrees_with_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(2)
    m = canon.Matcher(LIST)
    for _ in range(150):
        q = list("".join(canon.value_words(r.choice(LIST))))
        for _ in range(r.randint(0, 4)):
            q[r.randrange(len(q))] = r.choice("abehlmnst")
        q = "".join(q)
        want = {}
        for e in LIST:
            w = canon.value_words(e)
            for words in (w, w[::-1]):
                d = plain(q, "".join(words))
                if d <= canon.limit(len(q)) and m.word_by_word(q, tuple(words)):
                    want[e] = min(want.get(e, 99), d)
        assert {e: d for d, e in m.search(q)} == want


def test_values_to_entries():
    m = canon.Matcher(LIST, [("सबाह माला", "SABAH MALA"), ("odd spelling", "KOHSAR JAAP")])
    for v, e in [("mala neelam", "NEELAM MALA"), ("Saa-Tasbeeh", "SABAH TASBEEH"), ("sabah e tasbeeh shareef", "SABAH TASBEEH"), ("सबह माला", "SABAH MALA"), ("kohsar laap", "KOHSAR JAAP"), ("gulzar paht", "UNMATCHED"), ("meher tasbih", "UNMATCHED"), ("odd spelling", "KOHSAR JAAP"), ("", "UNMATCHED"), (None, "UNMATCHED"), ("12", "UNMATCHED")]:
        assert m.match(v)[1] == e, v
    assert m.match_inside("janab Hulrin Pashbhuri ji SABH MALA 190 bar") == "SABAH MALA" and m.match_inside("quiz night 4") == "UNMATCHED"
    assert canon.Matcher([]).match("x")[1] == "UNMATCHED"


def test_aliases_long_entries_shards_and_all_hits(spark, monkeypatch):
    m = canon.Matcher([*LIST, "NIGHT OF STARS"], [("purani misaal", "KOHSAR JAAP")])
    assert m.match("purani misal") == (0, "KOHSAR JAAP") and m.match("purini misaal") == (1, "KOHSAR JAAP")  # one letter off a known spelling
    assert m.match_inside("aaj night of stras 40 bar") == "NIGHT OF STARS"
    assert [e for _, _, e in canon.Matcher(["SABAH MALA", "SABAH MALAH"]).matches("sabah mala")] == ["SABAH MALA", "SABAH MALAH"]
    lst = spark.createDataFrame([(i, c) for i, c in enumerate(LIST)], "ord int, chant string")
    var = spark.createDataFrame([("purani misaal", "KOHSAR JAAP")], "key string, canonical string")
    values = spark.createDataFrame([("sabh mala",), ("purani misaal",), ("zzz",), (None,), ("mala neelam",)], "value string")
    whole = canon.matchers_of(lst, var)
    monkeypatch.setattr(canon, "SHARD", 2)
    parts = canon.matchers_of(lst, var)
    assert len(whole) == 1 and len(parts) > 2
    of = lambda ms: {(r.value, r.canonical) for r in canon.canonical_values(values, ms).collect()}
    assert of(whole) == of(parts) == {("sabh mala", "SABAH MALA"), ("purani misaal", "KOHSAR JAAP"), ("zzz", "UNMATCHED"), (None, "UNMATCHED"), ("mala neelam", "NEELAM MALA")}
    got = {tuple(r) for r in canon.all_matches(values, parts).collect()}
    assert got == {tuple(r) for r in canon.all_matches(values, whole).collect()} and {(v, e) for v, e, *_ in got} >= {("sabh mala", "SABAH MALA"), ("purani misaal", "KOHSAR JAAP")}


def test_canonical_chants(spark, blocks_of):
    e = spark.createDataFrame([(1, 1, "SABAH MALA", 1), (1, 2, "sabah mala", 1), (1, 2, "sabah mala", 1), (2, 1, None, 1), (3, 1, "xyz", None)], "msg_id long, seq int, chant string, count long")
    rv = spark.createDataFrame([(9, "HARD", "unresolved", "m"), (9, "HARD", "unresolved", "m"), (8, "INFO", "non-chant", "m"), (7, "HARD", "unresolved", "m")], "msg_id long, level string, code string, message string")
    b = blocks_of([(9, None, None, "neelam mla 4"), (8, None, None, "x"), (7, None, None, None)])
    lst = spark.createDataFrame([(i, c) for i, c in enumerate(LIST)], "ord int, chant string")
    var = spark.createDataFrame([("k", None), (None, "SABAH MALA")], "key string, canonical string")
    assert {tuple(r) for r in canon.canonical_chants(e, b, rv, lst, var).collect()} == {(1, 2, "SABAH MALA"), (3, 1, "UNMATCHED"), (9, 1, "NEELAM MALA"), (7, 1, "UNMATCHED")}


# --- p8 ---------------------------------------------------------------------------------------------------------------


@needs_vocabulary
def test_encoding_agrees_and_comes_back(spark):
    import tiktoken

    ranks = bpe.load(bpe.vocabulary_path())
    own, other = bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    parts = ["a", "b", "the", "ing", "  ", "\n", "é", "ज", "‍", "22", "!!", "zz", "<|endoftext|>", "aaaa", "tion", "🙏", "'s", "\r\n"]
    texts = ["", " ", "\n\n  x", "a" * 3000] + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    back = {v: k for k, v in ranks.items()}
    for t in texts:
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t) and "".join(bpe.decode(ids, back)) == t
    own.machine.reset()
    assert own.encode("the") == other.encode_ordinary("the")
    got = bpe.encode_corpus(spark.createDataFrame([(1, None), (2, ""), (3, " "), (3, " ")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.ids) for x in got) == [(1, []), (2, []), (3, [220]), (3, [220])]


def test_utf8_machine_agrees_with_the_library():
    r = random.Random(6)
    for _ in range(2000):
        b = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE0, 0xA4, 0x85, 0xF0, 0x9F, 0x99, 0x8F, 0xED, 0xA0, 0xFF, 0xC0]) for _ in range(r.randint(0, 8)))
        m = bpe.Utf8Machine()
        assert "".join(m.feed(b[i : i + 1]) for i in range(len(b))) + m.close() == b.decode("utf-8", "replace"), b


# --- p9, p10 ----------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    item = [r.choice(vocab) for _ in range(60)]
    short = [r.choice(vocab) for _ in range(9)]
    other = lambda n: [r.choice(vocab) for _ in range(n)]
    replaced = [x if i % 9 else "zzz" for i, x in enumerate(item[10:40], 1)]
    reordered = item[40:] + item[20:40] + item[:20]
    docs = {1: other(30) + item + other(30), 2: other(20) + item[5:25], 3: other(20) + item[5:17] + other(20), 4: replaced, 5: reordered, 6: short + other(5), 7: short[:6] + other(9), 8: other(50)}
    d = spark.createDataFrame([(k, " ".join(v).upper().replace("W1", "ｗ1​") + "!") for k, v in docs.items()] + [(9, None), (10, ""), (1, " ".join(docs[1]))], "doc_id long, text string")
    i = spark.createDataFrame([(100, " ".join(item)), (101, ", ".join(short)), (102, None), (103, "  "), (104, " ".join(item))], "item_id long, text string")
    want = {(k, x) for k in (1, 2, 4, 5) for x in (100, 104)} | {(6, 101)}
    assert {tuple(x) for x in leak.leaks(d.withColumn("item_id", F.lit(1)), i).collect()} == want
    old, leak.SHARD_WORDS = leak.SHARD_WORDS, 61
    try:
        assert {tuple(x) for x in leak.leaks(d, i).collect()} == want
    finally:
        leak.SHARD_WORDS = old
    assert leak.leaks(d, i.limit(0)).count() == 0 and leak.leaks(d.limit(0), i).count() == 0


def test_longest_run_agrees_with_brute_force():
    r = random.Random(8)
    both = [0, 0]
    for _ in range(200):
        item = r.sample(range(500), 24)
        doc = ["zz" if r.random() < 0.12 else f"w{x}" for x in item[r.randint(0, 8) : r.randint(16, 24)]]
        got = list(leak.Index([(1, " ".join(f"w{x}" for x in item))]).leaks([" ".join(doc)], 10, 2.0))
        best, run, since, k = 0, 0, 99, 0
        while k < len(doc):  # pieces of three or more shared words, joined across one replaced word
            n = k
            while n < len(doc) and doc[n] != "zz":
                n += 1
            if n - k >= 3:
                run = run + 1 + n - k if since == 1 else n - k
                best, since = max(best, run), 0
            else:
                since = 99
            since, k = since + 1, n + 1
        assert bool(got) == (best >= 10), (doc, best)
        both[bool(got)] += 1
    assert min(both) > 20


def test_every_fourth_word_replaced_and_short_items():
    item = [f"w{i}" for i in range(24)]
    doc = " ".join(w if i % 4 else f"z{i}" for i, w in enumerate(item))
    index = leak.Index([(1, " ".join(item)), (2, "just three words"), (3, "a b c d"), (4, "one")])
    assert set(index.leaks([doc, "x just THREE words y", "a b c e", "a b c d", None, "one " * 50_000], 18, 0.9)) == {(0, 1), (1, 2), (3, 3), (5, 4)}


@needs_data
def test_levels_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    texts, y = level.labelled(docs, labels, 4000)
    m = level.fit(texts[:140], y[:140])
    got = np.array([m.levels(t).argmax() for t in texts[140:]])
    assert (got == y[140:]).mean() > 0.75


def test_levels_of_odd_documents(spark):
    easy, hard = "the cat is red. we go home.", "idiosyncratic historiography exacerbates methodological heterogeneity, albeit provisionally."
    mid = "although the message was local, father checked one habit by the river."
    d = spark.createDataFrame([(i, t * 3) for i, t in enumerate([easy, mid, hard] * 4)] + [(50, None), (51, ""), (52, " \n"), (53, "..."), (0, easy * 3)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 3 + 1) for i in range(12)] + [(0, None), (1, 9), (2, 3), (None, 1)], "doc_id long, level int")
    got = {r.doc_id: r.level for r in level.reading_levels(d, lab).collect()}
    assert got == {i: i % 3 + 1 for i in range(12)}
    assert level.reading_levels(d, lab.limit(0)).count() == 0


def test_keys_agree_with_the_expression(spark):
    from tallyforge.functions.chars import sender_key

    v = ["A​  b", "Tárganj", "Ｈａｌｑａ ５", "Βelganj Ηalqa", "", " x y "]
    d = spark.createDataFrame([(x,) for x in v], "s string").select(sender_key(F.col("s")).alias("k")).collect()
    assert [r.k for r in d] == [py_key(x) for x in v]
