"""Labelled spans for the tagger, and its training: python -m tallyforge.llm.pii_train BLOCKS.parquet [rows].

The data hold no labelled spans. Numbers and addresses are labelled by what is typed after cue words. Names are labelled by where
they stand: two words after a title or at the head of a list, or the first two of a sender of three words, show which words are given and which are
family names; such a pair is a name wherever it stands. No list of the names in the data is used. So that the tagger goes
by what stands around a name and not by its letters alone, texts are repeated with other names in place of theirs: names in
use in several countries (NAMES) and made-up words; lines with further kinds of numbers and addresses are added. A fifth of
the given and of the family names in NAMES is held out, whole, to measure recall on names never seen.

At most `rows` texts are used (a documented bound, chosen by a hash of the text); a tenth of them is held out. Texts are
trained in the windows in which they are read, whole.
"""

from __future__ import annotations

import sys
from zlib import crc32

import numpy as np
import regex

from tallyforge.llm.pii import FIELD, KINDS, TAGS, plain, save, shaped, spans, windows
from tallyforge.llm.tagger import Tagger

ROWS = 12_000
_TIMED = regex.compile(r"[0-9][:h][0-9]{2}|[0-9]{10}")
#: Given and family names by script, for texts with other names.
NAMES = {
    "latin": (
        "michael sarah david emily james maria john anna robert laura william sofia thomas elena daniel grace priya ramesh amina rahul anjali sunil kavita vijay deepa arjun meera sanjay pooja rohan neha imran fatima yusuf ayesha bilal zainab hassan khadija omar mariam tariq nadia chen hiroshi yuki carlos lucia pedro kwame adaeze chidi ngozi ivan olga pierre claire lars ingrid".split(),
        "johnson smith williams brown garcia miller davis martinez wilson anderson taylor moore jackson harris clark lewis walker sharma kumar gupta singh verma reddy nair iyer joshi mehta desai chopra banerjee mukherjee khan ahmed qureshi siddiqui hussain malik sheikh ansari farooqui mirza rahman zhang tanaka suzuki rodriguez fernandez silva santos okafor mensah adeyemi petrov dubois moreau hansen nilsson".split(),
    ),
    "devanagari": (
        "राहुल अंजली सुनील कविता विजय दीपा अर्जुन मीरा संजय पूजा रोहन नेहा रमेश प्रिया अमित सीमा राजेश गीता मनोज सुनीता इमरान फातिमा यूसुफ आयशा बिलाल जैनब हसन मरियम".split(),
        "शर्मा कुमार गुप्ता सिंह वर्मा रेड्डी नायर जोशी मेहता देसाई चोपड़ा बनर्जी खान अहमद कुरैशी सिद्दीकी हुसैन मलिक शेख अंसारी मिश्रा तिवारी यादव चौहान पांडे".split(),
    ),
    "arabic": (
        "عمران فاطمہ یوسف عائشہ بلال زینب حسن مریم طارق نادیہ احمد خدیجہ عمر صفیہ سلمان ثنا فیصل حنا کاشف رابعہ".split(),
        "خان قریشی صدیقی حسین ملک شیخ انصاری فاروقی مرزا رحمان بٹ چوہدری ہاشمی گیلانی بخاری رضوی نقوی عباسی".split(),
    ),
}
#: Parts of made-up words by script.
PARTS = {"latin": ("b ch d f g h j k l m n p r s sh t v y z tr br".split(), "a e i o u aa ai".split(), " n r l m s t".split(" ")), "devanagari": ("क ग च ज त द न प ब म र ल व स श ह".split(), " ा ि ी ु े ो".split(" "), " न र ल म".split(" ")), "arabic": ("ب پ ت ج د ر ز س ش ف ق ک گ ل م ن".split(), "ا و ی".split(), " ن ر ل م".split(" "))}
# Titles that stand before a name.
TITLES = "from|janab|sufi|haji|hafiz|maulana|dr|mr|mrs|ms|जनाब|सूफी|हाजी|جناب|صوفی|حاجی"
# Words that may follow a title and are no name.
NO_NAME = set("list report aaj today my counts ki ka ke se ji bhai aapa hisaab ginti सूची आज فہرست آج".split())
_TWO = regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:{TITLES})\.? +(?P<a>[\p{{L}}\p{{M}}]{{3,}}) +(?P<b>[\p{{L}}\p{{M}}]{{3,}})(?![\p{{L}}\p{{M}}])")
#: Two words that head a text, but for its date, and are followed by a mark or a word that opens a list, and not by a count.
_HEAD = regex.compile(r"^(?:dinank )?[0-9 ./,-]*\n?(?P<a>[\p{L}\p{M}]{3,}) +(?P<b>[\p{L}\p{M}]{3,})(?: *[:\n]| +(?:सूची|आज|فہرست|آج|list|report|aaj|today|my|se|bhai|aapa|sahab|didi)(?![\p{L}\p{M}]))(?! *-?[0-9])")
_WORDS = regex.compile(r"[\p{L}\p{M}]+")
_PAIR = regex.compile(r"(?<![\p{L}\p{M}])(?P<a>[\p{L}\p{M}]{3,})(?P<s> +)(?P<b>[\p{L}\p{M}]{3,})(?![\p{L}\p{M}])")


def name_words(texts: list[str], senders: list[str], least: int = 2) -> tuple[set[str], set[str]]:
    """Given and family names of plain texts: words that stand so after titles, over lists or in senders, each with `least` different partners."""
    pairs = {(m["a"], m["b"]) for t in texts for g in (_TWO, _HEAD) for m in g.finditer(t)}
    for x in senders:
        w = x.split()
        if len(w) == 3 and all(_WORDS.fullmatch(y) for y in w):
            pairs.add((w[0], w[1]))
    pairs = {(a, b) for a, b in pairs if a not in NO_NAME and b not in NO_NAME}
    for _ in range(3):  # until what is left leans on itself
        with_, of = {}, {}
        for a, b in pairs:
            with_.setdefault(a, set()).add(b)
            of.setdefault(b, set()).add(a)
        pairs = {(a, b) for a, b in pairs if len(with_[a]) >= least and len(of[b]) >= least}
    return {a for a, _ in pairs}, {b for _, b in pairs}


_CUE = r"(?:^|[\n;|,]|(?<= )) ?(?:{}) ?[:-]? ?"
_TO = r"(?=\s*(?:$|\n|;| \| ))"
GRAMMAR = {
    "email": regex.compile(r"[a-z0-9._+-]+ ?(?:@|\[at\]|\(at\)) ?[a-z0-9-]+(?: ?\[dot\] ?[a-z]+|\.[a-z]+)+"),
    "address": regex.compile(_CUE.format("address|pata|venue|aana hai|bhejna hai") + r"\K(?:h\.no|makan|house|flat|plot|[0-9]+/|मकान|مکان)[^\n;|]*?" + _TO),
    "id_number": regex.compile(_CUE.format("kyc|id|document|card no|pehchan no") + r"\K[a-z0-9][a-z0-9 -]*?[0-9][a-z0-9]*" + _TO),
    "phone": regex.compile(_CUE.format("ph|call|mobile no|whatsapp|sampark|naya number|reach me on") + r"\K[+(]?[0-9][0-9 ().+-]*[0-9]" + _TO),
}
_SENDER_PHONE = regex.compile(r"\+?[0-9][0-9 ().-]{7,}[0-9]")


def label(p: str, field: str, names: tuple[set[str], set[str]]) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of plain text; pieces found first keep their place."""
    if field == "sender" and _SENDER_PHONE.fullmatch(p.strip()):
        b = len(p) - len(p.lstrip())
        return [("phone", b, b + len(p.strip()))]
    taken, out = np.zeros(len(p), bool), []
    own = [(m.start(), m.end()) for m in _PAIR.finditer(p, overlapped=True) if m["a"] in names[0] and m["b"] in names[1]]
    for kind, found in [(k, [m.span() for m in g.finditer(p)]) for k, g in GRAMMAR.items()] + [("name", own)]:
        for b, e in found:
            if not taken[b:e].any():
                taken[b:e] = True
                out.append((kind, b, e))
    return sorted(out, key=lambda x: x[1])


def script_of(s: str) -> str:
    return "devanagari" if regex.search(r"\p{Devanagari}", s) else "arabic" if regex.search(r"\p{Arabic}", s) else "latin"


def split_names() -> tuple[dict, dict]:
    """(names to train with, names held out), by script: every fifth given and every fifth family name is held out."""
    part = lambda w, held: [x for i, x in enumerate(w) if (i % 5 == 4) == held]
    return tuple({k: tuple([y for y in (plain(x)[0] for x in part(w, held)) if y] for w in v) for k, v in NAMES.items()} for held in (False, True))


def renamed(p: str, found: list[tuple[str, int, int]], pick) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with other names, `pick(script)`, in place of its own, and where its pieces then are."""
    out, spans_, at = "", [], 0
    for kind, b, e in found:
        out += p[at:b]
        piece = pick(script_of(p[b:e])) if kind == "name" else p[b:e]
        spans_.append((kind, len(out), len(out) + len(piece)))
        out, at = out + piece, e
    return out + p[at:], spans_


def made_up(r: np.random.Generator, script: str) -> str:
    on, mid, end = PARTS[script]
    word = lambda: "".join(r.choice(on) + r.choice(mid) for _ in range(r.integers(1, 4))) + r.choice(end)
    w = [word() for _ in range(2)]
    return " ".join(x if len(x) > 2 else x + word() for x in w)


def further_line(r: np.random.Generator) -> tuple[str, str, str]:
    """(cue, piece, kind) of numbers and addresses that the data lack."""
    n = lambda k: "".join(r.choice(list("0123456789"), k))
    street = f"{r.choice(['park', 'church', 'baker', 'mill', 'lake', 'station', 'king', 'high', 'garden', 'rose', 'hill', 'canal'])} {r.choice(['street', 'road', 'lane', 'avenue', 'st', 'rd', 'marg', 'nagar'])}"
    town = r.choice(["springfield", "lakeview", "pune", "lahore", "london", "boston", "delhi", "karachi", "leeds", "austin"])
    return [
        (r.choice(["ssn", "ssn no", "social security", "social security no"]), f"{n(3)}-{n(2)}-{n(4)}", "id_number"),
        (r.choice(["passport", "passport no", "passport number", "id"]), r.choice(list("abkmnprz")) + n(r.integers(7, 9)), "id_number"),
        (r.choice(["address", "pata", "venue", "lives at", "ship to", "bhejna hai"]), f"{r.integers(1, 400)}{r.choice(['', '', 'a', 'b'])} {street}, {town}", "address"),
        (r.choice(["call", "phone", "ph", "mobile no"]), r.choice([f"({n(3)}) {n(3)}-{n(4)}", f"+1 {n(3)} {n(3)} {n(4)}", f"{n(3)}-{n(3)}-{n(4)}"]), "phone"),
    ][r.integers(0, 4)]


def with_line(r: np.random.Generator, p: str, found: list) -> tuple[str, list]:
    cue, piece, kind = further_line(r)
    begin = f"{p}{r.choice([chr(10), ' | ', '; '])}{cue}{r.choice([': ', ' ', ' - '])}"
    return begin + piece, [*found, (kind, len(begin), len(begin) + len(piece))]


def tags_of(p: str, found: list[tuple[str, int, int]]) -> list[int]:
    y = [0] * (len(p) + 1)
    for kind, b, e in found:
        k = KINDS.index(kind)
        y[b + 1 : e + 1] = [2 * k + 1] + [2 * k + 2] * (e - b - 1)
    return y


def sample(texts: list[str], senders: list[str], rows: int, names: tuple[set[str], set[str]]) -> list[tuple[str, str]]:
    """At most `rows` (value, field), by hash: texts with more than names, with a moment, and others, in fixed shares, then senders."""
    by_hash = lambda v: sorted({t for t in v if t and t.strip()}, key=lambda t: crc32(t.encode("utf-8", "replace")))
    rich, timed, poor = [], [], []
    for t in by_hash(texts):
        p = plain(t)[0]
        kinds = {k for k, *_ in label(p, "text", names)}
        (rich if kinds - {"name"} else timed if _TIMED.search(p) else poor).append((t, "text"))
    n = rows * 5 // 6
    rich, timed = rich[: n * 9 // 20], timed[: n * 4 // 20]
    return rich + timed + poor[: n - len(rich) - len(timed)] + [(s, "sender") for s in by_hash(senders)[: rows - n]]


def main(path: str, rows: int = ROWS, epochs: int = 8) -> None:
    import pandas as pd

    b = pd.read_parquet(path, columns=["sender", "text"])
    texts, senders = ([x for x in b[c] if isinstance(x, str)] for c in ("text", "sender"))
    names = name_words([plain(t)[0] for t in texts], [plain(x)[0] for x in set(senders)])
    print(f"{len(names[0])} given and {len(names[1])} family names by where they stand")
    data = sample(texts, senders, rows, names)
    r = np.random.default_rng(7)
    train, unseen = split_names()
    own = lambda table: lambda k: f"{r.choice(table[k][0])} {r.choice(table[k][1])}"
    pairs: list[tuple[str, str, list]] = []
    for i, (v, f) in enumerate(data):
        if i % 10 == 0:
            continue
        p = plain(v)[0]
        found = label(p, f, names)
        pairs.append((p, f, found))
        if any(k == "name" for k, *_ in found):
            pick = own(train) if r.random() < 0.5 else lambda k: made_up(r, k)
            q, g = renamed(p, found, pick)
            if f == "text" and r.random() < 0.4:
                q, g = with_line(r, q, g)
            pairs.append((q, f, g))
        elif f == "text" and r.random() < 0.1:
            pairs.append((*(x := with_line(r, p, found))[:1], f, x[1]))
    cut, tags = [], []
    for p, f, found in pairs:
        t, y = FIELD[f] + shaped(p), tags_of(p, found)
        for x, z in windows(len(t)):
            cut.append(t[x:z])
            tags.append(y[x:z])
    count: dict[str, int] = {}
    for p in cut:
        for c in p:
            count[c] = count.get(c, 0) + 1
    tagger = Tagger("".join(sorted(c for c, n in count.items() if n >= 3)), TAGS)
    print(f"{len(cut)} windows")
    tagger.train([tagger.codes(p) for p in cut], tags, epochs, log=lambda x: print(x, flush=True))
    save(tagger)
    held = [x for i, x in enumerate(data) if i % 10 == 0]
    got = spans(tagger, [v for v, _ in held], [f for _, f in held])
    right = wrong = missed = 0
    for (v, f), g in zip(held, got):
        p, at = plain(v)
        want = {(k, at[x], at[e - 1] + 1) for k, x, e in label(p, f, names)}
        right, wrong, missed = right + len(want & set(g)), wrong + len(set(g) - want), missed + len(want - set(g))
    print(f"held out: precision {right / max(1, right + wrong):.4f}, recall {right / max(1, right + missed):.4f}")
    for what, table in (("held-out names", unseen), ("made-up names", None)):
        recall(tagger, held, names, what, own(table) if table else lambda k: made_up(r, k))
    lines = [with_line(r, "sabah mala 50 bar", []) for _ in range(400)]
    for kind in ("id_number", "address", "phone"):
        of = [(p, g[0]) for p, g in lines if g[0][0] == kind]
        hit = sum(g in x for (_, g), x in zip(of, spans(tagger, [p for p, _ in of], ["text"] * len(of))))
        print(f"further lines, {kind}: recall {hit / len(of):.3f} of {len(of)}")


def recall(tagger: Tagger, held: list[tuple[str, str]], names: tuple[set[str], set[str]], what: str, pick) -> None:
    """Recall of names never seen in training, in held-out texts and senders, by script and field."""
    rows = []
    for v, f in held:
        p = plain(v)[0]
        found = label(p, f, names)
        if any(k == "name" for k, *_ in found):
            rows.append((f, *renamed(p, found, pick)))
    by: dict[tuple[str, str], list[int]] = {}
    for (f, q, g), x in zip(rows, spans(tagger, [q for _, q, _ in rows], [f for f, *_ in rows])):
        for k in (k for k in g if k[0] == "name"):
            by.setdefault((f, script_of(q[k[1] : k[2]])), []).append(k in x)
    for k, v in sorted(by.items()):
        print(f"{what}, {k[0]}, {k[1]}: recall {sum(v) / len(v):.3f} of {len(v)}")


if __name__ == "__main__":
    main(sys.argv[1], *(int(x) for x in sys.argv[2:]))
