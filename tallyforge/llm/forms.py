"""Visually identical text brought to one form, by a compiled longest-match transducer.

The mapping is computed from the Unicode tables: forms of other width and presentation, letter plus accent where one
letter exists, spaces, invisible characters, Arabic letters that Urdu writes with its own, and letters that look
like one of another alphabet. It is checked for conflicts when it is compiled: no key has two values, and no value
holds a key. The transducer reads words and other grapheme clusters left to right, once. A cluster's form is the longest
keys at each of its places, composed; it is worked out once and remembered. A word's clusters are put out in its main
alphabet: where the word mixes alphabets, look-alikes of the others are replaced by those of the main one.

Defined results: null stays null; empty and blank text is changed only where its spaces are not plain; emoji joined by
U+200D or tags, variation selectors, native digits, typographic quotes and words wholly in one script are left as they are;
so are the joiners that spelling needs: after an Indic virama, and between a Persian word and its prefix or ending.
"""

from __future__ import annotations

import unicodedata as U
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.chars import INVISIBLE, LOOKALIKES, SPACES, URDU
from tallyforge.session import spread

#: Kinds of compatibility decomposition that are another form of the same character.
FORMS = ("<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
CLUSTER = regex.compile(r"\X")
JOINED_EMOJI = r"(?:\p{Extended_Pictographic}\p{EMod}?\uFE0F?(?:\u200D\p{Extended_Pictographic}\p{EMod}?\uFE0F?)+|\U0001F3F4[\U000E0020-\U000E007F]+)"
#: Invisible beyond the shared list: fillers, and tags that stand by no flag.
FILLERS = "\u115f\u1160\u3164\uffa0" + "".join(map(chr, range(0xE0000, 0xE0080)))
# Letters of Armenian and Cherokee that look like a Latin letter.
FURTHER = dict(zip("օոսհցզյՕՍՏ", "onuhgqjOUS")) | dict(zip("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎠᏀ", "ABCEHJKLMPRSTVWZDG"))
# Persian prefixes and endings that U+200C parts from their word.
PREFIXES, ENDINGS = ("می", "نمی"), ("ها", "های", "هایی", "ام", "ات", "اش", "ای", "اند", "ایم", "تر", "ترین")
_ARABIC = r"[\p{Arabic}--\p{P}]"
#: Joiners that spelling needs: after a virama before a letter; after a prefix or before an ending.
NEEDED = rf"(?V1:(?<=[\u094D\u09CD\u0A4D\u0ACD\u0B4D\u0BCD\u0C4D\u0CCD\u0D4D])[\u200C\u200D](?=\p{{L}})|(?<=(?<!\p{{L}})(?:{'|'.join(PREFIXES)}))\u200C(?={_ARABIC})|(?<={_ARABIC})\u200C(?=(?:{'|'.join(ENDINGS)})(?!\p{{L}})))"
#: What is left as it is; a word with what is not seen in it; any other cluster.
TOKEN = regex.compile(rf"(?P<keep>{JOINED_EMOJI})|(?P<word>(?:[\p{{L}}\p{{M}}{INVISIBLE}]|(?P<joiner>{NEEDED}))*[\p{{L}}\p{{M}}](?:[\p{{L}}\p{{M}}{INVISIBLE}])*)|(?P<cluster>\X)")
_JOINER = regex.compile(NEEDED)
MAX_FORMS = 100_000


def _script(c: str) -> str:
    o = ord(c)
    if c.isascii() and c.isalpha() or 0xC0 <= o < 0x250:
        return "L"
    return "I" if 0x250 <= o < 0x2B0 or 0x1D00 <= o < 0x1D80 else "G" if 0x370 <= o < 0x400 else "C" if 0x400 <= o < 0x530 else "A" if 0x530 <= o < 0x590 else "K" if 0x13A0 <= o < 0x1400 or 0xAB70 <= o < 0xABC0 else ""


def _small_capitals() -> dict[str, str]:
    """Phonetic small capitals and the script g, by their names in the Unicode tables."""
    out = {"ɡ": "g"}
    for o in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D30)):
        name = U.name(chr(o), "")
        if name.startswith("LATIN LETTER SMALL CAPITAL ") and len(name.split()) == 5 and len(name.split()[4]) == 1:
            out[chr(o)] = name.split()[4].lower()
    return out


@lru_cache(maxsize=1)
def compile_mapping() -> tuple[dict, dict[tuple[str, str], str]]:
    """(trie of character sequences with their values under '', look-alikes by (letter, main alphabet))."""
    table: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if table.setdefault(key, value) != value:
            raise ValueError(f"two values for {key!r}")

    for c in SPACES + "  ":
        put(c, " ")
    for c in INVISIBLE + FILLERS:
        put(c, "")
    for k, v in URDU.items():
        put(k, v)
    for o in range(0x80, 0x1F000):
        c = chr(o)
        d = U.decomposition(c)
        if d.startswith(FORMS) and c not in table:
            put(c, U.normalize("NFKC", c).translate(str.maketrans(URDU)).translate(str.maketrans({s: " " for s in SPACES})))
        elif d and d[0] != "<" and c not in table:
            full = U.normalize("NFD", c)
            if U.normalize("NFC", full) == c and len(full) > 1:  # not one that composition leaves out
                put(full, c)
    for k, v in table.items():
        if any(x in table for x in v):
            raise ValueError(f"the value of {k!r} holds a key")
    root: dict = {}
    for k, v in table.items():
        at = root
        for c in k:
            at = at.setdefault(c, {})
        at[""] = v
    alike: dict[tuple[str, str], str] = {}
    for k, v in (FURTHER | _small_capitals()).items():
        alike[k, "L"] = v
    for k, v in LOOKALIKES.items():
        alike[k, "L"] = v
        for other, w in LOOKALIKES.items():
            if w == v and _script(other) != _script(k):
                alike.setdefault((k, _script(other)), other)
        if v.isascii():
            alike.setdefault((v, _script(k)), k)
    return root, alike


@lru_cache(maxsize=1)
def _starts() -> regex.Pattern:
    root, _ = compile_mapping()
    heads = {k for k, v in root.items() if "" in v}
    # a letter begins a key only if an accent follows, so marks stand for those
    return regex.compile("[" + "".join(regex.escape(c) for c in sorted(heads)) + r"]|\p{L}\p{M}|[\u0250-\u02af\u0370-\u058f\u13a0-\u13ff\u1d00-\u1d7f\uab70-\uabbf]")


_forms: dict[str, str] = {}


def cluster_form(cluster: str) -> str:
    """The form of one cluster: the longest key at each place, composed."""
    if (out := _forms.get(cluster)) is None:
        root, _ = compile_mapping()
        parts, i, n = [], 0, len(cluster)
        while i < n:
            at, j, hit, end = root, i, None, i + 1
            while j < n and (at := at.get(cluster[j])) is not None:
                j += 1
                if "" in at:
                    hit, end = at[""], j
            parts.append(cluster[i] if hit is None else hit)
            i = end
        out = U.normalize("NFC", "".join(parts))
        if len(_forms) >= MAX_FORMS:
            _forms.clear()
        _forms[cluster] = out
    return out


def word_form(word: str) -> str:
    """The form of a word's clusters in its main alphabet; joiners that its spelling needs are kept."""
    out = []
    at = 0
    for m in _JOINER.finditer(word):
        out += [*map(cluster_form, CLUSTER.findall(_unjoined(word[at : m.start()]))), m[0]]
        at = m.end()
    out += map(cluster_form, CLUSTER.findall(_unjoined(word[at:])))
    w = "".join(out)
    if w.isascii():
        return w
    if not U.is_normalized("NFC", w):
        w = U.normalize("NFC", w)  # accents that what is gone had parted from their letter
    _, alike = compile_mapping()
    kinds = [_script(c) for c in w]
    found = {k for k in kinds if k}
    if len(found) < 2:
        return w
    # the main alphabet is that of most letters without a twin; then of most letters
    score = {s: (sum(k == s and not any((c, t) in alike for t in found - {s}) for c, k in zip(w, kinds)), kinds.count(s), s == "L") for s in found}
    main = max(score, key=score.get)
    return "".join(alike.get((c, main), c) if k and k != main else c for c, k in zip(w, kinds))


_HIDDEN = str.maketrans({c: "" for c in INVISIBLE + FILLERS})


def _unjoined(s: str) -> str:
    """Without what is not seen, so that accents meet their letters again."""
    return s.translate(_HIDDEN)


def one_form(text: str | None) -> str | None:
    """The consistent form of a text."""
    if text is None or text.isascii() or not _starts().search(text):
        return text
    return TOKEN.sub(lambda m: m[0] if m["keep"] else m[0] if m[0].isascii() else word_form(m[0]) if m["word"] else cluster_form(m[0]), text)


def with_one_form(rows: DataFrame, columns: list[str], suffix: str = "_form") -> DataFrame:
    """Adds the consistent form of each column; only values with a character beyond ASCII leave the JVM."""

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: one_form(x) if isinstance(x, str) else None)

    for c in columns:
        rows = rows.withColumn(c + suffix, F.coalesce(form(F.when(F.col(c).rlike(r"[^\x00-\x7f]"), F.col(c))), F.col(c)))
    return rows


def odd_fields(blocks: DataFrame) -> DataFrame:
    """(id, field) of every field that holds characters standing in for the plain ones."""
    fields = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("text", "sender")]))
    rows = spread(blocks.select("id", "text", "sender")).select(F.col("id").cast("long").alias("id"), fields).where(F.col("value").rlike(r"[^\x00-\x7f]"))
    return with_one_form(rows, ["value"]).where("value_form <> value").select("id", "field").distinct()
