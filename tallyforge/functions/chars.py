"""Character folding shared by several operators: one plain form for keys and for parsing.

`fold` is the Python side (used inside Arrow batches), `fold_col` / `sender_key` the JVM side
(plain `translate` + `regexp_replace`, so they stay inside whole-stage code generation).
A null input gives null; an empty or blank one gives an empty key.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other alphabets that look like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "κ": "k", "χ": "x", "ɡ": "g", "ı": "i",
}
# what a capital looks like, its small letter stands for when text was put in lower case afterwards
LOOKALIKES |= {k.lower(): v.lower() for k, v in LOOKALIKES.items() if k.lower() not in LOOKALIKES}
# Arabic letters that Urdu writes with its own.
URDU = {"ي": "ی", "ى": "ی", "ك": "ک", "ه": "ہ", "ة": "ہ"}
#: Characters that are not seen at all.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
#: White space other than space, tab and line break.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: First code points of the decimal digit blocks in use.
DIGIT_BLOCKS = (0x0660, 0x06F0, 0x0966, 0xFF10)
DIGITS = {chr(b + i): str(i) for b in DIGIT_BLOCKS for i in range(10)}
BEYOND_ASCII = r"[^\x00-\x7f]"
WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
#: Latin letters with an accent, and the bare letter.
ACCENTS = {c: d[0] for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()}
MARKS = "".join(map(chr, range(0x300, 0x370)))

_FOLD = {**WIDE, **DIGITS, **LOOKALIKES, **URDU, **{c: " " for c in SPACES}, **{c: "" for c in INVISIBLE}}
_PY_FOLD = str.maketrans(_FOLD)
_PY_DIGITS = str.maketrans({**DIGITS, **WIDE})


def fold(s: str) -> str:
    """Plain form of `s`: widths, digits, look-alikes and spaces; accents composed; invisible characters gone."""
    return s if s.isascii() else unicodedata.normalize("NFC", s.translate(_PY_FOLD))


def _translate(col: Column, table: dict[str, str], gone: str = "") -> Column:
    keep = [k for k, v in table.items() if len(v) == 1]
    return F.translate(col, "".join(keep) + gone, "".join(table[k] for k in keep))


def ascii_digits(col: Column) -> Column:
    """Any decimal digit of the blocks in use to 0-9."""
    return _translate(col, DIGITS)


def fold_col(col: Column) -> Column:
    """`fold` without composition: accents of Latin letters are dropped instead, so both spellings agree."""
    folded = _translate(col, {**WIDE, **DIGITS, **LOOKALIKES, **URDU, **ACCENTS, **{c: " " for c in SPACES}}, INVISIBLE + MARKS)
    return F.when(col.rlike(BEYOND_ASCII), folded).otherwise(col)


def sender_key(col: Column) -> Column:
    """Key under which one sender's spellings agree: folded, lower case, single spaces. Blank gives ''."""
    return F.trim(F.regexp_replace(F.lower(fold_col(col)), r"\s+", " "))


_WS = re.compile(r"\s+")


_PY_KEY = str.maketrans({**_FOLD, **ACCENTS, **{m: "" for m in MARKS}})


def py_key(s: str) -> str:
    """Python twin of `sender_key`."""
    return _WS.sub(" ", (s if s.isascii() else s.translate(_PY_KEY)).lower()).strip(" ")
