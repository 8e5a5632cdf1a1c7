r"""Scalar expressions on report texts: headers, dates, number words, numbers, phrases, keys. Column in, Column out.

Patterns follow Unicode where Java's defaults do not: \p{Nd} for digits, explicit sets for white space and word bounds.
Null in gives null out; a text without a match gives an empty list, or null where one value is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyforge.functions.chars import ascii_digits

WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
_W = r"[\p{L}\p{N}_]"
BEGIN, END = rf"(?<!{_W})", rf"(?!{_W})"
BIDI = "‎‏‪‫‬‭‮"

# Words that close a phrase (count units, connectives, greetings, family).
SEPARATORS = (
    "martba martaba maratba mrtba msrtba martbaa bar baar times dafa para pare बार मर्तबा दफा वक्त मरतबा पारे पारा "
    "se ko ki ka ke mein main aur and tak dinank aaj wale से को की का के में और तक दिनांक आज "
    "assalam walekum walaikum salam salaam rahmtullahi wa barakatuh barkatuhu shukriya pranam namaste ameen amin प्रणाम नमस्ते शुक्रिया family parivar परिवार"
).split()
# Words after a given name; they close a phrase and take the word before them along.
NAME_SUFFIXES = "bi bee bano patel begum khatun khatoon".split()
# Numbers written as words, and the units that must follow them.
NUMBER_WORDS = {"ek": 1, "एक": 1, "sau": 100, "सौ": 100}
COUNT_UNITS = "bar baar martba martaba maratba mrtba martbaa बार मर्तबा मरतबा दफा times dafa".split()
# Arabic letters that count as one in a key.
ARABIC = {"آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ئ": "ي", "ک": "ك", "ہ": "ه", "ھ": "ه", "ة": "ه", "ؤ": "و"}
COSMETIC = "ـ‌‍‎‏﻿"

_TIME = r"\d{1,2}:\d{2}(?::\d{2})?[\s  ]*[ap]\.?m\.?"
_CLOCK = r"(\d{1,2}:\d{2}(?::\d{2})?[\s  ]*[ap]\.?m\.?)"
_DATE = r"(\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?)"
# The two layouts of a header, and of a dated line without a sender.
HEADERS = [rf"(?iud)^\s*\[?\s*{_CLOCK},\s*{_DATE}\]?\s*-?\s*([^:]+?):(.*)$", rf"(?iud)^\s*\[?\s*{_DATE},\s*{_CLOCK}\]?\s*-?\s*([^:]+?):(.*)$"]
ENVELOPES = [rf"(?iud)^\s*\[?\s*{_CLOCK},\s*{_DATE}\]?\s*-?\s*\S", rf"(?iud)^\s*\[?\s*{_DATE},\s*{_CLOCK}\]?\s*-?\s*\S"]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def strip_leading_bidi(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BIDI}]+", "")


def header(line: Column) -> Column:
    """struct(time, date, sender, text) of a message header in either layout, else null."""
    parts = []
    for p, (t, d) in zip(HEADERS, ((1, 2), (2, 1))):
        g = lambda i, p=p: strip(F.regexp_extract(line, p, i))
        parts.append(F.when(line.rlike(p), F.struct(g(t).alias("time"), g(d).alias("date"), g(3).alias("sender"), g(4).alias("text"))))
    return F.coalesce(*parts)


def is_notice(line: Column) -> Column:
    """A dated line without a sender."""
    return (line.rlike(ENVELOPES[0]) | line.rlike(ENVELOPES[1])) & header(line).isNull()


def split_glued(line: Column) -> Column:
    """A line cut before each embedded header; pieces that are no header stay with the one before."""
    pieces = F.split(line, rf"(?iu)(?<!^)(?=\[(?:{_TIME},|\d{{1,2}}[./-]\d{{1,2}}(?:[./-]\d{{2,4}})?,))")
    is_head = lambda x: x.rlike(HEADERS[0]) | x.rlike(HEADERS[1])
    glue = lambda acc, x: F.when((F.size(acc) == 0) | is_head(x), F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), x))))
    return F.when(F.size(pieces) <= 1, F.array(line)).otherwise(F.aggregate(pieces, F.array().cast("array<string>"), glue))


def seconds_of_day(time: Column) -> Column:
    """12-hour clock to seconds of the day; null if unreadable."""
    p = r"(?iu)^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?[\s  ]*([ap])\.?m\.?\s*$"
    g = lambda i: F.regexp_extract(time, p, i)
    h = F.pmod(g(1).try_cast("int"), F.lit(12)) + F.when(F.lower(g(4)) == "p", 12).otherwise(0)
    return F.when(time.rlike(p), h * 3600 + g(2).try_cast("int") * 60 + F.coalesce(g(3).try_cast("int"), F.lit(0)))


def parse_date(raw: Column, default_year: int | None = 2026, month_first: bool = False) -> Column:
    """DATE of d/m[/y] with any of . / - between; two-digit years are 20yy; null if there is no such day."""
    p = F.split(F.regexp_replace(strip(raw), "[.-]", "/"), "/")
    a, b, y = (F.get(p, F.lit(i)).try_cast("int") for i in range(3))
    day, month = (b, a) if month_first else (a, b)
    year = F.when(F.size(p) == 2, F.lit(default_year)).otherwise(F.when(y < 100, y + 2000).otherwise(y))
    return F.when(F.size(p).isin(2, 3), F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date"))


def week_start(d: Column, first_weekday: int = 0) -> Column:
    """First day of the seven-day bucket; 0 is Monday."""
    return F.date_sub(d, F.pmod(F.weekday(d) - first_weekday, F.lit(7)))


def week_label(start: Column) -> Column:
    """Name of a week in one of three layouts: same month, across months, across years."""
    end = F.date_add(start, 6)
    f = lambda c, p: F.date_format(c, p)
    return (
        F.when(F.year(start) != F.year(end), F.concat(f(start, "dd-MMM-yyyy"), F.lit("-to-"), f(end, "dd-MMM-yyyy"), F.lit(".txt")))
        .when(F.month(start) != F.month(end), F.concat(f(start, "dd-MMM"), F.lit("-to-"), f(end, "dd-MMM-yyyy"), F.lit(".txt")))
        .otherwise(F.concat(f(start, "dd"), F.lit("-to-"), f(end, "dd-MMM-yyyy"), F.lit(".txt")))
    )


def norm_date(s: Column, year: int = 2026) -> Column:
    """Date key: a two-part date gets the year, anything else stays as it is."""
    p = F.split(strip(s), "[./-]")
    return F.when(F.size(p) == 2, F.concat(p[0], F.lit("/"), p[1], F.lit(f"/{year}"))).otherwise(strip(s))


def year_of(s: Column, year: int = 2026) -> Column:
    y = F.try_element_at(F.split(norm_date(s, year), "[./-]"), F.lit(-1)).try_cast("int")
    # the usual notation is read without splitting
    return F.when(s.rlike(r"^[0-9]{1,2}[./-][0-9]{1,2}[./-][1-9][0-9]{3}$"), F.right(s, F.lit(4)).cast("int")).otherwise(F.when(y.between(1000, 9999), y))


def year_ok(y: Column, ref: Column) -> Column:
    two = F.when(ref.isNull(), y.between(20, 40)).otherwise(y.isin(ref % 100, (ref - 1) % 100, (ref + 1) % 100))
    return F.when(y >= 100, y.between(2000, 2099)).otherwise(two)


def is_date_triple(d: Column, m: Column, y: Column, ref: Column) -> Column:
    return d.between(1, 31) & m.between(1, 12) & year_ok(y, ref)


# Dates as three loose numbers, anywhere and at the end.
_T = r"[\s.,;:/\\=|~-]+"
LOOSE = rf"(?<!\p{{Nd}})\p{{Nd}}{{1,2}}{_T}\p{{Nd}}{{1,2}}{_T}\p{{Nd}}{{2,4}}(?!\p{{Nd}})"
_DD, _MM = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])"
TRAILING = rf"(?<!\p{{Nd}}){_DD}{_T}{_MM}{_T}\p{{Nd}}{{2,4}}(?!\p{{Nd}})(\P{{Nd}}*)\z"


def strip_date_triples(text: Column, ref: Column) -> Column:
    """Dates written as three loose numbers to a blank; triples that are no date are passed over whole, left to right."""
    tokens = F.regexp_extract_all(ascii_digits(text), F.lit(rf"{LOOSE}|\p{{Nd}}+|\P{{Nd}}+"), F.lit(0))

    def blank(t: Column) -> Column:
        n = F.transform(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
        return F.when((F.size(n) == 3) & is_date_triple(F.get(n, F.lit(0)), F.get(n, F.lit(1)), F.get(n, F.lit(2)), ref), F.lit(" ")).otherwise(t)

    # both patterns are three loose numbers: texts without them stay as they are
    return F.when(text.rlike(LOOSE), F.regexp_replace(F.array_join(F.transform(tokens, blank), ""), TRAILING, " $1")).otherwise(ascii_digits(text))


_S = r"\s*[./,=\-]+\s*"
# Dates and list markers, blanked in this order.
DATE_PATTERNS = [
    rf"\d{{1,2}}{_S}\d{{1,2}}\s+20\d\d",
    rf"{BEGIN}\d{{3,4}}{_S}20\d\d{END}",
    rf"\d{{1,2}}{_S}\d{{1,2}}{_S}\d{{2,4}}",
    r"\d{1,2}:\d{1,2}:\d{2,4}",
    rf"{BEGIN}\d{{1,2}}\s+\d{{1,2}}\s+20\d\d{END}",
    rf"(?iu){BEGIN}dinank\s+\d{{1,2}}\s+20\d\d{END}",
    rf"(?iu){BEGIN}dinank\s+\d{{1,2}}\s+\d{{1,2}}\s+\d{{2}}{END}",
    rf"\A\s*\d{{1,2}}\s+\d{{1,2}}\s+\.?\d{{2}}{END}",
    rf"\A\s*\d{{1,2}}-\d{{4,6}}{END}",
    r"(?md)^\s*\d{1,2}[.)-]",
]


def strip_dates(text: Column, ref: Column) -> Column:
    t = strip_date_triples(text, ref)
    for p in DATE_PATTERNS:
        t = F.regexp_replace(t, p, " ")
    return t


def expand_number_words(text: Column) -> Column:
    """Number words before a count unit to digits, unless a digit before makes them a multiplier."""
    t = text
    units = "|".join(sorted(COUNT_UNITS, key=len, reverse=True))
    for w, n in NUMBER_WORDS.items():
        # what stands before is looked at only where the word is
        t = F.regexp_replace(t, rf"(?iu){w}(?<![^\s.,;:=\-/()\[\]|~]{w})(?<!\p{{Nd}}[ \t]{{0,64}}{w})([\s.,;:=\-/]+)(?=(?:{units})(?:[\s.,;:=\-/]|$))", f"{n}$1")
    return F.when(text.rlike(rf"(?iu)(?:{'|'.join(NUMBER_WORDS)})[\s.,;:=\-/]"), t).otherwise(text)


def digit_runs(text: Column) -> Column:
    """Every run of digits as a number; null where it is too large."""
    return F.transform(F.regexp_extract_all(ascii_digits(text), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("long"))


def numbers_in(text: Column, ref: Column) -> Column:
    """The counts a text reports: number words read, dates and list markers left out."""
    return digit_runs(strip_dates(ascii_digits(expand_number_words(text)), ref))


_NFC = r"[A-Za-z][̀-ͯ]|ا[ٓ-ٕ]|[ويہےە]ٔ|[नरळ]़"


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.str.normalize("NFC")


def nfc(c: Column) -> Column:
    """NFC; only the values in which something composes leave the JVM."""
    return F.coalesce(_nfc(F.when(c.rlike(_NFC), c)), c)


def simplify(c: Column, compose: bool = True) -> Column:
    """Key of a spelling: lower case, no marks, one form of Arabic letters, words of letters only. compose: NFC first."""
    s = F.regexp_replace(F.lower(nfc(c) if compose else c), r"\p{M}+", "")
    s = F.translate(s, "".join(ARABIC) + COSMETIC, "".join(ARABIC.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_]|\p{Nd}", " "), " +", " "))


def phrases(run: Column) -> Column:
    """Words between numbers to phrases: separators close one; a name suffix closes it and takes the last word along."""
    words = F.regexp_replace(run, r"[\s\p{Z}.,;=\-:/()\[\]{}!?|~'\"“”‘’।]+", " ")
    sep, suffix = "|".join(SEPARATORS), "|".join(NAME_SUFFIXES)
    cut = rf"(?iu)(?<=^| )(?:(?:{sep})|(?:(?!(?:{sep}|{suffix}) )[^ ]+ )?(?:{suffix}))(?= |$)"
    return F.filter(F.transform(F.split(F.regexp_replace(words, cut, "\n"), "\n"), lambda p: F.trim(p)), lambda p: p != "")


def atoms(text: Column, ref: Column) -> Column:
    """array<struct<kind, value, text>>: the numbers and phrases of a text, in order."""
    t = expand_number_words(strip_dates(text, ref))
    runs = F.regexp_extract_all(ascii_digits(t), F.lit(r"\d+|\D+"), F.lit(0))
    number = lambda r: F.array(F.struct(F.lit("num").alias("kind"), r.try_cast("long").alias("value"), F.lit(None).cast("string").alias("text")))
    phrase = lambda r: F.transform(phrases(r), lambda p: F.struct(F.lit("phrase").alias("kind"), F.lit(None).cast("long").alias("value"), p.alias("text")))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), number(r)).otherwise(phrase(r))))


def repair_infix(text: Column) -> Column:
    """A single letter between digits to 0."""
    return F.regexp_replace(text, r"(?<=\p{Nd})[A-Za-z](?=\p{Nd})", "0")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+", "")


def entries_of_json(text: Column) -> Column:
    """array<struct<chant, count>> of a model's answer: code fences off, outermost list or object read; null if neither."""
    kind = "array<struct<chant:string,count:long>>"
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    many = F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), kind)
    one = F.from_json(F.concat(F.lit("["), F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("]")), kind)
    return F.coalesce(F.when(F.size(many) > 0, many), F.when(F.size(one) > 0, one))
