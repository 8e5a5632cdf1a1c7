r"""Several values packed in one field: one row per value, with its position.

Quoted spans are replaced by indexed placeholders between two private characters that the text does not hold,
the rest is split at the delimiters, the spans are restored by array lookup, and the pieces are exploded with
their positions. Everything is native expressions, in one pass without a shuffle.

`unpack` is the general splitter; `report_items` keeps the pieces that are one label with one count, and only of
fields with two or more of them. Defined results: null, empty and blank fields give no rows; an unclosed quote is an
ordinary character; a field without delimiters is one value; repeated rows are kept by `unpack`, merged by `report_items`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import spread

SP = r"[\s\p{Z}\p{Cf}]"
#: Spans within which a delimiter does not split.
QUOTED = r"\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|(?<![\p{L}\p{M}\p{Nd}])['‘][^'’\n]+['’](?![\p{L}\p{M}\p{Nd}])"
#: One of these begins every quoted span.
OPENING = "[\"“«'‘]"
DELIMITERS = r"[;,|•/+&\t\r\n।॥،؛；，｜／＋＆]"
#: Pairs of private characters; the first pair of which the field has neither is used.
PRIVATE = [(chr(a), chr(a + 1)) for a in range(0xE000, 0xE010, 2)]

NUM = r"[-−－]?\p{Nd}[\p{Nd}\p{Cf}]*"
# Words for "times" that may stand beside a count.
UNIT = r"(?:times|martaba|martba|mrtba|baar|bar|x|×|बार|मर्तबा|بار|مرتبہ|مرتبه)"
# Words that begin a note about a moment, a place or a person's number, or a register number.
NOTE = (
    r"(?:waqt|likha gaya|recorded at|recorded|posted|sent|starts|shuru|समय|शुरू|شروع|وقت|ts|ms|epoch|page|forwarded"
    r"|address|pata|venue|aana hai|bhejna hai|likhiye|mail|e-?mail|email id|write to|kyc|id|document|card no|pehchan no|ph|phone|call|mobile no|whatsapp|sampark|naya number|reach me on"
    r"|register no|register|sl no|dua mein yaad rakhna)"
)
# digits of a number may be parted by characters that are not seen
_D = r"\p{Nd}(?:\p{Cf}*\p{Nd})"
DATE = rf"(?<!\p{{Nd}})(?:dinank\s+)?(?:{_D}?\s?[./,-]\s?{_D}?\s?[./,-]\s?(?:{_D}{{3}}|{_D})|{_D}{{3}}-{_D}-{_D})(?!\p{{Cf}}*\p{{Nd}})"
LABEL = r"[\p{L}][\p{L}\p{M}\p{Cf}\p{Z}\s.'’_;,|•/+&।،-]*?[\p{L}\p{M}\p{Cf}]"
EDGES = rf"^{SP}+|{SP}+$"
ITEM_A = rf"^{LABEL}{SP}*(?:[=:–x×-]|{SP}){SP}*{NUM}(?:{SP}*{UNIT})?$"
ITEM_B = rf"^{NUM}(?:{SP}*{UNIT})?{SP}*(?:[=:–x×-]|{SP}){SP}*{LABEL}$"


def spans(text: Column) -> Column:
    """The quoted spans of a field, in order."""
    return F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0))


def mask_quotes(text: Column, opening: Column, closing: Column) -> Column:
    """The field with every quoted span replaced by its index between two private characters."""
    parts = F.split(text, QUOTED, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(opening, (i - 1).cast("string"), closing, p))), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces_of(text: Column, delimiters: str = DELIMITERS) -> Column:
    """array<string>: every piece between delimiters, quoted spans whole, outer space gone, empty pieces left out."""
    # where a text holds all those pairs, a run of a private character longer than any in the text is free for certain
    longest = lambda t: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit(f"{PRIVATE[0][0]}+"), F.lit(0)), F.length)), F.lit(0))
    run = lambda t, more: F.concat(F.lit(PRIVATE[0][1]), F.repeat(F.lit(PRIVATE[0][0]), longest(t) + more), F.lit(PRIVATE[0][1]))
    mark = lambda t, i: F.coalesce(*[F.when(~t.contains(p[0]) & ~t.contains(p[1]), F.lit(p[i])) for p in PRIVATE], run(t, i + 1))

    trim = lambda p: F.regexp_replace(p, EDGES, "")
    kept = lambda pieces: F.filter(pieces, lambda p: p != "")

    def quoted(s: Column) -> Column:
        t, o, c, q = s["t"], s["o"], s["c"], s["q"]

        def restore(piece: Column) -> Column:
            inner = F.split(piece, F.concat(o, F.lit("|"), c), -1)
            return F.array_join(F.transform(inner, lambda x, i: F.when(i % 2 == 1, F.get(q, x.try_cast("int"))).otherwise(x)), "")

        return kept(F.transform(F.split(mask_quotes(t, o, c), delimiters, -1), lambda p: trim(restore(p))))

    def split(t: Column) -> Column:
        with_quotes = let(F.struct(t.alias("t"), mark(t, 0).alias("o"), mark(t, 1).alias("c"), spans(t).alias("q")), quoted)
        return F.when(t.rlike(OPENING), with_quotes).otherwise(kept(F.transform(F.split(t, delimiters, -1), trim)))

    return let(text, split)


def unpack(rows: DataFrame, text: str = "text", delimiters: str = DELIMITERS) -> DataFrame:
    """Adds `pos` (from 1) and `piece` to each row. Columns of those names are overwritten."""
    d = rows.where(F.col(text).isNotNull())
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("pos", "piece")]
    return d.select(*kept, F.posexplode(pieces_of(F.col(text), delimiters)).alias("pos", "piece")).withColumn("pos", F.col("pos") + 1)


def bare(piece: Column) -> Column:
    """Without enclosing quotes and outer space."""
    inner = F.regexp_replace(piece, r"^(?:\"([^\"]*)\"|“([^”]*)”|«([^»]*)»|['‘]([^'’]*)['’])$", "$1$2$3$4")
    return F.when(piece.rlike(f"^{OPENING}"), F.regexp_replace(inner, EDGES, "")).otherwise(piece)


def item(piece: Column) -> Column:
    """The item in a piece without outer space: itself, or what follows a lead-in and a colon; null if it is none."""
    fits = lambda c: (c.rlike(ITEM_A) | c.rlike(ITEM_B)) & ~c.rlike(rf"(?iu)^{NOTE}(?![\p{{L}}\p{{M}}])")
    after = lambda w: let(bare(F.regexp_replace(w, rf"^[^:]*:{SP}*", "")), lambda r: F.when(fits(r), r))
    of = lambda w: F.when(w.rlike(rf"(?iu)^{NOTE}{SP}*[:=-]"), None).when(fits(w), w).when(w.contains(":"), after(w))
    # a piece without a digit holds no count
    return F.when(piece.rlike(r"\p{Nd}"), let(bare(piece), of))


def report_items(blocks: DataFrame) -> DataFrame:
    """(id, pos, value): every label-with-count of the texts that pack two or more of them. A row's items stay in its array until they are numbered, so nothing is shuffled but the distinct rows of the end."""
    # notes about moments, places and numbers run to the end of their line or bar; dates hold delimiters of their own
    note = rf"(?iu)(?:(?<=[\n|;])|^){SP}*{NOTE}(?![\p{{L}}\p{{M}}]){SP}*[:=-]?{SP}*[^\n]*"
    t = F.regexp_replace(F.regexp_replace(F.col("text"), DATE, ""), r"\r\n?", "\n")
    lines = F.transform(F.split(t, "\n"), lambda x: F.when(x.rlike(rf"(?iu)^{SP}*(?:register|sl no)"), x).otherwise(F.regexp_replace(x, note, "")))
    items = F.array_compact(F.transform(pieces_of(F.array_join(lines, "\n")), item))
    d = spread(blocks.select("id", "text")).where(F.col("text").rlike(r"\p{Nd}")).select(F.col("id").cast("long").alias("id"), F.inline(F.array(F.struct(items.alias("v")))))
    return d.where(F.size("v") >= 2).select("id", F.posexplode("v").alias("pos", "value")).select("id", (F.col("pos") + 1).alias("pos"), "value").distinct()
