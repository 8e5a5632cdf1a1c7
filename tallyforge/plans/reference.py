"""Queries of the reference operators over whole tables, and for those that SQL can express the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import lexicon, messages, quality, report, resolve
from tallyforge.session import spread
from tallyforge.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (table reader) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- numbers and keys -------------------------------------------------------------------------------------------------


@query("""
SELECT CAST(v AS BIGINT) AS value, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS v FROM documents WHERE text IS NOT NULL)
WHERE length(v) <= 18 GROUP BY 1""")
def number_census(r):
    """Numbers in the documents' texts, counted by value."""
    v = r("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("v"))
    return v.where(F.length("v") <= 18).groupBy(F.col("v").cast("long").alias("value")).agg(F.count("*").alias("n"))


@query("""
SELECT key, count(*) AS n FROM (
  SELECT trim(regexp_replace(regexp_replace(translate(regexp_replace(lower(nfc_normalize(chant)), '\\p{M}+', '', 'g'),
    'آأإٱىیئکہھةؤ', 'اااايييكهههو'), '[\\x{640}\\x{200C}-\\x{200F}\\x{FEFF}]', '', 'g'), '([^\\p{L}\\p{N}_]|\\p{Nd})+', ' ', 'g')) AS key
  FROM extracted WHERE chant IS NOT NULL) GROUP BY 1""")
def simplified_labels(r):
    """Spellings of labels, counted by their key."""
    return r("extracted").where("chant is not null").select(T.simplify(F.col("chant")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("""
SELECT id, envelope_date,
  CASE WHEN len(p) = 2 THEN p[1] || '/' || p[2] || '/2026' ELSE trim(envelope_date) END AS key,
  CASE WHEN len(p) IN (2, 3) AND regexp_full_match(trim(envelope_date), '[0-9]{1,2}[./-][0-9]{1,2}([./-]([0-9]{2}|[0-9]{4}))?') THEN
    TRY_CAST(CASE WHEN len(p) = 2 OR TRY_CAST(p[3] AS INT) IS NOT NULL THEN printf('%04d-%02d-%02d', CASE WHEN len(p) = 2 THEN 2026 WHEN CAST(p[3] AS INT) < 100 THEN CAST(p[3] AS INT) + 2000 ELSE CAST(p[3] AS INT) END, CAST(p[2] AS INT), CAST(p[1] AS INT)) END AS DATE) END AS day
FROM (SELECT id, envelope_date, regexp_split_to_array(trim(envelope_date), '[./-]') AS p FROM blocks
      WHERE regexp_full_match(trim(envelope_date), '[0-9]{1,2}[./-][0-9]{1,2}([./-]([0-9]{2}|[0-9]{4}))?'))""")
def date_keys(r):
    """Numeric envelope dates: the key that is kept as written, and the day, null where there is no such day."""
    b = r("blocks").where(F.trim("envelope_date").rlike(r"^[0-9]{1,2}[./-][0-9]{1,2}([./-]([0-9]{2}|[0-9]{4}))?$"))
    return b.select("id", "envelope_date", T.norm_date(F.col("envelope_date")).alias("key"), T.parse_date(F.col("envelope_date")).alias("day"))


def _dated_text(o: DataFrame) -> DataFrame:
    seps = F.element_at(F.array(*[F.lit(x) for x in (".", "/", "-", ",", ", ", " : ", "=", "~")]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    d, m, y = F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate") % 100
    return o.select("o_orderkey", F.year("o_orderdate").alias("ref"), F.concat(F.lit("qty "), F.floor(F.col("o_totalprice")).cast("string"), F.lit(" on "), d.cast("string"), seps, m.cast("string"), seps, F.lpad(y.cast("string"), 2, "0"), F.lit(" custno "), F.col("o_custkey").cast("string")).alias("text"))


@query("""SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS first_number, o_custkey AS last_number, CAST(2 AS INT) AS numbers FROM orders""")
def date_stripping(r):
    """Texts with a date between two counts, in eight notations: the date goes, the counts stay."""
    n = _dated_text(r("orders")).select("o_orderkey", F.inline(F.array(F.struct(T.numbers_in(F.col("text"), F.col("ref")).alias("v")))))
    return n.select("o_orderkey", F.get("v", F.lit(0)).alias("first_number"), F.element_at("v", -1).alias("last_number"), F.size("v").alias("numbers"))


@query()
def reported_numbers(r):
    """Counts that each block's text reports, without its dates and list markers."""
    return r("blocks").select("id", F.posexplode(T.numbers_in(F.col("text"), T.year_of(F.col("envelope_date")))).alias("pos", "value"))


@query()
def text_atoms(r):
    """Numbers and phrases of each block's text, in order."""
    return r("blocks").select("id", F.posexplode(T.atoms(F.col("text"), T.year_of(F.col("envelope_date")))).alias("pos", "a")).select("id", "pos", "a.kind", "a.value", "a.text")


@query("""SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, CAST(round(sum(value), 2) AS DOUBLE) AS total FROM events GROUP BY 1""")
def json_props(r):
    """A property of JSON strings, grouped."""
    return r("events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


# --- messages ---------------------------------------------------------------------------------------------------------

_LINES = """lines AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS line_no
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text LIKE '%[%:%')),
heads AS (SELECT *, regexp_matches(line, '^\\s*\\[[0-9]{1,2}:[0-9]{2}\\s*[aApP]\\.?[mM]\\.?, [0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\\]\\s*[^:]+:') AS head FROM lines)"""


def _chat(r) -> DataFrame:
    t = F.regexp_replace("text", r"\r\n?", "\n")
    return r("documents").where(F.col("text").like("%[%:%")).select("doc_id", "text").distinct().select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split(t, "\n")).alias("line_no", "line"))


@query(f"""WITH {_LINES}, g AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS msg FROM heads)
SELECT doc_id, CAST(max(msg) AS BIGINT) AS messages, count(*) AS lines FROM g WHERE msg > 0 GROUP BY 1""")
def sessionized_logs(r):
    """Messages in the documents that are chat logs, and the lines that belong to them."""
    m = messages.sessionize(_chat(r), unglue=False)
    return m.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("messages"), F.sum(F.size("lines")).cast("long").alias("lines"))


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, line_no, regexp_extract(line, '^\\s*\\[([0-9]{{1,2}}):([0-9]{{2}})\\s*([aApP])\\.?[mM]\\.?, ([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})\\]\\s*([^:]+):', ['h', 'mi', 'half', 'd', 'm', 'y', 'sender']) AS x FROM heads WHERE head)
SELECT doc_id, line_no, CAST((CAST(x.h AS INT) % 12 + CASE WHEN lower(x.half) = 'p' THEN 12 ELSE 0 END) * 3600 + CAST(x.mi AS INT) * 60 AS INT) AS seconds, TRY_CAST(x.y || '-' || lpad(x.m, 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE) AS msg_date, length(x.sender) AS sender_length FROM p""")
def parsed_headers(r):
    """Time, date and sender of every message header in the chat logs."""
    h = _chat(r).select("path", "line_no", F.inline(F.array(F.struct(T.header(F.col("line")).alias("h"))))).where("h is not null")
    return h.select(F.col("path").cast("long").alias("doc_id"), (F.col("line_no") + 1).cast("long").alias("line_no"), T.seconds_of_day(F.col("h.time")).alias("seconds"), T.parse_date(F.col("h.date")).alias("msg_date"), F.length("h.sender").cast("long").alias("sender_length"))


@query("""WITH c AS (SELECT sender, envelope_date, text, src_idx, count(*) AS n FROM blocks GROUP BY ALL),
m AS (SELECT sender, envelope_date, text, max(n) AS n, count(*) AS sources FROM c GROUP BY ALL)
SELECT sender, count(*) AS identities, CAST(sum(n) AS BIGINT) AS kept, CAST(sum(sources) AS BIGINT) AS seen FROM m GROUP BY 1""")
def merged_batches(r):
    """Batches merged by greatest multiplicity: what is kept of each sender."""
    b = r("blocks")
    key = ["sender", "envelope_date", "text"]
    kept = messages.bag_union(b.select(*key, "src_idx", "id"), key, "src_idx", ["id"])
    k = kept.groupBy(*key).agg(F.count("*").alias("n"))
    seen = b.select(*key, "src_idx").distinct().groupBy(*key).agg(F.count("*").alias("s"))
    j = [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in key]
    both = k.alias("k").join(seen.alias("s"), j[0] & j[1] & j[2])
    return both.groupBy(F.col("k.sender").alias("sender")).agg(F.count("*").alias("identities"), F.sum("n").alias("kept"), F.sum("s.s").alias("seen"))


@query("""SELECT id, src_idx, length(text) AS n_chars FROM blocks a WHERE text IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM blocks b WHERE b.sender IS NOT DISTINCT FROM a.sender AND b.envelope_date IS NOT DISTINCT FROM a.envelope_date
  AND b.src_idx <> a.src_idx AND starts_with(b.text, a.text) AND length(b.text) > length(a.text))""")
def untruncated_blocks(r):
    """Blocks that are not the beginning of a longer one from another batch."""
    b = r("blocks").where("text is not null").select("id", "src_idx", "sender", "envelope_date", F.col("text").alias("body"))
    return messages.drop_truncated(b, ["sender", "envelope_date"], "src_idx").select("id", "src_idx", F.length("body").cast("long").alias("n_chars"))


@query("""WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT s AS week_start, CASE WHEN year(s) <> year(s + 6) THEN strftime(s, '%d-%b-%Y') || '-to-' || strftime(s + 6, '%d-%b-%Y') WHEN month(s) <> month(s + 6) THEN strftime(s, '%d-%b') || '-to-' || strftime(s + 6, '%d-%b-%Y') ELSE strftime(s, '%d') || '-to-' || strftime(s + 6, '%d-%b-%Y') END || '.txt' AS week_label, n FROM w""")
def week_buckets(r):
    """Rows by week, with the week's name in its three layouts."""
    o = r("orders").select(T.week_start(F.to_date("o_orderdate")).alias("week_start")).groupBy("week_start").agg(F.count("*").alias("n"))
    return o.select("week_start", T.week_label(F.col("week_start")).alias("week_label"), "n")


@query("""SELECT o_orderstatus, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(date_trunc('week', o_orderdate) AS DATE) < CAST(date_trunc('week', DATE '1998-07-01') AS DATE) GROUP BY 1""")
def since_floor(r):
    """A static floor and closed weeks only."""
    o = r("orders").withColumn("day", F.to_date("o_orderdate"))
    w = messages.closed_weeks(messages.with_week(messages.since(o, "day", "1996-01-01"), "day"), "1998-07-01")
    return w.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))


# --- joins and lookups ------------------------------------------------------------------------------------------------

_SQL_KEY = "trim(regexp_replace(regexp_replace(translate(regexp_replace(lower(nfc_normalize({0})), '\\p{{M}}+', '', 'g'), 'آأإٱىیئکہھةؤ', 'اااايييكهههو'), '[\\x{{640}}\\x{{200C}}-\\x{{200F}}\\x{{FEFF}}]', '', 'g'), '([^\\p{{L}}\\p{{N}}_]|\\p{{Nd}})+', ' ', 'g'))"


def _dictionary(r) -> DataFrame:
    own = r("chant_list").select(F.col("chant").alias("spelling"), F.col("chant").alias("canonical"))
    return lexicon.dictionary(own.unionByName(r("chant_variants").select(F.col("key").alias("spelling"), "canonical")))


_SQL_DICT = f"""dict AS (SELECT key, max(canonical) AS canonical FROM (SELECT {_SQL_KEY.format("chant")} AS key, chant AS canonical FROM chant_list UNION ALL SELECT {_SQL_KEY.format("key")}, canonical FROM chant_variants) WHERE key <> '' GROUP BY 1)"""


@query(f"""WITH {_SQL_DICT}, e AS (SELECT {_SQL_KEY.format("chant")} AS key FROM extracted WHERE chant IS NOT NULL)
SELECT coalesce(canonical, '?') AS canonical, count(*) AS n, count(DISTINCT e.key) AS spellings FROM e LEFT JOIN dict USING (key) GROUP BY 1""")
def dictionary_join(r):
    """Labels looked up by key in the dictionary of known spellings."""
    e = r("extracted").where("chant is not null").select(T.simplify(F.col("chant")).alias("key"))
    return lexicon.lookup(e, _dictionary(r)).groupBy(F.coalesce("canonical", F.lit("?")).alias("canonical")).agg(F.count("*").alias("n"), F.countDistinct("key").alias("spellings"))


@query(f"""WITH e AS (SELECT DISTINCT {_SQL_KEY.format("chant")} AS key FROM extracted WHERE chant IS NOT NULL),
s AS (SELECT key, trim(regexp_replace(' ' || replace(key, ' ', '  ') || ' ', ' (e|ye) ', ' ', 'g')) AS rest FROM e),
t AS (SELECT key, regexp_replace(rest, ' +', ' ', 'g') AS rest FROM s)
SELECT key, chant AS canonical FROM t JOIN chant_list ON rest = lower(chant) OR rest IN (lower(chant) || ' pak', lower(chant) || ' shareef', lower(chant) || ' sharif', 'shri ' || lower(chant), 'shri ' || lower(chant) || ' pak', 'shri ' || lower(chant) || ' shareef', 'shri ' || lower(chant) || ' sharif')""")
def composed_labels(r):
    """Labels composed of classes of words, with optional words before and after."""
    keys = r("extracted").where("chant is not null").select(T.simplify(F.col("chant")).alias("key"))
    return lexicon.compose(keys, *_rules(r))


@query("""SELECT src_idx, count(*) AS n FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM review r WHERE r.msg_id = b.id AND r.code = 'non-chant') GROUP BY 1""")
def excluded_blocks(r):
    """Blocks that are not excluded as no report, by batch."""
    out = r("blocks").join(r("review").where("code = 'non-chant'").select(F.col("msg_id").alias("id")), "id", "left_anti")
    return out.groupBy("src_idx").agg(F.count("*").alias("n"))


@query(r"""WITH s AS (SELECT regexp_replace(sender, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s, trim(envelope_date) AS d0, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t, corrected_text FROM text_corrections),
c AS (SELECT s, CASE WHEN len(regexp_split_to_array(d0, '[./-]')) = 2 THEN replace(replace(d0, '.', '/'), '-', '/') || '/2026' ELSE d0 END AS d, t, min(corrected_text) AS f FROM s WHERE s IS NOT NULL AND d0 IS NOT NULL AND t IS NOT NULL GROUP BY ALL),
b AS (SELECT id, regexp_replace(sender, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s, trim(envelope_date) AS d0, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t, text FROM blocks)
SELECT id, coalesce(f, text) AS text, f IS NOT NULL AS corrected FROM b LEFT JOIN c ON b.s = c.s AND c.d = CASE WHEN len(regexp_split_to_array(d0, '[./-]')) = 2 THEN replace(replace(d0, '.', '/'), '-', '/') || '/2026' ELSE d0 END AND b.t = c.t""")
def corrected_texts(r):
    """Texts replaced where a correction is filed for the same sender, date and text."""
    m = resolve.with_store(r("blocks").select("id", "sender", "envelope_date", "text"), r("text_corrections"), "corrected_text", "fixed")
    return m.select("id", F.coalesce("fixed", "text").alias("text"), F.col("fixed").isNotNull().alias("corrected"))


@query("""WITH t(slot, label) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D')),
n AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1 HAVING count(*) = 4),
x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS slot, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM n))
SELECT label, count(*) AS n, CAST(sum(CASE WHEN label = 'B' AND q = 50 THEN 500 ELSE q END) AS BIGINT) AS total FROM x JOIN t USING (slot) GROUP BY 1""")
def template_slots(r):
    """Values given to labels by their place, where their number fits the template; a known slip put right."""
    spark = r("lineitem").sparkSession
    tpl = spark.createDataFrame([("all", 1, "A"), ("all", 2, "B"), ("all", 3, "C"), ("all", 4, "D")], "sender string, slot int, chant string")
    fixes = spark.createDataFrame([("all", "B", 50, 500)], "sender string, chant string, bad long, good long")
    li = r("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("v"))
    text = F.array_join(F.transform("v", lambda x: F.concat(F.lit("item "), x["l_quantity"].cast("long").cast("string"))), "; ")
    m = li.select(F.col("l_orderkey").alias("id"), F.lit("all").alias("sender"), F.lit("01/01/2026").alias("envelope_date"), text.alias("text"))
    return resolve.template_pairs(m, tpl, fixes).groupBy(F.col("chant").alias("label")).agg(F.count("*").alias("n"), F.sum("count").alias("total"))


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'L' ELSE 'N' END AS k, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS size FROM events),
b AS (SELECT user_id, day, size, i // 2 AS pair, count(DISTINCT k) AS kinds, count(*) AS c FROM s GROUP BY ALL)
SELECT user_id, day, CAST(max(size) AS INT) AS items, bool_and(kinds = 2 AND c = 2) AS pairs_hold FROM b GROUP BY ALL""")
def paired_streams(r):
    """Streams of labels and numbers of each user and day: whether they pair two by two."""
    k = F.when(F.col("event_type").isin("view", "click"), "L").otherwise("N")
    e = r("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", k.alias("k")))).alias("s"))
    stream = F.transform("s", lambda x: F.struct(x["k"].alias("k"), F.when(x["k"] == "L", x["event_id"].cast("string")).alias("l"), F.when(x["k"] == "N", x["event_id"]).alias("n")))
    return e.select("user_id", "day", F.size("s").alias("items"), resolve.pair_stream(stream).isNotNull().alias("pairs_hold"))


@query()
def resolved_facts(r):
    """The whole cascade, blocks to facts: no-reports excluded, corrections, templates of senders who always report the same labels in the same order, dictionary, decisions from unambiguous known spellings, compositional rules. (The tables have no store of known duplicates; that one is empty here.)"""
    return _built(r)[0]


@query()
def resolved_review(r):
    """The cascade's review side-output, counted by level and code."""
    return _built(r)[1].groupBy("level", "code").agg(F.count("*").alias("n"))


def _rules(r) -> tuple[DataFrame, DataFrame, list[str]]:
    chants = [x.chant for x in r("chant_list").select("chant").distinct().collect()]
    tokens = {w: [w.lower()] for c in chants for w in c.split()} | {"HONOUR": ["pak", "shareef", "sharif"], "SHRI": ["shri"]}
    return *lexicon.compile_rules(r("chant_list").sparkSession, tokens, {c: f"SHRI? {c} HONOUR?" for c in chants}), ["e", "ye"]


def _templates(r) -> DataFrame:
    """(sender, slot, chant): of senders with twenty messages or more that all report the same listed labels in the same order."""
    e = r("extracted").where("chant is not null").select("msg_id", "seq", "chant").distinct()
    shape = e.groupBy("msg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chant"))), lambda x: x["chant"]).alias("shape"))
    s = shape.join(r("blocks").where("sender is not null").select(F.col("id").alias("msg_id"), T.strip(F.col("sender")).alias("sender")), "msg_id")
    same = s.groupBy("sender").agg(F.count("*").alias("n"), F.min("shape").alias("a"), F.max("shape").alias("z")).where("sender <> '' and n >= 20 and a = z")
    return same.select("sender", F.posexplode("a").alias("slot", "chant")).select("sender", (F.col("slot") + 1).alias("slot"), "chant")


def _built(r) -> tuple[DataFrame, DataFrame]:
    spark = r("blocks").sparkSession
    b = spread(r("blocks").select("id", "envelope_date", "sender", "text"))
    store = lambda ids, reason: r("blocks").join(ids, "id", "left_semi").select("sender", "envelope_date", "text", F.lit(reason).alias("reason"))
    code = lambda c: r("review").where(F.col("code") == c).select(F.col("msg_id").alias("id"))
    dup = spark.createDataFrame([], readers.STORE)
    fixes = spark.createDataFrame([], "sender string, chant string, bad long, good long")
    decisions = r("chant_variants").select(T.simplify(F.col("key")).alias("key"), "canonical").where("key <> ''").groupBy("key").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("_z")).where("canonical = _z").drop("_z")
    own = r("chant_list").select(F.col("chant").alias("spelling"), F.col("chant").alias("canonical"))
    return resolve.build(b, lexicon.dictionary(own), dup, store(code("non-chant"), "no report in message"), r("text_corrections"), _templates(r), fixes, decisions, _rules(r))


# --- reconciliation and checks ----------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT envelope_date AS date, CAST(v AS BIGINT) AS value FROM (SELECT envelope_date, unnest(regexp_extract_all(text, '[0-9]+')) AS v FROM blocks) WHERE length(v) BETWEEN 3 AND 9),
f AS (SELECT date, count AS value FROM extracted WHERE count >= 100),
m AS (SELECT * FROM s EXCEPT ALL SELECT * FROM f), e AS (SELECT * FROM f EXCEPT ALL SELECT * FROM s),
u AS (SELECT date, value, count(*) AS missed, 0 AS extra FROM m GROUP BY ALL UNION ALL SELECT date, value, 0, count(*) FROM e GROUP BY ALL)
SELECT date, value, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(extra) AS BIGINT) AS extra FROM u GROUP BY ALL""")
def bag_differences(r):
    """Bags of numbers by date, in the texts and in the facts: what either has beyond the other."""
    s = r("blocks").select(F.col("envelope_date").alias("date"), F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("v")).where(F.length("v").between(3, 9)).select("date", F.col("v").cast("long").alias("value"))
    return quality.bag_difference(s, r("extracted").where("count >= 100").select("date", F.col("count").alias("value")), ["date", "value"])


@query()
def bag_differences_all(r):
    """Bags of all numbers by date, in the texts (digits of any script) and in the facts; significant from the gate's threshold on. A null value stands for runs too large for a long: no fact can hold them, so each is missed."""
    s = r("blocks").select(F.col("envelope_date").alias("date"), F.explode(T.digit_runs(F.col("text"))).alias("value"))
    d = quality.bag_difference(s, r("extracted").where("count is not null").select("date", F.col("count").alias("value")), ["date", "value"])
    return d.withColumn("significant", F.coalesce(F.col("value") >= readers.threshold(), F.lit(True)))


@query()
def reconcile_report(r):
    """Dates on which the facts differ from the numbers that the corrected texts report, with the gate's verdict."""
    code = r("review").where("code = 'non-chant'").select(F.col("msg_id").alias("id"))
    live = spread(r("blocks").select("id", "sender", "envelope_date", "text")).join(code, "id", "left_anti")
    none = code.sparkSession.createDataFrame([], readers.STORE)
    m = resolve.live_messages(live, none, none, r("text_corrections"), _templates(r))
    fixes = code.sparkSession.createDataFrame([], "sender string, chant string, bad long, good long")
    return quality.reconcile(resolve.reported_bag(m, _templates(r), fixes), quality.fact_bag(r("extracted").distinct()))


@query("""SELECT msg_id, seq, level, code FROM (
SELECT msg_id, seq, 'soft' AS level, 'year-like-count' AS code FROM (SELECT DISTINCT msg_id, seq, count FROM extracted) WHERE count BETWEEN 2020 AND 2030
UNION ALL SELECT msg_id, seq, 'hard', 'uncertain' FROM (SELECT DISTINCT msg_id, seq, chant, count FROM extracted) WHERE chant IS NULL
UNION ALL SELECT msg_id, seq, 'hard', 'count-shape' FROM (SELECT DISTINCT msg_id, seq, chant, count FROM extracted) WHERE count IS NULL) GROUP BY ALL""")
def row_flags(r):
    """Facts as labelled records of two segments: checks of role, count and plausibility."""
    e = r("extracted").select("msg_id", "seq", "chant", "count").distinct()
    seg = F.array(F.struct(F.coalesce("chant", F.lit("?")).alias("t"), F.when(F.col("chant").isNull(), "uncertain").otherwise("chant-label").alias("role")), F.struct(F.concat(F.lit(" "), F.coalesce(F.col("count").cast("string"), F.lit("-"))).alias("t"), F.lit("count").alias("role")))
    rec = e.select(F.struct("msg_id", "seq").alias("id"), F.concat(F.coalesce("chant", F.lit("?")), F.lit(" "), F.coalesce(F.col("count").cast("string"), F.lit("-"))).alias("text"), seg.alias("segments"))
    return quality.record_flags(rec).select("id.msg_id", "id.seq", "level", "code").distinct()


@query("""SELECT level, code, count(*) AS n, count(DISTINCT msg_id) AS messages, level = 'HARD' AS gate_fails FROM review GROUP BY ALL""")
def review_gate(r):
    """Review items by level and code, and whether they fail the gate."""
    return r("review").groupBy("level", "code").agg(F.count("*").alias("n"), F.countDistinct("msg_id").alias("messages")).withColumn("gate_fails", F.col("level") == "HARD")


# --- reports ----------------------------------------------------------------------------------------------------------


@query("""SELECT date, chant, string_agg(CAST(count AS VARCHAR), '+' ORDER BY msg_id, seq, count) AS expr FROM extracted WHERE chant <> '' AND count IS NOT NULL GROUP BY ALL""")
def daily_expressions(r):
    """Counts of a day and label joined with +, in order."""
    return report.daily_expressions(r("extracted")).select("date", "chant", "expr")


@query("""SELECT chant, CAST(sum(count) AS BIGINT) AS total, count(*) AS n FROM extracted WHERE chant <> '' AND count IS NOT NULL GROUP BY 1""")
def label_totals(r):
    """Totals by label."""
    return report.totals(r("extracted"), ["chant"])


_CHANTS = ["SABAH TASBEEH", "GULZAR WAZEEFA", "SAMANDAR JAAP", "KOHSAR PAATH", "NEELAM MALA"]


@query(f"""SELECT date, {", ".join(f"coalesce(CAST(sum(CASE WHEN chant = '{c}' THEN count END) AS BIGINT), 0) AS {c.lower().replace(' ', '_')}" for c in _CHANTS)} FROM extracted WHERE chant <> '' AND count IS NOT NULL AND date <> 'Unknown' GROUP BY 1""")
def daily_pivot(r):
    """Totals by date in columns for five labels, zero where there is none."""
    p = report.daily_pivot(r("extracted"), _CHANTS)
    return p.select("date", *[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in _CHANTS])


@query()
def daily_pivot_all(r):
    """Totals by date in a column for every label that has a fact: those of chant_list in its order, then the free spellings by first arrival; zero where there is none."""
    e = r("extracted")
    return report.daily_pivot(e.repartition("date"), report.ordered_labels(e, r("chant_list")))


@query("""SELECT chant, count(*) AS n, min(count) AS least, max(count) AS greatest, count(DISTINCT count) AS kinds FROM extracted WHERE chant <> '' AND count IS NOT NULL GROUP BY 1""")
def label_profile(r):
    """Number, least, greatest and distinct counts of each label."""
    return report.profile(r("extracted"), ["chant"])


@query("""SELECT chant, CAST(length(CAST(count AS VARCHAR)) AS INT) AS digits, count(*) AS n FROM extracted WHERE chant <> '' AND count IS NOT NULL GROUP BY ALL""")
def digit_lengths(r):
    """Counts by number of digits."""
    return report.digit_lengths(r("extracted"), ["chant"])


@query("""WITH c AS (SELECT chant, count, count(*) AS n, min(coalesce(date, '')) AS d FROM extracted WHERE chant <> '' AND count IS NOT NULL GROUP BY ALL),
k AS (SELECT chant, count, n, row_number() OVER (PARTITION BY chant ORDER BY n DESC, d, count) AS rank FROM c)
SELECT chant, count, n, CAST(rank AS INT) AS rank FROM k WHERE rank <= 6""")
def most_common_counts(r):
    """The six commonest counts of each label."""
    return report.most_common(r("extracted").withColumn("date", F.coalesce("date", F.lit(""))), ["chant"])


@query("""SELECT chant, date, CAST(sum(count) AS BIGINT) AS total, CAST(grouping(date) AS INT) AS all_dates FROM extracted WHERE chant <> '' AND count IS NOT NULL GROUP BY GROUPING SETS ((chant, date), (chant))""")
def rolled_up_totals(r):
    """Totals by label and date, and by label over all dates, in one pass."""
    e = report.usable(r("extracted"))
    return e.rollup("chant", "date").agg(F.sum("count").alias("total"), F.grouping("date").cast("int").alias("all_dates"), F.grouping("chant").alias("_g")).where("_g = 0").drop("_g")


@query("""SELECT id, CAST(n AS INT) AS n FROM (SELECT id, row_number() OVER (PARTITION BY sender, envelope_date, text, src_idx ORDER BY id) AS n FROM blocks) WHERE n > 1""")
def repeated_in_batch(r):
    """Blocks that repeat one of their own batch, by occurrence number."""
    w = Window.partitionBy("sender", "envelope_date", "text", "src_idx").orderBy("id")
    return r("blocks").select("id", F.row_number().over(w).alias("n")).where("n > 1")
