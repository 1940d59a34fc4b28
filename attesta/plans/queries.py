"""Queries that apply the operators to the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import card_text, geometry, mrz
from attesta.functions import tables as T
from attesta.functions import text as X
from attesta.operators import fit, layout, names, raster, spatial, votes
from attesta.plans import card, zones
from attesta.sources.tables import dealt, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def digits(x, n):
    return F.lpad(x.cast("string"), n, "0")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, dealt by their key: each row is widened to much more work than its size shows."""
    return dealt(table(spark, sf_dir, "customer"), "c_custkey")


# --- machine-readable zones ----------------------------------------------------------------------------------------


def mrz_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zone's text per customer, made from its key and then damaged in known ways."""
    k = F.col("c_custkey")
    c = customers(spark, sf_dir).select(k, F.concat(F.lit("A"), digits(k, 8)).alias("number"))
    birth = F.concat(digits(F.lit(60) + k % 40, 2), digits(1 + k % 12, 2), digits(1 + k % 28, 2))
    expiry = F.concat(digits(F.lit(25) + k % 10, 2), digits(1 + k % 12, 2), digits(1 + k % 28, 2))
    sex = F.when(k % 2 == 0, "M").otherwise("F")
    c = c.withColumn("a", F.concat(F.lit("I<TJK"), "number", mrz.check_sum(F.col("number"), 9), digits(k, 13), F.lit("<<")))
    c = c.withColumn("b", F.concat(birth, mrz.check_sum(birth, 6), sex, expiry, mrz.check_sum(expiry, 6), F.lit("TJK" + "<" * 11)))
    whole = F.concat(F.substring("a", 6, 25), F.substring("b", 1, 7), F.substring("b", 9, 7), F.substring("b", 19, 11))
    c = c.withColumn("b", F.concat("b", mrz.check_sum(whole, 50)))
    letters = F.translate(k.cast("string"), "0123456789", "ABDFGHJMNO")
    c = c.withColumn("c", F.rpad(F.concat(F.lit("M"), letters, F.lit("<<N"), letters), 30, "<"))
    damaged = F.when(k % 7 == 0, F.concat(F.substring("a", 1, 6), F.replace(F.substring("a", 7, 8), F.lit("0"), F.lit("O")), F.substring("a", 15, 100))).otherwise(F.col("a"))
    damaged = F.when(k % 11 == 0, F.concat(F.substring(damaged, 1, 20), F.substring(damaged, 22, 100))).otherwise(damaged)
    noise = F.when(k % 5 == 0, "NOTHING<TO<SEE<HERE<AT<ALL\n").otherwise("")
    return c.select(F.col("c_custkey").alias("doc_id"), F.concat(noise, damaged, F.lit("\n"), "b", F.lit("\n"), "c").alias("text"))


_TRUTH = """
WITH k AS (SELECT c_custkey AS doc_id, lpad(c_custkey::VARCHAR, 8, '0') AS num, lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') AS d, lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') AS m,
  c_custkey % 11 = 0 AS dropped, lpad(c_custkey::VARCHAR, 13, '0') || '00' AS xo, '0' || substr(lpad(c_custkey::VARCHAR, 13, '0'), 1, 5) || substr(lpad(c_custkey::VARCHAR, 13, '0'), 7, 7) || '00' AS xn,
  c_custkey % 11 = 0 AND list_sum(list_transform(range(0, 15), lambda j: (substr(xn, j + 1, 1)::INT - substr(xo, j + 1, 1)::INT) * [7, 3, 1][(10 + j) % 3 + 1])) % 10 <> 0 AS unsure, translate(c_custkey::VARCHAR, '0123456789', 'ABDFGHJMNO') AS letters FROM customer),
f AS (
  SELECT doc_id, 'documentNumber' AS field, 'A' || num AS value, 98.0 AS confidence FROM k
  UNION ALL SELECT doc_id, 'birthDate', d || '.' || m || '.19' || (60 + doc_id % 40)::VARCHAR, 98.0 FROM k
  UNION ALL SELECT doc_id, 'expiryDate', d || '.' || m || '.20' || (25 + doc_id % 10)::VARCHAR, 98.0 FROM k
  UNION ALL SELECT doc_id, 'sex', CASE WHEN doc_id % 2 = 0 THEN 'M' ELSE 'F' END, CASE WHEN unsure THEN 82.0 ELSE 92.0 END FROM k
  UNION ALL SELECT doc_id, 'citizenship', 'TJK', CASE WHEN unsure THEN 82.0 ELSE 92.0 END FROM k
  UNION ALL SELECT doc_id, 'nationalIdNumber', lpad(doc_id::VARCHAR, 13, '0'), 92.0 FROM k WHERE NOT dropped
  UNION ALL SELECT doc_id, 'mrzSurname', 'M' || letters, CASE WHEN unsure THEN 82.0 ELSE 92.0 END FROM k
  UNION ALL SELECT doc_id, 'mrzGivenNames', 'N' || letters, CASE WHEN unsure THEN 82.0 ELSE 92.0 END FROM k)
"""


@query(_TRUTH + "SELECT doc_id, field, value, confidence::DOUBLE AS confidence, 'mrz' AS source FROM f")
def mrz_roundtrip_fields(spark, sf_dir):
    return card.mrz_facts(mrz_texts(spark, sf_dir))


@query(_TRUTH + "SELECT doc_id, " + ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS \"{f}\"" for f in T.FIELDS) + " FROM f GROUP BY doc_id")
def fields_pivot_wide(spark, sf_dir):
    return votes.wide(card.mrz_facts(mrz_texts(spark, sf_dir)), ["doc_id"], T.FIELDS)


@query("SELECT o_orderkey, ((SELECT sum((ascii(c) - 48) * [7, 3, 1][(i - 1) % 3 + 1]) FROM (SELECT unnest(string_split(lpad(o_orderkey::VARCHAR, 9, '0'), '')) AS c, unnest(range(1, 10)) AS i)) % 10)::BIGINT::VARCHAR AS digit FROM orders")
def check_digit_731(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", mrz.check_sum(digits(F.col("o_orderkey"), 9), 9).alias("digit"))


# --- text ----------------------------------------------------------------------------------------------------------

_UNWRAP = r"regexp_replace({}, '([^.!?:;\n])\n([a-zа-яёӣӯқғҳҷ])', '\1 \2', 'g')"
_EDGES = r"regexp_replace({}, '^[\s\x{{00A0}}\x{{FEFF}}]+|[\s\x{{00A0}}\x{{FEFF}}]+$', '', 'g')"


@query(
    r"""
WITH t AS (SELECT doc_id, replace(replace(replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10)), ' and ', chr(10) || 'and  '), ' the ', '   the' || chr(9)) AS x FROM documents),
l AS (SELECT doc_id, list_transform(string_split(replace(x, chr(13), ''), chr(10)), lambda s: """
    + _EDGES.format(r"regexp_replace(s, '[ \t]+', ' ', 'g')")
    + r""") AS ls FROM t),
j AS (SELECT doc_id, array_to_string(list_filter(ls, lambda s, i: s <> '' OR (i > 1 AND ls[i - 1] <> '')), chr(10)) AS x FROM l)
SELECT doc_id, """
    + _EDGES.format(r"regexp_replace(" + _UNWRAP.format(_UNWRAP.format("x")) + r", '\n{{3,}}', chr(10) || chr(10), 'g')").replace("{{3,}}", "{3,}")
    + " AS text FROM j"
)
def text_cleanup(spark, sf_dir):
    x = F.replace(F.replace(F.replace("text", F.lit(". "), F.lit(".\r\n\n\n")), F.lit(" and "), F.lit("\nand  ")), F.lit(" the "), F.lit("   the\t"))
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_text(x).alias("text"))


@query("SELECT p_partkey, 'A' || lpad(p_partkey::VARCHAR, 8, '0') AS number, 'ABEK' || p_partkey::VARCHAR AS latin FROM part")
def homoglyph_digit_repair(spark, sf_dir):
    k = F.col("p_partkey")
    read = F.concat(F.lit("А"), F.translate(digits(k, 8), "013568", "OІЗSбВ"))
    return table(spark, sf_dir, "part").select("p_partkey", X.number_digits(read).alias("number"), X.homoglyphs(F.concat(F.lit("АВЕК"), k.cast("string"))).alias("latin"))


@query(
    """
WITH d AS (SELECT o_orderkey, lpad((1 + o_orderkey % 31)::VARCHAR, 2, '0') AS d, lpad((1 + o_orderkey % 13)::VARCHAR, 2, '0') AS m, strftime(o_orderdate, '%Y') AS y FROM orders)
SELECT o_orderkey, CASE WHEN try_strptime(y || '-' || m || '-' || d, '%Y-%m-%d') IS NOT NULL THEN d || '.' || m || '.' || y END AS date,
  CASE WHEN try_strptime(y || '-' || m || '-' || d, '%Y-%m-%d') IS NOT NULL AND y::INT BETWEEN 1995 AND 2100 THEN d || '.' || m || '.' || y END AS zone,
  CASE WHEN try_strptime('20' || right(y, 2) || '-' || m || '-' || d, '%Y-%m-%d') IS NOT NULL THEN d || '.' || m || '.20' || right(y, 2) END AS expiry FROM d"""
)
def date_shape_validation(spark, sf_dir):
    k = F.col("o_orderkey")
    d, m, y = digits(1 + k % 31, 2), digits(1 + k % 13, 2), F.date_format("o_orderdate", "yyyy")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X.validate_date(F.concat(F.lit("on "), d, F.lit("/"), m, F.lit("/"), y, F.lit(" ."))).alias("date"), X.zone_date(F.concat(d, m, y), 1995, 2100).alias("zone"),
        mrz.date_of(F.concat(F.substring(y, 3, 2), m, d), True, card.AS_OF_YEAR).alias("expiry"),
    )


@query(
    r"""
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ab ' || lpad(o_orderkey::VARCHAR, 7, '0') WHEN 1 THEN 'ABCD' || o_orderkey WHEN 2 THEN 'Z' || lpad(o_orderkey::VARCHAR, 9, '0') || '.' ELSE o_orderkey::VARCHAR END AS v FROM orders),
c AS (SELECT *, regexp_replace(upper(regexp_replace(v, '^[\s:;/|.,-]+|[\s:;/|.,-]+$', '', 'g')), '\s', '', 'g') AS n, regexp_replace(v, '\s', '', 'g') AS s FROM x)
SELECT o_orderkey, CASE WHEN regexp_matches(n, '^[A-Z]{1,3}[0-9]{6,9}$') THEN n END AS number, CASE WHEN regexp_matches(s, '^[0-9]{8,14}$') THEN s END AS digits,
  (length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 2) AS is_value FROM c"""
)
def document_number_shape(spark, sf_dir):
    k = F.col("o_orderkey")
    v = F.when(k % 4 == 0, F.concat(F.lit(" ab "), digits(k, 7))).when(k % 4 == 1, F.concat(F.lit("ABCD"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("Z"), digits(k, 9), F.lit("."))).otherwise(k.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.validate_document_number(v).alias("number"), X.validate_digits(v).alias("digits"), X.looks_like_value(v).alias("is_value"))


@query(
    r"""
WITH t AS (SELECT doc_id, 'surname' AS a, text || chr(10) || '31.12.1999 and 01/02/03, 05.06.2001' AS x FROM documents),
e AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(x, '(\d{1,2}[./]\d{1,2}[./]\d{2,4})', 1))) AS d, x FROM t),
o AS (SELECT doc_id, d, regexp_extract(d, '(\d{2,4})$', 1)::INT AS y, instr(x, d) AS p FROM e)
SELECT doc_id, array_to_string(list(d ORDER BY y, list_position(all_, d)), ' ') AS dates FROM (SELECT o.*, regexp_extract_all(t.x, '(\d{1,2}[./]\d{1,2}[./]\d{2,4})', 1) AS all_ FROM o JOIN t USING (doc_id)) GROUP BY doc_id"""
)
def pattern_fact_extraction(spark, sf_dir):
    x = F.concat("text", F.lit("\n31.12.1999 and 01/02/03, 05.06.2001"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(card_text.ordered_dates(x), " ").alias("dates"))


@query(
    r"""
SELECT conv_id, turn, (SELECT count(*) > 0 AND bool_and(list_contains(['"""
    + "','".join(T.LABEL_WORDS)
    + r"""'], w)) FROM (SELECT unnest(regexp_extract_all(replace(lower(t), '''', ''), '[a-z]+')) AS w)) AS label_text, regexp_matches(t, '^[[:upper:]\s''-]{4,}$') AND NOT regexp_matches(t, '[^A-Z\s''-]') AS plausible
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Date of Birth' WHEN 1 THEN 'SAMPLEOVA' ELSE 'Father''s name X' END AS t FROM conversations)"""
)
def label_text_filter(spark, sf_dir):
    t = F.when(F.col("turn") % 3 == 0, "Date of Birth").when(F.col("turn") % 3 == 1, "SAMPLEOVA").otherwise("Father's name X")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.english_label_text(t).alias("label_text"), X.plausible_name(t).alias("plausible"))


# --- similarity ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, levenshtein(p_name, p_brand)::BIGINT AS distance, round(levenshtein(p_name, p_brand)::DOUBLE / greatest(length(p_name), length(p_brand), 1), 6) AS ratio FROM part")
def edit_distance_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_brand").cast("long").alias("distance"), F.round(X.distance_ratio(F.col("p_name"), F.col("p_brand")), 6).alias("ratio"))


@query(
    """
WITH k AS (SELECT c_custkey, translate(c_custkey::VARCHAR, '0123456789', 'АБВҒЖХЧШЯҚ') AS cyr FROM customer),
t AS (SELECT c_custkey, cyr, replace(replace(replace(replace(replace(replace(translate(cyr, 'АБВҚ', 'ABVQ'), 'Ғ', 'GH'), 'Ж', 'ZH'), 'Х', 'KH'), 'Ч', 'CH'), 'Ш', 'SH'), 'Я', 'YA') AS lat FROM k)
SELECT c_custkey, lat, translate(replace(replace(cyr, 'А', ''), 'Я', ''), 'БВҒЖХЧШҚ', 'BVGJHJSK') AS cyr_skeleton,
  regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(lat, 'KH', 'H'), 'SH', 'S'), 'CH', 'J'), 'TS', 'S'), 'Q', 'K'), 'C', 'S'), 'X', 'H'), 'W', 'V'), '[AEIOUY]', '', 'g') AS lat_skeleton, true AS agree FROM t"""
)
def transliterate_skeleton(spark, sf_dir):
    cyr = F.translate(F.col("c_custkey").cast("string"), "0123456789", "АБВҒЖХЧШЯҚ")
    lat = X.transliterate(cyr)
    return table(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), X.cyrillic_skeleton(cyr).alias("cyr_skeleton"), X.latin_skeleton(lat).alias("lat_skeleton"), X.agrees(cyr, lat).alias("agree"))


# --- votes and merges ----------------------------------------------------------------------------------------------


def reads(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("value"), F.floor(F.col("value") % 100).alias("confidence"))


_READS = "r AS (SELECT user_id, event_id AS seq, event_type AS value, floor(value % 100)::BIGINT AS confidence FROM events)"


@query(
    f"""WITH {_READS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, value ORDER BY seq) AS n FROM r),
s AS (SELECT *, min(seq) FILTER (WHERE n = 2) OVER (PARTITION BY user_id) AS stop FROM n),
v AS (SELECT user_id, value, count(*) AS votes, max(confidence) AS confidence, min(seq) AS first_seq FROM s WHERE stop IS NULL OR seq <= stop GROUP BY user_id, value)
SELECT * FROM v WHERE votes >= 2 OR confidence >= 60 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, confidence DESC, first_seq) = 1"""
    .replace("FROM v WHERE votes >= 2 OR confidence >= 60 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, confidence DESC, first_seq) = 1",
             "FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, confidence DESC, first_seq) = 1) WHERE votes >= 2 OR confidence >= 60")
)
def vote_winner_first_to_two(spark, sf_dir):
    return votes.first_to_two(reads(spark, sf_dir), ["user_id"], 60)


@query(f"WITH {_READS} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (confidence >= 92) DESC, CASE WHEN confidence >= 92 THEN seq END, confidence DESC, seq) = 1")
def best_read_early_stop(spark, sf_dir):
    return votes.best_read(reads(spark, sf_dir), ["user_id"])


@query(f"WITH {_READS} SELECT * FROM r WHERE confidence >= 40 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1")
def first_acceptable_read(spark, sf_dir):
    return votes.first_read(reads(spark, sf_dir), ["user_id"], 40)


@query(f"WITH {_READS}, d AS (SELECT user_id, value, min(seq) AS seq, max(confidence) AS confidence FROM r GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq)::INT AS place FROM d QUALIFY place <= 2")
def distinct_reads_capped(spark, sf_dir):
    return votes.distinct_reads(reads(spark, sf_dir), ["user_id"])


_POS = "((l_linenumber * 1000000 + l_partkey) * 100000000 + floor(l_extendedprice * 100 + 0.5))::BIGINT"


def line_order():
    """A total order of an order's lines: their numbers may repeat."""
    return ((F.col("l_linenumber") * F.lit(1_000_000).cast("long") + F.col("l_partkey")) * 100_000_000 + F.floor(F.col("l_extendedprice") * 100 + 0.5)).cast("long")


@query(
    """
WITH t AS (SELECT *, min((l_quantity > 8)::INT) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ok FROM (SELECT *, {POS} AS pos FROM lineitem))
SELECT l_orderkey, string_agg(l_returnflag || l_partkey, ', ' ORDER BY pos) AS value, greatest(50.0, least(90.0, floor(avg(l_quantity + 40) + 0.5)))::DOUBLE AS confidence FROM t WHERE ok = 1 GROUP BY l_orderkey""".replace("{POS}", _POS)
)
def take_while_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", line_order().alias("pos"), "l_quantity", F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"), (F.col("l_quantity") + 40).alias("confidence"))
    return votes.joined_lines(votes.take_while(lines, ["l_orderkey"], "pos", F.col("l_quantity") > 8), ["l_orderkey"], "pos")


def ranked(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_type").alias("field"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), F.floor(F.col("value") % 100).alias("confidence"), F.col("event_id").alias("src_rank"), (F.col("event_id") % 2).alias("tier"))


_RANKED = "f AS (SELECT user_id, event_type AS field, 'v' || event_id AS value, floor(value % 100)::BIGINT AS confidence, event_id AS src_rank, event_id % 2 AS tier FROM events)"


@query(f"WITH {_RANKED} SELECT * FROM f WHERE confidence >= 35 QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY confidence DESC, src_rank) = 1")
def confidence_merge(spark, sf_dir):
    return votes.merge_facts(ranked(spark, sf_dir), ["user_id", "field"])


@query(f"WITH {_RANKED} SELECT * FROM f WHERE confidence >= 35 QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY tier, confidence DESC, src_rank) = 1")
def tiered_overlay(spark, sf_dir):
    return votes.tiered_merge(ranked(spark, sf_dir), ["user_id", "field"])


@query(f"WITH {_RANKED} SELECT * FROM f QUALIFY src_rank = max(src_rank) OVER (PARTITION BY user_id, field)")
def latest_attempt_wins(spark, sf_dir):
    return votes.latest_attempts(ranked(spark, sf_dir), ["user_id", "field"], "src_rank")


# --- sequences -----------------------------------------------------------------------------------------------------


@query(
    """
WITH w AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS x0, floor(epoch(ts))::BIGINT + 600 AS x1, value FROM events),
n AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY user_id ORDER BY x0, event_id) > 36000 THEN 1 ELSE 0 END AS new_ FROM w),
s AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY x0, event_id) AS segment FROM n)
SELECT user_id, segment::BIGINT AS segment, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM s GROUP BY user_id, segment"""
)
def gap_segments(spark, sf_dir):
    w = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("x0"), (F.unix_timestamp("ts") + 600).alias("x1"))
    g = spatial.gap_segments(w, ["user_id"], "x0", "x1", F.lit(36000))
    return g.groupBy("user_id", "segment").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n"))


_BANDS = """y AS (SELECT DISTINCT event_type, (floor(epoch(ts)) % 86400)::BIGINT // 60 AS y FROM events),
n AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY event_type ORDER BY y) > 3 THEN 1 ELSE 0 END AS new_ FROM y),
s AS (SELECT *, sum(new_) OVER (PARTITION BY event_type ORDER BY y) AS band FROM n)"""


@query(f"WITH {_BANDS} SELECT event_type, band::BIGINT AS band, min(y) AS top, max(y) AS bottom, count(*) AS n FROM s GROUP BY event_type, band")
def tolerant_bands(spark, sf_dir):
    y = table(spark, sf_dir, "events").select("event_type", F.floor((F.unix_timestamp("ts") % 86400) / 60).alias("y")).distinct()
    return spatial.tolerant_bands(y, ["event_type"], "y")


@query(
    """
WITH b AS (SELECT l_orderkey, {POS} AS pos, l_linenumber * 40.0 + l_quantity / 10 AS top, l_linenumber * 40.0 + l_quantity / 10 + 20 + l_quantity / 5 AS bottom, l_discount * 100 AS l, 300.0 + l_tax * 100 AS r FROM lineitem),
g AS (SELECT *, lag(top, 1) OVER w AS t1, lag(top, 2) OVER w AS t2, lag(bottom, 1) OVER w AS b1, lag(bottom, 2) OVER w AS b2, lag(l, 1) OVER w AS l1, lag(l, 2) OVER w AS l2, lag(r, 1) OVER w AS r1, lag(r, 2) OVER w AS r2
  FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)),
o AS (SELECT *, greatest(bottom - top, b1 - t1, b2 - t2) AS hi, least(bottom - top, b1 - t1, b2 - t2) AS lo FROM g WHERE t2 IS NOT NULL)
SELECT l_orderkey, pos FROM o WHERE (hi - lo) / hi <= 0.4 AND abs((top - t1) - (t1 - t2)) / greatest(top - t1, t1 - t2) <= 0.3
  AND least(greatest(0, least(r, r1) - greatest(l, l1)) / greatest(1, least(r - l, r1 - l1)), greatest(0, least(r1, r2) - greatest(l1, l2)) / greatest(1, least(r1 - l1, r2 - l2))) >= 0.7
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY pos DESC) = 1""".replace("{POS}", _POS)
)
def sliding_triples(spark, sf_dir):
    q = F.col("l_quantity")
    top = F.col("l_linenumber") * 40.0 + q / 10
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", line_order().alias("pos"), top.alias("top"), (top + 20 + q / 5).alias("bottom"), (F.col("l_discount") * 100).alias("left"), (F.lit(300.0) + F.col("l_tax") * 100).alias("right"))
    return spatial.band_triples(b, ["l_orderkey"], "pos").select("l_orderkey", "pos")


@query(
    """
WITH l AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next1, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations)
SELECT conv_id, turn, length(text)::BIGINT AS asked, length(next1)::BIGINT AS answered FROM l WHERE role = 'user' AND next_role = 'assistant'"""
)
def adjacent_pair_scan(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("next1", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("asked"), F.length("next1").cast("long").alias("answered"))


# --- joins ---------------------------------------------------------------------------------------------------------


def boxes(spark, sf_dir, odd):
    e = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == odd)
    x, y = F.col("event_id") % 50, (F.unix_timestamp("ts") % 86400) / 60.0
    return e.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("text"), F.floor(F.col("value") % 100).alias("confidence"), x.cast("double").alias("x0"), (x + 60).cast("double").alias("x1"), F.floor(y).cast("double").alias("y0"), (F.floor(y) + 30).cast("double").alias("y1"))


_BOXES = """b AS (SELECT user_id, event_id AS seq, event_type AS text, floor(value % 100)::BIGINT AS confidence, (event_id % 50)::DOUBLE AS x0, (event_id % 50 + 60)::DOUBLE AS x1,
  floor((floor(epoch(ts)) % 86400) / 60.0)::DOUBLE AS y0, floor((floor(epoch(ts)) % 86400) / 60.0)::DOUBLE + 30 AS y1 FROM events),
even_ AS (SELECT * FROM b WHERE seq % 2 = 0), odd_ AS (SELECT * FROM b WHERE seq % 2 = 1)"""
_OVER = "greatest(0, least(a.{0}1, c.{0}1) - greatest(a.{0}0, c.{0}0)) / greatest(1, least(a.{0}1 - a.{0}0, c.{0}1 - c.{0}0))"


@query(
    f"""WITH {_BOXES} SELECT a.user_id, a.seq, c.seq AS below FROM even_ a LEFT JOIN odd_ c ON a.user_id = c.user_id AND c.y0 BETWEEN a.y1 - 0.4 * (a.y1 - a.y0) AND a.y1 + 2 * (a.y1 - a.y0) AND {_OVER.format("x")} >= 0.3
QUALIFY row_number() OVER (PARTITION BY a.user_id, a.seq ORDER BY c.y0 NULLS LAST, c.seq) = 1"""
)
def nearest_below_join(spark, sf_dir):
    return spatial.nearest_below(boxes(spark, sf_dir, 0), boxes(spark, sf_dir, 1), ["user_id"]).select("a.user_id", "a.seq", F.col("b.seq").alias("below"))


@query(
    f"""WITH {_BOXES} SELECT a.user_id, a.seq FROM even_ a WHERE NOT EXISTS (SELECT 1 FROM odd_ c WHERE a.user_id = c.user_id AND {_OVER.format("y")} >= 0.5 AND {_OVER.format("x")} >= 0.3 AND c.confidence > a.confidence + 8)"""
)
def overlap_antijoin(spark, sf_dir):
    return spatial.drop_shadows(boxes(spark, sf_dir, 0), boxes(spark, sf_dir, 1), ["user_id"]).select("user_id", "seq")


@query(
    f"""WITH {_BOXES}, h AS (SELECT a.user_id, a.seq AS w_seq, c.seq AS l_seq, c.text FROM even_ a JOIN odd_ c ON a.user_id = c.user_id AND {_OVER.format("y")} >= 0.5 AND {_OVER.format("x")} >= 0.5
  QUALIFY row_number() OVER (PARTITION BY a.user_id, a.seq ORDER BY c.seq) = 1), u AS (SELECT *, row_number() OVER (PARTITION BY user_id, l_seq ORDER BY w_seq) AS use_ FROM h)
SELECT e.user_id, e.seq, coalesce(u.text, e.text) AS text, u.l_seq FROM even_ e LEFT JOIN u ON e.user_id = u.user_id AND e.seq = u.w_seq WHERE use_ IS NULL OR use_ = 1"""
)
def first_match_once_join(spark, sf_dir):
    return spatial.merge_labels(boxes(spark, sf_dir, 0), boxes(spark, sf_dir, 1), ["user_id"], spatial.same_spot("w", "l")).select("user_id", "seq", "text", "l_seq")


@query(
    f"""WITH {_BOXES}, j AS (SELECT a.user_id, a.seq, c.seq AS value_seq, greatest(0.0, c.y0 - a.y1) + 0.25 * abs((c.x0 + c.x1) / 2 - (a.x0 + a.x1) / 2) AS far FROM even_ a JOIN odd_ c ON a.user_id = c.user_id
  AND c.y0 - a.y1 BETWEEN -0.2 * (a.y1 - a.y0) AND 3.5 * (a.y1 - a.y0) AND abs((c.x0 + c.x1) / 2 - (a.x0 + a.x1) / 2) <= greatest(a.x1 - a.x0, 3 * (a.y1 - a.y0)) AND c.confidence >= 40)
SELECT user_id, seq, value_seq FROM j QUALIFY row_number() OVER (PARTITION BY user_id, seq ORDER BY far, value_seq) = 1"""
)
def value_near_label(spark, sf_dir):
    return spatial.closest_value(boxes(spark, sf_dir, 0), boxes(spark, sf_dir, 1).withColumnRenamed("text", "value"), ["user_id"]).select("a.user_id", "a.seq", F.col("b.seq").alias("value_seq"))


@query(
    """
WITH s AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Surname' WHEN 1 THEN 'Place of birth' WHEN 2 THEN 'Father name' ELSE 'Date of BIRTH' END AS text FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 1 WHEN 2 THEN 5 ELSE 7 END AS anchor FROM s WHERE turn % 4 <> 1"""
)
def label_left_join_regex(spark, sf_dir):
    anchors = spark.createDataFrame([(i, *a) for i, a in enumerate(T.ANCHORS)], "anchor int, source string, pattern string, excluded string, x int, y int")
    t = F.col("turn") % 4
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("english").alias("source"), F.when(t == 0, "Surname").when(t == 1, "Place of birth").when(t == 2, "Father name").otherwise("Date of BIRTH").alias("text"))
    return spatial.match_anchors(s, anchors).select("conv_id", "turn", "anchor")


# --- fits and statistics -------------------------------------------------------------------------------------------


@query("SELECT l_partkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS scale, round(regr_intercept(l_extendedprice, l_quantity), 2) + 0.0 AS shift, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_quantity) > 1")
def linear_refit(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").alias("t"), F.col("l_extendedprice").alias("v"))
    some = l.groupBy("l_partkey").agg(F.count_distinct("t").alias("d")).where("d > 1").select("l_partkey")
    r = fit.refit(l.join(some, "l_partkey", "left_semi"), ["l_partkey"])
    return r.select("l_partkey", F.round("scale", 4).alias("scale"), (F.round("shift", 2) + 0.0).alias("shift"), "n")


@query("SELECT s_suppkey, round(0.5 + (s_suppkey % 20) / 10.0, 3)::DOUBLE AS scale, (s_suppkey % 70)::DOUBLE AS shift, 9::BIGINT AS n FROM supplier")
def consensus_axis_fit(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("seq"))
    k, i = F.col("s_suppkey"), F.col("seq")
    t = (i * 140).cast("double")
    good = (0.5 + (k % 20) / 10.0) * t + k % 70
    points = s.select("s_suppkey", "seq", t.alias("t"), F.when(i % 4 == 3, good + 900 + i * 137).otherwise(good).alias("v"))
    f = fit.consensus_fit(points, ["s_suppkey"])
    return f.select("s_suppkey", F.round("scale", 3).alias("scale"), (F.round("shift", 3) + 0.0).alias("shift"), "n")


@query("SELECT l_suppkey, list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 2 + 1] AS median FROM lineitem GROUP BY l_suppkey")
def upper_median(spark, sf_dir):
    return fit.upper_medians(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")


_HIST = "h AS (SELECT l_returnflag, greatest(0, least(255, floor(l_extendedprice / 400)))::INT AS bin, count(*) AS n FROM lineitem GROUP BY ALL)"


def prices(spark, sf_dir):
    return fit.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_extendedprice") / 400)


@query(
    f"""WITH {_HIST}, c AS (SELECT *, sum(n) OVER w AS c, sum(n * bin) OVER w AS m, sum(n) OVER (PARTITION BY l_returnflag) AS cn, sum(n * bin) OVER (PARTITION BY l_returnflag) AS mn FROM h WINDOW w AS (PARTITION BY l_returnflag ORDER BY bin))
SELECT l_returnflag, bin AS threshold FROM (SELECT *, CASE WHEN cn > c THEN c::DOUBLE * (cn - c)::DOUBLE * (m::DOUBLE / c - (mn - m)::DOUBLE / (cn - c)) * (m::DOUBLE / c - (mn - m)::DOUBLE / (cn - c)) END AS v FROM c) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC NULLS LAST, bin) = 1"""
)
def histogram_otsu(spark, sf_dir):
    return fit.otsu(prices(spark, sf_dir), ["l_returnflag"])


@query(
    f"""WITH {_HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) AS a, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin DESC) AS z, sum(n) OVER (PARTITION BY l_returnflag) AS al FROM h)
SELECT l_returnflag, min(bin) FILTER (WHERE a >= al * 0.015) AS low, greatest(min(bin) FILTER (WHERE a >= al * 0.015) + 1, max(bin) FILTER (WHERE z >= al * 0.015)) AS high FROM c GROUP BY l_returnflag"""
)
def percentile_clip(spark, sf_dir):
    return fit.clip_range(prices(spark, sf_dir), ["l_returnflag"])


@query("SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 14 PRECEDING AND 14 FOLLOWING), 6) AS mean FROM events")
def box_mean_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return fit.box_mean(e, ["event_type"], "event_id", "value", 14).select("event_type", "event_id", F.round("mean", 6).alias("mean"))


# --- zone reads ----------------------------------------------------------------------------------------------------


@query(
    """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '1' || lpad((c_custkey % 1000)::VARCHAR, 12, '0') WHEN 1 THEN 'TJK' WHEN 2 THEN 'A' || lpad((c_custkey % 100000)::VARCHAR, 8, '0') WHEN 3 THEN
  CASE WHEN c_custkey % 31 < 28 THEN lpad((1 + c_custkey % 31)::VARCHAR, 2, '0') || '.02.2011' END END AS value FROM customer"""
)
def zone_read_parsing(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        k, F.element_at(F.array(*[F.lit(x) for x in ("nationalIdNumber", "citizenship", "documentNumber", "issueDate")]), (k % 4 + 1).cast("int")).alias("field"),
        F.when(k % 4 == 0, F.concat(F.lit("1"), digits(k % 1000, 12), F.lit(" ."))).when(k % 4 == 1, F.lit("тҷк/TIK")).when(k % 4 == 2, F.concat(F.lit("a"), F.translate(digits(k % 100000, 8), "0158", "OISB")))
        .otherwise(F.concat(digits(1 + k % 31, 2), F.lit(". 02.2011"))).alias("raw"),
    )
    return c.select(k, X.parse_zone_read(F.col("field"), F.lit("value"), F.col("raw"), card.AS_OF_YEAR).alias("value"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lpad(c_custkey::VARCHAR, 9, '0') WHEN 1 THEN 'AB(IV)Rh+' WHEN 2 THEN 'MARRIED' WHEN 3 THEN 'N/A' ELSE 'МУҶАРРАД' END AS value FROM customer")
def back_read_parsing(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (k % 5 + 1).cast("int"))
    raw = pick(F.concat(digits(k, 9), F.lit(" -")), "ab(IV) Rh+", "ОИЛАДОР/MARIED", "n/a", "мучаррад/SINGLE")
    raw = F.when(k % 5 == 4, "муҷаррад/SINGLE").otherwise(raw)
    return table(spark, sf_dir, "customer").select(k, X.parse_back_read(pick("taxId", "bloodGroup", "maritalStatus", "bloodGroup", "maritalStatus"), pick("value", "value", "latin", "value", "cyrillic"), raw).alias("value"))


# --- Python kernels ------------------------------------------------------------------------------------------------


_BASE = "translate({}::VARCHAR, '0123456789', 'АНИҚОХЧШРЛ')"
_LATIN = "replace(replace(replace(replace(translate({}, 'АВДИҚЛМНОРСУФ', 'AVDIQLMNORSUF'), 'Х', 'KH'), 'Ч', 'CH'), 'Ш', 'SH'), 'Я', 'YA')"


@query(f"SELECT c_custkey, {_BASE.format('c_custkey')} AS truth, translate({_BASE.format('c_custkey')}, 'ҚЧ', 'КҶ') AS cyrillic, {_BASE.format('c_custkey')} AS repaired, 0.0::DOUBLE AS ratio FROM customer")
def name_repair(spark, sf_dir):
    cyr = F.translate(F.col("c_custkey").cast("string"), "0123456789", "АНИҚОХЧШРЛ")
    wrong = F.translate(cyr, "ҚЧ", "КҶ")
    rows = customers(spark, sf_dir).select("c_custkey", cyr.alias("truth"), wrong.alias("cyrillic"))
    return names.with_repair(rows, "cyrillic", F.array(X.transliterate(F.col("truth"))), whole=True)


@query(
    f"""WITH k AS (SELECT c_custkey AS doc_id, 'СН' || {_BASE.format("c_custkey")} || 'АД' AS truth FROM customer)
SELECT doc_id, 'СП' || substr(truth, 3) AS cyrillic, truth AS repaired, 0.0::DOUBLE AS ratio FROM k"""
)
def name_alignment(spark, sf_dir):
    """A letter that recognition confused and hooks cannot mend."""
    k = F.col("c_custkey")
    truth = F.concat(F.lit("СН"), F.translate(k.cast("string"), "0123456789", "АНИҚОХЧШРЛ"), F.lit("АД"))
    rows = customers(spark, sf_dir).select(k.alias("doc_id"), F.concat(F.lit("СП"), F.substring(truth, 3, 100)).alias("cyrillic"), X.transliterate(truth).alias("l"))
    return names.with_repair(rows, "cyrillic", F.array("l"), whole=True).drop("l")


# --- names across both sides ---------------------------------------------------------------------------------------

#: Fields with the first letters of their made-up names and their height on the page.
NAME_HEADS = [("surname", "САФА", 0.0), ("givenNames", "ДАВ", 200.0), ("fatherName", "МУР", 400.0)]


def name_truth(spark, sf_dir):
    """(doc_id, case, field, y, truth): three names per customer and one of six ways in which they are found."""
    k = F.col("c_custkey")
    heads = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(h).alias("head"), F.lit(y).alias("y")) for f, h, y in NAME_HEADS])).alias("n")
    base = F.translate(k.cast("string"), "0123456789", "АНИҚОХЧШРЛ")
    return customers(spark, sf_dir).select(k.alias("doc_id"), (k % 6).alias("case"), base.alias("base"), heads).select("doc_id", "case", "n.field", "n.y", F.concat("n.head", "base").alias("truth"))


def name_evidence(spark, sf_dir):
    """(cyrillic lines, latin lines, zone reads, labelled names, machine-read names) of name_truth."""
    t = name_truth(spark, sf_dir)
    seen = t.where(F.col("case").isin(0, 4, 5))
    box = lambda top: [F.lit(0.0).alias("x0"), top.alias("y0"), F.lit(300.0).alias("x1"), (top + 40).alias("y1")]
    line = lambda df, text, seen_, top, seq: df.select("doc_id", F.lit("front").alias("side"), seq.alias("seq"), text.alias("text"), F.lit(seen_).alias("confidence"), *box(top))
    wrong = F.when(F.col("case") == 4, F.translate("truth", "ҚЧ", "КҶ")).otherwise(F.col("truth"))
    at = (F.col("y") / 100).cast("int")
    cyrillic = line(seen, F.concat(F.lit(" "), wrong, F.lit(".")), 80.0, F.col("y"), at)
    # in case 5 each model also reads the other script's line, as a shadow
    cyrillic = cyrillic.unionByName(line(seen.where("case = 5"), F.lit("ХХХНАШ"), 50.0, F.col("y") + 45, at + 1))
    latin = line(seen, X.transliterate(F.col("truth")), 80.0, F.col("y") + 45, at)
    latin = latin.unionByName(line(seen.where("case = 5"), F.lit("NAWXX"), 60.0, F.col("y") + 2, at + 1)).unionByName(line(seen, F.lit("SURNAME"), 95.0, F.col("y") + 100, at + 7))
    under = t.where("case = 3")
    no_box = [F.lit(None).cast("int").alias("line"), F.lit(0).alias("zone_seq"), F.lit(0).alias("padding_seq"), F.lit(False).alias("fixed")]
    reads = under.select("doc_id", F.lit("front").alias("side"), "field", F.lit("cyrillic").alias("part"), *no_box, F.concat(F.lit("'"), F.lower("truth"), F.lit(" -")).alias("raw"), F.lit(70.0).alias("confidence"), *box(F.col("y")))
    labelled = t.where("case = 2").select("doc_id", F.lit("front").alias("side"), "field", F.col("truth").alias("value"), F.lit(80.0).alias("confidence"))
    machine = t.where("case in (0, 1) and field <> 'fatherName'").select("doc_id", F.lit("back").alias("side"), "field", X.transliterate(F.col("truth")).alias("value"))
    # a front without machine-read names says nothing about the back's
    machine = machine.unionByName(machine.withColumn("side", F.lit("front")).withColumn("value", F.lit(None).cast("string")))
    return cyrillic, latin, reads, labelled, machine


_NAME_TRUTH = f"""t AS (SELECT c_custkey AS doc_id, c_custkey % 6 AS c, f.field, f.head || {_BASE.format("c_custkey")} AS truth
  FROM customer, (VALUES ('surname', 'САФА'), ('givenNames', 'ДАВ'), ('fatherName', 'МУР')) f(field, head)),
names_ AS (SELECT doc_id, field, CASE WHEN c = 1 THEN {_LATIN.format("truth")} ELSE truth END AS value,
  CASE WHEN c IN (0, 4, 5) THEN 88.0 WHEN c = 1 THEN 58.0 ELSE 55.0 END::DOUBLE AS confidence,
  CASE WHEN c IN (0, 4, 5) THEN 'verified' WHEN c = 1 THEN 'mrz' ELSE 'layout' END AS source FROM t WHERE NOT (c = 1 AND field = 'fatherName'))"""


@query(f"WITH {_NAME_TRUTH} SELECT * FROM names_")
def resolve_names(spark, sf_dir):
    cyrillic, latin, reads, labelled, machine = name_evidence(spark, sf_dir)
    return names.resolve_names(names.line_pairs(cyrillic, latin), zones.anchored_names(reads, card.AS_OF_YEAR), labelled, machine)


@query(f"WITH {_NAME_TRUTH} SELECT doc_id, truth AS cyrillic, {_LATIN.format('truth')} AS latin FROM t WHERE c IN (0, 5) UNION ALL SELECT doc_id, translate(truth, 'ҚЧ', 'КҶ'), {_LATIN.format('truth')} FROM t WHERE c = 4")
def name_line_pairs(spark, sf_dir):
    cyrillic, latin, *_ = name_evidence(spark, sf_dir)
    return names.line_pairs(cyrillic, latin).select("doc_id", "cyrillic", "latin")


@query(
    f"""WITH k AS (SELECT c_custkey AS doc_id, 'САФА' || {_BASE.format("c_custkey")} AS truth FROM customer)
SELECT doc_id, 'surname' AS field, truth AS cyrillic, {_LATIN.format("truth")} AS latin, 50.0::DOUBLE AS confidence FROM k"""
)
def closest_name_reads(spark, sf_dir):
    """Of two reads in each script the pair that agrees best, whatever their confidence."""
    t = name_truth(spark, sf_dir).where("field = 'surname'")
    reads = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(i).alias("seq"), v.alias("value"), F.lit(c).alias("confidence")) for p, i, v, c in (
        ("cyrillic", 0, F.concat(F.lit("ОЛ"), F.col("truth")), 90.0), ("cyrillic", 1, F.col("truth"), 50.0), ("latin", 0, F.lit("XWVU"), 95.0), ("latin", 1, X.transliterate(F.col("truth")), 40.0),
    )])).alias("r")
    rows = t.select("doc_id", F.lit("front").alias("side"), "field", reads).select("doc_id", "side", "field", "r.*", *[F.lit(float(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    return names.closest_reads(rows).select("doc_id", "field", "cyrillic", "latin", "confidence")


# --- known places on the card --------------------------------------------------------------------------------------


def card_reads(spark, sf_dir):
    """Reads of both sides' places per customer, some wrong, some repeated, some too unsure."""
    k = F.col("c_custkey")
    d, m = digits(1 + k % 28, 2), digits(1 + k % 12, 2)
    number, person = F.concat(F.lit("B"), digits(k % 100000000, 8)), digits(k, 13)
    t = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    rows = [  # side, field, part, line, zone, padding, fixed, text, confidence
        ("front", "sex", "value", None, 0, 0, False, t("?"), 99), ("front", "sex", "value", None, 0, 1, False, F.when(k % 2 == 0, "M").otherwise(" F"), 10),
        ("front", "citizenship", "value", None, 0, 0, False, t("тҷк/TIK"), 30), ("front", "birthPlace", "value", None, 0, 0, False, t("XXXTJK"), 30),
        ("front", "birthDate", "value", None, 0, 0, False, t("01.01.1999"), 99), ("front", "birthDate", "value", None, 1, 0, False, t("01.01.1999"), 99),
        ("front", "birthDate", "value", None, 2, 0, False, t(d, ".", m, ". 1990"), 50), ("front", "birthDate", "value", None, 2, 1, False, t(d, m, "1990"), 30), ("front", "birthDate", "value", None, 2, 2, False, t("01.01.1999"), 99),
        ("front", "issueDate", "value", None, 0, 0, False, t(d, ".", m, ".2012"), 55), ("front", "issueDate", "value", None, 0, 0, True, t(d, ".", m, ".2013"), 91),
        ("front", "expiryDate", "value", None, 0, 0, False, t("none"), 99), ("front", "expiryDate", "value", None, 3, 0, False, t("x"), 99), ("front", "expiryDate", "value", None, 4, 0, False, t("x"), 99),
        ("front", "expiryDate", "value", None, 5, 0, False, t("01.01.2031"), 99), ("front", "documentNumber", "value", None, 0, 0, False, F.lower(number), 45), ("front", "documentNumber", "value", None, 0, 0, True, t("Z00000000"), 99),
        ("front", "nationalIdNumber", "value", None, 0, 0, True, t(person, "."), 10), ("front", "nationalIdNumber", "value", None, 0, 1, True, t("no"), 99), ("front", "nationalIdNumber", "value", None, 0, 2, True, person, 20),
        ("back", "address", "cyrillic", 0, 0, 0, False, t("ш. Душанбе,"), 50), ("back", "address", "cyrillic", 0, 0, 1, False, t("ш. Душанбе, х.", k.cast("string")), 70), ("back", "address", "cyrillic", 1, 0, 0, False, t("к. Лоҳутӣ (2) -"), 95),
        ("back", "address", "cyrillic", 1, 0, 1, False, t("к. Лоҳутии"), 99), ("back", "address", "cyrillic", 2, 0, 0, False, t("12"), 99), ("back", "address", "cyrillic", 3, 0, 0, False, t("дигар"), 99),
        ("back", "authority", "cyrillic", None, 0, 0, False, t("ШВКД"), 99), ("back", "authority", "cyrillic", None, 0, 1, False, t("ШВКД ноҳияи", k.cast("string")), 99),
        ("back", "maritalStatus", "cyrillic", None, 0, 0, False, t("оиладор/"), 0), ("back", "maritalStatus", "latin", None, 0, 0, False, F.when(k % 3 == 0, "/MARIED").otherwise("x"), 0),
        ("back", "bloodGroup", "value", None, 0, 0, False, t("A(II)Rh-"), 5), ("back", "bloodGroup", "value", None, 0, 1, False, t("b(iii) rh+"), 3), ("back", "bloodGroup", "value", None, 0, 2, False, t("B(III)Rh+"), 4),
        ("back", "taxId", "value", None, 0, 0, False, digits(k, 9), 0), ("back", "taxId", "value", None, 0, 1, False, t("12"), 99),
    ]
    every = [F.struct(F.lit(s).alias("side"), F.lit(f).alias("field"), F.lit(p).alias("part"), F.lit(n).cast("int").alias("line"), F.lit(z).alias("zone_seq"), F.lit(g).alias("padding_seq"), F.lit(x).alias("fixed"), v.cast("string").alias("raw"), F.lit(float(c)).alias("confidence")) for s, f, p, n, z, g, x, v, c in rows]
    out = customers(spark, sf_dir).select(k.alias("doc_id"), F.explode(F.array(*every)).alias("r")).select("doc_id", "r.*")
    out = out.withColumn("confidence", F.when((F.col("field") == "taxId") & (F.col("padding_seq") == 0), F.when(F.col("doc_id") % 2 == 0, 96.4).otherwise(39.0)).otherwise(F.col("confidence")))
    # the second rectangle of a value lies within 8 pixels of the first, the others do not
    x = F.when(F.col("zone_seq") < 2, F.col("zone_seq") * 8.0).otherwise(F.col("zone_seq") * 100.0)
    return out.select("*", x.alias("x0"), F.lit(0.0).alias("y0"), (x + 50).alias("x1"), F.lit(30.0).alias("y1"))


_CARD = "k AS (SELECT c_custkey AS doc_id, lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') || '.' || lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') AS dm FROM customer)"
_FRONT = """front AS (SELECT doc_id, 'sex' AS field, CASE WHEN doc_id % 2 = 0 THEN 'M' ELSE 'F' END AS value, 85.0 AS confidence FROM k UNION ALL SELECT doc_id, 'citizenship', 'TJK', 85 FROM k UNION ALL SELECT doc_id, 'birthPlace', 'TJK', 85 FROM k
  UNION ALL SELECT doc_id, 'birthDate', dm || '.1990', 86 FROM k UNION ALL SELECT doc_id, 'issueDate', dm || '.2013', 91 FROM k
  UNION ALL SELECT doc_id, 'documentNumber', 'B' || lpad((doc_id % 100000000)::VARCHAR, 8, '0'), 86 FROM k UNION ALL SELECT doc_id, 'nationalIdNumber', lpad(doc_id::VARCHAR, 13, '0'), 86 FROM k)"""
_BACK = """back AS (SELECT doc_id, 'address' AS field, 'Ш. ДУШАНБЕ, Х.' || doc_id || ', К. ЛОҲУТӢ (2)' AS value, 83.0 AS confidence FROM k UNION ALL SELECT doc_id, 'authority', 'ШВКД НОҲИЯИ' || doc_id, 90 FROM k
  UNION ALL SELECT doc_id, 'maritalStatus', 'ОИЛАДОР', CASE WHEN doc_id % 3 = 0 THEN 90 ELSE 65 END FROM k UNION ALL SELECT doc_id, 'bloodGroup', 'B(III)Rh+', 86 FROM k
  UNION ALL SELECT doc_id, 'taxId', lpad(doc_id::VARCHAR, 9, '0'), 96 FROM k WHERE doc_id % 2 = 0)"""


@query(f"WITH {_CARD}, {_FRONT} SELECT doc_id, 'front' AS side, field, value, confidence::DOUBLE AS confidence, 'layout' AS source FROM front")
def front_zone_facts(spark, sf_dir):
    return zones.front_zone_facts(card_reads(spark, sf_dir).where("side = 'front'"), card.AS_OF_YEAR)


@query(f"WITH {_CARD}, {_BACK} SELECT doc_id, 'back' AS side, field, value, confidence::DOUBLE AS confidence, 'layout' AS source FROM back")
def back_zone_facts(spark, sf_dir):
    return zones.back_zone_facts(card_reads(spark, sf_dir).where("side = 'back'"))


@query("SELECT c_custkey AS doc_id, 'expiryDate' AS field, 0.585::DOUBLE AS x, 0.795::DOUBLE AS y, 0.15::DOUBLE AS width, 0.055::DOUBLE AS height FROM customer")
def missing_zone_fallback(spark, sf_dir):
    reads = card_reads(spark, sf_dir).where("side = 'front'")
    return zones.missing_zones(reads, zones.front_zone_facts(reads, card.AS_OF_YEAR))


# --- layout of a page ----------------------------------------------------------------------------------------------


def page_lines(spark, sf_dir):
    """A page's lines per customer: label lines with values beside, below and far below them."""
    k = F.col("c_custkey")
    letters = F.translate(k.cast("string"), "0123456789", "ABDFGHJMNO")
    number, date = F.concat(F.lit("C"), digits(k % 100000000, 8)), F.concat(digits(1 + k % 28, 2), F.lit("/"), digits(1 + k % 12, 2), F.lit("/1991"))
    spec = [  # top, line confidence, words of (text, confidence, left, right)
        (0, 90, [("|Surname:", 90, 0, 80)]), (30, 60, [(F.concat(F.lit("SAFA"), letters), 60, 5, 90)]), (36, 95, [("SMALL", 39, 10, 60)]),
        (200, 88, [("Document", 88, 0, 80), ("No.", 70, 85, 110), (number, 66, 115, 200)]), (400, 75, [("Sex", 75, 0, 30), ("Date", 75, 200, 240), ("of", 75, 245, 260), ("birth", 75, 265, 300)]),
        (430, 71, [("M", 71, 5, 20), (date, 64, 205, 300)]), (600, 80, [("Nationality", 80, 0, 100)]), (640, 77, [("TJK", 77, 160, 190)]), (660, 24, [("TJK", 99, 0, 50)]),
        (700, 90, [("Surname", 90, 0, 80)]), (730, 50, [("OTHER", 50, 5, 90)]),
    ]
    box = lambda x0, y0, x1, y1: F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))])
    word = lambda w, y: F.struct((w[0] if not isinstance(w[0], str) else F.lit(w[0])).alias("text"), F.lit(float(w[1])).alias("confidence"), box(w[2], y, w[3], y + 20).alias("bbox"))
    lines = [
        F.struct(F.lit(i).alias("line_no"), F.concat_ws(" ", *[w[0] if not isinstance(w[0], str) else F.lit(w[0]) for w in ws]).alias("text"), F.lit(float(c)).alias("confidence"), box(min(w[2] for w in ws), y, max(w[3] for w in ws), y + 20).alias("bbox"), F.array(*[word(w, y) for w in ws]).alias("words"))
        for i, (y, c, ws) in enumerate(reversed(spec))
    ]
    rows = customers(spark, sf_dir).select(k.alias("doc_id"), F.explode(F.array(*lines)).alias("l"))
    return rows.select("doc_id", F.lit("front").alias("side"), F.lit(0).alias("block_no"), F.lit(0).alias("par_no"), "l.*")


_LAYOUT = """k AS (SELECT c_custkey AS doc_id, translate(c_custkey::VARCHAR, '0123456789', 'ABDFGHJMNO') AS letters, lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') || '.' || lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') || '.1991' AS d FROM customer),
f AS (SELECT doc_id, 'surname' AS field, 'SAFA' || letters AS value, 60.0 AS confidence FROM k UNION ALL SELECT doc_id, 'documentNumber', 'C' || lpad((doc_id % 100000000)::VARCHAR, 8, '0'), 88 FROM k
  UNION ALL SELECT doc_id, 'sex', 'M', 71 FROM k UNION ALL SELECT doc_id, 'birthDate', d, 64 FROM k UNION ALL SELECT doc_id, 'citizenship', 'TJK', 77 FROM k)"""


@query(f"WITH {_LAYOUT} SELECT doc_id, 'front' AS side, field, value, confidence::DOUBLE AS confidence, 'layout' AS source FROM f")
def layout_page_facts(spark, sf_dir):
    return card.layout_facts(page_lines(spark, sf_dir))


@query(
    """SELECT doc_id, "at"::INT AS "at", text FROM (SELECT c_custkey AS doc_id, v."at", CASE v."at" WHEN 2 THEN 'SAFA' || translate(c_custkey::VARCHAR, '0123456789', 'ABDFGHJMNO') WHEN 4 THEN 'Document No. C' || lpad((c_custkey % 100000000)::VARCHAR, 8, '0')
  WHEN 6 THEN 'M ' || lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') || '/' || lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') || '/1991' ELSE v.text END AS text
FROM customer, (VALUES (1, 'Surname'), (2, ''), (3, 'SMALL'), (4, ''), (5, 'Sex Date of birth'), (6, ''), (7, 'Nationality'), (8, 'TJK'), (9, 'Surname'), (10, 'OTHER')) v("at", text))"""
)
def page_line_order(spark, sf_dir):
    return layout.clean_lines(page_lines(spark, sf_dir)).select("doc_id", "at", "text")


_PAGES = "p AS (SELECT user_id, event_id AS seq, floor(value % 100)::BIGINT AS confidence, event_id % 5 AS n FROM events), s AS (SELECT *, confidence + 3 * n AS score FROM p), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, seq) = 1)"


def scored_pages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.floor(F.col("value") % 100).alias("confidence"))
    fields = e.select("user_id", "seq", F.explode(F.slice(F.array(*[F.lit(f) for f in T.FIELDS]), F.lit(1), (F.col("seq") % 5).cast("int"))).alias("field"))
    return e, layout.best_page(e, fields, ["user_id"])


@query(f"WITH {_PAGES} SELECT user_id, seq, confidence, score FROM b")
def best_page(spark, sf_dir):
    return scored_pages(spark, sf_dir)[1]


@query(f"WITH {_PAGES} SELECT p.user_id, p.seq, row_number() OVER (PARTITION BY p.user_id ORDER BY (p.seq <> b.seq)::INT, p.seq)::INT AS turn FROM p JOIN b ON p.user_id = b.user_id QUALIFY turn <= 2")
def zone_page_order(spark, sf_dir):
    pages, best = scored_pages(spark, sf_dir)
    return layout.zone_page_order(pages, best, ["user_id"]).select("user_id", "seq", "turn")


@query(
    """WITH r AS (SELECT user_id, event_id % 2 + 1 AS turn, event_id % 3 % 2 AS area, event_id AS seq, event_id % 7 AS score, floor(value % 100)::BIGINT AS confidence FROM events)
SELECT user_id, seq FROM r WHERE turn = 1 OR area <> 1 OR (SELECT max(area) FROM r x WHERE x.user_id = r.user_id) = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY 10 * score + confidence DESC, turn, area, seq) = 1"""
)
def best_zone_read(spark, sf_dir):
    i = F.col("event_id")
    reads = table(spark, sf_dir, "events").select("user_id", (i % 2 + 1).alias("turn"), (i % 3 % 2).alias("area"), i.alias("seq"), (i % 7).alias("score"), F.floor(F.col("value") % 100).alias("confidence"))
    return layout.best_zone_read(reads, ["user_id"]).select("user_id", "seq")


@query(
    """WITH l AS (SELECT l_orderkey, {POS} AS seq, repeat('A', (20 + l_quantity % 20)::INT) || ' <-' AS text, l_linenumber * 10.0 AS y0 FROM lineitem),
r AS (SELECT * FROM l WHERE length(text) - 2 BETWEEN 24 AND 36 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY y0 DESC, seq DESC) <= 3)
SELECT l_orderkey, seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY y0, seq)::INT AS place FROM r""".replace("{POS}", _POS)
)
def lowest_zone_lines(spark, sf_dir):
    text = F.concat(F.repeat(F.lit("a"), (F.col("l_quantity") % 20 + 20).cast("int")), F.lit(" <-"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", line_order().alias("seq"), text.alias("text"), (F.col("l_linenumber") * 10.0).alias("y0"))
    return layout.zone_lines(lines, ["l_orderkey"]).select("l_orderkey", "seq", "place")


# --- text of a card, and both sides together ------------------------------------------------------------------------


def card_texts(spark, sf_dir):
    """The front's text per customer in four states: clean, headers garbled, numbers split, machine-readable lines only."""
    k = F.col("c_custkey")
    letters, latin = F.translate(k.cast("string"), "0123456789", "АБВДЖЗКЛМН"), F.translate(k.cast("string"), "0123456789", "ABVDJZKLMN")
    d, m, n8 = digits(1 + k % 28, 2), digits(1 + k % 12, 2), digits(k % 100000000, 8)
    born, issued, ends = F.concat(d, F.lit("."), m, F.lit(".1990")), F.concat(d, F.lit("."), m, F.lit(".2013")), F.concat(d, F.lit("."), m, F.lit(".2033"))
    t = lambda *xs: F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in xs])
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    name = lambda cyr, lat: (c(cyr, letters), c(lat, latin))
    clean = t("НАСАБ/Surname", *name("САФ", "SAF"), "ном/Name", *name("ДАВ", "DAV"), "Номи падар/Father's name", "||", *name("МУР", "MUR"), "Sex  Nationality  Date of birth", c("М TJK ", d, " . ", m, ". 1990"),
              "Place of birth: ДУШАНБЕ", "Date of issue Date of expiry National ID", c(issued, " ", ends, " ", digits(k, 13)), "Document No.", c("A", n8))
    garbled = t(*name("САФ", "SAF"), *name("ДАВ", "DAV"), *name("САФ", "SAF"), *name("МУР", "MUR"), c("аз ", F.lit("01.01.2018"), " сол"), c("FF TYKTJK ", born), c("x ", issued, " 4x ", ends), c("no ", digits(k, 12), " ."), c("А", F.translate(n8, "01", "ОІ")))
    split = t("Document ID No", "garbled «line»", c("A", F.substring(n8, 1, 6)), F.substring(n8, 7, 2), c(born), "Surname", "дед", issued, "noise", ends, c("4", F.substring(d, 2, 1), ".", m, ".1950 сол"))
    machine = t(c("I<TJKB", F.substring(n8, 1, 8), "1<<<<<<<<<<<<<<<"), c("9", F.lit("00229"), "9M", F.lit("3301019"), "TJK<<<<<<<<<<<2"), c("SAF", latin, "<<DAV", latin, "<<<<<<<<<<<<"))
    return customers(spark, sf_dir).select(k.alias("doc_id"), F.lit("front").alias("side"), F.when(k % 4 == 0, clean).when(k % 4 == 1, garbled).when(k % 4 == 2, split).otherwise(machine).alias("text"))


_TEXT = """k AS (SELECT c_custkey AS doc_id, c_custkey % 4 AS c, translate(c_custkey::VARCHAR, '0123456789', 'АБВДЖЗКЛМН') AS cyr, translate(c_custkey::VARCHAR, '0123456789', 'ABVDJZKLMN') AS lat,
  lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') || '.' || lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') AS dm, lpad(c_custkey::VARCHAR, 8, '0') AS n8 FROM customer),
f AS (SELECT doc_id, 'surname' AS field, CASE WHEN c = 3 THEN 'SAF' || lat ELSE 'САФ' || cyr END AS value FROM k WHERE c <> 2
  UNION ALL SELECT doc_id, 'givenNames', CASE WHEN c = 3 THEN 'DAV' || lat ELSE 'ДАВ' || cyr END FROM k WHERE c <> 2
  UNION ALL SELECT doc_id, 'fatherName', CASE WHEN c = 0 THEN 'МУР' || cyr ELSE 'САФ' || cyr END FROM k WHERE c IN (0, 1)
  UNION ALL SELECT doc_id, 'sex', CASE WHEN c = 1 THEN 'F' ELSE 'M' END FROM k WHERE c <> 2
  UNION ALL SELECT doc_id, 'birthPlace', 'ДУШАНБЕ' FROM k WHERE c = 0
  UNION ALL SELECT doc_id, 'birthDate', CASE WHEN c = 3 THEN '29.02.1990' ELSE dm || '.1990' END FROM k
  UNION ALL SELECT doc_id, 'issueDate', dm || '.2013' FROM k WHERE c <> 3
  UNION ALL SELECT doc_id, 'expiryDate', CASE WHEN c = 3 THEN '01.01.1933' ELSE dm || '.2033' END FROM k
  UNION ALL SELECT doc_id, 'nationalIdNumber', CASE WHEN c = 0 THEN lpad(doc_id::VARCHAR, 13, '0') ELSE lpad(doc_id::VARCHAR, 12, '0') END FROM k WHERE c < 2
  UNION ALL SELECT doc_id, 'documentNumber', CASE WHEN c = 3 THEN 'B' ELSE 'A' END || n8 FROM k)"""


@query(f"WITH {_TEXT} SELECT doc_id, 'front' AS side, field, value, 80.0::DOUBLE AS confidence, 'layout' AS source FROM f")
def text_card_facts(spark, sf_dir):
    return card.text_facts(card_texts(spark, sf_dir))


@query("SELECT c_custkey AS doc_id, c_custkey % 4 IN (0, 3) AS card FROM customer")
def card_text_filter(spark, sf_dir):
    t = card_texts(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\nIdentity  card"))).otherwise(F.col("text")))
    return t.select("doc_id", card_text.card_text(F.col("text")).alias("card"))


@query(
    """WITH c AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Sex Date of Birth' WHEN 1 THEN 'Насаб' WHEN 2 THEN 'Date of birth  Place of birth' WHEN 3 THEN '1D number' ELSE 'Sexual' END AS t FROM conversations)
SELECT conv_id, turn, turn % 5 IN (0, 2) AS header, turn % 5 <> 4 AS known FROM c"""
)
def label_line_tests(spark, sf_dir):
    i = F.col("turn") % 5
    t = F.when(i == 0, "Sex Date of Birth").when(i == 1, "Насаб").when(i == 2, "Date of birth  Place of birth").when(i == 3, "1D number").otherwise("Sexual")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", card_text.birth_row_header(t).alias("header"), card_text.known_label(t).alias("known"))


@query(
    f"""WITH {_NAME_TRUTH}, {_CARD}, {_FRONT}, {_BACK}, every_ AS (SELECT doc_id, field, value FROM names_ UNION ALL SELECT doc_id, field, value FROM front UNION ALL SELECT doc_id, field, value FROM back
  UNION ALL SELECT c_custkey, 'expiryDate', lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') || '.' || lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') || '.20' || (25 + c_custkey % 10)::VARCHAR FROM customer)
SELECT doc_id, """
    + ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS \"{f}\"" for f in T.FIELDS)
    + " FROM every_ GROUP BY doc_id"
)
def card_wide(spark, sf_dir):
    """Both sides' zone reads, the machine-readable zone and the names of both scripts, merged to one row per card."""
    cyrillic, latin, reads, labelled, machine = name_evidence(spark, sf_dir)
    every = card_reads(spark, sf_dir)
    zone = zones.front_zone_facts(every.where("side = 'front'"), card.AS_OF_YEAR).unionByName(zones.back_zone_facts(every.where("side = 'back'")))
    texts = mrz_texts(spark, sf_dir)
    machine_facts = card.mrz_facts(texts).where("field = 'expiryDate'").withColumn("side", F.lit("back"))
    guess = labelled.withColumn("source", F.lit("layout")).select(*card.FACT)
    wrong = zone.where("field = 'sex'").withColumn("value", F.lit("X")).withColumn("confidence", F.lit(99.0))
    facts = card.side_facts(zone, machine_facts, wrong, guess)
    named = names.resolve_names(names.line_pairs(cyrillic, latin), zones.anchored_names(reads, card.AS_OF_YEAR), card.label_names(guess, guess.limit(0)), machine)
    return card.card(facts, named)


@query("SELECT c_custkey AS doc_id, f.field FROM customer, (VALUES ('sex'), ('taxId')) f(field) WHERE f.field = 'sex' AND c_custkey % 3 = 0 OR f.field = 'taxId' AND c_custkey % 2 = 0")
def missing_field_rows(spark, sf_dir):
    k = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(k.alias("doc_id"))
    facts = docs.select("doc_id", F.lit("sex").alias("field"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise("M").alias("value"))
    facts = facts.unionByName(docs.where("doc_id % 2 = 1").select("doc_id", F.lit("taxId").alias("field"), F.lit("1").alias("value")))
    return votes.missing_fields(docs, facts, ["sex", "taxId"])


@query("SELECT user_id, bool_or(event_id % 9 = 0) AS known FROM events GROUP BY user_id")
def anything_known(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_id") % 9 == 0, "x").when(F.col("event_id") % 9 == 1, " ").alias("value"))
    return votes.anything_known(e).withColumnRenamed("doc_id", "user_id")


# --- geometry ------------------------------------------------------------------------------------------------------


@query(
    """WITH k AS (SELECT c_custkey, 100.0 + c_custkey % 300 AS x, 80.0 + c_custkey % 200 AS y, 20.0 + c_custkey % 400 AS w, 10.0 + c_custkey % 37 AS h, (c_custkey % 3) * 0.12 AS pad FROM customer),
r AS (SELECT *, greatest(0, floor(x - h * pad + 0.5)) AS l, greatest(0, floor(y - h * pad + 0.5)) AS t FROM k), s AS (SELECT *, least(640 - l, floor(w + 2 * h * pad + 0.5)) AS cw, least(480 - t, floor(h + 2 * h * pad + 0.5)) AS ch FROM r)
SELECT c_custkey, l::BIGINT AS "left", t::BIGINT AS top, cw::BIGINT AS width, ch::BIGINT AS height, floor(cw * greatest(1.0, least(5.0, 110.0 / ch)) + 0.5)::BIGINT AS out_width,
  floor(ch * greatest(1.0, least(5.0, 110.0 / ch)) + 0.5)::BIGINT AS out_height, floor(480 * 0.55 + 0.5)::BIGINT AS bottom_top FROM s"""
)
def zone_crops(spark, sf_dir):
    k = F.col("c_custkey")
    x, y, w, h = 100.0 + k % 300, 80.0 + k % 200, 20.0 + k % 400, 10.0 + k % 37
    crop = geometry.crop(x, y, x + w, y + h, (k % 3) * F.lit(0.12), F.lit(640), F.lit(480))
    c = table(spark, sf_dir, "customer").select("c_custkey", crop.alias("c"), geometry.bottom_region(F.lit(640), F.lit(480))["top"].alias("bottom_top"))
    return c.select("c_custkey", "c.left", "c.top", "c.width", "c.height", "c.out_width", "c.out_height", "bottom_top")


@query(
    """WITH k AS (SELECT c_custkey, 50.0 + c_custkey % 100 AS x, 40.0 + c_custkey % 50 AS y, 200.0 + c_custkey % 90 AS w, 120.0 + c_custkey % 70 AS h FROM customer)
SELECT c_custkey, round(x - 6, 6) + 0.0 AS x0, round(y - 6, 6) + 0.0 AS y0, round(least(319, x + w + 6), 6) + 0.0 AS x2, round(least(239, y + h + 6), 6) + 0.0 AS y2, round(w * h, 6) + 0.0 AS area,
  (320 * 0.01)::DOUBLE AS frame_x, true AS same, c_custkey % 2 = 0 AS moved_same, floor(x)::BIGINT AS cut_left, least(320, ceil(x + w))::BIGINT AS cut_right FROM k"""
)
def quad_geometry(spark, sf_dir):
    k = F.col("c_custkey")
    x, y, w, h = 50.0 + k % 100, 40.0 + k % 50, 200.0 + k % 90, 120.0 + k % 70
    quad = F.array(*[geometry.point(a, b) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])
    near = F.transform(quad, lambda p: geometry.point(p["x"] + F.when(k % 2 == 0, 3.0).otherwise(9.0), p["y"]))
    c = table(spark, sf_dir, "customer").select("c_custkey", quad.alias("q"), near.alias("near"))
    c = c.withColumn("e", geometry.expand_quad(F.col("q"), F.lit(6.0), F.lit(320), F.lit(240))).withColumn("cut", geometry.bounding_crop(F.col("q"), F.lit(320), F.lit(240)))
    r = lambda v: F.round(v, 6) + 0.0
    return c.select(
        "c_custkey", r(F.col("e")[0]["x"]).alias("x0"), r(F.col("e")[0]["y"]).alias("y0"), r(F.col("e")[2]["x"]).alias("x2"), r(F.col("e")[2]["y"]).alias("y2"), r(geometry.area(F.col("q"))).alias("area"),
        geometry.whole_frame(F.lit(320), F.lit(240))[0]["x"].alias("frame_x"), geometry.same_quad(F.col("q"), F.col("q"), F.lit(4.0)).alias("same"), geometry.same_quad(F.col("q"), F.col("near"), F.lit(4.0)).alias("moved_same"),
        F.col("cut.left").alias("cut_left"), F.col("cut.right").alias("cut_right"),
    )


@query(
    """WITH k AS (SELECT c_custkey AS doc_id, c_custkey % 3 AS c, 0.5 + (c_custkey % 20) / 10.0 AS s, c_custkey % 30 AS tx, c_custkey % 40 AS ty FROM customer), z AS (SELECT * FROM (VALUES ('maritalStatus', 'latin', 560.0, 472.0, 1040.0, 530.0), ('taxId', 'value', 1435.0, 474.0, 1780.0, 534.0)) v(field, part, a, b, c, d)),
f AS (SELECT doc_id, CASE WHEN c = 2 THEN 900 / 1800.0 ELSE s END AS sx, CASE WHEN c = 2 THEN 603 / 1206.0 ELSE s END AS sy, CASE WHEN c = 2 THEN 0 ELSE tx END AS tx, CASE WHEN c = 2 THEN 0 ELSE ty END AS ty, CASE WHEN c = 2 THEN 900 ELSE 9000 END AS w, CASE WHEN c = 2 THEN 603 ELSE 9000 END AS h FROM k)
SELECT doc_id, field, part, round(least(w, greatest(0, a * sx + tx)), 3) + 0.0 AS x0, round(least(h, greatest(0, b * sy + ty)), 3) + 0.0 AS y0, round(least(w, z.c * sx + tx), 3) + 0.0 AS x1, round(least(h, d * sy + ty), 3) + 0.0 AS y1 FROM f, z"""
)
def back_zone_boxes(spark, sf_dir):
    """Template boxes placed by three machine-readable lines, or by the image's size where there are only two."""
    k = F.col("c_custkey")
    left, right, centres = T.BACK_MRZ
    s, tx, ty = 0.5 + (k % 20) / 10.0, (k % 30).cast("double"), (k % 40).cast("double")
    line = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(float(c)).alias("c")) for i, c in enumerate(centres)]), lambda x: (k % 3 != 2) | (x["seq"] < 2)))
    size = lambda small: F.when(k % 3 == 2, small).otherwise(9000)
    b = customers(spark, sf_dir).select(k.alias("doc_id"), line.alias("l"), s.alias("s"), tx.alias("tx"), ty.alias("ty"), size(900).alias("width"), size(603).alias("height"))
    boxes_ = b.select("doc_id", "l.seq", (left * F.col("s") + F.col("tx")).alias("x0"), (right * F.col("s") + F.col("tx")).alias("x1"), (F.col("l.c") * F.col("s") + F.col("ty") - 20).alias("y0"), (F.col("l.c") * F.col("s") + F.col("ty") + 20).alias("y1"), "width", "height")
    zones_ = spatial.place(fit.register_by_lines(boxes_, ["doc_id"], T.BACK_MRZ, T.BACK_SIZE), [z for z in zones.back_template() if z[:2] in (("maritalStatus", "latin"), ("taxId", "value"))])
    return zones_.select("doc_id", "field", "part", *[(F.round(c, 3) + 0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    """WITH p AS (SELECT DISTINCT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE label IS NOT NULL),
e AS (SELECT a.label, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)),
h AS (SELECT e.* FROM e JOIN p c ON c.label = e.label GROUP BY ALL HAVING min((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax)) >= 0)
SELECT label, count(*) AS corners, round(abs(sum(ax * by_ - bx * ay)) / 2, 6) AS area FROM h GROUP BY label"""
)
def hull_area_by_group(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label is not null").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return raster.hull_by_key(e, "label")


def grids(spark, sf_dir):
    """An 8 x 8 one-channel image per embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    px = F.transform("embedding", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 60 + 128))).cast("long")), 2, "0"))
    return e.select("doc_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), F.unhex(F.array_join(px, "")).alias("data"))


_GRID = """g AS (SELECT vec_id AS doc_id, i // 8 AS y, i % 8 AS x, greatest(0, least(255, floor((embedding[i + 1]::DOUBLE::FLOAT * 60::DOUBLE)::DOUBLE + 128)))::BIGINT AS v FROM embeddings, range(64) r(i))"""


@query(
    f"""WITH RECURSIVE {_GRID}, on_ AS (SELECT doc_id, y, x FROM g WHERE v > 128), reach AS (SELECT doc_id, y * 8 + x AS seed, y, x FROM on_
  UNION SELECT r.doc_id, r.seed, o.y, o.x FROM reach r JOIN on_ o ON o.doc_id = r.doc_id AND abs(o.y - r.y) + abs(o.x - r.x) = 1),
l AS (SELECT doc_id, y, x, min(seed) AS label FROM reach GROUP BY doc_id, y, x), n AS (SELECT doc_id, label, count(*) AS n FROM l GROUP BY doc_id, label)
SELECT d.doc_id, count(n.label) AS regions, coalesce(max(n.n), 0)::BIGINT AS largest, coalesce(sum(n.n), 0)::BIGINT AS covered FROM (SELECT DISTINCT doc_id FROM g) d LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id"""
)
def connected_regions(spark, sf_dir):
    def kernel(x):
        label, n = raster.regions(x[..., 0] > 128)
        sizes = [int((label == k).sum()) for k in range(1, n + 1)]
        return [{"regions": n, "largest": max(sizes, default=0), "covered": sum(sizes)}]

    return raster.over_images(grids(spark, sf_dir), "doc_id long, regions long, largest long, covered long", kernel)


@query(
    f"""WITH {_GRID}, m AS (SELECT a.doc_id, a.y, a.x, a.v < avg(b.v) - 18 AS ink FROM g a JOIN g b ON a.doc_id = b.doc_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY a.doc_id, a.y, a.x, a.v),
t AS (SELECT doc_id, y, sum(ink::INT) AS ink, sum((ink <> before)::INT) AS turns FROM (SELECT *, lag(ink) OVER (PARTITION BY doc_id, y ORDER BY x) AS before FROM m) GROUP BY doc_id, y),
r AS (SELECT doc_id, sum(ink)::BIGINT AS ink, sum((turns >= 3)::INT)::BIGINT AS rows FROM t GROUP BY doc_id),
h AS (SELECT doc_id, v, count(*) AS n, sum(v) AS s FROM g GROUP BY doc_id, v),
c AS (SELECT doc_id, v, sum(n) OVER w AS c, sum(s) OVER w AS m, sum(n) OVER (PARTITION BY doc_id) AS cn, sum(s) OVER (PARTITION BY doc_id) AS mn FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY v)),
o AS (SELECT doc_id, v AS threshold FROM (SELECT *, CASE WHEN cn > c THEN c::DOUBLE * (cn - c) * (m::DOUBLE / c - (mn - m)::DOUBLE / (cn - c)) * (m::DOUBLE / c - (mn - m)::DOUBLE / (cn - c)) END AS b FROM c) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY b DESC NULLS LAST, v) = 1)
SELECT doc_id, ink, rows, threshold FROM r JOIN o USING (doc_id)"""
)
def local_ink_rows(spark, sf_dir):
    def kernel(x):
        mask = raster.ink(x[..., 0].astype(float), 2, 18)
        return [{"ink": int(mask.sum()), "rows": int(raster.text_rows(mask, 3).sum()), "threshold": raster.otsu(x[..., 0].astype(float), 256, 0, 256)}]

    return raster.over_images(grids(spark, sf_dir), "doc_id long, ink long, rows long, threshold long", kernel)
