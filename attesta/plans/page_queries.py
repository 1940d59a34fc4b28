"""Queries on whole pages and on the form they fill, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import tables as T
from attesta.functions import geometry
from attesta.functions import text as X
from attesta.operators import fit, pages, regions, votes
from attesta.plans import card, zones
from attesta.plans.queries import _BACK, _BASE, _CARD, _FRONT, _GRID, _POS, _TRUTH, NAME_HEADS, card_reads, customers, line_order, mrz_texts, query
from attesta.sources.tables import dealt, page_lines, table

# --- overlay of label words ----------------------------------------------------------------------------------------


def _box(x: Column, y: Column, w: float, h: float) -> Column:
    return F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + w).cast("double").alias("x1"), (y + h).cast("double").alias("y1"))


def _line(words: Column) -> Column:
    edge = lambda pick, c: pick(F.transform(words, lambda w: w["bbox"][c])).alias(c)
    box = F.struct(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))
    return F.struct(F.lit("").alias("text"), F.lit(50.0).alias("confidence"), box.alias("bbox"), words.alias("words"))


def two_pages(spark, sf_dir) -> DataFrame:
    """(doc_id, blocks, english): an order's lines as words of two pages, which two models read with other boxes and texts."""
    # dealt first: lines of an order meet once, in the order's array, which alone is sorted
    at = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", line_order().alias("pos")).repartition("l_orderkey")
    x, y = F.col("l_partkey") % 4 * 25, F.col("l_suppkey") % 2 * 20
    label = F.get(F.array(*[F.lit(f"{w.capitalize()}:") for w in T.LABEL_WORDS]), (F.col("l_partkey") % len(T.LABEL_WORDS)).cast("int"))
    mine = F.struct(F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"), (F.col("l_quantity") + 20).cast("double").alias("confidence"), _box(x, y, 30, 14).alias("bbox"))
    other = F.struct(F.when(F.col("l_suppkey") % 3 == 0, "zz").otherwise(label).alias("text"), (F.col("l_quantity") + 45).cast("double").alias("confidence"), _box(x + F.col("l_partkey") % 7 * 3, y + F.col("l_suppkey") % 3, 30, 14).alias("bbox"))
    # words are made before they are collected: inside of collect_list they would be interpreted
    each = at.select(F.col("l_orderkey").alias("doc_id"), F.struct("pos", mine.alias("w"), other.alias("e")).alias("s"))
    read = each.groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("s")).select("doc_id", F.transform("s", lambda s: s["w"]).alias("w"), F.transform("s", lambda s: s["e"]).alias("e"))
    # six words to a block, four to its first paragraph and two to its second, two to a line
    some = lambda i, n, step: F.transform(F.filter(F.sequence(i, i + n - step, F.lit(step)), lambda j: j < F.size("w")), lambda j: X.let(F.slice("w", j + 1, 2), _line))
    paragraph = lambda i, n: F.struct(some(i, n, 2).alias("lines"))
    block = lambda i: F.struct(F.filter(F.array(paragraph(i, 4), paragraph(i + 4, 2)), lambda p: F.size(p["lines"]) > 0).alias("paragraphs"))
    blocks = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(6)), block)
    return read.select("doc_id", blocks.alias("blocks"), F.array(F.struct(F.array(F.struct(F.array(_line(F.col("e"))).alias("lines"))).alias("paragraphs"))).alias("english"))


def merged_pages(spark, sf_dir) -> DataFrame:
    p = two_pages(spark, sf_dir)
    return p.select("doc_id", F.lit("front").alias("side"), pages.merge_labels(F.col("blocks"), F.col("english")).alias("blocks"))


_LABELS = "[" + ", ".join(f"'{w.capitalize()}:'" for w in T.LABEL_WORDS) + "]"
_MERGED = f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_POS}) - 1 AS r FROM lineitem),
w AS (SELECT l_orderkey AS doc_id, r, r // 6 AS b, r % 6 // 4 AS p, r % 6 % 4 // 2 AS l, l_returnflag || l_partkey AS text, l_quantity + 20 AS confidence, l_partkey % 4 * 25 AS x, l_suppkey % 2 * 20 AS y,
  CASE WHEN l_suppkey % 3 = 0 THEN 'zz' ELSE ({_LABELS})[l_partkey % {len(T.LABEL_WORDS)} + 1] END AS e_text, l_quantity + 45 AS e_confidence,
  l_partkey % 4 * 25 + l_partkey % 7 * 3 AS ex, l_suppkey % 2 * 20 + l_suppkey % 3 AS ey FROM l),
e AS (SELECT * FROM w WHERE e_text <> 'zz' AND e_confidence >= CASE WHEN length(e_text) <= 4 THEN 80 ELSE 50 END),
h AS (SELECT w.doc_id, w.r, min(e.r) AS hit FROM w JOIN e ON w.doc_id = e.doc_id AND greatest(0, least(w.x, e.ex) + 30 - greatest(w.x, e.ex)) >= 15 AND greatest(0, least(w.y, e.ey) + 14 - greatest(w.y, e.ey)) >= 7 GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hit ORDER BY r) AS n FROM h),
m AS (SELECT w.doc_id, w.r, w.b, w.p, w.l, w.x, w.y, coalesce(e.e_text, w.text) AS text, coalesce(e.e_confidence, w.confidence)::DOUBLE AS confidence,
  min(w.y) OVER (PARTITION BY w.doc_id, w.b, w.p, w.l) AS top, max(w.y) OVER (PARTITION BY w.doc_id, w.b, w.p, w.l) + 14 AS bottom, n
  FROM w LEFT JOIN u ON u.doc_id = w.doc_id AND u.r = w.r LEFT JOIN e ON e.doc_id = w.doc_id AND e.r = u.hit),
k AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS block_no, dense_rank() OVER (PARTITION BY doc_id, b ORDER BY p) - 1 AS par_no, dense_rank() OVER (PARTITION BY doc_id, b, p ORDER BY l) - 1 AS line_no FROM m WHERE n IS NULL OR n = 1)"""


@query(
    _MERGED
    + """
SELECT doc_id, block_no::INT AS block_no, par_no::INT AS par_no, line_no::INT AS line_no, string_agg(text, ' ' ORDER BY r) || chr(10) AS text, count(*)::INT AS words, sum(confidence)::DOUBLE AS confidence FROM k GROUP BY ALL"""
)
def label_overlay_pages(spark, sf_dir):
    """Nested pages with label words of the English model in place, flattened to lines."""
    total = F.aggregate("words", F.lit(0.0), lambda s, w: s + w["confidence"])
    return page_lines(merged_pages(spark, sf_dir)).select("doc_id", "block_no", "par_no", "line_no", "text", F.size("words").alias("words"), total.alias("confidence"))


@query(
    _MERGED
    + """,
o AS (SELECT *, row_number() OVER t AS place, x - lag(x) OVER t - 30 > bottom - top AS wide FROM k WHERE confidence >= 30 WINDOW t AS (PARTITION BY doc_id, b, p, l ORDER BY x, r)),
g AS (SELECT *, sum(coalesce(wide, false)::INT) OVER (PARTITION BY doc_id, b, p, l ORDER BY place) AS part FROM o),
a AS (SELECT doc_id, b, p, l, part, string_agg(text, ' ' ORDER BY place) AS text, avg(confidence) AS confidence, min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, (max(x) + 30)::DOUBLE AS x1, (max(y) + 14)::DOUBLE AS y1 FROM g GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b, p, l, part) - 1)::INT AS seg, text, round(confidence, 6) AS confidence, x0, y0, x1, y1 FROM a"""
)
def page_segments(spark, sf_dir):
    """The segments of the merged pages: runs of sure words that no wide gap parts, with their box and mean confidence."""
    found = merged_pages(spark, sf_dir).select("doc_id", F.posexplode(pages.segments(F.col("blocks"))).alias("seg", "s"))
    return found.select("doc_id", "seg", "s.text", F.round("s.confidence", 6).alias("confidence"), "s.bbox.*")


# --- places of values ----------------------------------------------------------------------------------------------

#: (source, text, x, y): a printed label for each anchor, in the anchors' order; places are those of the front template.
FRONT_LABELS = [
    (source, text, x, y)
    for (source, *_, x, y), text in zip(
        T.ANCHORS,
        ["Насаб/", "Surname", "Ном/", "Given name", "Номи падар/", "Father's", "Санаи таваллуд/", "Date of birth", "Ҷои таваллуд/", "Ҷинс/",
         "SEX", "Шаҳрвандӣ/", "Рақами ягонаи", "National ID", "Санаи оғози", "Date of issue", "Санаи анҷоми", "Date of expiry", "Рақами шиносномаи", "Document No"],
    )
]
_SEX, _STATE = 9, 11  # the two labels of one line


def front_pages(spark, sf_dir) -> DataFrame:
    """(doc_id, tajik, english, width, height): a front per customer at a scale and shift of its own.

    Labels are left out, moved a little or far off by the customer's key; some
    fronts have two labels only, some only labels of one column, and some a
    scale that is out of range.
    """
    k = F.col("c_custkey")
    c = customers(spark, sf_dir).select(
        k.alias("doc_id"), F.when(k % 10 == 2, F.lit(0.25)).otherwise(0.5 + (k % 20) / 10.0).alias("s"), (k % 90 - 30).cast("double").alias("dx"), (k % 50 - 20).cast("double").alias("dy")
    )
    labels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("source"), F.lit(t).alias("text"), F.lit(float(x)).alias("tx"), F.lit(float(y)).alias("ty")) for i, (s, t, x, y) in enumerate(FRONT_LABELS)])
    d, i = F.col("doc_id"), F.col("i")
    far = lambda i: (d * (i + 11) + i) % 13 == 0
    usual = lambda i: (d * (2 * i + 7) + i * i) % 11 < 8
    shown = F.when(d % 10 == 0, i < 2).when(d % 10 == 1, F.col("tx").between(660, 675)).otherwise(usual(i))
    # two labels share a line where both stand in their place
    together = (d % 10 > 1) & usual(F.lit(_SEX)) & ~far(F.lit(_SEX)) & ~far(F.lit(_STATE)) & i.isin(_SEX, _STATE)
    x = F.col("s") * (F.col("tx") + (d * (i + 3)) % 7 - 3 + F.when(far(i), 200).otherwise(0)) + F.col("dx")
    y = F.col("s") * (F.col("ty") + (d * (i + 5)) % 7 - 3 - F.when(far(i), 150).otherwise(0)) + F.col("dy")
    rows = c.select("*", F.inline(labels)).where(shown).select("doc_id", "s", "i", "source", "text", x.alias("x"), y.alias("y"), F.when(together, _SEX).otherwise(i).alias("line"), together.alias("together"))

    def word(text: Column, confidence: float, x: Column, y: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(confidence).alias("confidence"), F.struct(x.alias("x0"), y.alias("y0"), (x + 60 * F.col("s")).alias("x1"), (y + 24 * F.col("s")).alias("y1")).alias("bbox"))

    words = F.transform(F.split("text", " "), lambda w, n: word(w, 90.0, F.col("x") + 70 * F.col("s") * n, F.col("y") + F.when(n > 0, 2).otherwise(0)))
    # a word that is too unsure stands before a label
    unsure = F.when(F.col("together"), F.slice(words, 1, 0)).otherwise(F.array(word(F.lit("падар"), 20.0, F.col("x") - 500, F.col("y"))))
    lines = rows.groupBy("doc_id", "source", "line").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", F.concat(words, unsure).alias("w")))), lambda e: e["w"])).alias("w"))
    of = lambda source: F.transform(F.sort_array(F.collect_list(F.when(F.col("source") == source, F.struct("line", _line(F.col("w")).alias("l"))))), lambda e: e["l"])
    page = lambda source: F.array(F.struct(F.array(F.struct(of(source).alias("lines"))).alias("paragraphs"))).alias(source)
    small = F.when(d % 5 == 3, 1000).otherwise(9000)
    return lines.groupBy("doc_id").agg(page("tajik"), page("english")).select("doc_id", "tajik", "english", small.alias("width"), F.lit(9000).alias("height"))


_POINTS = ", ".join(f"({i}, {x}.0, {y}.0)" for i, (_, _, x, y) in enumerate(FRONT_LABELS))
_FRONT_BOXES = ", ".join(f"('{f}', '{p}', {', '.join(f'{v}.0' for v in box)})" for f, p, *box in T.FRONT_BOXES)


def _axis_sql(v: str) -> str:
    """Consensus of one axis from points p(doc_id, i, tx, ty, x, y): f_{v}(doc_id, s, t)."""
    return f"""
l_{v} AS (SELECT a.doc_id, a.i, b.i AS j, (b.{v} - a.{v}) / (b.t{v} - a.t{v}) AS s, a.{v} - (b.{v} - a.{v}) / (b.t{v} - a.t{v}) * a.t{v} AS c FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.i < b.i AND abs(b.t{v} - a.t{v}) >= 100),
n_{v} AS (SELECT l.doc_id, l.i, j, s, c, count(*) AS n, sum(abs(s * t{v} + c - {v})) AS err FROM l_{v} l JOIN p ON p.doc_id = l.doc_id AND abs(s * t{v} + c - {v}) <= 16 * s WHERE s BETWEEN 0.3 AND 4 GROUP BY ALL),
b_{v} AS (SELECT * FROM n_{v} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, err, i, j) = 1),
f_{v} AS (SELECT b.doc_id, regr_slope({v}, t{v}) AS s, regr_intercept({v}, t{v}) AS t FROM b_{v} b JOIN p ON p.doc_id = b.doc_id AND abs(s * t{v} + c - {v}) <= 16 * s GROUP BY b.doc_id
  HAVING count(*) >= 3 AND max(t{v}) - min(t{v}) >= 100 AND regr_slope({v}, t{v}) BETWEEN 0.3 AND 4)"""


@query(
    f"""
WITH k AS (SELECT c_custkey AS d, CASE WHEN c_custkey % 10 = 2 THEN 0.25 ELSE 0.5 + (c_custkey % 20) / 10.0::DOUBLE END AS s, (c_custkey % 90 - 30)::DOUBLE AS dx, (c_custkey % 50 - 20)::DOUBLE AS dy FROM customer),
a AS (SELECT * FROM (VALUES {_POINTS}) v(i, tx, ty)),
p AS MATERIALIZED (SELECT d AS doc_id, i, tx::DOUBLE AS tx, ty::DOUBLE AS ty,
  s * (tx + (d * (i + 3)) % 7 - 3 + CASE WHEN (d * (i + 11) + i) % 13 = 0 THEN 200 ELSE 0 END) + dx AS x, s * (ty + (d * (i + 5)) % 7 - 3 - CASE WHEN (d * (i + 11) + i) % 13 = 0 THEN 150 ELSE 0 END) + dy AS y
  FROM k, a WHERE CASE WHEN d % 10 = 0 THEN i < 2 WHEN d % 10 = 1 THEN tx BETWEEN 660 AND 675 ELSE (d * (2 * i + 7) + i * i) % 11 < 8 END),
{_axis_sql("x")},{_axis_sql("y")},
z AS (SELECT * FROM (VALUES {_FRONT_BOXES}) v(field, part, a, b, c, d)),
o AS (SELECT doc_id, field, part, greatest(0.0, z.a * f_x.s + f_x.t) AS x0, greatest(0.0, z.b * f_y.s + f_y.t) AS y0, least(CASE WHEN doc_id % 5 = 3 THEN 1000 ELSE 9000 END, z.c * f_x.s + f_x.t) AS x1, least(9000, z.d * f_y.s + f_y.t) AS y1 FROM f_x JOIN f_y USING (doc_id), z)
SELECT doc_id, field, part, round(x0, 4) + 0.0 AS x0, round(y0, 4) + 0.0 AS y0, round(x1, 4) + 0.0 AS x1, round(y1, 4) + 0.0 AS y1 FROM o WHERE x1 - x0 > 20 AND y1 - y0 > 10"""
)
def front_zone_boxes(spark, sf_dir):
    """Where a front's values stand, by all twenty anchors, some of them missing, moved or far off."""
    found = zones.locate_front_zones(front_pages(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "field", "part", *[(F.round(c, 4) + 0.0).alias(c) for c in zones.BOX])


_BACK_BOXES = ", ".join(f"('{f}', '{p}', {'NULL' if n is None else n}, {', '.join(f'{v}.0' for v in box)})" for f, p, n, *box in zones.back_template())


@query(
    f"""
WITH k AS (SELECT s_suppkey AS doc_id, s_suppkey % 4 AS c, 0.5 + (s_suppkey % 20) / 10.0 AS s, s_suppkey % 30 AS tx, s_suppkey % 40 AS ty, 700 + s_suppkey % 7 * 300 AS w, 500 + s_suppkey % 5 * 300 AS h FROM supplier),
f AS (SELECT doc_id, w, h, CASE WHEN c < 2 THEN s ELSE w / 1800.0 END AS sx, CASE WHEN c < 2 THEN s ELSE h / 1206.0 END AS sy, CASE WHEN c < 2 THEN tx ELSE 0 END AS tx, CASE WHEN c < 2 THEN ty ELSE 0 END AS ty FROM k),
z AS (SELECT * FROM (VALUES {_BACK_BOXES}) v(field, part, line, a, b, c, d)),
o AS (SELECT doc_id, field, part, line::INT AS line, greatest(0, a * sx + tx) AS x0, greatest(0, b * sy + ty) AS y0, least(w, z.c * sx + tx) AS x1, least(h, d * sy + ty) AS y1 FROM f, z)
SELECT doc_id, field, part, line, round(x0, 4)::DOUBLE + 0.0 AS x0, round(y0, 4)::DOUBLE + 0.0 AS y0, round(x1, 4)::DOUBLE + 0.0 AS x1, round(y1, 4)::DOUBLE + 0.0 AS y1 FROM o WHERE x1 - x0 > 20 AND y1 - y0 > 10"""
)
def back_address_boxes(spark, sf_dir):
    """All places of a back, its address lines with them: by three machine-readable lines, or by the image's size where there are two or none."""
    k = F.col("s_suppkey")
    left, right, centres = T.BACK_MRZ
    s, tx, ty = 0.5 + (k % 20) / 10.0, k % 30, k % 40
    each = table(spark, sf_dir, "supplier").select(k.alias("doc_id"), s.alias("s"), tx.alias("tx"), ty.alias("ty"), (k % 4).alias("c"), (700 + k % 7 * 300).alias("width"), (500 + k % 5 * 300).alias("height"))
    rows = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(float(v)).alias("v")) for i, v in enumerate(centres)]), lambda x: (F.col("c") < 2) | ((F.col("c") == 2) & (x["seq"] < 2))))
    lines = each.select("doc_id", "s", "tx", "ty", rows.alias("l")).select("doc_id", "l.seq", (left * F.col("s") + F.col("tx")).alias("x0"), (F.col("l.v") * F.col("s") + F.col("ty") - 20).alias("y0"), (right * F.col("s") + F.col("tx")).alias("x1"), (F.col("l.v") * F.col("s") + F.col("ty") + 20).alias("y1"))
    found = zones.locate_back_zones(lines, each, ["doc_id"])
    return found.select("doc_id", "field", "part", "line", *[(F.round(c, 4) + 0.0).alias(c) for c in zones.BOX])


# --- the form and its corrections ----------------------------------------------------------------------------------


@query(
    """
WITH f AS (SELECT user_id AS doc_id, event_type AS field, 'v' || event_id AS value, floor(value % 100)::DOUBLE AS confidence, event_id AS src_rank FROM events WHERE event_id % 3 <> 0),
b AS (SELECT * FROM f WHERE confidence >= 35 QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, src_rank) = 1),
e AS (SELECT user_id AS doc_id, event_type AS field, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'edit' || event_id END AS text FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1),
u AS (SELECT * FROM e WHERE text IS NOT NULL)
SELECT coalesce(u.doc_id, b.doc_id) AS doc_id, coalesce(u.field, b.field) AS field, coalesce(u.text, b.value) AS value, CASE WHEN u.text IS NULL THEN confidence END AS confidence, CASE WHEN u.text IS NULL THEN 'mrz' END AS source
FROM b FULL JOIN u ON b.doc_id = u.doc_id AND b.field = u.field"""
)
def edited_facts(spark, sf_dir):
    """Merged facts with a log of corrections replayed over them: the last one counts, null takes it back, and an edited field has no metadata."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    facts = e.where(i % 3 != 0).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field"), F.concat(F.lit("v"), i.cast("string")).alias("value"), F.floor(F.col("value") % 100).cast("double").alias("confidence"), F.lit("mrz").alias("source"), i.alias("src_rank"))
    text = F.when(i % 5 == 0, None).when(i % 5 == 1, "").otherwise(F.concat(F.lit("edit"), i.cast("string")))
    edits = e.where(i % 3 == 0).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field"), text.alias("value"), i.alias("at"))
    return votes.with_edits(votes.merge_facts(facts, ["doc_id", "field"]), edits, ["doc_id", "field"])


# --- a whole card --------------------------------------------------------------------------------------------------


def card_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(pages, english): three variants of a customer's front, of which the second is the best by its layout, and a back without words.

    Only the English page of the second variant mends its label, and two of
    three fronts show names, in both scripts.
    """
    k = F.col("c_custkey")
    base = F.translate(k.cast("string"), "0123456789", "АНИҚОХЧШРЛ")
    text = lambda v: F.lit(v) if isinstance(v, str) else v

    def line(y: float, confidence: float, *words: tuple, high: int = 20) -> Column:
        ws = [F.struct(text(t).alias("text"), F.lit(float(c)).alias("confidence"), F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y, x1, y + high))]).alias("bbox")) for t, c, x0, x1 in words]
        box = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (min(w[2] for w in words), y, max(w[3] for w in words), y + high))])
        return F.struct(F.concat_ws(" ", *[text(w[0]) for w in words]).alias("text"), F.lit(float(confidence)).alias("confidence"), box.alias("bbox"), F.array(*ws).alias("words"))

    names = [(F.concat(F.lit(head), base), 1000.0 + y) for _, head, y in NAME_HEADS]
    shown = lambda lines: F.when(k % 3 != 0, F.array(*lines)).otherwise(F.slice(F.array(*lines), 1, 0))
    good = F.concat(F.array(
        line(400, 75, ("Sex", 75, 0, 30)), line(430, 71, ("M", 71, 5, 20)), line(600, 80, ("Рлаке", 80, 0, 60), ("of", 80, 65, 80), ("birth", 80, 85, 130)), line(640, 77, ("ДУШАНБЕ", 77, 5, 90)),
    ), shown([line(y, 80, (n, 80, 0, 300), high=40) for n, y in names]))
    bad = F.array(line(600, 99, ("ХАТО", 99, 0, 300)))
    latin = F.concat(F.array(line(600, 95, ("Place", 95, 0, 60))), shown([line(y + 45, 80, (X.transliterate(n), 80, 0, 300), high=40) for n, y in names]))
    blocks = lambda lines: F.array(F.struct(F.array(F.struct(lines.alias("lines"))).alias("paragraphs")))
    rows = lambda *vs: F.inline(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(seq).alias("seq"), F.lit(float(c)).alias("confidence"), F.lit(t).alias("text"), b.alias("blocks")) for side, seq, c, t, b in vs]))
    none = F.when(F.lit(False), blocks(bad))
    c = customers(spark, sf_dir)
    mine = c.select(k.alias("doc_id"), rows(("front", 0, 70, "", blocks(bad)), ("front", 1, 69, "", blocks(good)), ("front", 2, 71, "", blocks(bad)), ("back", 0, 50, "x", none)))
    return mine, c.select(k.alias("doc_id"), rows(("front", 0, 0, "", blocks(bad)), ("front", 1, 0, "", blocks(latin)), ("front", 2, 0, "", blocks(bad)))).drop("confidence", "text")


@query(
    f"""
WITH m AS ({_TRUTH} SELECT doc_id, field, value, confidence FROM f),
fr AS (WITH {_CARD}, {_FRONT} SELECT doc_id, field, value, confidence FROM front WHERE NOT (field = 'birthPlace' AND doc_id % 5 = 0) UNION ALL SELECT doc_id, 'birthPlace', 'ДУШАНБЕ', 77 FROM k WHERE doc_id % 5 = 0),
bk AS (WITH {_CARD}, {_BACK} SELECT doc_id, field, value, confidence FROM back),
every_ AS (SELECT *, 0 AS r FROM fr UNION ALL SELECT *, 1 FROM bk UNION ALL SELECT *, 1 FROM m WHERE field NOT LIKE 'mrz%'),
best AS (SELECT doc_id, field, value FROM every_ QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, r) = 1),
named AS (SELECT c_custkey AS doc_id, f.field, f.head || {_BASE.format("c_custkey")} AS value FROM customer, (VALUES {", ".join(f"('{f}', '{h}')" for f, h, _ in NAME_HEADS)}) f(field, head) WHERE c_custkey % 3 <> 0
  UNION ALL SELECT doc_id, CASE field WHEN 'mrzSurname' THEN 'surname' ELSE 'givenNames' END, value FROM m WHERE field LIKE 'mrz%' AND doc_id % 3 = 0),
w AS (SELECT * FROM best UNION ALL SELECT * FROM named)
SELECT doc_id, """
    + ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS \"{f}\"" for f in T.FIELDS)
    + " FROM w GROUP BY doc_id"
)
def recognized_cards(spark, sf_dir):
    """From recognised pages of both sides to one row per card: page choice, label overlay, zone choice, all parsers, names, merge."""
    mine, english = card_pages(spark, sf_dir)
    reads = card_reads(spark, sf_dir).where(~((F.col("field") == "birthPlace") & (F.col("doc_id") % 5 == 0)))
    texts = mrz_texts(spark, sf_dir)
    # a surer read of nothing, the zone, and on the second turn a read of the second area, which does not count
    decoy = F.lit("I<TJKA0000004240000000000042<<\n9001011F3001019TJK<<<<<<<<<<<2\nSAMPLEOVA<<TESTA<<<<<<<<<<<<<<")
    tries = F.inline(F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(a).alias("area"), F.lit(float(c)).alias("confidence"), x.alias("text")) for t, a, c, x in ((1, 0, 30, F.lit("NOTHING")), (2, 0, 20, F.col("text")), (2, 1, 99, decoy), (1, 1, 25, F.lit("")))]))
    return card.recognized_cards(mine, english, texts.select("doc_id", tries), reads)


# --- means over areas ----------------------------------------------------------------------------------------------


@query(
    """
WITH c AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, floor(embedding[i + 1]::DOUBLE * 1000) AS value FROM embeddings, range(64) t(i) WHERE (vec_id + i) % 11 <> 0)
SELECT a.vec_id, a.y::BIGINT AS y, a.x::BIGINT AS x, round(avg(b.value), 6) AS mean FROM c a JOIN c b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL"""
)
def area_means(spark, sf_dir):
    """Means over boxes of five cells, clipped at the edges, of each embedding as a grid with cells missing, from summed areas of tiles."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).where((F.col("vec_id") + F.col("i")) % 11 != 0)
    cells = e.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), F.floor(F.col("v").cast("double") * 1000).alias("value"))
    return fit.area_mean(cells, ["vec_id"], 2, tile=4).select("vec_id", "y", "x", F.round("mean", 6).alias("mean"))


# --- regions -------------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {_GRID}, on_ AS (SELECT doc_id, y, x FROM g WHERE v > 128), reach AS (SELECT doc_id, y * 8 + x AS seed, y, x FROM on_
  UNION SELECT r.doc_id, r.seed, o.y, o.x FROM reach r JOIN on_ o ON o.doc_id = r.doc_id AND abs(o.y - r.y) + abs(o.x - r.x) = 1),
l AS (SELECT doc_id, y, x, min(seed) AS label FROM reach GROUP BY doc_id, y, x)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY label) - 1)::INT AS region, count(*) AS cells, min(x)::INT AS x0, min(y)::INT AS y0, max(x)::INT AS x1, max(y)::INT AS y1 FROM l GROUP BY doc_id, label"""
)
def run_regions(spark, sf_dir):
    """Connected regions of each embedding as a grid of marked cells, from runs in its rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("i", "v"))
    marked = e.where(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("v") * 60 + 128))) > 128).select("doc_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"))
    found = regions.regions(marked, ["doc_id"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("label")) - 1
    return found.select("doc_id", number.alias("region"), "cells", "x0", "y0", "x1", "y1")


# --- maps of quadrilaterals ----------------------------------------------------------------------------------------


@query(
    """
WITH k AS (SELECT s_suppkey AS d, 400.0 + s_suppkey % 50 AS w, 250.0 + s_suppkey % 40 AS h FROM supplier WHERE s_suppkey % 7 <> 0),
c AS (SELECT d, 0 AS i, 10.0 + d % 9 AS x, 20.0 + d % 11 AS y FROM k UNION ALL SELECT d, 1, 300.0 + d % 13, 5.0 + d % 8 FROM k UNION ALL SELECT d, 2, 320.0 - d % 10, 220.0 + d % 12 FROM k UNION ALL SELECT d, 3, 2.0 + d % 6, 200.0 - d % 14 FROM k)
SELECT d AS doc_id, i::INT AS corner, round(x, 6)::DOUBLE + 0.0 AS x, round(y, 6)::DOUBLE + 0.0 AS y, 'there' AS way FROM c
UNION ALL SELECT d, 4, round(w / 3, 6)::DOUBLE, round(h / 4, 6)::DOUBLE, 'there and back' FROM k"""
)
def quad_homography(spark, sf_dir):
    """Corners of a straight card carried to a photographed one, and an inner point there and back; degenerate ones have no map."""
    k = F.col("s_suppkey")
    d = table(spark, sf_dir, "supplier").select(k.alias("doc_id"), (400.0 + k % 50).alias("w"), (250.0 + k % 40).alias("h"))
    k, at = F.col("doc_id"), geometry.point
    card_ = F.array(at(F.lit(0), F.lit(0)), at(F.col("w"), F.lit(0)), at(F.col("w"), F.col("h")), at(F.lit(0), F.col("h")))
    seen = F.array(at(10.0 + k % 9, 20.0 + k % 11), at(300.0 + k % 13, 5.0 + k % 8), at(320.0 - k % 10, 220.0 + k % 12), at(2.0 + k % 6, 200.0 - k % 14))
    line = F.array(*[at(F.lit(i) * 10, F.lit(i) * 20) for i in range(4)])
    quads = d.withColumn("card", card_).withColumn("seen", F.when(k % 7 == 0, line).otherwise(seen))
    maps = quads.withColumn("there", geometry.homography(F.col("card"), F.col("seen"))).withColumn("back", geometry.homography(F.col("seen"), F.col("card"))).where("there is not null or back is not null")
    corners = maps.select("doc_id", F.posexplode(F.transform("card", lambda p: geometry.mapped(F.col("there"), p))).alias("corner", "p"), F.lit("there").alias("way"))
    inner = maps.select("doc_id", F.lit(4).alias("corner"), geometry.mapped(F.col("back"), geometry.mapped(F.col("there"), at(F.col("w") / 3, F.col("h") / 4))).alias("p"), F.lit("there and back").alias("way"))
    return corners.unionByName(inner).select("doc_id", "corner", (F.round("p.x", 6) + 0.0).alias("x"), (F.round("p.y", 6) + 0.0).alias("y"), "way")


# --- the longest stable run of thresholds --------------------------------------------------------------------------


@query(
    """
WITH c AS (SELECT vec_id, b, l, floor(embedding[b * 10 + l + 1]::DOUBLE * 25) AS s, floor(embedding[b * 10 + l + 21]::DOUBLE * 25) AS t FROM embeddings, range(2) p(b), range(10) q(l) WHERE (vec_id + 3 * l + b) % 7 <> 0),
n AS (SELECT *, coalesce(lag(l) OVER w = l - 1 AND abs(s - lag(s) OVER w) <= 4 AND sqrt(2.0) * abs(t - lag(t) OVER w) <= 4, false) AS on_ FROM c WINDOW w AS (PARTITION BY vec_id, b ORDER BY l)),
r AS (SELECT *, sum((NOT on_)::INT) OVER (PARTITION BY vec_id, b ORDER BY l) AS run FROM n),
g AS (SELECT vec_id, b, run, count(*) AS n, min(l) AS l0 FROM r GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, b, l0) = 1)
SELECT m.vec_id AS doc_id, m.b = 0 AS light, r.l::INT AS level, m.n::INT AS run, r.s AS x0, 100 + r.t AS x1 FROM m JOIN r ON r.vec_id = m.vec_id AND r.b = m.b AND r.l = m.l0 + m.n // 2"""
)
def stable_quads(spark, sf_dir):
    """The middle of the longest run of threshold levels at which a quadrilateral, moved about by an embedding's components, stays where it is."""
    e = table(spark, sf_dir, "embeddings")
    levels = e.select(F.col("vec_id").alias("doc_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).withColumn("level", F.col("i") % 10)
    moved = lambda j: F.floor(F.get("embedding", F.col("i") + j).cast("double") * 25).cast("double")
    left, right = moved(0), moved(20)
    corners = F.array(geometry.point(left, left * 0), geometry.point(right + 100, right), geometry.point(right + 100, right + 60), geometry.point(left, left * 0 + 60))
    none = (F.col("doc_id") + 3 * F.col("level") + F.floor(F.col("i") / 10)) % 7 == 0
    found = fit.longest_stable(levels.select("doc_id", (F.col("i") < 10).alias("light"), "level", F.when(~none, corners).alias("corners")), ["doc_id"], 4.0)
    return found.select("doc_id", "light", "level", "run", F.get("corners", F.lit(0))["x"].alias("x0"), F.get("corners", F.lit(1))["x"].alias("x1"))


# --- tilt of a page ------------------------------------------------------------------------------------------------

_TILTED = ", ".join(f"({float(a)}, {math.sin(math.radians(a))!r}, {math.cos(math.radians(a))!r})" for a in fit.TILTS)


@query(
    f"""
WITH i AS (SELECT s_suppkey * 4 + stride AS key, stride, s_suppkey AS k, 40 + s_suppkey % 21 AS width, 30 + s_suppkey % 12 AS height FROM supplier, (VALUES (1), (2)) p(stride)),
c AS (SELECT key, stride, width, height, x, y, CASE WHEN k % 9 <> 0 AND (y * 64 - x * (k % 11 - 5) + 65536) % 1536 < 128 THEN 20 + (k * 7 + x * 13 + y * 5) % 150 ELSE 200 + (k + x + y) % 56 END AS value FROM i, range(60) p(x), range(41) q(y) WHERE x < width AND y < height),
d AS (SELECT key, height, a, floor(-(x - width / 2.0) * s::DOUBLE + (y - height / 2.0) * o::DOUBLE + height / 2.0 + 0.5::DOUBLE)::BIGINT AS r, 255 - value AS d FROM c, (VALUES {_TILTED}) v(a, s, o) WHERE value <= {fit.DARK} AND x % stride = 0 AND y % stride = 0),
g AS (SELECT key, a, r, sum(d)::DOUBLE AS d FROM d WHERE r BETWEEN 0 AND height - 1 GROUP BY ALL),
w AS (SELECT i.key, v.a, y, coalesce(g.d, 0) AS d FROM i CROSS JOIN (VALUES {_TILTED}) v(a, s, o) CROSS JOIN range(41) q(y) LEFT JOIN g ON g.key = i.key AND g.a = v.a AND g.r = y WHERE y < height),
z AS (SELECT key, a, y, (d - lag(d) OVER (PARTITION BY key, a ORDER BY y)) ** 2 AS s FROM w),
t AS (SELECT key, a::DOUBLE AS a, coalesce(sum(s), 0)::DOUBLE AS score FROM z GROUP BY ALL)
SELECT key // 4 AS doc_id, (key % 4)::INT AS stride, a AS angle, score FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, a <> 0, a) = 1"""
)
def page_tilt(spark, sf_dir):
    """The tilt of pages with dark lines of a known slope on a light ground, from rows summed along each tilt, by all cells and by every other one; some pages are blank."""
    k = F.col("doc_id")
    # 500 pages are a million places of their rows along all tilts
    images = dealt(table(spark, sf_dir, "supplier"), "s_suppkey", 500).select(F.col("s_suppkey").alias("doc_id"), (40 + F.col("s_suppkey") % 21).alias("width"), (30 + F.col("s_suppkey") % 12).alias("height"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
    at = images.select("doc_id", "height", upto("width").alias("x")).select("doc_id", "x", upto("height").alias("y"))
    x, y = F.col("x"), F.col("y")
    line = (k % 9 != 0) & ((y * 64 - x * (k % 11 - 5) + 65536) % 1536 < 128)
    cells = at.select("doc_id", "y", "x", F.when(line, 20 + (k * 7 + x * 13 + y * 5) % 150).otherwise(200 + (k + x + y) % 56).alias("value"))
    found = [fit.skew_angle(images, cells, ["doc_id"], stride=n).select("doc_id", F.lit(n).alias("stride"), "angle", "score") for n in (1, fit.STRIDE)]
    return found[0].unionByName(found[1])
