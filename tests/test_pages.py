"""Nested pages: overlay of labels, segments, registration of the front against a plain version, places, corrections."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attesta.functions import tables as T
from attesta.operators import fit, pages, votes
from attesta.plans import zones
from attesta.sources.tables import PAGE

BLOCKS = PAGE.split("blocks ", 1)[1]


def word(text, confidence, x, y, w=30, h=10):
    return (text, float(confidence), (float(x), float(y), float(x + w), float(y + h)))


def line(*words):
    edges = [[w[2][i] for w in words] or [0.0] for i in range(4)]
    return ("old", 50.0, (min(edges[0]), min(edges[1]), max(edges[2]), max(edges[3])), list(words))


def page(*blocks):
    return [([([*lines],) for lines in paragraphs],) for paragraphs in blocks]


def texts(blocks):
    return [[[(l.text, [(w.text, w.confidence) for w in l.words]) for l in p.lines] for p in b.paragraphs] for b in blocks]


def overlay(spark, mine, english):
    df = spark.createDataFrame([(mine, english)], f"t {BLOCKS}, e {BLOCKS}")
    got = df.select(pages.merge_labels(F.col("t"), F.col("e")).alias("m")).first().m
    return got if got is None else texts(got)


def test_a_label_goes_in_once_and_what_is_left_empty_goes(spark):
    mine = page(
        [[line(word("Нате", 92, 0, 0), word("АЛИ", 90, 100, 0)), line(word("х", 80, 0, 20, 14), word("у", 80, 15, 20, 14))], [line(word("b", 10, 0, 40))]],
        [[line(word("x2", 80, 2, 20, 20))]],  # all of this block is a second hit of one label
        [[line()]],
    )
    english = page([[line(word("Name", 95, 1, 1), word("Surname:", 70, 0, 20), word("of", 79, 0, 40), word("Zebra", 99, 100, 0))]])
    assert overlay(spark, mine, english) == [[[("Name АЛИ\n", [("Name", 95.0), ("АЛИ", 90.0)]), ("Surname:\n", [("Surname:", 70.0)])], [("b\n", [("b", 10.0)])]]]


def test_overlay_of_missing_pages_and_repeated_labels(spark):
    mine = page([[line(word("a", 50, 0, 0)), line()]])
    assert overlay(spark, None, mine) is None
    assert overlay(spark, mine, None) == [[[("a\n", [("a", 50.0)])]]] == overlay(spark, mine, page())
    assert overlay(spark, [], mine) == []
    # two labels at one spot: the first one is taken, by both words, so the second word goes
    twice = page([[line(word("Date", 60, 0, 0), word("Name", 99, 0, 0))]])
    assert overlay(spark, page([[line(word("p", 1, 0, 0), word("q", 1, 1, 0))]]), twice) == [[[("Date\n", [("Date", 60.0)])]]]
    # exactly half of the shorter box is one spot, less is not; a label of three letters must be surer
    half = page([[line(word("Name", 60, 15, 5), word("sex", 79, 200, 0), word("SEX", 80, 300, 0))]])
    assert overlay(spark, page([[line(word("p", 1, 0, 0), word("q", 1, 200, 0), word("r", 1, 300, 0))]]), half)[0][0][0][0] == "Name q SEX\n"
    assert overlay(spark, page([[line(word("p", 1, -1, 0))]]), half)[0][0][0][0] == "p\n"


def test_segments(spark):
    mine = page([[line(word("b", 40, 40, 0), word("a", 30, 0, 0), word("low", 29, 75, 0), word("c", 50, 81, 2)), line(word("z", 10, 0, 0))]], [[line(word("d", 99, 0, 0), word("e", 97, 0, 3))]])
    got = spark.createDataFrame([(mine,), (None,)], f"t {BLOCKS}").select(pages.segments(F.col("t")).alias("s")).collect()
    assert [(s.text, s.confidence, tuple(s.bbox)) for s in got[0].s] == [("a b c", 40.0, (0.0, 0.0, 111.0, 12.0)), ("d e", 98.0, (0.0, 0.0, 30.0, 13.0))]
    assert got[1].s is None


def test_anchor_patterns(spark):
    seen = ["Насаб/", "НОМ/", "Номи падар/", "Санаи таваллуд", "Чои таваллуд", "Чинс", "Шахрванди", "Раками ягона", "оғози", "анчоми", "Рақами шиноснома", "surname", "Given Names", "Father's name", "Date of birth", "Place of birth", "Sex", "sex ", "National", "issue", "expiry", "Document"]
    box = {"x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0}
    segs = F.array(*[F.struct(F.lit(s).alias("text"), F.lit(9.0).alias("confidence"), F.struct(*[F.lit(v).alias(k) for k, v in box.items()]).alias("bbox")) for s in seen])
    got = spark.range(1).select(pages.anchor_points(segs, segs).alias("p")).first().p
    places = [(p.tx, p.ty) for p in got]
    # every anchor names one of these, in its own order; surname, father's name and place of birth are no other label's
    assert places == [(float(x), float(y)) for *_, x, y in T.ANCHORS]


def plain_axis(points):
    """(scale, shift) of [(template, actual)], or None."""
    best = None
    for (t0, v0), (t1, v1) in combinations(points, 2):
        if abs(t1 - t0) < 100 or not 0.3 <= (v1 - v0) / (t1 - t0) <= 4:
            continue
        s = (v1 - v0) / (t1 - t0)
        c = v0 - s * t0
        inside = [(t, v) for t, v in points if abs(s * t + c - v) <= 16 * s]
        key = (-len(inside), sum(abs(s * t + c - v) for t, v in inside))
        if best is None or key < best[0]:
            best = (key, inside)
    if best is None or len(best[1]) < 3:
        return None
    ts, vs = zip(*best[1])
    if max(ts) - min(ts) < 100:
        return None
    mt, mv = sum(ts) / len(ts), sum(vs) / len(vs)
    s = sum((t - mt) * (v - mv) for t, v in best[1]) / sum((t - mt) ** 2 for t in ts)
    return (s, mv - s * mt) if 0.3 <= s <= 4 else None


def test_register_axes_matches_a_plain_search(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for key in range(60):
        s = rng.choice([0.25, 0.31, 0.8, 1.7, 3.9, 4.2])
        n = rng.choice([0, 1, 2, 3, 5, 12, 20])
        spots = [rng.choice(T.ANCHORS)[3:] for _ in range(n)]
        points = [(float(x), float(y), s * (x + rng.uniform(-4, 4)) + 30, s * (y + rng.uniform(-4, 4)) - 10) for x, y in spots]
        points = [p if rng.random() < 0.75 else (*p[:2], rng.uniform(0, 3000), rng.uniform(0, 3000)) for p in points]
        rows += [(key, i, *p) for i, p in enumerate(points)]
        x, y = plain_axis([(p[0], p[2]) for p in points]), plain_axis([(p[1], p[3]) for p in points])
        if x and y:
            want[key] = (*x, *y)
    df = spark.createDataFrame(rows, "k int, seq int, tx double, ty double, x double, y double")
    got = {r.k: (r.sx, r.tx, r.sy, r.ty) for r in fit.register_axes(df, ["k"]).collect()}
    assert len(want) > 15 and got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)


def test_register_axes_shuffles_points_once(spark):
    points = spark.range(50).selectExpr("id % 3 AS k", "id AS seq", "id * 10D AS tx", "id * 7D AS ty", "id * 10D AS x", "id * 7D AS y")
    fits = fit.register_axes(points, ["k"])
    fits.collect()
    final = fits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") - final.count("ReusedExchange") == 1


def test_places_of_a_back(spark):
    images = spark.createDataFrame([(1, 1800, 1206), (2, 900, 603), (3, 30, 20)], "doc_id int, width int, height int")
    lines = spark.createDataFrame([(1, i, 96.0 + 5, c - 15.0 + 7, 1697.0 + 5, c + 15.0 + 7) for i, c in enumerate(T.BACK_MRZ[2])], "doc_id int, seq int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.doc_id, r.field, r.part, r.line): (r.x0, r.y0, r.x1, r.y1) for r in zones.locate_back_zones(lines, images, ["doc_id"]).collect()}
    assert got[1, "address", "value", 1] == pytest.approx((565, 239, 1725, 291)) and got[1, "taxId", "value", None] == pytest.approx((1440, 481, 1785, 541))
    assert got[2, "address", "value", 3] == pytest.approx((280, 160, 860, 186)) and len([k for k in got if k[0] == 2]) == 9
    assert not [k for k in got if k[0] == 3]  # everything there is too small


def test_corrections(spark):
    facts = spark.createDataFrame([(1, "a", "x", 50.0, "mrz"), (1, "b", "y", 60.0, "text"), (2, "a", "z", 70.0, "mrz")], "doc_id int, field string, value string, confidence double, source string")
    log = [(1, "a", "first", 1), (1, "a", "last", 9), (1, "b", "gone", 3), (1, "b", None, 4), (2, "a", "", 1), (2, "c", "new", 1), (3, "a", "only", 1), (3, "b", None, 2), (4, "t", "b", 5), (4, "t", "c", 5), (4, "t", None, 5)]
    edits = spark.createDataFrame(log, "doc_id int, field string, value string, at long")
    got = {(r.doc_id, r.field): (r.value, r.confidence, r.source) for r in votes.with_edits(facts, edits, ["doc_id", "field"]).collect()}
    assert got == {
        (1, "a"): ("last", None, None), (1, "b"): ("y", 60.0, "text"), (2, "a"): ("", None, None), (2, "c"): ("new", None, None), (3, "a"): ("only", None, None), (4, "t"): ("c", None, None),
    }
    assert votes.with_edits(facts.where("false"), edits.where("false"), ["doc_id", "field"]).collect() == []


def test_queries_are_registered():
    assert {"label_overlay_pages", "page_segments", "front_zone_boxes", "back_address_boxes", "edited_facts"} <= entry.queries().keys() & entry.oracle_sql().keys()


@pytest.mark.parametrize("radius,tile", [(1, 4), (3, 4), (9, 4), (2, 256)])
def test_area_mean_matches_plain_means(spark, radius, tile):
    rng = random.Random(radius)
    cells = [(k, y, x, None if rng.random() < 0.05 else float(rng.randrange(100))) for k, (h, w) in enumerate([(11, 9), (1, 1), (4, 13)]) for y in range(h) for x in range(w) if rng.random() < 0.8 or (y, x) == (0, 0)]
    df = spark.createDataFrame(cells, "k int, y int, x int, value double")
    got = {(r.k, r.y, r.x): r["mean"] for r in fit.area_mean(df, ["k"], radius, tile).collect()}
    known = [c for c in cells if c[3] is not None]
    want = {}
    for k, y, x, _ in known:
        near = [v for i, b, a, v in known if i == k and abs(b - y) <= radius and abs(a - x) <= radius]
        want[k, y, x] = sum(near) / len(near)
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
    assert fit.area_mean(df.where("false"), ["k"], radius, tile).collect() == []


def test_upper_medians(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([1.0, 2.0, 2.0, 5.0, None])) for k in range(40) for _ in range(rng.randrange(1, 9))]
    got = {r.k: r["median"] for r in fit.upper_medians(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    values = {k: sorted(v for i, v in rows if i == k and v is not None) for k in range(40)}
    assert got == {k: vs[len(vs) // 2] for k, vs in values.items() if vs}
