"""Operators of the field extraction engine, with expected values worked out by hand."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import card_text, geometry, mrz
from attesta.functions import text as X
from attesta.operators import names, raster, votes


def one(spark, expr_of, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr_of(F.col("v"))).collect()]


def test_cleaning(spark):
    assert one(spark, X.clean_text, "a  b\r\n\n\n\nC\tD\ne\n") == ["a b\n\nC D e"]
    assert one(spark, X.clean_value, " :a  b, ") == ["a b"]
    assert one(spark, X.number_digits, "АOЗl", "x") == ["A031", "x"]
    assert one(spark, X.normal_dates, "1 . 2, 2001 and 41.02.2001") == ["1.2.2001 and 01.02.2001"]
    assert one(spark, X.drop_single_letters, "-A BC D", "A B") == ["BC", "A B"]


def test_validators(spark):
    assert one(spark, X.validate_date, "x 31/01/2020", "31.02.2020", "01.01.0099") == ["31.01.2020", None, None]
    assert one(spark, X.validate_sex, "муж", "ЗАН", "x") == ["M", "F", None]
    assert one(spark, X.validate_document_number, " a 1234567 ", "ABCD1234567") == ["A1234567", None]
    assert one(spark, X.validate_citizenship, "тоҷикистон", "USA") == ["ТОҶИКИСТОН", None]
    assert one(spark, lambda v: X.parse_back_read(F.lit("bloodGroup"), F.lit("value"), v), "b(iii)rh-", "C") == ["B(III)Rh-", None]
    assert one(spark, X.plausible_name, "САФАР", "САFАР", "аб") == [True, False, False]


def test_first_to_two_stops_early(spark):
    rows = [(1, i, v, float(c)) for i, (v, c) in enumerate([("A", 10), ("A", 20), ("B", 99), ("B", 99), ("B", 99)])]
    rows += [(2, 0, "X", 30.0), (2, 1, None, 99.0), (2, 2, "Y", 30.0)]
    got = {r.k: (r.value, r.confidence) for r in votes.first_to_two(spark.createDataFrame(rows, "k int, seq int, value string, confidence double"), ["k"]).collect()}
    assert got == {1: ("A", 20.0), 2: ("X", 30.0)}


def test_tiers_beat_confidence(spark):
    rows = [(1, "f", "guess", 99.0, 1, 0), (1, "f", "sure", 40.0, 0, 1), (2, "f", "low", 34.0, 0, 0)]
    df = spark.createDataFrame(rows, "d int, field string, value string, confidence double, tier int, src_rank int")
    assert [(r.d, r.value) for r in votes.tiered_merge(df, ["d", "field"]).collect()] == [(1, "sure")]


def test_zone_of_three_lines(spark):
    text = "I<TJKA0000004240000000000042<<\n9001011F3001019TJK<<<<<<<<<<<2\nSAMPLEOVA<<TESTA<<<<<<<<<<<<<<"
    df = spark.createDataFrame([(text,), (text.replace("\n", ""),), ("short",)], "t string")
    rows = df.select(mrz.parse(F.col("t"), 2024).alias("b")).select(mrz.facts(F.col("b"), 2024).alias("f")).collect()
    for r in rows[:2]:
        found = {x.field: x.value for x in r.f}
        assert found["documentNumber"] == "A00000042" and found["birthDate"] == "01.01.1990" and found["mrzSurname"] == "SAMPLEOVA" and found["nationalIdNumber"] == "0000000000042"
    assert rows[2].f is None or rows[2].f == []


@settings(max_examples=20, deadline=None)
@given(st.text("ABCDEFGHJ0123456789", min_size=9, max_size=9), st.integers(0, 8), st.sampled_from("0123456789"))
def test_single_digit_change_is_found(v, i, c):
    digit = lambda s: sum("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(x) * (7, 3, 1)[k % 3] for k, x in enumerate(s)) % 10
    w = v[:i] + c + v[i + 1 :]
    if v[i].isdigit() and v != w:
        assert digit(v) != digit(w)


def test_labels(spark):
    text = "Surname\nРАХИМОВ\nRAHIMOV\nDate of birth 01.02.1990\nA12345678"
    rows = [(1, "front", text), (2, "front", None), (3, "back", ""), (1, "back", text)]
    got = card_text.text_facts(spark.createDataFrame(rows, "doc_id long, side string, text string"), 2024).collect()
    assert {(r.doc_id, r.side) for r in got} == {(1, "front"), (1, "back")}
    found = {r.field: r.value for r in got if r.side == "front"}
    assert found["surname"] == "РАХИМОВ" and found["documentNumber"] == "A12345678" and found["birthDate"] == "01.02.1990"


def test_name_repair(spark):
    rows = [("КОСИМ", ["QOSIM"]), ("РАХИМОВ", []), ("ПАВИД", ["NAVID", None, ""]), (None, None), ("К" * 9, ["Q" * 9]), ("КОСИМ", ["XXXXXXXX"])]
    df = spark.createDataFrame(rows, "w string, l array<string>")
    got = [(r.repaired, r.ratio) for r in names.with_repair(df, "w", F.col("l")).collect()]
    assert got == [("ҚОСИМ", 0.0), ("РАХИМОВ", 1.0), ("НАВИД", 0.0), ("", 1.0), ("К" * 9, 1.0), ("КОСИМ", 1.0)]
    assert names.aligned("САФАР", "SAFAR") == "САФАР" and names.aligned("А Б", "AB") is None and names.aligned("СОЛЬ", "SOL") == "СОЛ"
    assert names.aligned("АААА", "ZZZZ") is None and names.aligned("А" * 700, "A" * 700) == "А" * 700


def test_names_without_evidence(spark):
    pairs = spark.createDataFrame([], "doc_id long, side string, seq long, cyrillic string, latin string, confidence double, x0 double, y0 double, x1 double, y1 double")
    anchored = spark.createDataFrame([], "doc_id long, side string, field string, cyrillic string, latin string, confidence double, x0 double, y0 double, x1 double, y1 double")
    labeled = spark.createDataFrame([(1, "back", "surname", "«РАХИМОВ»", 90.0)], "doc_id long, side string, field string, value string, confidence double")
    zone = spark.createDataFrame([(2, "front", "surname", None), (2, "back", "surname", "RAHIMOV")], "doc_id long, side string, field string, value string")
    got = {(r.doc_id, r.field): (r.value, r.confidence, r.source) for r in names.resolve_names(pairs, anchored, labeled, zone).collect()}
    assert got == {(1, "surname"): ("«РАХИМОВ»", 55.0, "layout"), (2, "surname"): ("RAHIMOV", 58.0, "mrz")}
    # a label's value in quotes still names the line
    line = spark.createDataFrame([(1, "front", 0, "РАХИМОВ", None, 80.0, 0.0, 0.0, 9.0, 9.0)], pairs.schema)
    got = names.resolve_names(line, anchored, labeled, zone.limit(0)).collect()
    assert [(r.field, r.value, r.confidence) for r in got] == [("surname", "РАХИМОВ", 55.0)]


def test_expanded_diamond(spark):
    q = [(50.0, 10.0), (90.0, 50.0), (50.0, 90.0), (10.0, 50.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in q],)], "q array<struct<x: double, y: double>>")
    got = df.select(geometry.expand_quad(F.col("q"), F.lit(2**0.5), F.lit(200), F.lit(200)).alias("e"), geometry.area(F.col("q")).alias("a")).first()
    assert np.allclose([(p.x, p.y) for p in got.e], [(50, 8), (92, 50), (50, 92), (8, 50)]) and got.a == 3200


def test_raster():
    x = np.zeros((6, 6), bool)
    x[0, 0] = x[2:4, 2:5] = True
    label, n = raster.regions(x)
    assert n == 2 and (label == 2).sum() == 6
    assert raster.area(raster.hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]]))) == 4
    h = raster.homography(np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), np.array([[0, 0], [2, 0], [2, 2], [0, 2]]))
    assert np.allclose(h, np.diag([2, 2, 1]))
    assert np.allclose(raster.box_mean(np.ones((5, 7)), 2), 1)
    with pytest.raises(np.linalg.LinAlgError):
        raster.homography(np.zeros((4, 2)), np.zeros((4, 2)))
    card = np.full((120, 200, 3), 20, np.uint8)
    card[25:95, 40:160] = 240
    quad, sure = raster.card_quad(card)
    assert quad is not None and sure > 0.5 and np.abs(quad[0] - [40, 25]).max() < 5


def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "customer supplier part orders lineitem events documents embeddings conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    from attesta.plans.queries import ORACLE_SQL, QUERIES

    assert set(QUERIES) <= set(entry.queries())
    for name in ("vote_winner_first_to_two", "nearest_below_join", "text_cleanup", "date_shape_validation", "histogram_otsu", "transliterate_skeleton", "resolve_names", "back_zone_facts", "layout_page_facts", "text_card_facts", "connected_regions", "hull_area_by_group"):
        df = QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        got = sorted(str([r[c] for c in cols]) for r in df.collect())
        want = sorted(str(list(r)) for r in con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLE_SQL[name]})").fetchall())
        assert got == want, name
