"""Maps between quadrilaterals against the solution of their linear system."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import geometry
from attesta.operators import raster


def test_maps_match_the_linear_system(spark):
    rng = random.Random(3)
    quad = lambda: [(x + rng.uniform(-20, 20), y + rng.uniform(-20, 20)) for x, y in ((0, 0), (100, 0), (100, 80), (0, 80))]
    pairs = [(quad(), quad()) for _ in range(25)]
    inside = (41.0, 37.0)
    corners = "array<struct<x: double, y: double>>"
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    line, same = [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], [(5.0, 5.0)] * 4
    rows += [(100, line, pairs[0][1]), (101, pairs[0][0], line), (102, same, same), (103, None, pairs[0][1]), (104, pairs[0][0], [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0), (0.0, 9.0)])]
    df = spark.createDataFrame(rows, f"i int, a {corners}, b {corners}").withColumn("h", geometry.homography(F.col("a"), F.col("b")))
    got = {r.i: (r.h, r.p, r.q) for r in df.select("i", "h", geometry.mapped(F.col("h"), geometry.point(F.lit(inside[0]), F.lit(inside[1]))).alias("p"), F.transform("a", lambda c: geometry.mapped(F.col("h"), c)).alias("q")).collect()}
    for i, (a, b) in enumerate(pairs):
        want = raster.homography(np.array(a), np.array(b)) @ np.array([*inside, 1.0])
        assert tuple(got[i][1]) == pytest.approx(tuple(want[:2] / want[2]), abs=1e-6)
        assert np.array(got[i][2]) == pytest.approx(np.array(b), abs=1e-6)
    assert all(got[i][0] is None and got[i][1] is None for i in (100, 101, 102, 103))
