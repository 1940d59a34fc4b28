"""Stable runs of thresholds and tilts of pages against plain Python."""

import math
import random

from pyspark.sql import functions as F

from attesta.operators import fit

LEVELS = "doc_id int, light boolean, level int, corners array<struct<x: double, y: double>>"


def longest(levels, tolerance, least=3):
    """(light, level, corners, run) by walking the levels of each polarity."""
    best = None
    for light in (True, False):
        run, last = [], None
        for level in [*range(10), None]:
            q = levels.get((light, level))
            if q and run and last == level - 1 and all(math.dist(a, b) <= tolerance for a, b in zip(run[-1][1], q)):
                run.append((level, q))
            else:
                if len(run) >= least and (not best or len(run) > best[1]):
                    best = (light, len(run), run[len(run) // 2])
                run = [(level, q)] if q else []
            last = level
    return best and (best[0], best[2][0], best[2][1], best[1])


def test_longest_stable_run(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for d in range(60):
        levels, x = {}, 0.0
        for light in (True, False):
            for level in range(10):
                if rng.random() < 0.05:
                    continue  # an absent level ends a run like a null one
                x += rng.choice([0, 0, 1, -1, 9])
                levels[light, level] = None if rng.random() < 0.15 else [(x, 0.0), (x + 50, 0.0), (x + 50, 30 + x % 4), (x, 30.0)]
        rows += [(d, *k, q) for k, q in levels.items()]
        if d % 10 != 9:
            want[d] = longest(levels, 2.0)
    rows = [(d, light, level, None if d % 10 == 9 else q) for d, light, level, q in rows]
    got = {r.doc_id: (r.light, r.level, [tuple(p) for p in r.corners], r.run) for r in fit.longest_stable(spark.createDataFrame(rows, LEVELS), ["doc_id"], 2.0).collect()}
    assert got == {d: w for d, w in want.items() if w} and 30 < len(got)
    assert any(not w[0] for w in got.values())
    assert fit.longest_stable(spark.createDataFrame([], LEVELS), ["doc_id"], F.lit(2.0)).count() == 0


def test_known_tilts_are_found(spark):
    """Pages of long thin lines at the tried angles, one upright, one blank, one with null cells and one without cells."""
    width, height = 160, 90
    tilts = {1: 3.0, 2: -2.5, 3: 0.0, 4: 4.5}
    cells = [(d, y, x, 30 if (y - (x - 80) * math.tan(math.radians(a))) % 24 < 2 else 240) for d, a in tilts.items() for y in range(height) for x in range(width)]
    cells += [(5, 0, 0, 255), (5, 2, 2, None)]
    images = spark.createDataFrame([(d, width, height) for d in range(1, 7)], "doc_id int, width int, height int")
    df = spark.createDataFrame(cells, "doc_id int, y int, x int, value int")
    got = {(r.doc_id, n): (r.angle, r.score) for n in (1, 2) for r in fit.skew_angle(images, df, ["doc_id"], stride=n).collect()}
    assert {d: got[d, 1][0] for d in tilts} == tilts
    assert {got[d, n] for d in (5, 6) for n in (1, 2)} == {(0.0, 0.0)}

    def score(page, a, n):
        rows = [0.0] * height
        for d, y, x, v in cells:
            if d == page and v <= 190 and not (x % n or y % n):
                r = math.floor(-(x - width / 2) * math.sin(math.radians(a)) + (y - height / 2) * math.cos(math.radians(a)) + height / 2 + 0.5)
                if 0 <= r < height:
                    rows[r] += 255 - v
        return sum((b - a) ** 2 for a, b in zip(rows, rows[1:]))

    for d in tilts:
        for n in (1, 2):
            tried = {a: score(d, a, n) for a in fit.TILTS}
            best = max(tried, key=lambda a: (tried[a], a == 0, -a))
            assert got[d, n] == (best, tried[best])
