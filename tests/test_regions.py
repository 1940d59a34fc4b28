"""Regions from runs against a flood fill: random cells, a spiral, combs, repeated cells, nothing."""

import random

from attesta.operators import regions


def filled(cells):
    """{first cell: (n, x0, y0, x1, y1)} of the regions of a set of (y, x)."""
    left, out = set(cells), {}
    for start in sorted(cells):
        if start in left:
            left.discard(start)
            found, todo = [], [start]
            while todo:
                y, x = todo.pop()
                found.append((y, x))
                for near in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if near in left:
                        left.discard(near)
                        todo.append(near)
            ys, xs = zip(*found)
            out[min(found)] = (len(found), min(xs), min(ys), max(xs), max(ys))
    return out


def spiral(n):
    cells, y, x, dy, dx = {(0, 0)}, 0, 0, 0, 1
    for length in [n - 1] + [k for k in range(n - 1, 1, -2) for _ in (0, 1)]:
        for _ in range(length):
            y, x = y + dy, x + dx
            cells.add((y, x))
        dy, dx = dx, -dy
    return cells


def test_regions_match_flood_fill(spark):
    rng = random.Random(8)
    images = [{(y, x) for y in range(14) for x in range(17) if rng.random() < share} for share in (0.2, 0.55, 0.65)]
    images += [spiral(17), {(y, x) for y in range(12) for x in range(15) if x % 2 == 0 or y == 11}, {(0, 0)}, {(3, 4), (4, 5)}]
    rows = [(k, y, x) for k, cells in enumerate(images) for y, x in cells]
    df = spark.createDataFrame(rows + rows[:50], "k int, y int, x int").repartition(3)
    got = {(r.k, (r.label >> 32, r.label & 0xFFFFFFFF)): (r.cells, r.x0, r.y0, r.x1, r.y1) for r in regions.regions(df, ["k"]).collect()}
    assert got == {(k, first): box for k, cells in enumerate(images) for first, box in filled(cells).items()}


def test_no_cells(spark):
    assert regions.regions(spark.createDataFrame([], "k int, y int, x int"), ["k"]).collect() == []
