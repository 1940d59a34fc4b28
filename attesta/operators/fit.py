"""Medians, refits and consensus lines, and statistics over histograms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import geometry


def upper_median(x: Column) -> Column:
    """The element at floor(n/2) of the sorted values."""
    s = F.sort_array(F.collect_list(x))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def upper_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the element at floor(n/2) of each key's sorted values, from a count of each different one.

    Equal values meet before the shuffle, and no key's values are gathered in
    one row. Nulls are left out; a key without values has no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    run = counts.select("*", F.sum("_n").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)).alias("_up"), F.sum("_n").over(w).alias("_all"))
    return run.where((F.col("_up") > F.floor(F.col("_all") / 2)) & (F.col("_up") - F.col("_n") <= F.floor(F.col("_all") / 2))).select(*keys, F.col("_v").alias("median"))


def refit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares slope and intercept of v over t."""
    return points.groupBy(*keys).agg(F.regr_slope("v", "t").alias("scale"), F.regr_intercept("v", "t").alias("shift"), F.count(F.lit(1)).alias("n"))


def consensus_fit(points: DataFrame, keys: list[str], low: float = 0.3, high: float = 4.0, spread: float = 100.0, tolerance: float = 16.0, least: int = 3) -> DataFrame:
    """v = scale * t + shift per key from (keys, seq, t, v) points, of which some are wrong.

    Every pair far enough apart proposes a line; the one with most inliers
    wins, then the smaller sum of residuals, then the earlier pair. Its
    inliers, at least `least` and `spread` apart, are refitted.
    """
    p, q = points.alias("p"), points.alias("q")
    same = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in keys]
    on = F.col("p.seq") < F.col("q.seq")
    for s in same:
        on = s & on
    slope = F.try_divide(F.col("q.v") - F.col("p.v"), F.col("q.t") - F.col("p.t"))
    lines = p.join(q, on).where(F.abs(F.col("q.t") - F.col("p.t")) >= spread).select(*[f"p.{k}" for k in keys], F.col("p.seq").alias("i"), F.col("q.seq").alias("j"), slope.alias("s"), F.col("p.t").alias("t0"), F.col("p.v").alias("v0"))
    lines = lines.where(F.col("s").between(low, high)).withColumn("c", F.col("v0") - F.col("s") * F.col("t0"))
    tried = lines.join(points, keys).withColumn("err", F.abs(F.col("v") - (F.col("s") * F.col("t") + F.col("c")))).where(F.col("err") <= F.lit(tolerance) * F.col("s"))
    scored = tried.groupBy(*keys, "i", "j", "s", "c").agg(F.count(F.lit(1)).alias("inliers"), F.sum("err").alias("total"))
    w = Window.partitionBy(*keys).orderBy(F.col("inliers").desc(), F.col("total"), "i", "j")
    best = scored.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & (F.col("inliers") >= least))
    inside = best.join(points, keys).where(F.abs(F.col("v") - (F.col("s") * F.col("t") + F.col("c"))) <= F.lit(tolerance) * F.col("s"))
    fits = inside.groupBy(*keys).agg(F.regr_slope("v", "t").alias("scale"), F.regr_intercept("v", "t").alias("shift"), F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("_spread"))
    return fits.where(F.col("_spread") >= spread).drop("_spread")


def register_axes(points: DataFrame, keys: list[str], low: float = 0.3, high: float = 4.0, spread: float = 100.0, tolerance: float = 16.0, least: int = 3) -> DataFrame:
    """(keys, sx, tx, sy, ty): x = sx * tx + shift and the same for y, per key from (keys, seq, tx, ty, x, y) points, some of them wrong.

    Each axis has its own consensus, over the same pairs of points: a pair that
    stands `spread` apart on an axis of the template proposes a line there; most
    points within `tolerance` win, then the smaller sum of residuals, then the
    earlier pair. The points that agree are refitted. A key has no row if on
    either axis fewer than `least` points agree, if these stand less than
    `spread` apart, or if the scale is out of range.

    Points are shuffled once, by key, and a key's points meet in one row.
    """
    point = F.struct("seq", *[F.col(c).cast("double").alias(c) for c in ("tx", "ty", "x", "y")])
    rows = points.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("_p"))
    return rows.select(*keys, axes_of(F.col("_p"), low, high, spread, tolerance, least).alias("_f")).where("_f.sx is not null").select(*keys, "_f.*")


def axes_of(points: Column, low: float = 0.3, high: float = 4.0, spread: float = 100.0, tolerance: float = 16.0, least: int = 3) -> Column:
    """struct<sx, tx, sy, ty> as register_axes finds it, from an array of struct(tx, ty, x, y) in the order of the points; of nulls where there is none."""

    def fitted(tx: pd.Series, ty: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = np.full((len(tx), 4), np.nan)
        sizes = np.array([0 if p is None else len(p) for p in tx], dtype=np.int64)
        for n in np.unique(sizes[sizes >= max(least, 2)]):
            same = np.flatnonzero(sizes == n)
            for some in np.array_split(same, -(-len(same) * int(n) // BLOCK)):
                every = [np.stack([np.asarray(c.iloc[k], dtype=float) for k in some]) for c in (tx, x, ty, y)]
                for at, (t, v) in enumerate((every[:2], every[2:])):
                    out[some, 2 * at], out[some, 2 * at + 1] = _consensus(t, v, low, high, spread, tolerance, least)
        out[np.isnan(out).any(axis=1)] = np.nan
        return pd.DataFrame(out, columns=["sx", "tx", "sy", "ty"]).astype(object).where(~np.isnan(out), None)

    udf = F.pandas_udf(fitted, "sx double, tx double, sy double, ty double").asNondeterministic()  # so that no filter runs it twice
    return udf(*[F.transform(points, lambda p: p[c]) for c in ("tx", "ty", "x", "y")])


#: Numbers that one step of the search for a consensus holds at once.
BLOCK = 1 << 20


def _consensus(t: np.ndarray, v: np.ndarray, low: float, high: float, spread: float, tolerance: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(scale, shift) of each row of points, NaN where they have none; pairs are tried some at a time."""
    m, n = t.shape
    count, total, s, c = np.zeros(m, dtype=np.int64), np.full(m, np.inf), np.full(m, np.nan), np.full(m, np.nan)
    i, j = np.triu_indices(n, 1)
    step = max(1, BLOCK // (m * n))
    with np.errstate(all="ignore"):
        for k in range(0, len(i), step):
            a, b = i[k : k + step], j[k : k + step]
            apart = t[:, b] - t[:, a]
            scale = (v[:, b] - v[:, a]) / apart
            scale[~((np.abs(apart) >= spread) & (scale >= low) & (scale <= high))] = np.nan
            shift = v[:, a] - scale * t[:, a]
            off = np.abs(scale[:, :, None] * t[:, None, :] + shift[:, :, None] - v[:, None, :])
            near = off <= tolerance * scale[:, :, None]
            some, sums = near.sum(axis=2), np.where(near, off, 0.0).sum(axis=2)
            first = np.where(some == some.max(axis=1, keepdims=True), sums, np.inf).argmin(axis=1)
            row = np.arange(m)
            won = (some[row, first] > count) | ((some[row, first] == count) & (count > 0) & (sums[row, first] < total))
            for kept, new in ((count, some), (total, sums), (s, scale), (c, shift)):
                kept[won] = new[row, first][won]
        near = np.abs(s[:, None] * t + c[:, None] - v) <= tolerance * s[:, None]
        size = near.sum(axis=1)
        mean = lambda x: np.where(near, x, 0.0).sum(axis=1) / size
        dt, dv = np.where(near, t - mean(t)[:, None], 0.0), np.where(near, v - mean(v)[:, None], 0.0)
        scale = (dt * dv).sum(axis=1) / (dt * dt).sum(axis=1)
        wide = np.where(near, t, -np.inf).max(axis=1) - np.where(near, t, np.inf).min(axis=1)
        good = (size >= least) & (wide >= spread) & (scale >= low) & (scale <= high)
        return np.where(good, scale, np.nan), np.where(good, mean(v) - scale * mean(t), np.nan)


def register_by_lines(boxes: DataFrame, keys: list[str], mrz: tuple, size: tuple, drift: float = 1.25) -> DataFrame:
    """sx, tx, sy, ty of a back image from its three machine-readable line boxes, else from the image's size."""
    left, right, centres = mrz
    order = Window.partitionBy(*keys).orderBy("y0", "seq")
    rows = boxes.withColumn("place", F.row_number().over(order)).withColumn("v", (F.col("y0") + F.col("y1")) / 2)
    rows = rows.withColumn("t", F.element_at(F.array(*[F.lit(float(c)) for c in centres]), F.least("place", F.lit(3))))
    g = rows.groupBy(*keys).agg(upper_median(F.col("x0")).alias("l"), upper_median(F.col("x1")).alias("r"), F.regr_slope("v", "t").alias("sy"), F.regr_intercept("v", "t").alias("ty"), F.count(F.lit(1)).alias("n"), F.first("width").alias("width"), F.first("height").alias("height"))
    sx = (F.col("r") - F.col("l")) / F.lit(float(right - left))
    usable = (F.col("n") == 3) & sx.between(0.3, 4) & F.col("sy").between(0.3, 4) & (F.greatest(F.try_divide(sx, F.col("sy")), F.try_divide(F.col("sy"), sx)) <= drift)
    return g.select(
        *keys, "width", "height", F.when(usable, sx).otherwise(F.col("width") / size[0]).alias("sx"), F.when(usable, F.col("l") - sx * left).otherwise(0.0).alias("tx"),
        F.when(usable, F.col("sy")).otherwise(F.col("height") / size[1]).alias("sy"), F.when(usable, F.col("ty")).otherwise(0.0).alias("ty"),
    )


def histogram(values: DataFrame, keys: list[str], bin_: Column, bins: int = 256) -> DataFrame:
    return values.groupBy(*keys, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(bin_))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame, keys: list[str], default: int = 127) -> DataFrame:
    """The bin that parts a histogram with the largest between-class variance, the first of equal ones."""
    w = Window.partitionBy(*keys).orderBy("bin")
    run, all_ = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    x = hist.withColumns({"c": F.sum("n").over(run), "m": F.sum(F.col("n") * F.col("bin")).over(run), "cn": F.sum("n").over(all_), "mn": F.sum(F.col("n") * F.col("bin")).over(all_)})
    rest = F.col("cn") - F.col("c")
    apart = F.try_divide(F.col("m").cast("double"), F.col("c")) - F.try_divide((F.col("mn") - F.col("m")).cast("double"), rest)
    x = x.withColumn("between", F.when(rest > 0, F.col("c").cast("double") * rest * apart * apart))
    best = Window.partitionBy(*keys).orderBy(F.col("between").desc_nulls_last(), "bin")
    return x.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, F.when(F.col("between") > 0, F.col("bin")).otherwise(default).alias("threshold"))


def clip_range(hist: DataFrame, keys: list[str], share: float = 0.015) -> DataFrame:
    """The first bins at which the counts from below and from above reach a share of all."""
    w = Window.partitionBy(*keys)
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = w.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = hist.withColumns({"a": F.sum("n").over(up), "z": F.sum("n").over(down), "all": F.sum("n").over(w)})
    need = F.col("all") * F.lit(share)
    g = x.groupBy(*keys).agg(F.min(F.when(F.col("a") >= need, F.col("bin"))).alias("low"), F.max(F.when(F.col("z") >= need, F.col("bin"))).alias("high"))
    return g.withColumn("high", F.greatest(F.col("low") + 1, F.col("high")))


def box_mean(values: DataFrame, keys: list[str], at: str, value: str, radius: int) -> DataFrame:
    """Mean of the values within `radius` places, clipped at the ends."""
    return values.withColumn("mean", F.avg(value).over(Window.partitionBy(*keys).orderBy(at).rangeBetween(-radius, radius)))


#: Cells of a tile's side in area_mean.
TILE = 256


def area_mean(cells: DataFrame, keys: list[str], radius: int, tile: int = TILE) -> DataFrame:
    """(keys, y, x, mean): the mean of the cells at most `radius` rows and columns away, clipped at the edges.

    cells: (keys, y, x, value), y and x from 0, one row a cell; cells that are
    missing or null count as absent. Summed areas are made tile by tile, each
    with a rim of `radius` from its neighbours, so an image of any size is many
    tasks: a tile's cells meet in one row, in the only shuffle, and a cell's
    sum is four look-ups at the corners of its box.
    """
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    known = cells.where(F.col("value").isNotNull()).select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"))
    # the tiles whose rim or inside a cell lies in
    near = lambda c: F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col(c) - radius) / tile).cast("long")), F.floor((F.col(c) + radius) / tile).cast("long"))
    spread = known.select("*", F.explode(near("y")).alias("_ty")).select("*", F.explode(near("x")).alias("_tx"))
    unit = [*keys, "_ty", "_tx"]
    tiles = spread.groupBy(*unit).agg(F.collect_list(F.struct("y", "x", "value")).alias("_c"))
    found = tiles.select(*keys, _tile_means(radius, tile)("_ty", "_tx", "_c.y", "_c.x", "_c.value").alias("_m"))
    return found.select(*keys, F.inline(F.arrays_zip("_m.y", "_m.x", "_m.mean")))


def _tile_means(radius: int, tile: int):
    """A pandas UDF from a tile's number and the cells of it and its rim to the places and means of its own cells."""

    def means(ty: pd.Series, tx: pd.Series, ys: pd.Series, xs: pd.Series, values: pd.Series) -> pd.DataFrame:
        out = []
        for at in zip(ty, tx, ys, xs, values):
            (r, c), (y, x), v = at[:2], (np.asarray(i, dtype=np.int64) for i in at[2:4]), np.asarray(at[4], dtype=float)
            top, left = y.min(), x.min()
            # sums of all cells above and to the left of a place, both excluded
            sums = np.zeros((2, y.max() - top + 2, x.max() - left + 2))
            np.add.at(sums[0], (y - top + 1, x - left + 1), v)
            np.add.at(sums[1], (y - top + 1, x - left + 1), 1.0)
            sums = sums.cumsum(axis=1).cumsum(axis=2)
            own = (y // tile == r) & (x // tile == c)
            y, x = y[own], x[own]
            y0, y1 = np.maximum(y - radius - top, 0), np.minimum(y + radius + 1 - top, sums.shape[1] - 1)
            x0, x1 = np.maximum(x - radius - left, 0), np.minimum(x + radius + 1 - left, sums.shape[2] - 1)
            total, n = sums[:, y1, x1] - sums[:, y0, x1] - sums[:, y1, x0] + sums[:, y0, x0]
            out.append((y, x, total / n))
        return pd.DataFrame(out, columns=["y", "x", "mean"])

    return F.pandas_udf(means, "y array<bigint>, x array<bigint>, mean array<double>").asNondeterministic()


def longest_stable(levels: DataFrame, keys: list[str], tolerance: Column | float, least: int = 3) -> DataFrame:
    """(keys, light, level, corners, run): the middle of the longest run of neighbouring levels whose quadrilaterals stay where they are.

    levels: (keys, light, level, corners), a row for each polarity and threshold
    level, corners an array of points or null where the level shows none. A
    level continues a run if it follows the last one of its polarity and no
    corner moves by more than the tolerance. Runs under `least` do not count;
    of runs of one length the light one and then the first wins. Levels that
    are absent count as null ones; keys without a run give no row.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("light").desc(), "level")
    before = F.lag(F.struct("light", "level", "corners")).over(w)
    goes_on = (F.col("_p.light") == F.col("light")) & (F.col("_p.level") == F.col("level") - 1) & geometry.same_quad(F.col("_p.corners"), F.col("corners"), F.lit(tolerance) if isinstance(tolerance, (int, float)) else tolerance)
    shown = levels.withColumn("_p", before).withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    runs = shown.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("corners").isNotNull())
    # a run has no more rows than there are levels
    found = runs.groupBy(*keys, "light", "_run").agg(F.sort_array(F.collect_list(F.struct("level", "corners"))).alias("r")).where(F.size("r") >= least)
    first = F.struct((-F.size("r")).alias("n"), (~F.col("light")).alias("dark"), F.get("r", F.lit(0))["level"].alias("level"), F.get("r", F.floor(F.size("r") / 2).cast("int")).alias("middle"))
    return found.groupBy(*keys).agg(F.min(first).alias("b")).select(*keys, (~F.col("b.dark")).alias("light"), "b.middle.level", "b.middle.corners", (-F.col("b.n")).alias("run"))


#: Angles in degrees at which a page's rows are tried, the stride of its cells, and the value up to which a cell is dark.
TILTS, STRIDE, DARK = tuple(i / 2 for i in range(-10, 11)), 2, 190


def skew_angle(images: DataFrame, cells: DataFrame, keys: list[str], angles: tuple[float, ...] = TILTS, stride: int = STRIDE, dark: float = DARK) -> DataFrame:
    """(keys, angle, score): the tilt at which the darkness of a page's rows changes most from row to row.

    images: (keys, width, height); cells: (keys, y, x, value) with values up to
    255. The dark cells on the stride are summed along each tilt into rows,
    which are counted before the shuffle; the score is the sum of squared
    differences of neighbouring rows, rows without dark cells included. Of
    equal scores the tilt 0 wins, then the smallest; a page without dark cells
    has tilt 0 and score 0. Null values are not dark. A stride over 1 leaves
    every other row empty at tilt 0 and so favours it unless lines are thin and
    far apart; with stride 1 small tilts of any page are found.
    """
    picked = cells.where((F.col("value") <= dark) & (F.col("y") % stride == 0) & (F.col("x") % stride == 0))
    known = picked.join(images.select(*keys, "width", "height"), keys)
    middle = F.col("height") / 2
    turned = lambda a: F.floor(-(F.col("x") - F.col("width") / 2) * F.lit(math.sin(math.radians(a))) + (F.col("y") - middle) * F.lit(math.cos(math.radians(a))) + middle + F.lit(0.5)).cast("long")
    tried = known.select(*keys, "height", (F.lit(255.0) - F.col("value")).alias("d"), F.inline(F.array(*[F.struct(F.lit(float(a)).alias("angle"), turned(a).alias("row")) for a in angles])))
    rows = tried.where((F.col("row") >= 0) & (F.col("row") < F.col("height"))).groupBy(*keys, "height", "angle", "row").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys, "height", "angle").orderBy("row")
    d, row = F.col("d"), F.col("row")
    rise = F.when(F.lag("row").over(w) == row - 1, d - F.lag("d").over(w)).when(row > 0, d).otherwise(F.lit(0.0))
    fall = F.when((F.coalesce(F.lead("row").over(w), F.lit(-1)) != row + 1) & (row + 1 < F.col("height")), d).otherwise(F.lit(0.0))
    scores = rows.select(*keys, "angle", (rise * rise + fall * fall).alias("s")).groupBy(*keys, "angle").agg(F.sum("s").alias("score"))
    best = scores.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), (F.col("angle") != 0).alias("tilted"), "angle")).alias("b"))
    best = best.select(*keys, F.when(F.col("b.s") < 0, F.col("b.angle")).otherwise(0.0).alias("_a"), (-F.col("b.s")).alias("_s"))
    return images.select(*keys).join(best, keys, "left").select(*keys, F.coalesce("_a", F.lit(0.0)).alias("angle"), F.coalesce("_s", F.lit(0.0)).alias("score"))
