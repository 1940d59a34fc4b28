"""Joins of boxes and lines within one document. The document key is always an equality, the geometry a residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the shorter length (1 at least)."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / F.greatest(F.lit(1.0), F.least(a1 - a0, b1 - b0))


def _axis(a: str, b: str, axis: str) -> Column:
    return overlap(F.col(f"{a}.{axis}0"), F.col(f"{a}.{axis}1"), F.col(f"{b}.{axis}0"), F.col(f"{b}.{axis}1"))


def same_spot(a: str, b: str) -> Column:
    return (_axis(a, b, "y") >= 0.5) & (_axis(a, b, "x") >= 0.5)


def same_line(a: str, b: str) -> Column:
    return (_axis(a, b, "y") >= 0.5) & (_axis(a, b, "x") >= 0.3)


def merge_labels(words: DataFrame, labels: DataFrame, keys: list[str], match: Column) -> DataFrame:
    """Words (w, with seq and text) overlaid with the first label (l) at their spot.

    A label is used once: the first word that matches it takes its text and
    confidence, later ones are dropped; other words stay as they are.
    """
    w, m = words.alias("w"), labels.alias("l")
    on = match
    for k in keys:
        on = (F.col(f"w.{k}") == F.col(f"l.{k}")) & on
    first = Window.partitionBy(*[f"w_{k}" for k in keys], "w_seq").orderBy("l_seq")
    hits = w.join(m, on).select(*[F.col(f"w.{k}").alias(f"w_{k}") for k in keys], F.col("w.seq").alias("w_seq"), F.col("l.seq").alias("l_seq"), F.col("l.text").alias("l_text"), F.col("l.confidence").alias("l_confidence"))
    hits = hits.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    hits = hits.withColumn("use", F.row_number().over(Window.partitionBy(*[f"w_{k}" for k in keys], "l_seq").orderBy("w_seq")))
    on = F.col("w.seq") == F.col("w_seq")
    for k in keys:
        on = on & (F.col(f"w.{k}") == F.col(f"w_{k}"))
    out = w.join(hits, on, "left").where(F.col("use").isNull() | (F.col("use") == 1))
    return out.select("w.*", "l_seq", "l_text", "l_confidence").withColumn("text", F.coalesce("l_text", "text")).withColumn("confidence", F.coalesce("l_confidence", "confidence")).drop("l_text", "l_confidence")


def drop_shadows(lines: DataFrame, others: DataFrame, keys: list[str], margin: float = 8.0, match: Column | None = None) -> DataFrame:
    """Lines (a) without those that a more confident line of the other script (b) lies on."""
    on = (match if match is not None else same_line("a", "b")) & (F.col("b.confidence") > F.col("a.confidence") + margin)
    for k in keys:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    return lines.alias("a").join(others.alias("b"), on, "left_anti")


def nearest_below(lines: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Each line (a) with the nearest other line (b) below it: a left join, one row per line."""
    h = F.greatest(F.lit(1.0), F.col("a.y1") - F.col("a.y0"))
    on = (F.col("b.y0") >= F.col("a.y1") - 0.4 * h) & (F.col("b.y0") <= F.col("a.y1") + 2 * h) & (_axis("a", "b", "x") >= 0.3)
    for k in keys:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    joined = lines.alias("a").join(others.alias("b"), on, "left")
    w = Window.partitionBy(*[f"a.{k}" for k in keys], "a.seq").orderBy(F.col("b.y0").asc_nulls_last(), F.col("b.seq"))
    return joined.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def closest_value(labels: DataFrame, words: DataFrame, keys: list[str], floor: float = 40.0) -> DataFrame:
    """For each label box (a) the nearest valid word (b) near it, by vertical gap and a quarter of the sideways one."""
    h, gap = F.col("a.y1") - F.col("a.y0"), F.col("b.y0") - F.col("a.y1")
    aside = F.abs((F.col("b.x0") + F.col("b.x1")) / 2 - (F.col("a.x0") + F.col("a.x1")) / 2)
    on = gap.between(-0.2 * h, 3.5 * h) & (aside <= F.greatest(F.col("a.x1") - F.col("a.x0"), 3 * h)) & (F.col("b.confidence") >= floor) & F.col("b.value").isNotNull()
    for k in keys:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    far = F.greatest(F.lit(0.0), gap) + 0.25 * aside
    w = Window.partitionBy(*[f"a.{k}" for k in keys], "a.seq").orderBy(far, F.col("b.seq"))
    return labels.alias("a").join(words.alias("b"), on).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def match_anchors(segments: DataFrame, anchors: DataFrame) -> DataFrame:
    """Segments joined to the anchor patterns of their source that they match; anchors are a small fixed table."""
    hit = F.expr("s.text rlike concat('(?iu)', a.pattern)") & ~F.coalesce(F.expr("s.text rlike concat('(?iu)', a.excluded)"), F.lit(False))
    return segments.alias("s").join(F.broadcast(anchors).alias("a"), (F.col("s.source") == F.col("a.source")) & hit).select("s.*", "a.anchor", F.col("a.x").alias("point_x"), F.col("a.y").alias("point_y"))


def gap_segments(words: DataFrame, keys: list[str], start: str, stop: str, gap: Column) -> DataFrame:
    """Number the groups of neighbouring words: a new one begins where the gap before a word is larger than `gap`."""
    w = Window.partitionBy(*keys).orderBy(start, "seq")
    new = F.coalesce((F.col(start) - F.lag(stop).over(w) > gap).cast("int"), F.lit(0))
    return words.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def tolerant_bands(rows: DataFrame, keys: list[str], y: str, gap: int = 2) -> DataFrame:
    """Islands of rows with up to `gap` rows missing between neighbours: keys, band, top, bottom, n."""
    w = Window.partitionBy(*keys).orderBy(y)
    new = F.coalesce((F.col(y) - F.lag(y).over(w) > gap + 1).cast("int"), F.lit(0))
    marked = rows.withColumn("_new", new).withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "band").agg(F.min(y).alias("top"), F.max(y).alias("bottom"), F.count(F.lit(1)).alias("n"))


def band_triples(bands: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last three bands in a row that stand like three printed lines."""
    w = Window.partitionBy(*keys).orderBy(order)
    cols = {f"{c}{i}": F.lag(c, i).over(w) for c in ("top", "bottom", "left", "right") for i in (1, 2)}
    b = bands.withColumns(cols)
    hs = [F.col("bottom") - F.col("top"), F.col("bottom1") - F.col("top1"), F.col("bottom2") - F.col("top2")]
    high, low = F.greatest(*hs), F.least(*hs)
    p1, p2 = F.col("top") - F.col("top1"), F.col("top1") - F.col("top2")
    sideways = F.least(overlap(F.col("left"), F.col("right"), F.col("left1"), F.col("right1")), overlap(F.col("left1"), F.col("right1"), F.col("left2"), F.col("right2")))
    ok = (F.try_divide(high - low, high) <= 0.4) & (F.try_divide(F.abs(p1 - p2), F.greatest(p1, p2)) <= 0.3) & (sideways >= 0.7)
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return b.where(ok).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def place(fits: DataFrame, zones: list[tuple]) -> DataFrame:
    """Template boxes (field, part, line, x0, y0, x1, y1) carried onto each image by its fit (sx, tx, sy, ty).

    They are clamped to (width, height); those not over 20 wide and 10 high are dropped.
    """
    low = lambda v, s, t: F.greatest(F.lit(0.0), F.lit(float(v)) * F.col(s) + F.col(t))
    high = lambda v, s, t, most: F.least(F.col(most).cast("double"), F.lit(float(v)) * F.col(s) + F.col(t))
    boxes = F.array(*[
        F.struct(
            F.lit(f).alias("field"), F.lit(p).alias("part"), F.lit(n).cast("int").alias("line"), low(x0, "sx", "tx").alias("x0"), low(y0, "sy", "ty").alias("y0"),
            high(x1, "sx", "tx", "width").alias("x1"), high(y1, "sy", "ty", "height").alias("y1"),
        )
        for f, p, n, x0, y0, x1, y1 in zones
    ])
    out = fits.withColumn("_z", F.explode(F.filter(boxes, lambda z: (z["x1"] - z["x0"] > 20) & (z["y1"] - z["y0"] > 10))))
    return out.select("*", "_z.*").drop("_z")
