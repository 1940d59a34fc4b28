"""Connected regions of marked cells, from runs of cells in rows: runs are nodes, runs that touch in neighbouring rows are edges.

An image is rows of a DataFrame, so one of any size is many tasks, and a region
may span them all. Labels spread by joins; each round is written in the shared
folder, so its lineage is one step long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.sources.tables import written


def row_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x0, x1, run): cells (keys, y, x) that follow one another in a row. Repeated cells count once; run is unique in an image."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    begins = F.coalesce((F.col("x") - F.lag("x").over(w) > 1).cast("int"), F.lit(1))
    marked = cells.select(*keys, "y", "x", begins.alias("_b")).withColumn("_n", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, "y", "_n").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_n")
    return runs.withColumn("run", F.shiftleft(F.col("y").cast("long"), 32) + F.col("x0"))


def touching(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, u, v): runs of neighbouring rows that have a column in common."""
    a, b = runs.alias("a"), runs.withColumn("y", F.col("y") - 1).alias("b")
    on = (F.col("a.y") == F.col("b.y")) & (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1"))
    for k in keys:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    return a.join(b, on).select(*[f"a.{k}" for k in keys], F.col("a.run").alias("u"), F.col("b.run").alias("v"))


def _spread(labels: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """One round: each run, and the run that it is labelled by, takes the least label across an edge; then labels are followed one step."""
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    here, there = labels.select(*keys, F.col("run").alias("u"), F.col("label").alias("_u")), labels.select(*keys, F.col("run").alias("v"), F.col("label").alias("_v"))
    across = both.join(here, [*keys, "u"]).join(there, [*keys, "v"]).where("_v < _u")
    offers = across.select(*keys, F.inline(F.array(F.struct(F.col("u").alias("run"), F.col("_v").alias("label")), F.struct(F.col("_u").alias("run"), F.col("_v").alias("label")))))
    least = labels.unionByName(offers).groupBy(*keys, "run").agg(F.min("label").alias("label"))
    roots = least.select(*keys, F.col("run").alias("label"), F.col("label").alias("_root"))
    return least.join(roots, [*keys, "label"]).select(*keys, "run", F.least("label", "_root").alias("label"))


def labelled_runs(cells: DataFrame, keys: list[str], most_rounds: int = 60) -> DataFrame:
    """(keys, y, x0, x1, run, label): the runs of marked cells with the first run, from the top and then from the left, of their region.

    Cells are neighbours in their row and their column. The driver sees one
    count and one sum a round; rounds grow with the logarithm of a region's
    extent. No cells give no rows.
    """
    runs = written(row_runs(cells, keys), "runs")
    edges = written(touching(runs, keys), "touching")
    labels, seen = runs.select(*keys, "run", F.col("run").alias("label")), None
    for _ in range(most_rounds):
        labels = written(_spread(labels, edges, keys), "labels")
        state = tuple(labels.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("decimal(38,0)"))).first())
        if state == seen:
            return runs.join(labels, [*keys, "run"])
        seen = state
    raise RuntimeError(f"regions did not settle in {most_rounds} rounds")


def regions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, cells, x0, y0, x1, y1): each region of marked cells (keys, y, x), its size and the box around it, edges included."""
    runs = labelled_runs(cells, keys)
    box = [F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1")]
    return runs.groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("cells"), *box)
