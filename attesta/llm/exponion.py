"""Centroid clustering by exponion search, in exact integers.

Vectors stay in Spark; a task holds one Arrow batch. The centroids, k rows, are
sent to the tasks with the code. Each vector carries its centroid, a bound from
above on the distance to it and one from below on the distance to any other;
after a round the bounds are moved by how far the centroids went. A vector is
searched only if its bounds cannot tell that its centroid is the nearest, and
then only among the centroids inside the ball around its own centroid of radius
2 * upper + (distance from there to the next centroid), read from the front of
that centroid's list of the others by distance. The ball is closed, so equally
near centroids are in it and the smaller number wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import discard, materialize

#: Relative room that bounds in floating point leave for their rounding.
SLACK = 1e-9
#: Components up to here have squared distances that fit 64 bits up to 1,024 of them; larger ones are computed as Python integers.
SAFE = 1 << 26


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to the one centroid c, exactly."""
    d = x - c
    return (d * d).sum(axis=1)


class Centroids:
    """k centroids with what a search needs: distances between them, and each one's others by distance."""

    def __init__(self, rows: list[list[int]], moved: list[float] | None = None):
        # numbers beyond 64-bit squares need Python integers
        big = any(abs(v) > SAFE for r in rows for v in r)
        self.rows = np.array(rows, dtype=object if big else np.int64).reshape(len(rows), -1)
        k = len(rows)
        between = np.array([[float(v) ** 0.5 for v in squared(self.rows, self.rows[a])] for a in range(k)]).reshape(k, k)
        self.order = np.argsort(between, axis=1, kind="stable")
        # a centroid is first in its own list, even where another is equal to it
        for a in range(k):
            self.order[a] = [a, *[j for j in self.order[a] if j != a]]
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        self.nearest = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        self.moved = np.array(moved if moved is not None else [0.0] * k)

    def exact(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and centroids in a type that holds their squared distances."""
        if self.rows.dtype == object or x.dtype == object or (x.size and np.abs(x).max() > SAFE):
            return x.astype(object), self.rows.astype(object)
        return x, self.rows


def search(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, cents: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row and new bounds; also how many distances were computed.

    at: each row's centroid of the round before, -1 for none, whose first
    centroid is then taken.
    """
    x, rows = cents.exact(x)
    fresh = at < 0
    at = np.where(fresh, 0, at)
    upper = np.where(fresh, np.inf, (upper + cents.moved[at]) * (1 + SLACK))
    lower = np.where(fresh, 0.0, (lower - cents.moved.max(initial=0.0)) * (1 - SLACK))
    # strict: an equally near centroid of a smaller number would win
    safe = np.maximum(cents.nearest[at] / 2 * (1 - SLACK), lower)
    open_ = np.flatnonzero(~(upper < safe))
    computed = len(open_)
    if not len(open_):
        return at, upper, lower, 0
    own = np.empty(len(open_), dtype=x.dtype)
    for a in np.unique(at[open_]):
        of = at[open_] == a
        own[of] = squared(x[open_[of]], rows[a])
    upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    wide = ~(upper[open_] < safe[open_])  # the exact distance may settle it
    open_, own = open_[wide], own[wide]
    held = at[open_]
    for a in np.unique(held):
        of = np.flatnonzero(held == a)
        mine = open_[of]
        radius = (2 * upper[mine] + cents.nearest[a]) * (1 + SLACK)
        inside = np.searchsorted(cents.sorted[a], radius, side="right")
        best, best_at = own[of].copy(), np.full(len(mine), a)
        second = np.full(len(mine), np.inf, dtype=np.float64)
        for r in range(1, inside.max(initial=1)):
            some = np.flatnonzero(inside > r)
            j = cents.order[a, r]
            d = squared(x[mine[some]], rows[j])
            computed += len(some)
            wins = (d < best[some]) | ((d == best[some]) & (j < best_at[some]))
            loser = np.where(wins, best[some], d).astype(np.float64)
            second[some] = np.minimum(second[some], loser)
            best_at[some] = np.where(wins, j, best_at[some])
            best[some] = np.where(wins, d, best[some])
        at[mine] = best_at
        upper[mine] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        lower[mine] = np.sqrt(second) * (1 - SLACK)
    return at, upper, lower, computed


STATE = "id long, x array<bigint>, at int, upper double, lower double"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def assigned(state: DataFrame, cents: Centroids) -> DataFrame:
    """The state after one search of all vectors."""
    width = cents.rows.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, upper, lower, _ = search(_matrix(b.column("x"), width), b.column("at").to_numpy(), b.column("upper").to_numpy(), b.column("lower").to_numpy(), cents)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(at.astype(np.int32)), pa.array(upper), pa.array(lower)], ["id", "x", "at", "upper", "lower"])

    return state.mapInArrow(work, STATE)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, x): vectors of exactly dims components, none null or not finite, as integers floor(scale * component).

    A scaled component that no 64-bit integer holds takes the nearest one.
    """
    v = F.col(f"`{vector_col}`")
    whole = (F.size(v) == dims) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    top = float(1 << 62)  # far beyond it conversion would fail
    number = lambda e: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), F.lit(float(scale)) * e.cast("double")))).cast("long")
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, number).alias("x"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors of the k smallest hashes of `salt:id`; k rows come to the driver."""
    named = rows.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "x")
    return [list(r["x"]) for r in named.orderBy("h", "x").limit(k).collect()]


def _means(state: DataFrame, cents: Centroids) -> tuple[list[list[int]], list[float]]:
    """Each centroid's floor(sum / count) over its vectors, empty ones as they were, and how far each went.

    Sums are made for each batch in its task, as rows (centroid, component),
    and then added exactly; k * dims rows come to the driver.
    """
    k, width = cents.rows.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), dtype=object), np.zeros(k, dtype=np.int64)
        for b in batches:
            x, at = _matrix(b.column("x"), width), b.column("at").to_numpy()
            x = x if not x.size or np.abs(x).max() < 1 << 40 else x.astype(object)  # so a batch's sum fits
            for a in np.unique(at):
                total[a] += x[at == a].sum(axis=0).astype(object)
                n[a] += (at == a).sum()
        some = np.flatnonzero(n)
        flat = [str(v) for a in some for v in total[a]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(some))), pa.array(np.repeat(n[some], width)), pa.array(flat, pa.string())],
            ["a", "i", "n", "total"],
        )

    parts = state.mapInArrow(sums, "a int, i int, n long, total string")
    rows = parts.groupBy("a", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    new = [[int(v) for v in row] for row in cents.rows]
    for r in rows:
        new[r["a"]][r["i"]] = int(r["total"]) // r["n"]
    went = [float(sum((int(p) - q) ** 2 for p, q in zip(old, now))) ** 0.5 * (1 + SLACK) for old, now in zip(cents.rows, new)]
    return new, went


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1") -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of another length, or with a null, NaN or infinite component, are
    left out; so are null vectors. Centroids start as the vectors of the k
    smallest hashes, all vectors if there are fewer. Each round assigns every
    vector to the nearest centroid, of equally near ones to that of the smaller
    number, and moves each centroid that has vectors to their componentwise
    floor(sum / count). A last assignment follows. Repeated rows count as often
    as they occur, a null id is hashed as empty text. Distances and their sums
    that no 64-bit integer holds are given as the largest one. A table without
    kept vectors gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, path = materialize(kept_vectors(vectors, id_col, vector_col, dims, scale).select("id", "x", F.lit(-1).alias("at"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")), "vectors")
    start = first_centroids(rows, k, salt)
    if not start:
        empty = rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
        return empty.where(F.lit(False))
    cents = Centroids(start)
    for _ in range(rounds):
        state, new = materialize(assigned(rows, cents), "clusters")
        centroids, went = _means(state, cents)
        cents = Centroids(centroids, went)
        discard(spark, path)
        rows, path = state, new
    return _reported(assigned(rows, cents), cents, id_col)


def _reported(state: DataFrame, cents: Centroids, id_col: str) -> DataFrame:
    """The output rows: distances exactly, and their sums by cluster, k rows, joined back."""
    width, most = cents.rows.shape[1], (1 << 63) - 1

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = cents.exact(_matrix(b.column("x"), width))
            at = b.column("at").to_numpy()
            d = x - rows[at]
            far = (d * d).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), pa.array([min(int(v), most) for v in far], pa.int64())], ["id", "cluster", "distance"])

    spark = state.sparkSession
    rows, _ = materialize(state.mapInArrow(measure, "id long, cluster int, distance long"), "distances")
    held = F.least(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(most).cast("decimal(38,0)"))
    sums = rows.groupBy("cluster").agg(held.cast("long").alias("cluster_inertia"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("_sum"))
    total = F.least(F.sum("_sum").over(Window.partitionBy(F.lit(0))), F.lit(most).cast("decimal(38,0)")).cast("long")  # over k rows
    names = [(a, hashlib.sha256(",".join(str(int(v)) for v in c).encode("ascii")).hexdigest()) for a, c in enumerate(cents.rows)]
    digests = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    by_cluster = sums.select("cluster", "cluster_inertia", total.alias("inertia")).join(F.broadcast(digests), "cluster")
    out = rows.join(F.broadcast(by_cluster), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
