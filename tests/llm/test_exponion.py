"""Exponion search against plain assignment, and the query's contract on odd vectors."""

import hashlib

import numpy as np
import pytest

from attesta.llm import exponion


def plain(rows, k, rounds, salt="1"):
    """(centroids, cluster and distance of each row) by computing every distance in Python integers."""
    start = sorted(rows, key=lambda r: (hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(x) for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in rows]
        for j in range(len(cents)):
            mine = [x for (_, x), a in zip(rows, at) if a == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return cents, [nearest(x) for _, x in rows]


@pytest.mark.parametrize("seed", range(6))
def test_search_matches_all_distances(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-6, 6, (300, 3)) if seed % 2 else rng.integers(-60, 60, (400, 8))  # small ranges have many ties
    c = x[rng.choice(len(x), 12)].copy()
    at, upper, lower = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x))
    cents = exponion.Centroids(c.tolist())
    for _ in range(6):
        far = ((x[:, None] - c[None]) ** 2).sum(-1)
        at, upper, lower, computed = exponion.search(x, at, upper, lower, cents)
        assert (at == far.argmin(1)).all()
        assert computed <= far.size
        assert (upper >= np.sqrt(far.min(1)) - 1e-6).all()
        new = np.array([x[at == j].sum(0) // (at == j).sum() if (at == j).any() else c[j] for j in range(len(c))])
        cents, c = exponion.Centroids(new.tolist(), np.sqrt(((new - c) ** 2).sum(1)).tolist()), new


def test_separate_clusters_are_hardly_searched():
    rng = np.random.default_rng(1)
    centres = rng.integers(-10_000, 10_000, (16, 8))
    x = (centres[rng.integers(0, 16, 2000)] + rng.integers(-5, 6, (2000, 8))).astype(np.int64)
    cents = exponion.Centroids(centres.tolist())
    at, upper, lower, _ = exponion.search(x, np.full(2000, -1), np.zeros(2000), np.zeros(2000), cents)
    *_, computed = exponion.search(x, at, upper, lower, cents)
    assert computed <= 2000  # one distance at most to each, not sixteen


def test_clusters_match_plain_rounds(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.integers(-40, 40, 4) / 10]) for i in range(120)] + [(5, [1.0, 1.0, 1.0, 1.0])] * 3 + [(-8, [-0.01, 0.0, 0.0, 0.0])]
    odd = [(900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster string")
    got = exponion.clusters(df, k=5, rounds=3, dims=4, scale=64).collect()
    whole = [(i, [int(np.floor(64 * e)) for e in v]) for i, v in rows]
    cents, near = plain(whole, 5, 3)
    want = sorted((i, c, d) for (i, _), (d, c) in zip(whole, near))
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    inertia = {c: sum(d for _, a, d in want if a == c) for c in range(5)}
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()


def test_clusters_few_huge_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert exponion.clusters(spark.createDataFrame([], schema), dims=2).collect() == []
    assert exponion.clusters(spark.createDataFrame([(1, None)], schema), dims=2).collect() == []
    two = exponion.clusters(spark.createDataFrame([(1, [0.0, 0.0]), (None, [9.0, 9.0])], schema), dims=2).collect()
    assert sorted(r["distance"] for r in two) == [0, 0] and {r["cluster"] for r in two} == {0, 1}
    huge = exponion.clusters(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e300, 0.0])], schema), k=1, rounds=2, dims=2).collect()
    assert len(huge) == 3 and all(r["distance"] == (1 << 63) - 1 for r in huge)  # the largest number stands for more
