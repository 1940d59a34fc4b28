"""Fractal traversal against a plainly built tree, bounded memory, and the manifest's contract on odd rows."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attesta.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_paths(leaves):
    """(root, path of each leaf) of a whole tree held in memory."""
    paths, level = [[] for _ in leaves], list(leaves)
    place = list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(place):
            run = at // 3 * 3
            paths[i].append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
            place[i] = at // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 82, 244, 300])
@pytest.mark.parametrize("band", [1, 2, 3])
def test_traversal_matches_the_whole_tree(n, band):
    leaves = [h(str(i)) for i in range(n)]
    root, want = plain_paths(leaves)
    got = list(merkle.paths(leaves, 3, None, band))
    assert got == want
    assert merkle.block_root(leaves, 3) == root
    assert all(merkle.fold(leaf, path) == root for leaf, path in zip(leaves, got))


def test_subtrees_hold_few_nodes(monkeypatch):
    kept = []

    class Watched(merkle.Subtree):
        def __init__(self, *args):
            super().__init__(*args)
            kept.append(self)

    monkeypatch.setattr(merkle, "Subtree", Watched)
    leaves = [h(str(i)) for i in range(3**6)]
    for _ in merkle.paths(leaves, 3, None, 2):
        assert sum(len(x) for s in kept[-6:] for x in s.nodes) <= 6 * 12  # two subtrees of 12 nodes for each of three bands
    assert all(len(r) <= 3 for s in kept for r in s.runs)


def encoded(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_manifest(rows, tampered):
    """Rows of the manifest by building every tree whole."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, inner = [], {}
    for s in names:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, encoded(*r), tampered(r)))
        root, paths = plain_paths([encoded(*r) for r in mine])
        subroots.append(root)
        inner[s] = (root, list(zip(mine, paths)))
    root, upper = plain_paths(subroots)
    out = []
    for s, up in zip(names, upper):
        subroot, leaves = inner[s]
        for r, path in leaves:
            whole = path + up
            folded = merkle.fold(tampered(r), whole)
            out.append((r[0], encoded(*r), subroot, root, h(*[a + b for a, b in whole]), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_matches_whole_trees(spark, height):
    rows = [(i * 7 % 101, "hot", "en", 3, f"a\nb{i}") for i in range(60)] + [(i, f"s{i % 5}", None, None, "x\n") for i in range(23)]
    rows += [(1, None, "de", 1, None), (None, None, None, None, None), (None, "", None, None, ""), (5, "", "é", 2, "\n"), (5, "", "é", 2, "\n"), (9, "-", "e", 1, "y" * 50_000), (2, "lone", "e", 1, "z")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS leaf", "2 AS at", "3 AS digest", "4 AS id", "5 AS tree")
    now = merkle.leaf_digest([F.regexp_replace("text", "\n", "") if f == "text" else F.col(f) for f in merkle.FIELDS])
    got = merkle.manifest(df, tampered=F.when(F.col("doc_id") % 2 == 0, now), height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def tampered(r):
        change = r[0] is not None and r[0] % 2 == 0 and r[4] is not None
        return encoded(*r[:4], r[4].replace("\n", "") if change else r[4])

    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows, tampered)


def test_manifest_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(empty).collect() == []
