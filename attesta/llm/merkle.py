"""A Merkle manifest of a data set: every row's authentication path, by fractal traversal of aligned blocks.

Rows are leaves; each source has a tree of its own, and the sources' roots
have one above them. Every ARITY consecutive nodes become their hash, the last
run of a level may be shorter, and a tree ends where one node remains.

No task sees a whole tree. A source's leaves are numbered by one range sort,
so that the ARITY ** HEIGHT leaves of an aligned block meet in one task however
large the source is; the blocks' roots are the leaves of the next tier, which
is handled alike until each source has one node. Then each block is traversed:
stacked subtrees hold the nodes that the paths of the current leaves need, and
each of them builds its successor by taking in one leaf a step, so a step costs
one leaf for each band of levels and memory is that of two subtrees for each
band. The upper path of the block's root is appended to every leaf's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import discard, materialize

#: Children of a node; levels of a block (ARITY ** HEIGHT leaves); levels of a stacked subtree.
ARITY, HEIGHT, BAND = 3, 8, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def node(parts: list[str]) -> str:
    """The hash of a run of nodes, which are hex digests."""
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values in order: `-` for null, else the UTF-8 byte count, `:` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*parts), 256)


class Subtree:
    """The nodes of a band of levels below one root, taken in from leaves one after the other.

    low is the band's lowest level; nodes below it are kept only until their
    run is full. nodes[i] lists those of level low + i from `first[i]` on.
    """

    def __init__(self, low: int, high: int, root: int, arity: int, counts: list[int]):
        self.low, self.high, self.arity, self.counts = low, high, arity, counts
        self.first = [root * arity ** (high - low - i) for i in range(high - low)]
        self.nodes: list[list[str]] = [[] for _ in range(high - low)]
        self.runs: list[list[str]] = [[] for _ in range(high)]
        self.done = [root * arity ** (high - l) for l in range(high)]  # nodes of each level that lie before or are taken in
        self.next = root * arity**high

    def take(self, leaf: str) -> None:
        """One leaf; a run that is full, or ends its level, becomes a node of the next level."""
        self.next += 1
        level, value = 0, leaf
        while level < self.high:
            if level >= self.low:
                self.nodes[level - self.low].append(value)
            run = self.runs[level]
            run.append(value)
            self.done[level] += 1
            if len(run) < self.arity and self.done[level] < self.counts[level]:
                return
            value, self.runs[level] = node(run), []
            level += 1

    def around(self, level: int, at: int) -> tuple[str, str]:
        """The other nodes of the run that node `at` of a level is in: those left and those right of it."""
        row, start = self.nodes[level - self.low], self.first[level - self.low]
        begin = at - at % self.arity
        end = min(begin + self.arity, self.counts[level])
        return "".join(row[begin - start : at - start]), "".join(row[at + 1 - start : end - start])


def level_counts(n: int, arity: int, height: int | None = None) -> list[int]:
    """Nodes of each level from the leaves up: to one node, or `height` levels above the leaves."""
    counts = [n]
    while counts[-1] > 1 if height is None else len(counts) <= height:
        counts.append(-(-counts[-1] // arity))
    return counts


def block_root(leaves: list[str], arity: int, height: int | None = None) -> str:
    """The root of a block, from one pass that keeps one open run a level."""
    counts = level_counts(len(leaves), arity, height)
    high = len(counts) - 1
    if not high:
        return leaves[0]
    top = Subtree(high - 1, high, 0, arity, counts)
    for leaf in leaves:
        top.take(leaf)
    return node(top.nodes[0])


def paths(leaves: list[str], arity: int = ARITY, height: int | None = None, band: int = BAND) -> Iterator[list[tuple[str, str]]]:
    """The authentication path of each leaf in turn: (left, right) siblings of each level, from the leaf up.

    For each band of levels there is the existing subtree that the current
    leaf lies in and the desired one after it. Each step the desired ones take
    in one leaf, so each is whole when the leaves of the existing one are over
    and takes its place.
    """
    counts = level_counts(len(leaves), arity, height)
    levels = len(counts) - 1
    bands = [(low, min(low + band, levels)) for low in range(0, levels, band)]
    exist, desired = [], []
    for low, high in bands:
        now = Subtree(low, high, 0, arity, counts)
        for leaf in leaves[: arity**high]:
            now.take(leaf)
        exist.append(now)
        desired.append(Subtree(low, high, 1, arity, counts))
    for t in range(len(leaves)):
        path, at = [], t
        for level in range(levels):
            path.append(exist[level // band].around(level, at))
            at //= arity
        yield path
        for i, (low, high) in enumerate(bands):
            if desired[i].next < len(leaves):
                desired[i].take(leaves[desired[i].next])
            if (t + 1) % arity**high == 0:
                exist[i] = desired[i]
                desired[i] = Subtree(low, high, (t + 1) // arity**high + 1, arity, counts)


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = node([left, leaf, right])
    return leaf


def _numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with their number `at` in their group and the group's size `of`; no group is gathered in one task.

    One range sort, counts for each (range, group), and running sums over
    those counts. The result is written; its folders are returned.
    """
    # equal rows are told apart by where they were read, so that many of them can be in several ranges
    sort = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_read")]
    ranged = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    ranged = ranged.drop("_read").withColumn("_part", F.spark_partition_id()).withColumn("_no", F.monotonically_increasing_id())
    kept, path = materialize(ranged, "leaves")
    # the number of a row within its range and group: its place in the range less that of the group's first row there
    parts = kept.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_no").alias("_from"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("of", F.sum("_n").over(Window.partitionBy(group)))
    # a range holds few groups, and a group few ranges: far fewer rows than leaves
    places, places_path = materialize(placed.select(F.col("_part").alias("p"), F.col(group).alias("g"), "_from", "_before", "of"), "places")
    joined = kept.join(places, (kept["_part"] == places["p"]) & (kept[group] == places["g"]))
    return joined.withColumn("at", F.col("_no") - F.col("_from") + F.col("_before")).drop("_part", "_no", "p", "g", "_from", "_before"), [path, places_path]


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / F.lit(ARITY**height)).cast("long"))


def _sorted(table: pa.Table, column: str) -> pa.Table:
    return table.take(pa.array(np.argsort(table.column(column).to_numpy(), kind="stable")))


def _levels(table: pa.Table, height: int) -> int | None:
    """Levels to climb in a block: all of them where it is the whole tree, else those of a full block."""
    return None if table.column("of")[0].as_py() <= ARITY**height else height


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, at, of, digest): the blocks' roots as the nodes of the next tier."""
    size = ARITY**height

    def climb(table: pa.Table) -> pa.Table:
        t = _sorted(table, "at")
        of = t.column("of")[0].as_py()
        root = block_root(t.column("digest").to_pylist(), ARITY, _levels(t, height))
        return pa.table([t.column("tree").slice(0, 1), t.column("block").slice(0, 1), pa.array([-(-of // size)], pa.int64()), pa.array([root])], names=["tree", "at", "of", "digest"])

    return _blocked(nodes, height).select("tree", "at", "of", "block", "digest").groupBy("tree", "block").applyInArrow(climb, "tree string, at long, of long, digest string")


def _tier_paths(nodes: DataFrame, above: DataFrame | None, height: int) -> DataFrame:
    """(tree, at, path, root) of nodes: their path in the block, then that of the block's root, if there is a tier above.

    above: (tree, at, path, root) of the block roots.
    """
    schema = f"tree string, at long, path {PATH}, root string"
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def climb(table: pa.Table, up: pa.Table | None) -> pa.Table:
        t = _sorted(table, "at")
        leaves = t.column("digest").to_pylist()
        upper = [(s["left"], s["right"]) for s in up.column("path")[0].as_py()] if up is not None else []
        own = list(paths(leaves, ARITY, _levels(t, height)))
        root = up.column("root")[0].as_py() if up is not None else fold(leaves[0], own[0])
        whole = [[{"left": a, "right": b} for a, b in p + upper] for p in own]
        return pa.table([t.column("tree"), t.column("at"), pa.array(whole, kind), pa.array([root] * len(t))], names=["tree", "at", "path", "root"])

    left = _blocked(nodes, height).select("tree", "at", "of", "block", "digest").groupBy("tree", "block")
    if above is None:
        return left.applyInArrow(lambda t: climb(t, None), schema)
    return left.cogroup(above.select("tree", F.col("at").alias("block"), "path", "root").groupBy("tree", "block")).applyInArrow(climb, schema)


def _upper(nodes: DataFrame, height: int, paths_: list[str]) -> DataFrame:
    """(tree, at, path, root) of the nodes of a tier, which the tiers above it are built for first."""
    above = None
    if nodes.where(F.col("of") > ARITY**height).limit(1).count():
        roots, path = materialize(_roots(nodes, height), "roots")
        paths_.append(path)
        above = _upper(roots, height, paths_)
    return _tier_paths(nodes, above, height)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    leaf: hash of the fields; subroot: the root of the source's tree, whose
    leaves ascend by id; root: that over the sources' roots in the order of
    their names as bytes, null first. proof_sha256: hash of the siblings on the
    way from the leaf to the root. folded_root: the root that these siblings
    and the leaf lead to; `tampered` is a digest, as leaf_digest gives it, of
    what a row holds now where that differs, and verified tells whether the
    root is met.

    Null fields have a mark of their own, null sources are one source, null ids
    come first. Rows of one id in one source are ordered by their digest, so
    equal rows have equal leaves and different places. An empty table gives no
    rows. Other columns are ignored.
    """
    column = lambda c: F.col(f"`{c}`")
    leaf = leaf_digest([column(f) for f in fields])
    # null sources and others never share a name: a mark stands before each; bytes order as UTF-8 does
    tree = F.coalesce(F.concat(F.lit("s"), column(source_col).cast("string")), F.lit("-"))
    rows = docs.select(column(id_col).alias("id"), tree.alias("tree"), leaf.alias("digest"), F.coalesce(tampered, leaf).alias("now") if tampered is not None else leaf.alias("now"))
    leaves, made = _numbered(rows, "tree", ["id", "digest", "now"])
    nodes, path = materialize(leaves, "nodes")
    discard(docs.sparkSession, *made)
    kept = [path]
    # the roots of the sources' trees: tiers of blocks until every tree has one node
    tier, tiers = nodes, []
    while True:
        roots, path = materialize(_roots(tier, height), "roots")
        kept.append(path)
        tiers.append(roots)
        if not roots.where("of > 1").limit(1).count():
            break
        tier = roots
    # the tree over them, then back down, a tier at a time
    tops = tiers[-1].select(F.col("tree").alias("name"), "digest")
    ranked, made = _numbered(tops.withColumn("whole", F.lit("")), "whole", ["name"])
    kept += made
    over = _upper(ranked.select(F.lit("").alias("tree"), "at", "of", "digest"), height, kept)
    above = ranked.join(over.select("at", "path", "root"), "at").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "path", "root", F.col("digest").alias("subroot"))
    for lower in reversed(tiers[:-1]):
        subroots = above.select("tree", "subroot").distinct()
        above = _tier_paths(lower, above, height).join(subroots, "tree")
    return _leaf_rows(nodes, above, height).withColumnRenamed("id", id_col)


def _leaf_rows(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """The rows of manifest(): each block is traversed once, and its root's upper path appended; paths stay in the task."""
    id_type = nodes.schema["id"].dataType.simpleString()
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def traverse(table: pa.Table, up: pa.Table) -> pa.Table:
        t = _sorted(table, "at")
        leaves, now = t.column("digest").to_pylist(), t.column("now").to_pylist()
        upper = [(s["left"], s["right"]) for s in up.column("path")[0].as_py()]
        appended = "".join(a + b for a, b in upper)
        root, subroot = up.column("root")[0].as_py(), up.column("subroot")[0].as_py()
        proofs, folded = [], []
        for leaf, path in zip(now, paths(leaves, ARITY, _levels(t, height))):
            proofs.append(hashlib.sha256(("".join(a + b for a, b in path) + appended).encode("ascii")).hexdigest())
            folded.append(fold(fold(leaf, path), upper))
        n = len(t)
        columns = [t.column("id"), t.column("digest"), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])]
        return pa.table(columns, names=names)

    left = _blocked(nodes, height).select("tree", "block", "at", "of", "id", "digest", "now").groupBy("tree", "block")
    right = above.select("tree", F.col("at").alias("block"), "path", "root", "subroot").groupBy("tree", "block")
    schema = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return left.cogroup(right).applyInArrow(traverse, schema)
