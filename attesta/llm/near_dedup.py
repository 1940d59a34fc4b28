"""SimHash near-duplicates: shard BK-trees searched within a Hamming radius.

Two ways to deal fingerprints to shards are used, since no tree of all
fingerprints fits one machine:

* `simhash_components` is exact. Of `blocks` bit blocks, any two fingerprints
  within the radius agree on at least blocks - radius; a shard is a choice of
  that many blocks and their bits, so every such pair meets in some shard.
* `near_groups` looks for texts of a given shingle similarity. There the
  radius is wide, so shards are keyed by bands of min-hashes, trees propose
  pairs and the texts' whole shingle sets confirm them.

A shard's fingerprints go to the task that builds its tree; shards over
`shard_cap` texts or PIECE_BYTES of sets are cut into pieces, and only what
is not connected to one lead text of the shard meets all pieces, so memory is
bounded and no pair is lost. Trees give forest edges, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.bktree import Forest
from attesta.llm.common import materialize, salted_join, slices
from attesta.llm.components import connected_components

#: Seed of the shingle hash.
SEED = 42
#: A tree never holds more than twice as many fingerprints.
SHARD_CAP = 65_536
#: 64-bit words of the bitmap that screens pairs of sets.
SCREEN_WORDS = 16
#: Bytes of shingle sets to a piece of a shard; a text with more is a piece that holds little else.
PIECE_BYTES = 64 << 20
#: Texts whose features are held at one time.
STEP = 500
#: Rows and bytes that a task gathers before it builds a forest.
FOREST_ROWS, FOREST_BYTES = 200_000, 64 << 20


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; one of the whole sequence if it is shorter."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    if len(ws) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), SEED)], dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(s), SEED) for s in zip(*[ws[i:] for i in range(words)])), np.uint64, len(ws) - words + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes: zero."""
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[start : start + 4096])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long) for every row: the unweighted SimHash of the whole text's word shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(simhash(shingle_hashes(t.as_py(), words))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(work, "id long, fp long")


def _block_keys(fp: F.Column, radius: int, blocks: int) -> F.Column:
    """array<struct<t int, key long>>: the shards of a fingerprint."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(blocks)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key, used = F.lit(0).cast("long"), 0
        for i in chosen:
            key = key.bitwiseOR(F.shiftleft(part[i], used))
            used += cuts[i + 1] - cuts[i]
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    return F.array(*keys)


def block_count(n: int, radius: int, per_shard: int = 64, most: int = 4) -> int:
    """Least number of blocks at which an even spread leaves about per_shard fingerprints in a shard."""
    for extra in range(1, most):
        blocks = radius + extra
        if n / 2 ** (64 * extra / blocks) <= per_shard:
            return blocks
    return radius + most


def _forests(units: DataFrame, radius: int, columns: list[str], verifier: Callable[[pa.Table], tuple] | None = None, members: bool = False) -> DataFrame:
    """Edges (u, v) of a spanning forest of the links found in each unit (t, key, i, j) of rows.

    With `members`, where the row marked `lead` stands first in its unit, each
    other row instead: (t, key, i, id, bytes, v, near), v the row that its set
    in the unit is named by, near whether the lead is in that set.
    """
    schema = "t int, key long, i int, id long, bytes long, v long, near boolean" if members else "u long, v long"

    def edges(table: pa.Table) -> pa.RecordBatch:
        code = [table.column(c).to_numpy() for c in ("t", "key", "i", "j")]
        new = np.zeros(len(table), dtype=bool)
        for c in code:
            new[1:] |= c[1:] != c[:-1]
        unit, ids = np.cumsum(new), table.column("id").to_numpy()
        forest = Forest(table.column("fp").to_numpy().view(np.uint64), unit, radius, *(verifier(table) if verifier else ()))
        of = forest.components()
        if members:
            first = np.r_[0, np.flatnonzero(new)][unit]
            rest = np.flatnonzero(~table.column("lead").to_numpy(zero_copy_only=False))
            kept = table.select(["t", "key", "i", "id", "bytes"]).take(pa.array(rest)).combine_chunks()
            out = [c.combine_chunks() for c in kept.columns] + [pa.array(ids[of[rest]]), pa.array((of == first)[rest])]
            return pa.RecordBatch.from_arrays(out, ["t", "key", "i", "id", "bytes", "v", "near"])
        far = np.flatnonzero((of != np.arange(len(of))) & (ids[of] != ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[of[far]])], ["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = held_bytes = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            held_bytes += b.nbytes
            if rows < FOREST_ROWS and held_bytes < FOREST_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = [table.column(c)[rows - 1].as_py() for c in ("t", "key", "i", "j")]
            same = np.ones(rows, dtype=bool)
            for c, v in zip(("t", "key", "i", "j"), last):
                same &= table.column(c).to_numpy() == v
            cut = int(np.argmax(same))  # sorted: the last unit starts here
            if cut:
                yield edges(table.slice(0, cut).combine_chunks())
            held, rows = table.slice(cut).combine_chunks().to_batches(), rows - cut
            held_bytes = sum(x.nbytes for x in held)
        if rows:
            yield edges(pa.Table.from_batches(held).combine_chunks())

    extra, order = (["bytes", "lead"], [F.col("lead").desc()]) if members else ([], [])
    dealt = units.select("t", "key", "i", "j", *columns, *extra).repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", *order, "id")
    return dealt.mapInArrow(work, schema)


def _links(
    shards: DataFrame, cap: int, radius: int, columns: list[str], fill: Callable[[DataFrame], DataFrame], verifier: Callable[[pa.Table], tuple] | None = None,
) -> DataFrame:
    """Edges (u, v) that connect what is linked within each shard of (t, key, id, bytes) rows.

    `fill` adds to rows with an id the columns that a tree needs. A shard of up
    to `cap` rows and PIECE_BYTES is one tree. A larger one is cut into pieces,
    and one row of it, the lead, joins every piece. Rows connected to the lead
    in their piece are connected with each other, so no pair of those has to
    be looked at again: only the others, in pieces of their own, meet all rows.
    A hot family of near copies thus costs about its size, and no link is lost.
    """
    pieces = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(cap), F.sum("bytes") / F.lit(PIECE_BYTES))).cast("int")
    sizes = shards.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), pieces().alias("pieces"), F.min(F.struct(F.xxhash64("id"), "id")).getField("id").alias("top"))
    many, _ = materialize(sizes.where("n > 1").drop("n"), "shards")
    cut = salted_join(shards, many, ["t", "key"], F.col("id"))
    zero = F.lit(0)
    links = _forests(fill(cut.where("pieces = 1").select("t", "key", zero.alias("i"), zero.alias("j"), "id")), radius, columns, verifier)
    hot = many.where("pieces > 1")
    if hot.isEmpty():
        return links
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("i")
    each = F.explode(F.sequence(zero, F.col("pieces") - 1)).alias("i")
    rows = cut.where("pieces > 1").select("t", "key", piece, "id", "bytes", F.lit(False).alias("lead"))
    leads = hot.select("t", "key", each, F.col("top").alias("id"), F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("lead"))
    seen, _ = materialize(_forests(fill(rows.unionByName(leads).withColumn("j", F.col("i"))), radius, columns, verifier, members=True), "members")
    rest = seen.where("not near").groupBy("t", "key").agg(pieces().alias("others")).join(hot.select("t", "key", "pieces"), ["t", "key"])
    other = F.pmod(F.xxhash64("id", F.lit(1)), F.col("others")).cast("int")
    upto = lambda n: F.sequence(zero, n - 1)
    # pieces of the others are 0 to others - 1, those of the lead's rows follow
    near_units = F.transform(upto(F.col("others")), lambda x: F.struct(x.alias("i"), (F.col("others") + F.col("i")).alias("j")))
    own_units = F.concat(
        F.transform(upto(F.col("others")), lambda x: F.struct(F.least(x, other).alias("i"), F.greatest(x, other).alias("j"))),
        F.transform(upto(F.col("pieces")), lambda x: F.struct(other.alias("i"), (F.col("others") + x).alias("j"))),
    )
    again = salted_join(seen, rest, ["t", "key"], F.col("id")).select("t", "key", "id", F.explode(F.when(F.col("near"), near_units).otherwise(own_units)).alias("unit"))
    met = _forests(fill(again.select("t", "key", "unit.i", "unit.j", "id")), radius, columns, verifier)
    return links.unionByName(seen.where("id <> v").select(F.col("id").alias("u"), "v")).unionByName(met)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, shard_cap: int = SHARD_CAP) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Fingerprints at `radius` or fewer differing bits are linked; component_id
    is the smallest id reachable over links. A null text counts as empty; a
    text without words has fingerprint zero and is linked like any other.
    Equal fingerprints are one node of the trees. Repeated ids are allowed:
    each row gets the component of its own fingerprint. An empty table gives
    no rows; other columns are ignored.
    """
    per_row, _ = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    nodes, _ = materialize(per_row.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    blocks = block_count(nodes.count(), radius)
    shards = nodes.select("fp", F.explode(_block_keys(F.col("fp"), radius, blocks)).alias("s")).select("s.t", "s.key", F.col("fp").alias("id"), F.lit(0).cast("long").alias("bytes"))
    links = _links(shards, shard_cap, radius, ["id", "fp"], lambda rows: rows.withColumn("fp", F.col("id")))
    # nodes are named by their fingerprint while links are followed, then by the least id
    parts = connected_components(links)
    named = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("id").alias("component_id"))
    of_fp = salted_join(named.select("fp", "part"), least, ["part"], F.col("fp")).select("fp", "component_id")
    out = salted_join(per_row, of_fp, ["fp"], F.col("id"))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- texts of a given shingle similarity ---------------------------------------------------------------------------


def _features(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, fp, keys array<long>, sketch binary) of every text that has words; the sketch is its whole sorted set of shingle hashes."""
    rng = np.random.default_rng(SEED)
    mult = (rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, STEP):
            out: list[list] = [[], [], [], []]
            for i, t in zip(b.column(0), b.column(1)):
                h = shingle_hashes(t.as_py(), words)
                if not len(h):
                    continue
                kinds = np.unique(h)
                least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
                for s in range(0, len(kinds), 2048):
                    mixed = kinds[s : s + 2048, None] * mult
                    mixed ^= mixed >> np.uint64(32)
                    mixed *= np.uint64(0x9E3779B97F4A7C15)
                    least = np.minimum(least, mixed.min(axis=0))
                out[0].append(i.as_py())
                out[1].append(_signed(simhash(kinds)))  # of the set, as the similarity is
                out[2].append([_signed(xxhash.xxh64_intdigest(x.tobytes(), k)) for k, x in enumerate(least.reshape(bands, rows))])
                out[3].append(kinds.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return picked.mapInArrow(work, "id long, fp long, keys array<long>, sketch binary")


def _similar(mapped: int, threshold: float) -> Callable[[pa.Table], tuple]:
    """Whether the Jaccard similarity of two texts' whole shingle sets is the threshold or more, decided exactly.

    With it goes a screen that no similar pair fails: by sizes, and where both
    sets have up to `mapped` hashes (beyond, bitmaps are too full to tell) by
    bitmaps of the parity of their hashes, which differ in no more bits than
    the sets in elements.
    """

    def of(table: pa.Table) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
        column = table.column("sketch").combine_chunks()
        sizes = np.zeros(len(column), dtype=np.int64)
        maps = np.zeros((len(column), SCREEN_WORDS), dtype=np.uint64)

        def kinds(k: int) -> np.ndarray:
            return np.frombuffer(column[k].as_buffer(), dtype=np.uint64)

        for k in range(len(column)):
            x = kinds(k)
            sizes[k] = len(x)
            if len(x) <= mapped:
                bits = np.bincount((x % np.uint64(SCREEN_WORDS * 64)).view(np.int64), minlength=SCREEN_WORDS * 64) & 1
                maps[k] = np.packbits(bits.astype(bool)).view(np.uint64)

        def screen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            # of a union of low / threshold at most, a share of 1 - threshold is not shared
            near = np.bitwise_count(maps[a] ^ maps[b]).sum(axis=1, dtype=np.int64) <= low * (1 / threshold - 1) + 1e-6
            return (low >= threshold * high - 1e-6) & (near | (high > mapped))

        def pair(a: int, b: int) -> bool:
            x, y = kinds(a), kinds(b)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            return len(both) > 0 and shared >= threshold * (len(both) - shared)

        return lambda a, b: np.fromiter((pair(int(x), int(y)) for x, y in zip(a, b)), bool, len(a)), screen

    return of


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8,
    radius: int | None = None, bands: int = 10, rows: int = 3, mapped: int = 1024, shard_cap: int = 32_768,
) -> DataFrame:
    """(node, component) of every text that is linked to another; component is the group's smallest id.

    Two texts are linked if the Jaccard similarity of their sets of `words`-word
    shingles is `threshold` or more. Candidates share a band of `rows` min-hashes
    and lie within `radius` differing bits of the SimHash of the sets, repeats left
    out (default: the mean at the threshold and five standard deviations); each is decided by the exact
    similarity of the whole sets, which travel with the shards' rows, for texts
    that share a band only. Texts without words are linked to nothing. With bands=10, rows=3 a
    pair at the threshold shares a band with probability 0.9992; the radius loses
    fewer than one in 10,000 of those with 20 or more shingles.
    """
    if radius is None:
        turn = math.acos(2 * threshold / (1 + threshold)) / math.pi
        radius = math.ceil(64 * turn + 5 * math.sqrt(64 * turn * (1 - turn)))
    feats, _ = materialize(_features(docs, id_col, text_col, words, bands, rows), "features")
    shards = feats.where("id IS NOT NULL").select("id", F.octet_length("sketch").cast("long").alias("bytes"), F.posexplode("keys").alias("t", "key"))
    fill = lambda units: salted_join(units, feats.select("id", "fp", "sketch"), ["id"], F.col("t"), 1)
    return connected_components(_links(shards, shard_cap, radius, ["id", "fp", "sketch"], fill, _similar(mapped, threshold)))


def drop_near(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows that stay: of each group of near copies the one with the smallest id, whole and unchanged.

    Rows without an id stay. Rows that share an id stay or go together.
    """
    parts = near_groups(docs, id_col, **options)
    gone = parts.where("node <> component").select(F.col("node").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
