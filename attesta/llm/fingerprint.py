"""Document fingerprints: weighted SimHash of 256 bits and permuted block tables.

Terms are words and runs of two and three words. A term's weight is that of
its number of words and grows with the log of its count; each bit of its hash
adds the weight to one of 256 signed votes. Fingerprints within a Hamming radius are
found through tables that each put another block of bits first: of radius + 1
blocks, one is equal in any two such fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import salted_join

BITS = 256
#: Weights of single words, of pairs and of triples of words.
RUN_WEIGHTS = (0.5, 1.0, 1.0)
#: Radius of the search and bits of a block.
RADIUS, BLOCK_BITS = 7, 32
#: Bytes of texts that a batch unpacked after the shuffle holds.
UNPACKED_BYTES = 4 << 20
#: Weights are whole multiples of 1 / WEIGHT_UNIT, so votes do not depend on the order of terms.
WEIGHT_UNIT = 1024
UNITS = tuple(round(WEIGHT_UNIT * run) for run in RUN_WEIGHTS)
#: Weights and the runs that have them.
KINDS = [(unit, [r for r, u in enumerate(UNITS) if u == unit]) for unit in sorted(set(UNITS))]
#: Terms whose bits are added side by side, and of a block, whose sums fit bytes.
ACROSS = 8
BLOCK = 255 * ACROSS
#: Characters of the documents that are fingerprinted together; a longer one is taken alone.
TOGETHER = 200_000
#: Constants of the 64-bit mixing steps.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


class WordHashes:
    """64-bit hashes of words. None is kept: a hash costs less than its place in a table of many words."""

    def __call__(self, words: Iterable[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(7))), ">u8").astype(np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    return h ^ (h >> np.uint64(29))


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _runs(one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of one, two and three words that begin at each word."""
    two = _mix(one[:-1] * MIX[0] + one[1:])
    return one, two, _mix(two[:-1] * MIX[2] + one[2:])


def _hashes(terms: np.ndarray) -> np.ndarray:
    """The terms' hashes, by quarter and term."""
    h = MIX[:, None] * terms
    h += MIX[3]
    h ^= h >> np.uint64(31)
    h *= MIX[1]
    h ^= h >> np.uint64(29)
    return h


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1)).reshape(4, -1, BITS // 4)


def _sums(pieces: list[np.ndarray]) -> np.ndarray:
    """For each piece, how many of its terms have each bit. Pieces are hashed together, up to BLOCK terms at a time."""
    sums = np.zeros((len(pieces), BITS), np.int64)
    parts, room = [], 0

    def add() -> None:
        terms, used = np.zeros(room, np.uint64), np.zeros(room, bool)
        for _, start, x in parts:
            terms[start : start + len(x)] = x
            used[start : start + len(x)] = True
        hashes = _hashes(terms)
        hashes[:, np.flatnonzero(~used)] = 0
        # ACROSS terms side by side: at most 255 are added in a byte, in long rows
        rows = _bits(hashes).reshape(4, -1, ACROSS * BITS // 4)
        wide = np.empty((len(parts), 4, ACROSS * BITS // 4), np.uint8)
        for k, (_, start, x) in enumerate(parts):
            np.add.reduce(rows[:, start // ACROSS : (start + len(x) - 1) // ACROSS + 1], axis=1, dtype=np.uint8, out=wide[k])
        np.add.at(sums, [i for i, _, _ in parts], wide.reshape(-1, 4, ACROSS, BITS // 4).sum(axis=2, dtype=np.int64).reshape(-1, BITS))

    for i, piece in enumerate(pieces):
        for start in range(0, len(piece), BLOCK):
            x = piece[start : start + BLOCK]
            if room + len(x) > BLOCK and parts:
                add()
                parts, room = [], 0
            parts.append((i, room, x))
            room += -(-len(x) // ACROSS) * ACROSS
    if parts:
        add()
    return sums


def _weighted(terms: np.ndarray, weights: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The votes of each of n texts' terms that have weights of their own; whole numbers below 2**53, exact in any order."""
    votes = np.zeros((n, 4, BITS // 4))
    order = np.argsort(of, kind="stable")
    terms, weights, of = terms[order], weights[order], of[order]
    for start in range(0, len(terms), BLOCK):
        owners, w = of[start : start + BLOCK], weights[start : start + BLOCK]
        bits = _bits(_hashes(terms[start : start + BLOCK])).astype(np.float64)
        at = [0, *(np.flatnonzero(owners[1:] != owners[:-1]) + 1).tolist(), len(owners)]
        for i, j in zip(at, at[1:]):
            votes[owners[i]] += w[i:j] @ bits[:, i:j]
    return votes.reshape(n, BITS).astype(np.int64)


def _repeats(runs: tuple[np.ndarray, ...], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms that a text has more than once, with what their weight differs from that of as many single ones, and the text's number."""
    terms, weights, of = [], [], []
    bounds = [0, *ends.tolist()]
    for r, (run, unit) in enumerate(zip(RUN_WEIGHTS, UNITS)):
        ordered = runs[r].copy()
        for start, end in zip(bounds, bounds[1:]):
            ordered[start : max(end - r, start)].sort()
        same = ordered[1:] == ordered[:-1]
        for k in range(r + 1):  # pairs of two texts, or with a run over the end of one
            over = ends - 1 - k
            same[over[(over >= 0) & (over < len(same))]] = False
        again = np.flatnonzero(same)
        if len(again):
            heads = np.flatnonzero(np.concatenate(([True], again[1:] - again[:-1] != 1)))
            counts = np.append(heads[1:], len(again)) - heads + 1
            first = again[heads]
            terms.append(ordered[first])
            weights.append(np.rint(WEIGHT_UNIT * run * (1.0 + np.log(counts))) - unit * counts)
            of.append(np.searchsorted(ends, first, "right"))
    if not terms:
        return np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64)
    return np.concatenate(terms), np.concatenate(weights), np.concatenate(of)


class Doc:
    """A text, its words' hashes, its fingerprint and the votes of its first part, which its edited text begins with."""

    def __init__(self, text: str, where: int | None = None, raw: int | None = None):
        self.text, self.where, self.raw = text, where, raw
        self.half = len(text) // 2
        part = _lowered(text[: len(text) - self.half])
        words = part.split()
        #: What may go on with the next text, and the number of whole words before it.
        self.stem = [words.pop()] if words and not part[-1:].isspace() else []
        self.left = len(words)


class Seam:
    """Where a document's first part meets the next: whole words of each, and the words in between and at the end."""

    def __init__(self, first: Doc, second: Doc):
        part = _lowered(second.text[: first.half])
        words = part.split()
        joined = bool(first.stem and words and not part[:1].isspace())
        #: Words of the second text from skip to stop stay as they are.
        self.skip, self.stop = int(joined), max(len(words) - 1, int(joined))
        self.middle = [first.stem[0] + words[0]] if joined else first.stem
        self.end = words[self.stop :]


def fingerprint_all(docs: list[Doc], pairs: list[tuple[Doc, Doc]], known: WordHashes) -> list[bytes]:
    """Fingerprints of documents, kept in them, and of the edited texts of pairs.

    The second of a pair is one of docs, and of one pair only; the first is one of docs or of an earlier call.
    Each occurrence of a term votes as if it was the only one, so votes of a text's beginning serve for
    its edited text too; then the repeats within each text are put right.
    """
    seams = {second: Seam(first, second) for first, second in pairs}
    words = [_lowered(d.text).split() for d in docs] + [x for s in seams.values() for x in (s.middle, s.end)]
    hashed = known(chain.from_iterable(words))
    ends = np.cumsum([len(w) for w in words]).tolist()
    parts = [hashed[end - len(w) : end] for w, end in zip(words, ends)]
    for d, one in zip(docs, parts):
        d.one = one
    new = []
    for (first, second), middle, end in zip(pairs, parts[len(docs) :: 2], parts[len(docs) + 1 :: 2]):
        s = seams[second]
        new.append((first.one[: first.left], middle, second.one[s.skip : s.stop], end))
    one = np.concatenate([d.one for d in docs] + [x for parts in new for x in parts])
    sizes = [len(d.one) for d in docs] + [sum(map(len, parts)) for parts in new]
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    place = dict(zip(docs, starts))
    runs = _runs(one)
    # votes of the words before each document's cuts
    pieces, cuts = [], []
    for d, start, n in zip(docs, starts, sizes):
        stop = seams[d].stop if d in seams else 0
        own = sorted({d.left, stop, n} - {0})
        for before, cut in zip([0, *own], own):
            for _, alike in KINDS:
                pieces.append(np.concatenate([runs[r][start + max(before - r, 0) : start + max(cut - r, 0)] for r in alike]))
        cuts.append((own, stop))
    sums = np.tensordot(_sums(pieces).reshape(-1, len(KINDS), BITS), np.array([unit for unit, _ in KINDS]), (1, 0))
    votes = np.zeros((len(sizes), BITS), np.int64)
    at, seconds = 0, {}
    for i, (d, (own, stop)) in enumerate(zip(docs, cuts)):
        below = {0: votes[i]} | dict(zip(own, np.cumsum(sums[at : at + len(own)], axis=0)))
        at += len(own)
        d.first_votes, seconds[d], votes[i] = below[d.left].copy(), below[stop].copy(), below[sizes[i]]
    # runs with the second text's first word, where that is joined to another, and those over the seams
    terms, units, of = [], [], []
    for i, (first, second), parts in zip(range(len(docs), len(sizes)), pairs, new):
        s, start, end = seams[second], starts[i], starts[i] + sizes[i]
        votes[i] = first.first_votes + seconds[second]
        middle = start + first.left + len(parts[1])
        last = middle + s.stop - s.skip
        own = place[second]
        for r, (unit, run) in enumerate(zip(UNITS, runs)):
            over = ((own, own + min(s.skip, max(s.stop - r, 0)), -unit), (max(start + first.left - r, start), min(middle, end - r), unit), (max(last - r, middle), end - r, unit))
            for i0, i1, u in over:
                if i0 < i1:
                    terms.append(run[i0:i1])
                    units.append(u)
                    of.append(i)
    repeated, weights, whose = _repeats(runs, ends)
    lengths = [len(x) for x in terms]
    votes += _weighted(np.concatenate([*terms, repeated]), np.concatenate([np.repeat(units, lengths), weights]), np.concatenate([np.repeat(of, lengths), whose]).astype(np.int64), len(sizes))
    total = sum(unit * np.maximum(np.array(sizes) - r, 0) for r, unit in enumerate(UNITS)) + np.bincount(whose, weights, len(sizes)).astype(np.int64)
    found = [x.tobytes() for x in np.packbits(votes * 2 > total[:, None], axis=1)]
    for d, x in zip(docs, found):
        d.fingerprint = x
    return found[len(docs) :]


def fingerprint(text: str, known: WordHashes) -> bytes:
    """32 bytes. Equal texts have equal fingerprints; a text without words has zero bits only."""
    doc = Doc(text)
    fingerprint_all([doc], [], known)
    return doc.fingerprint


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1.0 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, other: str) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of the other, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


# --- each document and the next in order ---------------------------------------------------------------------------


def _count_below(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are below value, by a two-level search."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[-1]).cast("long") for g in groups])
    before = F.size(F.filter(heads, lambda b: b < value))
    rows = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    inside = F.size(F.filter(F.try_element_at(rows, before + 1), lambda b: b < value))
    return F.when(before >= len(groups), F.lit(len(bounds))).otherwise(before * step + inside).cast("int")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(raw, t) as (raw, size, z): the text's bytes compressed and their number."""
    codec = pa.Codec("zstd")
    for b in batches:
        bytes_of = [x.as_buffer() for x in b.column(1)]
        sizes = pa.array([x.size for x in bytes_of], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array([codec.compress(x, asbytes=True) for x in bytes_of], pa.binary())], ["raw", "size", "z"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, guest, id, raw, size, z) with the text in place of size and z, at most UNPACKED_BYTES or one text at a time."""
    codec = pa.Codec("zstd")
    for b in batches:
        ends = np.cumsum(b.column(4).to_numpy())
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + UNPACKED_BYTES, "right")))
            part = b.slice(start, stop - start)
            texts = [codec.decompress(z.as_buffer(), n, asbytes=True) for n, z in zip(part.column(4).to_pylist(), part.column(5))]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(texts, pa.binary()).view(pa.string())], ["range", "guest", "id", "raw", "t"])
            start = stop


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id (ties by text; a null
    id is the smallest); after the last comes the first, and a document alone
    is its own next. Rows are dealt to ranges of ids; the top document of a
    range is also sent to the range above, where it is needed as a next one, so
    texts are shuffled once, compressed one by one with zstd (Spark's lz4 leaves
    about half as much again), and sorted as they are. The driver holds one bound and one id per range.
    A null text counts as empty; an empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    known_id = F.coalesce(F.col("raw"), F.lit(least)).alias("id")
    rows = docs.select(F.col(id_col).cast("long").alias("raw"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(known_id)
    cuts = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges).alias("b")).first()["b"] or []
    bounds = sorted(set(cuts))
    spot = _count_below(bounds, F.col("id"))
    tops = {r["b"]: r["top"] for r in ids.groupBy(spot.alias("b")).agg(F.max("id").alias("top")).collect()}
    used = sorted(tops)
    up = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    n = len(bounds) + 1
    top = F.element_at(F.array(*[F.lit(tops.get(b)).cast("long") for b in range(n)]), F.col("b") + 1)
    above = F.element_at(F.array(*[F.lit(up.get(b, 0)).cast("int") for b in range(n)]), F.col("b") + 1)
    own = F.struct(F.col("b").alias("range"), F.lit(False).alias("guest"))
    guest = F.when(F.col("id") == top, F.struct(above.alias("range"), F.lit(True).alias("guest")))
    packed = rows.mapInArrow(_packed, "raw long, size long, z binary").select(known_id, "raw", "size", "z")
    dealt = packed.withColumn("b", spot).withColumn("s", F.explode(F.array_compact(F.array(own, guest)))).select("s.range", "s.guest", "id", "raw", "size", "z")
    dealt = dealt.repartitionById(ranges, F.col("range")).mapInArrow(_unpacked, "range int, guest boolean, id long, raw long, t string").sortWithinPartitions("range", "guest", F.col("id").desc(), "t")
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        last = None  # the document that waits for the next
        for b in batches:
            out: list[tuple] = []
            docs: list[Doc] = []
            pairs: list[tuple[Doc, Doc]] = []

            def add() -> None:
                for (first, second), new in zip(pairs, fingerprint_all(docs, pairs, known)):
                    its, sha = first.fingerprint, hashlib.sha256(edited(first.text, second.text).encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((first.raw, len(first.text), sha, its.hex(), new.hex(), likeness(its, new), likeness(its, second.fingerprint)))
                docs.clear()
                pairs.clear()

            held = 0
            for where, is_guest, raw, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                if is_guest and (last is None or last.where != where):
                    continue  # a further row with the guest's id
                doc = Doc(text.as_py(), where, raw)
                if docs and held + len(doc.text) > TOGETHER:
                    add()
                    held = 0
                docs.append(doc)
                held += len(doc.text)
                if last is not None:
                    pairs.append((last, doc))
                last = None if is_guest else doc
            if docs:
                add()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return dealt.mapInArrow(work, schema).withColumnRenamed("id", id_col)


# --- search --------------------------------------------------------------------------------------------------------


def differing_bits(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints in hexadecimal, 64 bits at a time."""
    out = F.lit(0)
    for i in range(0, BITS // 4, 8):
        word = [F.conv(F.substring(x, i + 1, 8), 16, 10).cast("long") for x in (a, b)]
        out = out + F.bit_count(word[0].bitwiseXOR(word[1]))
    return out


def permuted_tables(fps: DataFrame, fp_col: str = "fingerprint") -> DataFrame:
    """A row for each table and fingerprint: the fingerprint in bytes and, as one number, the table and the block that it puts first."""
    digits = BLOCK_BITS // 4
    keys = F.array(*[F.conv(F.substring(F.col(fp_col), 1 + i * digits, digits), 16, 10).cast("long") + (i << BLOCK_BITS) for i in range(BITS // BLOCK_BITS)])
    return fps.select(F.explode(keys).alias("block"), F.unhex(fp_col).alias(fp_col))


def find_near(queries: DataFrame, index: DataFrame, radius: int = RADIUS, fp_col: str = "fingerprint") -> DataFrame:
    """(query, match, bits): all different fingerprints of index within radius of the different ones of queries, lower-case hexadecimal.

    A pair that agrees on several blocks is found in its first such table only.
    The radius must be below the number of blocks for the search to be exact.
    The tables meet by a shuffle at any size: with its salts a query takes 64
    rows, which Spark's estimate for a broadcast does not see.
    """
    if radius >= BITS // BLOCK_BITS:
        raise ValueError("the tables find fingerprints of a smaller radius than their number only")
    q = permuted_tables(queries.select(F.col(fp_col).alias("query")).where(F.col("query").isNotNull()).distinct(), "query")
    m = permuted_tables(index.select(F.col(fp_col).alias("match")).where(F.col("match").isNotNull()).distinct(), "match")
    pairs = salted_join(m, q.hint("merge"), ["block"], F.col("match"))
    width = BLOCK_BITS // 8
    first = F.lit(0)
    for i in reversed(range(BITS // BLOCK_BITS)):
        same = F.substring("query", 1 + i * width, width) == F.substring("match", 1 + i * width, width)
        first = F.when(same, F.lit(i)).otherwise(first)
    told = pairs.where(F.shiftright("block", BLOCK_BITS) == first).select(F.lower(F.hex("query")).alias("query"), F.lower(F.hex("match")).alias("match"))
    return told.select("query", "match", differing_bits(F.col("query"), F.col("match")).alias("bits")).where(F.col("bits") <= radius)
