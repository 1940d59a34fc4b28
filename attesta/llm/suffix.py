"""Exact substring deduplication with suffix arrays.

A string of SPAN bytes is removed wherever it also starts in a document of a
smaller id. Texts are bytes; no match crosses documents.

1. Texts are gathered into slices, written once, about SLICE_BYTES each.
2. Every window of SPAN bytes has an anchor: the GRAM-byte string in it with the
   least hash, the leftmost of equal ones. It depends on the window alone, so
   equal windows have equal anchors. Each slice sends its different anchors,
   once each however often they occur, to buckets; anchors that only one
   document has are out, and with them all windows that cannot repeat.
3. The windows of a shared anchor that start one after the other make a short
   segment. Segments go to the shard of their anchor, equal ones of a slice
   once with their places. Each shard has a suffix array of its segments:
   Larsson-Sadakane refinement from 8 to 64 bytes, and Kasai's common prefixes;
   neighbours that share SPAN bytes are one string, and the least id of each
   is known.
4. A bucket too large for one shard is cut into several. Their sorted strings
   are merged by binary search, in parts chosen by a hash of the string, and
   the least ids go back to the shards.
5. Places to remove go back to their slice, where overlaps count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import discard, materialize

#: Bytes of a string that is removed, and of the strings that anchors are chosen from.
SPAN, GRAM = 50, 24
#: Bytes of text to a slice, of segments to a shard at most, and of text to a bucket of anchors.
SLICE_BYTES, SHARD_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20, 3 << 19
#: Bytes that a task hashes at once: small enough for a processor's cache.
BLOCK = 1 << 17
#: Bytes of a window's segment as they are reckoned before segments are cut.
SEGMENT = 64
#: A null id is larger than all others.
NULL_ID = (1 << 63) - 1
_U = np.uint64


def _power(base: int, n: int) -> np.uint64:
    return _U(pow(base, n, 1 << 64))


_BASE = 0x9E3779B97F4A7C15
_ODD = _U(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _ODD
    return h ^ (h >> _U(29))


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each position on, by doubling."""
    piece = _mixed((data.astype(_U) + _U(1)) * _U(0xA0761D6478BD642F))
    out, at, width = None, 0, 1
    left = size
    while True:
        if left & 1:
            tail = piece[at:]
            out = tail if out is None else out[: len(tail)] * _power(_BASE, width) + tail
            at += width
        left >>= 1
        if not left:
            return _mixed(out)
        piece = piece[:-width] * _power(_BASE, width) + piece[width:] if len(piece) > width else piece[:0]
        width *= 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def segments(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash) of each run of windows that have one anchor in common.

    data: texts one after the other; starts: where each begins, and the end.
    """
    found = []
    grams = SPAN - GRAM + 1
    for begin in range(0, len(data), BLOCK):
        part = data[begin : begin + BLOCK + SPAN - 1]
        if len(part) < SPAN:
            break
        h = gram_hashes(part)
        # the hash's upper bits and the place in the block: the least of them is the leftmost least hash
        key = (h & ~_U((1 << 18) - 1)) | np.arange(len(h), dtype=_U)
        place = (_least(key, grams) & _U((1 << 18) - 1)).astype(np.int64)
        new = np.r_[True, place[1:] != place[:-1]]
        # windows may not cross from one document into the next
        lo, hi = np.searchsorted(starts, [begin, begin + len(place) + SPAN], side="left")
        edges = starts[lo:hi] - begin
        allowed = np.ones(len(place), dtype=bool)
        for e in edges[edges > 0]:
            allowed[max(0, e - SPAN + 1) : e] = False
        inner = edges[(edges >= 0) & (edges < len(place))]
        new[inner] = True
        new[1:] |= allowed[1:] != allowed[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(place)])
        good = allowed[first]
        first, count = first[good], count[good]
        found.append((first + begin, count, h[place[first]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    return tuple(np.concatenate(c) for c in zip(*found))


def buckets_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of an anchor; hashes of anchors are small ones, so they are mixed anew."""
    return ((_mixed(h * _ODD) >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def key_of(h: np.ndarray) -> np.ndarray:
    """40 bits of an anchor's hash: what tells anchors of one bucket apart. Two of one key only mean a search more."""
    return _mixed(h * _U(0xE7037ED1A0B428DB)) >> _U(24)


def packed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def five_bytes(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_five(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel().astype(_U)


#: Bytes that a segment has at most, in whole 64-bit words.
WIDTH = 8 * -(-(2 * SPAN - GRAM) // 8)


def padded(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Segments as rows of 64-bit words, zeros behind their end."""
    grid, offsets, step = np.zeros((len(first), WIDTH), np.uint8), np.arange(WIDTH), 1 << 15
    for a in range(0, len(first), step):
        f, z = first[a : a + step, None], size[a : a + step, None]
        grid[a : a + step] = np.where(offsets < z, data[np.minimum(f + offsets, len(data) - 1)], 0)
    return grid.view(_U)


def row_hash(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = size.astype(_U)
    for c in range(words.shape[1]):
        h = _mixed(h * _power(_BASE, 1) + words[:, c])
    return h


def differ(h: np.ndarray, size: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each row but the first whether it differs from the one before it; bytes decide, not the hash."""
    out = (h[1:] != h[:-1]) | (size[1:] != size[:-1])
    same = np.flatnonzero(~out)
    out[same] = (words[same + 1] != words[same]).any(axis=1)
    return out


# ---- suffix arrays


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number that orders like them; past the end are zeros."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(_U)
    pair = (x[:-1] << _U(8)) | x[1:]
    four = (pair[:-2] << _U(16)) | pair[2:]
    return ((four[:-4] << _U(32)) | four[4:])[: len(data)]


def suffix_array(data: np.ndarray, depth: int = 64, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes, by Larsson-Sadakane refinement.

    Suffixes are sorted by 8 bytes; then, while groups of equal ones remain,
    only these are sorted further, by the group of the suffix as many bytes on
    as groups have in common, which doubles each round.
    """
    n = len(data)
    words = words_at(data) if words is None else words
    order = np.argsort(words, kind="stable")
    new = np.r_[True, words[order[1:]] != words[order[:-1]]][:n]
    group = np.empty(n, np.int64)
    group[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while h < depth:
        tied = np.flatnonzero(~new | np.r_[~new[1:], False])  # places in groups of two and more
        if not len(tied):
            break
        suffix = order[tied]
        # the end comes before everything, and sooner in the shorter one of two that end
        after = np.where(suffix + h < n, group[np.minimum(suffix + h, n - 1)], n - suffix - h - 1)
        key = (group[suffix].astype(_U) << _U(32)) | (after + depth).astype(_U)
        by = np.argsort(key, kind="stable")
        order[tied] = suffix[by]
        key = key[by]
        split = np.r_[True, key[1:] != key[:-1]]
        new[tied] |= split
        group[order[tied]] = np.maximum.accumulate(np.where(split, tied, 0))
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int = 64, words: np.ndarray | None = None, chain: int = 64) -> np.ndarray:
    """Bytes that each suffix of the array shares with the one before it, up to `depth`, by Kasai's rule.

    Going through the text, a suffix shares at least one byte less with its
    neighbour than the suffix before it did with its own. The array is in order
    by `depth` bytes only: where that many were shared, the rule holds only if
    both neighbours move on by one place, else the comparison starts anew. The
    text is cut into chains of `chain` places, which are followed side by side:
    step t compares the t-th place of every chain.
    """
    n = len(data)
    words = words_at(data) if words is None else words
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    heads = np.arange(0, n, chain)
    known, was = np.zeros(len(heads), np.int64), np.full(len(heads), -1, np.int64)
    for t in range(min(chain, n)):
        p = heads + t
        if p[-1] >= n:
            p = p[:-1]
        q, known, was = before[p], known[: len(p)], was[: len(p)]
        length = np.where((known < depth) | (q == was + 1), np.maximum(known - 1, 0), 0)
        length[q < 0] = 0
        live = np.flatnonzero(q >= 0)
        while len(live):
            room = n - np.maximum(p[live] + length[live], q[live] + length[live])
            live, room = live[room > 0], room[room > 0]
            x = words[p[live] + length[live]] ^ words[q[live] + length[live]]
            equal = np.minimum(np.where(x == 0, 8, _leading_bytes(x)), room)  # not into the zeros past the end
            length[live] += equal
            live = live[(equal == 8) & (length[live] < depth)]
        known, was = np.minimum(length, depth), q
        out[p] = known
    return out[order]


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the upper end of each number other than 0."""
    n = np.zeros(len(x), np.int64)
    for shift, step in ((32, 4), (16, 2), (8, 1)):
        small = x < _U(1) << _U(64 - shift)
        n[small] += step
        x = np.where(small, x << _U(shift), x)
    return n


class Shard:
    """Segments of a shard with their suffix array: the strings of SPAN bytes in them, in order, with the least id of each.

    sizes: bytes of each segment; least: the least id of its documents.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, least: np.ndarray):
        ends = np.cumsum(sizes)
        self.windows = sizes - SPAN + 1
        self.first = np.cumsum(self.windows) - self.windows  # number of each segment's first window
        self.of = np.repeat(np.arange(len(sizes)), self.windows)
        at = np.arange(len(self.of)) - self.first[self.of] + (ends - sizes)[self.of]
        number = np.full(len(data), -1, np.int64)
        number[at] = np.arange(len(at))
        words = words_at(data)
        order = suffix_array(data, 64, words)
        shared = common_prefixes(data, order, 64, words)
        string = np.cumsum(shared < SPAN) - 1
        window = number[order]
        real = window >= 0
        window, string = window[real], string[real]
        new = np.r_[True, string[1:] != string[:-1]][: len(string)]
        begin = np.flatnonzero(new)
        string = np.cumsum(new) - 1
        self.string = np.empty(len(at), np.int64)
        self.string[window] = string
        ids = least[self.of[window]]
        self.least = np.minimum.reduceat(ids, begin) if len(begin) else ids
        self.at = at[window[begin]]
        self.data = data

    def strings(self) -> np.ndarray:
        """The different strings in order, as fixed-width bytes."""
        return np.ascontiguousarray(self.data[self.at[:, None] + np.arange(SPAN)]).view(f"S{SPAN}").ravel()

    def removed(self, segment: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrence, first window, windows) of the runs of windows to remove, of occurrences (segment, id, place)."""
        n = self.windows[segment]
        total = np.cumsum(n)
        occurrence = np.repeat(np.arange(len(segment)), n)
        inner = np.arange(len(occurrence)) - (total - n)[occurrence]
        gone = self.least[self.string[self.first[segment][occurrence] + inner]] < ids[occurrence]
        on = gone & np.r_[True, ~gone[:-1] | (inner[1:] == 0)][: len(gone)]
        off = gone & np.r_[~gone[1:] | (inner[1:] == 0), True][-len(gone) :] if len(gone) else gone
        a, b = np.flatnonzero(on), np.flatnonzero(off)
        return occurrence[a], place[occurrence[a]] + inner[a], b - a + 1


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of different strings with the least id of each, from several: pairs of runs are merged by binary search."""
    while len(runs) > 1:
        out = []
        for i in range(0, len(runs) - 1, 2):
            (a, ids), (b, more) = runs[i], runs[i + 1]
            at = np.searchsorted(a, b)
            same = np.zeros(len(b), bool)
            inside = at < len(a)
            same[inside] = a[at[inside]] == b[inside]
            ids = ids.copy()
            ids[at[same]] = np.minimum(ids[at[same]], more[same])
            out.append((np.insert(a, at[~same], b[~same]), np.insert(ids, at[~same], more[~same])))
        runs = out + runs[len(runs) & ~1 :]
    return runs[0]


# ---- jobs


def _column(batch: pa.RecordBatch | pa.Table, name: str) -> list:
    return batch.column(name).to_pylist()


def slices(docs: DataFrame, id_col: str, text_col: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(slice, ids, sizes, bytes, data): texts gathered in the order in which they are read, each slice compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal ids, texts, held, made
            data = packed(b"".join(texts))
            sizes = np.array([len(t) for t in texts], "<i8").tobytes()
            out = pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.binary()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["slice", "ids", "sizes", "bytes", "data"])
            ids, texts, held, made = [], [], 0, made + 1
            return out

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                t = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if texts and held + len(t) > slice_bytes:
                    yield row()
                ids.append(i.as_py())
                texts.append(t)
                held += len(t)
        if texts:
            yield row()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(work, "slice long, ids array<bigint>, sizes binary, bytes long, data binary")


class Slice:
    """A slice's row opened: ids with null as NULL_ID, where texts start, the bytes, and the documents of places."""

    def __init__(self, row: dict):
        self.number, self.ids = row["slice"], row["ids"]
        self.order = np.array([NULL_ID if i is None else i for i in self.ids], np.int64)
        self.sizes = np.frombuffer(row["sizes"], "<i8").astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.data = np.frombuffer(unpacked(row["data"]), np.uint8)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def anchors(sliced: DataFrame, buckets: int) -> DataFrame:
    """(bucket, slice, keys, counts): the different anchors of each slice.

    A count's lower bits are the binary logarithm of the occurrences, rounded
    up; its upper bit tells that documents of different ids in the slice have
    the anchor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Slice(row)
            first, _, h = segments(s.data, s.starts)
            bucket, key = buckets_of(h, buckets), key_of(h)
            ids = s.order[s.document(first)]
            by = np.lexsort((key, bucket))
            bucket, key, ids = bucket[by], key[by], ids[by]
            if not len(key):
                continue
            new = np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]
            begin = np.flatnonzero(new)
            n = np.diff(np.r_[begin, len(key)])
            several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
            count = np.ceil(np.log2(n)).astype(np.uint8) | (several.astype(np.uint8) << 7)
            bucket, key = bucket[begin], key[begin]
            cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            keys, counts = five_bytes(key), count.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(np.full(len(cut) - 1, s.number)),
                    pa.array([keys[5 * a : 5 * b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([counts[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                ],
                ["bucket", "slice", "keys", "counts"],
            )

    return sliced.select("slice", "ids", "sizes", "data").mapInArrow(work, "bucket int, slice long, keys binary, counts binary")


def shared_anchors(found: DataFrame, shard_bytes: int) -> DataFrame:
    """(slice, bucket, shards, keys): the anchors that more than one id has, for each slice that has them.

    shards: into how many shards the bucket's segments are dealt.
    """

    def work(table: pa.Table) -> pa.Table:
        raw, counts = _column(table, "keys"), _column(table, "counts")
        keys = np.concatenate([from_five(k) for k in raw])
        count = np.concatenate([np.frombuffer(c, np.uint8) for c in counts])
        row = np.repeat(np.arange(len(raw)), [len(c) for c in counts])
        by = np.lexsort((row, keys))
        keys, count, row = keys[by], count[by], row[by]
        new = np.r_[True, keys[1:] != keys[:-1]]
        begin = np.flatnonzero(new)
        # slices do not share documents, but an id can occur in several: such anchors are kept, which costs only time
        shared = (np.add.reduceat(np.ones(len(keys), np.int64), begin) > 1) | (np.maximum.reduceat(count >> 7, begin) > 0)
        stays = shared[np.cumsum(new) - 1]
        weight = (1 << (count[stays] & 127).astype(np.int64)).sum()
        shards = max(1, int(-(-weight * SEGMENT // shard_bytes)))
        keys, row = keys[stays], row[stays]
        by = np.argsort(row, kind="stable")
        keys, row = keys[by], row[by]
        some, at = np.unique(row, return_index=True)
        cut = np.r_[at, len(row)]
        out = five_bytes(keys)
        return pa.table(
            [
                table.column("slice").take(pa.array(some)), table.column("bucket").take(pa.array(some)), pa.array(np.full(len(some), shards, np.int32)),
                pa.array([out[5 * a : 5 * b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
            ],
            names=["slice", "bucket", "shards", "keys"],
        )

    return found.groupBy("bucket").applyInArrow(work, "slice long, bucket int, shards int, keys binary")


SEGMENTS = "bucket int, shards int, shard int, slice long, data binary, sizes binary, of binary, ids binary, places binary"


def cut_segments(sliced: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """The segments of shared anchors, a row for each slice and shard.

    data and sizes: the different segments; of, ids, places, for each occurrence:
    whether it is the first of the next segment, its document's id and its place
    in the slice.
    """
    lists = shared.groupBy("slice").agg(F.collect_list(F.struct("bucket", "shards", "keys")).alias("anchors"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Slice(row)
            first, n, h = segments(s.data, s.starts)
            bucket = buckets_of(h, buckets)
            # an anchor is named by its bucket and key: both fit one number, as a slice has few buckets at a time
            known = sorted(row["anchors"], key=lambda a: a["bucket"])
            numbers = np.array([a["bucket"] for a in known])
            at = np.searchsorted(numbers, bucket)
            at[at == len(numbers)] = 0
            stays = np.flatnonzero(numbers[at] == bucket)
            at, key = at[stays], key_of(h[stays])
            names = np.concatenate([(from_five(a["keys"]) | (_U(i) << _U(40))) for i, a in enumerate(known)])
            names.sort()
            mine = key | (at.astype(_U) << _U(40))
            place = np.searchsorted(names, mine)
            place[place == len(names)] = 0
            hit = names[place] == mine
            stays, at = stays[hit], at[hit]
            shards = np.array([a["shards"] for a in known])[at]
            yield from _packed(s, first[stays], n[stays] + SPAN - 1, bucket[stays], shards)

    schema = SEGMENTS
    return sliced.select("slice", "ids", "sizes", "data").join(lists, "slice").mapInArrow(work, schema)


def _packed(s: Slice, first: np.ndarray, size: np.ndarray, bucket: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of SEGMENTS. Equal segments of a slice meet: found by a hash, decided by their bytes."""
    if not len(first):
        return
    words = padded(s.data, first, size)
    h = row_hash(words, size)
    by = np.lexsort((h, bucket))
    first, size, bucket, shards, h, words = first[by], size[by], bucket[by], shards[by], h[by], words[by]
    # a bucket of several shards is dealt by slice, so that equal segments of a slice stay together
    shard = (_mixed(np.array([s.number], np.int64).view(_U) * _ODD) >> _U(8)).astype(np.int64) % shards
    unit = np.r_[True, bucket[1:] != bucket[:-1]]
    new = unit.copy()
    new[1:] |= differ(h, size, words)
    raw, offsets = words.view(np.uint8), np.arange(WIDTH)
    ids = s.order[s.document(first)]
    cut = np.r_[np.flatnonzero(unit), len(first)]
    out: dict[str, list] = {k: [] for k in ("data", "sizes", "of", "ids", "places")}
    for a, b in zip(cut[:-1], cut[1:]):
        heads = a + np.flatnonzero(new[a:b])
        z = size[heads]
        out["data"].append(packed(raw[heads][offsets < z[:, None]].tobytes()))
        out["sizes"].append(z.astype(np.uint8).tobytes())
        # segments are numbered as they come: 1 where a new one begins
        out["of"].append(packed(np.packbits(new[a:b]).tobytes()))
        out["ids"].append(packed(ids[a:b].astype("<i8").tobytes()))
        out["places"].append(packed(first[a:b].astype("<i8").tobytes()))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(shards[cut[:-1]].astype(np.int32)), pa.array(shard[cut[:-1]].astype(np.int32)), pa.array(np.full(len(cut) - 1, s.number)),
            *[pa.array(out[k], pa.binary()) for k in ("data", "sizes", "of", "ids", "places")],
        ],
        ["bucket", "shards", "shard", "slice", "data", "sizes", "of", "ids", "places"],
    )


class Group:
    """The rows of one shard joined: its suffix array, and its occurrences."""

    def __init__(self, table: pa.Table):
        table = table.take(pa.array(np.argsort(table.column("slice").to_numpy(), kind="stable")))
        parts = lambda name, kind: [np.frombuffer(unpacked(x), kind) for x in _column(table, name)]
        sizes = np.concatenate([np.frombuffer(x, np.uint8) for x in _column(table, "sizes")]).astype(np.int64)
        ids = parts("ids", "<i8")
        self.row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        self.ids, self.places = np.concatenate(ids), np.concatenate(parts("places", "<i8"))
        new = np.concatenate([np.unpackbits(bits, count=len(i)) for bits, i in zip(parts("of", np.uint8), ids)])
        of = np.cumsum(new, dtype=np.int64) - 1
        # equal segments of several slices meet before the suffix array is made
        data, ends = np.concatenate(parts("data", np.uint8)), np.cumsum(sizes)
        words = padded(data, ends - sizes, sizes)
        h = row_hash(words, sizes)
        by = np.argsort(h, kind="stable")
        first = np.r_[True, differ(h[by], sizes[by], words[by])]
        name = np.empty(len(by), np.int64)
        name[by] = np.cumsum(first) - 1
        some = by[first]
        self.of = name[of]
        least = np.full(len(some), NULL_ID, np.int64)
        np.minimum.at(least, self.of, self.ids)
        self.slices = table.column("slice").to_numpy()
        self.shard = Shard(words[some].view(np.uint8)[np.arange(WIDTH) < sizes[some, None]], sizes[some], least)

    def places_removed(self) -> pa.Table:
        at, first, n = self.shard.removed(self.of, self.ids, self.places)
        row = self.row[at]
        some, begin = np.unique(row, return_index=True)  # occurrences are in the order of the rows
        cut = np.r_[begin, len(row)]
        first, n = first.astype("<i8").tobytes(), n.astype(np.uint8).tobytes()
        return pa.table(
            [pa.array(self.slices[some]), pa.array([packed(first[8 * a : 8 * b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([n[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
            names=["slice", "places", "windows"],
        )


PLACES = "slice long, places binary, windows binary"


def in_one_shard(cut: DataFrame) -> DataFrame:
    """PLACES of buckets that are one shard."""
    return cut.groupBy("bucket").applyInArrow(lambda t: Group(t).places_removed(), PLACES)


def in_many_shards(cut: DataFrame) -> DataFrame:
    """PLACES of buckets that are several: sorted strings of every shard, merged part by part, and the least ids taken back."""

    def sorted_strings(table: pa.Table) -> pa.Table:
        shard = Group(table).shard
        strings = shard.strings()
        shards = table.column("shards")[0].as_py()
        h = np.zeros(len(strings), _U)
        grid = strings.view(np.uint8).reshape(-1, SPAN)
        for c in range(SPAN):
            h = _mixed(h * _power(_BASE, 1) + grid[:, c])
        part = (h % _U(shards)).astype(np.int64)
        out: dict[str, list] = {k: [] for k in ("part", "strings", "least", "numbers")}
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)  # in order, as the strings are
            out["part"].append(int(p))
            out["strings"].append(grid[mine].tobytes())
            out["least"].append(shard.least[mine].astype("<i8").tobytes())
            out["numbers"].append(mine.astype("<i8").tobytes())
        n = len(out["part"])
        one = lambda c: pa.array([table.column(c)[0].as_py()] * n, pa.int32())
        return pa.table([one("bucket"), one("shard"), pa.array(out["part"], pa.int32()), *[pa.array(out[k], pa.binary()) for k in ("strings", "least", "numbers")]], names=["bucket", "shard", "part", "strings", "least", "numbers"])

    def merge(table: pa.Table) -> pa.Table:
        runs = [(np.frombuffer(s, f"S{SPAN}"), np.frombuffer(m, "<i8")) for s, m in zip(_column(table, "strings"), _column(table, "least"))]
        strings, least = merged(runs)
        back = [least[np.searchsorted(strings, s)].astype("<i8").tobytes() for s, _ in runs]
        return pa.table([table.column("bucket"), table.column("shard"), table.column("numbers"), pa.array(back, pa.binary())], names=["bucket", "shard", "numbers", "least"])

    def places(table: pa.Table, least: pa.Table) -> pa.Table:
        group = Group(table)
        known = group.shard.least.copy()
        for numbers, ids in zip(_column(least, "numbers"), _column(least, "least")):
            known[np.frombuffer(numbers, "<i8")] = np.frombuffer(ids, "<i8")
        group.shard.least = known
        return group.places_removed()

    own = cut.groupBy("bucket", "shard")
    parts = own.applyInArrow(sorted_strings, "bucket int, shard int, part int, strings binary, least binary, numbers binary")
    least = parts.groupBy("bucket", "part").applyInArrow(merge, "bucket int, shard int, numbers binary, least binary")
    return own.cogroup(least.groupBy("bucket", "shard")).applyInArrow(places, PLACES)


OUT = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _kept(sliced: DataFrame, places: DataFrame, texts: bool) -> DataFrame:
    """The output rows of each slice, from the places to remove in it."""
    lists = places.groupBy("slice").agg(F.collect_list(F.struct("places", "windows")).alias("gone"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Slice(row)
            edge = np.zeros(len(s.data) + 1, np.int32)
            for g in row["gone"] or []:
                first = np.frombuffer(unpacked(g["places"]), "<i8")
                np.add.at(edge, first, 1)
                np.add.at(edge, first + np.frombuffer(g["windows"], np.uint8).astype(np.int64) + SPAN - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone & np.r_[True, ~gone[:-1]][: len(gone)]
            begins[s.starts[:-1][s.sizes > 0]] |= gone[s.starts[:-1][s.sizes > 0]]  # runs of two documents may touch
            removed, spans = np.r_[0, np.cumsum(gone)][s.starts], np.r_[0, np.cumsum(begins)][s.starts]
            keep = s.data[~gone]
            ends = s.starts - removed
            raw = [keep[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            columns = [pa.array(s.ids, pa.int64()), pa.array(s.sizes), pa.array(np.diff(removed).astype(np.int64)), pa.array(np.diff(spans).astype(np.int64)), pa.array([hashlib.sha256(r).hexdigest() for r in raw])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if texts else []), OUT + (["kept"] if texts else []))

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return sliced.select("slice", "ids", "sizes", "data").join(lists, "slice", "left").mapInArrow(work, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, slice_bytes: int = SLICE_BYTES, bucket_bytes: int = BUCKET_BYTES, texts: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and, where asked for, the bytes kept.

    Every byte goes that a string of SPAN bytes covers which also starts in a
    document of a smaller id; strings are judged on the texts as they came.
    n_spans counts the runs of removed bytes of a document. A null text is
    empty. Texts of fewer than SPAN bytes lose nothing. Rows of one id are not
    smaller than each other, so nothing is removed between them; a null id is
    larger than all others and null ids are not smaller than each other. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    sliced, slices_path = materialize(slices(docs, id_col, text_col, slice_bytes), "slices")
    size = sliced.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, min((1 << 31) - 1, -(-size // bucket_bytes)))
    shared, shared_path = materialize(shared_anchors(anchors(sliced, buckets), shard_bytes), "anchors")
    cut = cut_segments(sliced, shared, buckets)
    made = [shared_path]
    if shared.where("shards > 1").limit(1).count():
        cut, path = materialize(cut, "segments")
        made.append(path)
        found = in_one_shard(cut.where("shards = 1")).unionByName(in_many_shards(cut.where("shards > 1")))
    else:
        found = in_one_shard(cut)
    places, path = materialize(found, "places")
    discard(spark, *made)
    return _kept(sliced, places, texts).withColumnRenamed("id", id_col)
