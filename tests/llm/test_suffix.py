"""Suffix arrays, common prefixes and merging against sorting, and the whole operator against counting every string."""

import hashlib
import random

import numpy as np
import pytest

from attesta.llm import suffix


def texts_of(kind, n=3000):
    rng = np.random.default_rng(3)
    if kind == "random":
        return rng.integers(0, 4, n).astype(np.uint8)
    if kind == "zeros":
        return np.zeros(n, np.uint8)
    if kind == "periodic":
        return np.tile(np.frombuffer(b"abcab", np.uint8), n // 5)
    passage = rng.integers(97, 123, 200).astype(np.uint8)
    return np.concatenate([np.r_[rng.integers(97, 123, 40).astype(np.uint8), passage[i:]] for i in range(0, 60, 5)])


@pytest.mark.parametrize("kind", ["random", "zeros", "periodic", "copies"])
def test_suffix_array_and_prefixes(kind):
    data = texts_of(kind)
    raw = data.tobytes()
    order = suffix.suffix_array(data)
    assert sorted(order) == list(range(len(data)))
    cut = [raw[i : i + 64] for i in order]
    whole = [i for i in range(1, len(cut)) if len(cut[i]) == 64 and len(cut[i - 1]) == 64]
    assert all(cut[i - 1] <= cut[i] for i in whole)
    shared = suffix.common_prefixes(data, order)

    def prefix(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert shared.tolist() == [0] + [prefix(cut[i - 1], cut[i]) for i in range(1, len(cut))]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 100, 400).astype(np.uint8)  # three letters: many equal grams
    seen = {}
    for lead in (0, 1, 13, 131_000):  # the last lies over the edge of a block
        data = np.r_[rng.integers(97, 123, lead).astype(np.uint8), passage]
        first, n, anchor = suffix.segments(data, np.array([0, len(data)]))
        assert n.sum() == len(data) - suffix.SPAN + 1
        for f, k, a in zip(first, n, anchor):
            for w in range(max(f, lead), f + k):
                assert seen.setdefault(w - lead, a) == a


def test_merged_runs():
    rng = random.Random(2)
    runs = []
    for _ in range(5):
        some = sorted({bytes(rng.choice(b"\0ab") for _ in range(50)) if rng.random() < 0.3 else bytes([rng.randrange(3)]) * 50 for _ in range(30)})
        runs.append((np.array(some, "S50"), np.array([rng.randrange(100) for _ in some])))
    want = {}
    for strings, ids in runs:
        for s, i in zip(strings, ids):
            want[s] = min(i, want.get(s, 1000))
    got, ids = suffix.merged([(a.copy(), b.copy()) for a, b in runs])
    assert dict(zip(got, ids)) == want and list(got) == sorted(want)


def brute(rows, span=50):
    """Output rows by the least id of every string of 50 bytes."""
    big = 1 << 63
    least = {}
    raw = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - span + 1):
            s = b[p : p + span]
            least[s] = min(i, least.get(s, big))
    out = []
    for (i, _), (key, b) in zip(rows, raw):
        gone = [False] * len(b)
        for p in range(len(b) - span + 1):
            if least[b[p : p + span]] < key:
                gone[p : p + span] = [True] * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    common, licence, long_ = prose(20), prose(12), prose(400)
    rows = [(i, " ".join([prose(rng.randrange(60)), common if i % 3 == 0 else "", prose(rng.randrange(30)), licence if i % 4 == 0 else ""])) for i in range(80)]
    rows += [(100 + i, long_[: 300 + 40 * i]) for i in range(12)] + [(200 + i, "x" * 30 + f"{i:03d}" + "y" * 46) for i in range(60)]
    rows += [(300, "a" * 500), (301, "a" * 49), (302, "a" * 50), (303, None), (304, ""), (5, common), (5, common), (None, common), (None, long_), (None, "only null " * 9), (None, "only null " * 9)]
    rows += [(400, "\0" * 80), (401, "\0" * 120), (402, prose(9000)), (403, common + common), (404, long_ * 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("slice_bytes,shard_bytes", [(8 << 20, 4 << 20), (700, 20_000), (3000, 300)])
def test_remove_repeats_matches_every_string(spark, monkeypatch, slice_bytes, shard_bytes):
    """Whole, with many slices, and with buckets cut into many shards, whose strings are merged."""
    rows = corpus()
    merges = []
    whole = suffix.in_many_shards
    monkeypatch.setattr(suffix, "in_many_shards", lambda cut: merges.append(1) or whole(cut))
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, slice int, bucket string").repartition(3)
    got = suffix.remove_repeats(df, shard_bytes=shard_bytes, slice_bytes=slice_bytes, bucket_bytes=shard_bytes, texts=True).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == brute(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert bool(merges) == (shard_bytes < 1 << 20)


def test_remove_repeats_of_nothing(spark):
    schema = "doc_id long, text string"
    assert suffix.remove_repeats(spark.createDataFrame([], schema)).collect() == []
    one = suffix.remove_repeats(spark.createDataFrame([(1, None)], schema)).collect()
    assert [tuple(r) for r in one] == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]
