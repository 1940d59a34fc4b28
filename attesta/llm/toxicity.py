"""Toxic spans by a linear-chain conditional random field.

Two tags, O and T. A token's score for T is the sum of the weights of its
features (the word and its prefixes and suffix), transitions have weights of
their own. Document labels become token labels by a test of association: in a
toxic document the tokens whose features are found in toxic documents far more
often than chance allows are tagged T. Forward-backward gives each token's
marginal; a document's score is a logistic function of what its marginals sum
to, and runs of T are its spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.near_dedup import shingle_hashes

TOKEN = re.compile(r"[^\W\d_]+")
#: Kinds of features: the whole word, its first 3 to 6 letters if it has more, its last 4 if it has more.
PREFIXES, SUFFIX = (3, 4, 5, 6), 4
#: Fitted weights nearer to zero are left out of the model.
LEAST_WEIGHT = 0.02
#: Labelled rows that the model is fitted on: so many toxic ones and so many others at most.
SAMPLE_TOXIC, SAMPLE_OTHER = 1_500, 3_000
#: Bytes of all their texts, and of one of them, at most.
SAMPLE_BYTES, ROW_BYTES = 32 << 20, 1 << 20
#: Rows whose crc32(id) has this remainder mod 5 are held out and never fitted on.
HELD_OUT = 0
#: Words whose score a task remembers, tokens of a batch, and tokens of a chunk of the chain.
CACHE_WORDS, BATCH_TOKENS, CHUNK = 150_000, 500_000, 64


def features(word: str) -> list[tuple[int, str]]:
    """The (kind, text) features of a lower-case word."""
    out = [(0, word)] + [(k, word[:n]) for k, n in enumerate(PREFIXES, 1) if len(word) > n]
    return out + [(len(PREFIXES) + 1, word[-SUFFIX:])] if len(word) > SUFFIX else out


@dataclass
class Crf:
    """Weights of the chain and of the document score."""

    #: for each kind the weight of each text
    weight: list[dict[str, float]] = field(default_factory=lambda: [{} for _ in range(len(PREFIXES) + 2)])
    #: log weights OO, OT, TO, TT; a text begins as if after an O
    chain: np.ndarray = field(default_factory=lambda: np.array([0.0, -4.0, 0.0, 0.0]))
    bias: float = 0.0
    score: tuple[float, float] = (-6.0, 4.0)
    fitted: bool = False


class Emissions(dict):
    """The score for T of each word as it is written, worked out when it is first met."""

    def __init__(self, model: Crf):
        super().__init__()
        self.model, self.begins = model, {}

    def __missing__(self, written: str) -> float:
        word, weight = written.lower(), self.model.weight
        n = len(word)
        u = self.model.bias + weight[0].get(word, 0.0)
        begin = word[: PREFIXES[-1] + 1]
        if begin not in self.begins:
            self.begins[begin] = sum(weight[k].get(begin[:size], 0.0) for k, size in enumerate(PREFIXES, 1) if len(begin) > size)
        u += self.begins[begin]
        if n > SUFFIX:
            u += weight[-1].get(word[-SUFFIX:], 0.0)
        self[written] = u
        return u

    def of(self, text: str) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.begins.clear()
        lower = text.lower()
        if len(lower) != len(text):  # a letter whose lower case is two: words are lowered one by one
            lower = text
        words = TOKEN.findall(lower)
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def marginals(u: np.ndarray, lengths: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """P(T) of each token of texts laid end to end, by forward-backward.

    Texts are cut into chunks. The product of a chunk's 2x2 matrices carries
    the forward and backward messages over it, so the recursion runs over the
    places of a chunk for all chunks at once, and over the chunks of a text.
    """
    oo, ot, to, tt = np.exp(chain)
    e = np.exp(np.clip(u, -30, 30))
    per = -(-lengths // CHUNK)
    total = int(per.sum())
    if not total:
        return np.zeros(0)
    first = np.cumsum(per) - per
    place = np.arange(total) - np.repeat(first, per)
    begin = np.repeat(np.cumsum(lengths) - lengths, per) + place * CHUNK
    size = np.minimum(CHUNK, np.repeat(lengths, per) - place * CHUNK)
    order = np.argsort(-size, kind="stable")  # longest first: those that still run are a head of the array
    begin, size = begin[order], size[order]
    live = [int(np.searchsorted(-size, -j, "left")) for j in range(int(size[0]))]
    rank = np.empty(total, dtype=np.int64)
    rank[order] = np.arange(total)
    m = np.tile(np.array([1.0, 0.0, 0.0, 1.0])[:, None], (1, total))
    for j, k in enumerate(live):
        x, (a, b, c, d) = e[begin[:k] + j], m[:, :k]
        na, nb, nc, nd = a * oo + b * to, (a * ot + b * tt) * x, c * oo + d * to, (c * ot + d * tt) * x
        scale = 1.0 / (na + nb + nc + nd)
        m[0, :k], m[1, :k], m[2, :k], m[3, :k] = na * scale, nb * scale, nc * scale, nd * scale
    # messages that enter each chunk from the left (r) and from the right (s), as odds
    r, s = np.zeros(total), np.ones(total)
    texts = np.argsort(-per, kind="stable")
    held = -per[texts]
    for p in range(1, int(per.max())):
        now = first[texts[: np.searchsorted(held, -p, "left")]] + p
        here, before = rank[now], rank[now - 1]
        a, b, c, d = m[:, before]
        r[here] = np.clip((b + r[before] * d) / (a + r[before] * c), 1e-30, 1e30)
    for p in range(int(per.max()) - 1, 0, -1):
        now = first[texts[: np.searchsorted(held, -p, "left")]] + p
        here, before = rank[now], rank[now - 1]
        a, b, c, d = m[:, here]
        s[before] = np.clip((c + d * s[here]) / (a + b * s[here]), 1e-30, 1e30)
    odds = np.empty(len(u))
    for j, k in enumerate(live):
        at = begin[:k] + j
        r[:k] = np.clip(e[at] * (r[:k] * tt + ot) / (r[:k] * to + oo), 1e-30, 1e30)
        odds[at] = r[:k]
    for j in range(len(live) - 1, -1, -1):
        at = begin[: live[j]] + j
        odds[at] *= s[: live[j]]
        x = e[at] * s[: live[j]]
        s[: live[j]] = (to + tt * x) / (oo + ot * x)
    return odds / (1 + odds)


# --- fitting -------------------------------------------------------------------------------------------------------


def _associated(here: np.ndarray, there: np.ndarray, rate: float) -> np.ndarray:
    """Which features are in toxic documents far more often than chance allows (log-likelihood ratio, corrected for their number).

    here and there: the toxic and the other documents that have each feature.
    """
    rate = max(rate, 1e-6)
    least = 2 * np.log(max(1, (here > 1).sum())) + 8
    p = here / np.maximum(here + there, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (here * np.log(p / rate) + np.where(there > 0, there * np.log((1 - p) / (1 - rate)), 0.0))
    return (here > 2) & (p > max(0.6, 2 * rate)) & (g > least)


def fit(texts: list[str], toxic: list[int], rounds: int = 30, rate: float = 0.5, l2: float = 1e-6) -> Crf:
    """Fit the chain on labelled texts by gradient ascent of the conditional likelihood of their token tags."""
    model, y = Crf(), np.array(toxic, dtype=bool)
    if not y.any() or y.all():
        return model
    index: dict[str, int] = {}
    ids = []
    for t in texts:
        words = [w.lower() for w in TOKEN.findall(t)]
        ids.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
    # rows of the feature matrix: (word, slot) pairs, by word
    slots: dict[tuple[int, str], int] = {}
    held = [[slots.setdefault(f, len(slots)) for f in features(w)] for w in index]
    many = np.array([len(h) for h in held])
    slot = np.fromiter((i for h in held for i in h), np.int32, int(many.sum()))
    del held
    at, begin = np.repeat(np.arange(len(index), dtype=np.int32), many), np.cumsum(many) - many
    found = np.zeros((2, len(slots)), dtype=np.int64)
    for x, d in zip(ids, y):
        kinds = np.unique(x)
        n = many[kinds]
        found[int(d)][np.unique(slot[np.repeat(begin[kinds] - np.cumsum(n) + n, n) + np.arange(n.sum())])] += 1
    strong = _associated(found[1], found[0], float(y.mean()))
    marked = np.bincount(at, weights=strong[slot], minlength=len(index)) > 0
    weight = np.zeros(len(slots))
    u_of = lambda: model.bias + np.bincount(at, weights=weight[slot], minlength=len(index))
    lengths, flat = np.array([len(x) for x in ids]), np.concatenate(ids)
    tag = (marked[flat] & np.repeat(y, lengths)).astype(np.float64)
    # the transitions are the tags' own frequencies; emissions are learnt given them
    head = np.cumsum(lengths)[:-1]
    before = np.r_[0.0, tag[:-1]]
    before[head[head < len(tag)]] = 0.0
    count = np.bincount((2 * before + tag).astype(np.int64), minlength=4) + 0.5
    model.chain = np.log(np.array([count[0] / (count[0] + count[1]), count[1] / (count[0] + count[1]), count[2] / (count[2] + count[3]), count[3] / (count[2] + count[3])]))
    sq, sq_bias = np.zeros(len(slots)), 0.0
    for _ in range(rounds):
        grad = np.bincount(flat, weights=tag - marginals(u_of()[flat], lengths, model.chain), minlength=len(index))
        step = np.bincount(slot, weights=grad[at], minlength=len(slots)) - l2 * len(flat) * weight
        sq += step**2
        weight = weight + rate * step / np.sqrt(sq + 1e-8)
        sq_bias += grad.sum() ** 2
        model.bias += rate * grad.sum() / np.sqrt(sq_bias + 1e-8)
    weight[np.abs(weight) < LEAST_WEIGHT] = 0.0
    for (kind, name), i in slots.items():
        if weight[i]:
            model.weight[kind][name] = round(float(weight[i]), 4)
    model.fitted = True
    ends = np.cumsum(lengths)
    mass = np.r_[0.0, np.cumsum(marginals(u_of()[flat], lengths, model.chain))]
    x = np.log1p(mass[ends] - mass[ends - lengths])
    a, b = model.score
    for _ in range(400):  # logistic regression on one input, with a little shrinkage
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(y - p).sum() - 0.01 * a, ((y - p) * x).sum() - 0.01 * b])
        v = p * (1 - p) + 1e-6
        h = np.array([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + move[0], b + move[1]
        if abs(move).max() < 1e-6:
            break
    model.score = (float(a), float(max(b, 0.0)))
    return model


def _mass(m: np.ndarray) -> float:
    """What a document's score depends on: the log of its expected number of toxic tokens."""
    return float(np.log1p(m.sum()))


def _marginals_of(us: list[np.ndarray], model: Crf) -> list[np.ndarray]:
    """Marginals of many documents, in batches of a bounded number of tokens (or one document)."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(us):
        stop, held = at, 0
        while stop < len(us) and (stop == at or held + len(us[stop]) <= BATCH_TOKENS):
            held += len(us[stop])
            stop += 1
        lengths = np.array([len(u) for u in us[at:stop]])
        out += np.split(marginals(np.concatenate(us[at:stop]), lengths, model.chain), np.cumsum(lengths)[:-1]) if held else us[at:stop]
        at = stop
    return out


def without_copies(texts: list[str], toxic: list[int], words: int = 5, keys: int = 4) -> tuple[list[str], list[int]]:
    """Texts without the later ones of near copies, which would make their own words look associated.

    A text goes if one of its least shingle hashes, under `keys` mixings, is an earlier text's.
    """
    seen: list[set[int]] = [set() for _ in range(keys)]
    mult = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)[:keys]
    kept: tuple[list[str], list[int]] = ([], [])
    for t, y in zip(texts, toxic):
        h = shingle_hashes(t, words)
        least = [int(((h * m) ^ (h * m >> np.uint64(32))).min()) for m in mult] if len(h) else []
        if not any(x in s for x, s in zip(least, seen)):
            kept[0].append(t)
            kept[1].append(y)
        for x, s in zip(least, seen):
            s.add(x)
    return kept


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = SAMPLE_TOXIC, most_other: int = SAMPLE_OTHER) -> Crf:
    """Fit on a bounded sample of labelled rows that are not held out, taken in hash order of their ids.

    An id counts once: as toxic if any of its labels is, with the least of its
    texts if documents repeat it. The driver gets most_toxic + most_other texts
    and SAMPLE_BYTES at most; texts over ROW_BYTES are not fitted on. Without
    rows of both kinds the model stays unfitted and scores every text 0. Null
    ids and labels are left out; other columns are ignored whatever their names.
    """
    key = F.col(f"`{id_col}`")
    may = labels.where(F.col(f"`{label_col}`").isNotNull() & key.isNotNull() & (F.crc32(key.cast("string")) % 5 != HELD_OUT))
    once = may.select(key.alias("i"), (F.col(f"`{label_col}`") == 1).cast("int").alias("y")).groupBy("i").agg(F.max("y").alias("y"))
    some = [once.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(n) for y, n in ((1, most_toxic), (0, most_other))]
    picked = docs.select(key.alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).where(F.octet_length("t") <= ROW_BYTES)
    got = picked.join(F.broadcast(some[0].unionByName(some[1])), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    rows, held = [], 0
    for r in got.orderBy(F.xxhash64("i"), "i").toLocalIterator():
        held += len(r["t"].encode("utf-8", "surrogatepass"))
        if held > SAMPLE_BYTES:
            break
        rows.append((r["i"], r["t"], r["y"]))
    rows.sort()
    texts, toxic = [t for _, t, _ in rows], [y for *_, y in rows]
    del rows
    return fit(*without_copies(texts, toxic))


# --- scoring -------------------------------------------------------------------------------------------------------


def score_texts(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, toxic_tokens, spans (array of start, stop code points).

    The whole text is scored; a null or empty one has no token and the score of
    a text without any. spans are runs of tokens tagged T (marginal of at least
    one half). Repeated rows score alike; an empty table gives no rows; other
    columns are ignored.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Emissions(model)
        a, b = model.score

        def spans(text: str, tagged: np.ndarray) -> list[dict]:
            found, last = [], -2
            for i, m in enumerate(TOKEN.finditer(text)):
                if tagged[i]:
                    if last == i - 1:
                        found[-1]["stop"] = m.end()
                    else:
                        found.append({"start": m.start(), "stop": m.end()})
                    last = i
            return found

        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                us = [known.of(t) for t in texts]
                ms = _marginals_of(us, model) if model.fitted else [np.zeros(len(u)) for u in us]
                score = [1 / (1 + np.exp(-(a + b * _mass(m)))) if model.fitted else 0.0 for m in ms]
                tagged = [m >= 0.5 for m in ms]
                found = [spans(t, g) if g.any() else [] for t, g in zip(texts, tagged)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(score, pa.float64()), pa.array([float(m.sum()) for m in ms], pa.float64()), pa.array(found, span)],
                    ["id", "score", "toxic_tokens", "spans"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    out = picked.mapInArrow(work, "id long, score double, toxic_tokens double, spans array<struct<start: long, stop: long>>")
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Crf, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores under the threshold, whole and unchanged."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        a, b = model.score
        if not model.fitted:
            return pa.array(np.zeros(len(texts)))
        known, out = Emissions(model), []
        for start in range(0, len(texts), 1000):
            us = [known.of(t or "") for t in texts.slice(start, 1000).to_pylist()]
            out += [1 / (1 + np.exp(-(a + b * _mass(m)))) for m in _marginals_of(us, model)]
        return pa.array(out, pa.float64())

    return docs.where(score(F.col(f"`{text_col}`")) < threshold)
