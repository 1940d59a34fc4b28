"""Vector bin packing of token sequences by the dot-product heuristic.

Pieces are placed under three limits at once: tokens, segments and loss-bearing
tokens of a sequence. Of the pieces waiting, the one with the largest weighted
dot product of its demands and the open sequence's room goes in next; a piece
that does not fit is cut at the room left where cutting is allowed. Each task
packs what it reads, so no text is shuffled, and leaves at most one sequence
that is not full.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 16, 4096
#: Pieces that wait for a place at one time.
POOL = 128
#: Documents that are encoded together.
STEP = 500
#: Words and runs of letters whose ids a worker remembers; when so many are held, those not met since go.
CACHE_WORDS, CACHE_RUNS = 1_000_000, 600_000


@lru_cache(4)
def tokenizer_of(path: str):  # noqa: ANN201
    """The tokenizer of a file without remembered words; one that is dropped leaves memory behind, so a worker loads it once."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Remembered:
    """A mapping with a bound: half of `most` entries are in use; then they are set aside and only what is met again comes back."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most // 2, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those keys that are not known; known ones are in `now` afterwards."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        unknown = keys.difference(self.now)
        out = []
        for k in unknown:
            if (ids := self.before.get(k)) is None:
                out.append(k)
            else:
                self.now[k] = ids
        return out


class WordTokenizer:
    """Ids of whole texts from a tokenizer that drops white space and marks the end of a word.

    Words between white space are encoded when they are first met. A word is
    the ids of its runs of letters and of other characters; new runs of letters
    of many texts go to the tokenizer together, and each ends at its first
    end-marked id. Words with apostrophes, control strings or combining marks,
    whose runs may depend on their neighbours, are encoded whole. Ids are held
    as bytes, so that a text is one join.
    """

    PARTS = re.compile(r"[^\W\d_]+|[\W\d_]+")
    SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")

    def __init__(self, path: str, words: int = CACHE_WORDS, runs: int = CACHE_RUNS):
        self.tokenizer = tokenizer_of(path)
        self.words, self.runs = Remembered(words), Remembered(runs)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
        #: What Python takes for white space and the tokenizer does not.
        self.odd = [c for c in spaces if self._encode(f"a{c}b") != self._encode("a b")]

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32).tobytes()

    def _letters(self, runs: list[str]) -> None:
        for start in range(0, len(runs), 4096):
            some = runs[start : start + 4096]
            raw = self._encode(" ".join(some))
            cut = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, dtype=np.uint32)]) + 1)).tolist()
            if len(cut) == len(some) and cut[-1] == len(raw):
                self.runs.now.update(zip(some, (raw[a:b] for a, b in zip([0, *cut], cut))))
            else:
                self.runs.now.update((w, self._encode(w)) for w in some)

    def _parts(self, word: str) -> list[str] | None:
        """The runs of a word, or None if one may depend on its neighbours."""
        if word.isalpha():  # the tokenizer lowers letters one by one; a capital sigma alone depends on its place in Python
            low = word.lower()
            return [low] if word.isascii() or (low.isalpha() and "Σ" not in word) else None
        if "'" in word or "<|" in word or "Σ" in word:
            return None
        runs = self.PARTS.findall(word.lower())
        for r in runs:
            if not r.isalpha() and not r.isascii() and any(c.isalnum() and not c.isdecimal() or unicodedata.combining(c) for c in r):
                return None
        return runs

    def _learn(self, new: list[str]) -> None:
        parts = {w: self._parts(w) for w in new}
        unknown = self.runs.missing({r for p in parts.values() if p for r in p})
        self._letters([r for r in unknown if r.isalpha()])
        known = self.runs.now
        known.update((r, self._encode(r)) for r in unknown if not r.isalpha())
        self.words.now.update((w, b"".join([known[r] for r in p]) if p is not None else self._encode(w)) for w, p in parts.items())

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; what is new in them is encoded together."""
        split = [self.SPACE.split(t) if any(c in t for c in self.odd) else t.split() for t in texts]
        out: list[np.ndarray] = []
        start = 0
        while start < len(split):  # a step holds at most a quarter of the cache's words, or one text
            stop, held = start + 1, len(split[start])
            while stop < len(split) and held + len(split[stop]) <= self.words.most // 4:
                held += len(split[stop])
                stop += 1
            if new := self.words.missing(set().union(*split[start:stop])):
                self._learn(new)
            get = self.words.now.__getitem__
            out += [np.frombuffer(b"".join(map(get, ws)), dtype=np.uint32) for ws in split[start:stop]]
            start = stop
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


@lru_cache(4)
def word_tokenizer(path: str, words: int = CACHE_WORDS, runs: int = CACHE_RUNS) -> WordTokenizer:
    """The tokenizer of a file, one for all tasks of a worker, so that words stay known."""
    return WordTokenizer(path, words, runs)


class Packer:
    """Open sequence and waiting pieces of one task."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, pool: int = POOL):
        self.limits, self.cut, self.pool = np.array(limits, dtype=np.float64), cut, pool
        self.sequence = -1
        self.waiting: list[list] = []  # [key, start, length, loss_start]
        self.demand = np.zeros((0, 3))
        self._open()

    def _open(self) -> None:
        self.sequence += 1
        self.room, self.offset = self.limits.copy(), 0

    @staticmethod
    def _needs(piece: list) -> tuple[int, int, int]:
        _, start, length, loss_start = piece
        return length, 1, max(0, start + length - max(start, loss_start))

    def _place(self, piece: list) -> tuple:
        out = (*piece[:3], self.sequence, self.offset)
        self.room -= self._needs(piece)
        self.offset += piece[2]
        if self.room[0] < 1 or self.room[1] < 1:
            self._open()
        return out

    def add(self, key, length: int, loss_start: int) -> Iterator[tuple]:
        """Take a document; yields (key, start, length, sequence, offset) of the pieces that found a place."""
        piece = [key, 0, length, loss_start]
        if not self.cut and (np.array(self._needs(piece)) > self.limits).any():
            raise ValueError("an example exceeds the limits of a sequence and may not be cut")
        self.waiting.append(piece)
        self.demand = np.vstack([self.demand, self._needs(piece)])
        while len(self.waiting) >= self.pool:
            yield self._next()

    def rest(self) -> Iterator[tuple]:
        while self.waiting:
            yield self._next()

    def _next(self) -> tuple:
        weight = self.demand.mean(axis=0) / self.limits**2  # demands and room as shares of the limits
        score = self.demand @ (weight * self.room)
        fits = (self.demand <= self.room).all(axis=1)
        if fits.any():
            k = int(np.argmax(np.where(fits, score, -1.0)))
            piece = self.waiting.pop(k)
            self.demand = np.delete(self.demand, k, axis=0)
            return self._place(piece)
        k = int(np.argmax(score))
        piece = self.waiting[k]
        take = self._most(piece) if self.cut else 0
        if take < 1:
            self._open()
            return self._next()
        head = [piece[0], piece[1], take, piece[3]]
        self.waiting[k] = [piece[0], piece[1] + take, piece[2] - take, piece[3]]
        self.demand[k] = self._needs(self.waiting[k])
        return self._place(head)

    def _most(self, piece: list) -> int:
        """Tokens of a piece's head that the room allows."""
        _, start, length, loss_start = piece
        free = max(0, loss_start - start)
        return int(min(self.room[0], length, free + self.room[2]))


def pack(
    docs: DataFrame, tokens: Callable[[], Callable[[str], np.ndarray]], id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 2, prompt_col: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS, cut: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    `tokens` makes, in each task, the function from a text to its ids (if it
    has a method `many`, that one is called with lists of texts); end_id
    follows each text. `prompt_col` counts the leading ids that bear no loss
    (none by default). A null text counts as empty and is one end_id; repeated
    rows are packed once each; every id lies in exactly one piece, and offsets
    in a sequence are gapless from 0. With cut=False an example is never cut
    and one over a limit is an error. An empty table gives no rows; other
    columns are ignored. Sequence ids are the task's number and a count, the
    same in a rerun over the same input splits.
    """
    limits = (max_tokens, max_segments, max_loss)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = tokens(), TaskContext.get().partitionId() << 40
        many = getattr(encode, "many", lambda texts: list(map(encode, texts)))
        packer, held = Packer(limits, cut), {}
        end = np.array([end_id], dtype=np.uint32)

        def rows(pieces: Iterator[tuple]) -> list[tuple]:
            out = []
            for key, start, length, sequence, offset in pieces:
                doc, ids, left, loss_start = held[key]
                crc = zlib.crc32(ids[start : start + length])
                loss = max(0, start + length - max(start, loss_start))
                out.append((doc, start, length, crc, len(ids), base + sequence, offset, loss))
                if left == length:
                    del held[key]
                else:
                    held[key] = (doc, ids, left - length, loss_start)
            return out

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)

        count = 0
        for whole in batches:
            for first in range(0, whole.num_rows, STEP):
                b = whole.slice(first, STEP)
                found: list[tuple] = []
                for doc, ids, prompt in zip(b.column(0).to_pylist(), many([t or "" for t in b.column(1).to_pylist()]), b.column(2).to_pylist()):
                    ids = np.concatenate([ids.astype("<u4", copy=False), end])
                    loss_start = prompt or 0
                    held[count] = (doc, ids, len(ids), loss_start)
                    found += rows(packer.add(count, len(ids), loss_start))
                    count += 1
                if found:
                    yield batch(found)
        if found := rows(packer.rest()):
            yield batch(found)

    prompt = F.col(prompt_col).cast("long") if prompt_col else F.lit(0).cast("long")
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), prompt.alias("p"))
    out = picked.mapInArrow(work, ", ".join(f"{n} long" for n in names))
    return out.withColumnRenamed("doc_id", id_col)
