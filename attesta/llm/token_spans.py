"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. Byte offsets of its tokens come from
the lengths of the vocabulary's entries, and an interval join of token spans
with section spans counts each section's tokens. A token that crosses a
boundary belongs to the section that holds most of its bytes, and to the
earlier one if that is a tie; so each token is counted once.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sections of a batch of results.
BATCH_ROWS = 20_000


class ByteTokenizer:
    """Byte spans of the tokens of a text, from a rank file of a byte-level BPE."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        """The end of each token, in bytes from the start of the text."""
        return np.cumsum(self.size[self.encoding.encode_ordinary(text)])


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section.

    ends: of the tokens; bounds: of the sections, from 0 to the text's length,
    ascending; a section may be empty and then has no token.
    """
    sections = len(bounds) - 1
    if not len(ends):
        return np.zeros(sections, dtype=np.int64), np.zeros(sections, dtype=np.int64)
    starts = np.r_[0, ends[:-1]]
    a = np.searchsorted(bounds, starts, "right") - 1
    z = np.searchsorted(bounds, ends, "left") - 1
    crossing = np.flatnonzero(a < z)
    of = a.copy()
    for i in crossing:
        inside = np.arange(a[i], z[i] + 1)
        held = np.minimum(bounds[inside + 1], ends[i]) - np.maximum(bounds[inside], starts[i])
        of[i] = inside[np.argmax(held)]
    return np.bincount(of, minlength=sections), np.bincount(of[crossing], minlength=sections)


def line_bounds(text: bytes) -> np.ndarray:
    """Sections are lines; a line break belongs to the line that it ends."""
    at = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    return np.unique(np.r_[0, at, len(text)]) if len(text) else np.array([0, 0])


def section_tokens(docs: DataFrame, tokens: Callable[[], Callable[[str], np.ndarray]], id_col: str = "doc_id", text_col: str = "text", bounds: Callable[[bytes], np.ndarray] = line_bounds) -> DataFrame:
    """One row per section of each row: id, section, start, stop (code points), n_tokens, n_crossing.

    A row's sections cover its text, and their tokens sum to those of the whole
    text. A null or empty text has one empty section. n_crossing counts the
    section's tokens that reach into another. Repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored.
    """
    schema = "id long, section long, start long, stop long, n_tokens long, n_crossing long"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_of, held, rows = tokens(), [], 0

        def batch() -> pa.RecordBatch:
            ids = pa.array([i for i, *c in held for _ in range(len(c[0]))], pa.int64())
            return pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate([h[k] for h in held]), pa.int64()) for k in range(1, 6)]], names)

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                text = t.as_py() or ""
                raw = text.encode("utf-8")
                cut = bounds(raw)
                count, crossing = attribute(ends_of(text), cut)
                chars = cut
                if len(raw) != len(text):  # bytes that begin a character, counted up to each boundary
                    chars = np.r_[0, np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)][cut]
                held.append((i.as_py(), np.arange(len(count)), chars[:-1], chars[1:], count, crossing))
                rows += len(count)
                if rows >= BATCH_ROWS:
                    yield batch()
                    held, rows = [], 0
        if held:
            yield batch()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return picked.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def field_tokens(docs: DataFrame, tokens: Callable[[], Callable[[str], np.ndarray]], fields: list[str], id_col: str = "doc_id", joint: str = "\n") -> DataFrame:
    """One row per row and field: id, field, n_tokens, n_crossing, with the fields joined by `joint` and encoded at once.

    The joint belongs to the field before it; a null field is an empty one.
    """
    schema = "id long, field string, n_tokens long, n_crossing long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_of = tokens()
        for b in batches:
            ids, counts, crosses = [], [], []
            for r in range(b.num_rows):
                parts = [b.column(1 + k)[r].as_py() or "" for k in range(len(fields))]
                parts = [p + joint for p in parts[:-1]] + parts[-1:]
                cut = np.r_[0, np.cumsum([len(p.encode("utf-8")) for p in parts])]
                count, crossing = attribute(ends_of("".join(parts)), cut)
                ids += [b.column(0)[r].as_py()] * len(fields)
                counts.append(count)
                crosses.append(crossing)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields * b.num_rows), pa.array(np.concatenate(counts)), pa.array(np.concatenate(crosses))], ["id", "field", "n_tokens", "n_crossing"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(fields)])
    return picked.mapInArrow(work, schema).withColumnRenamed("id", id_col)
