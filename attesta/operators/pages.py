"""Nested pages (blocks, paragraphs, lines, words) worked on in their row: overlay of label words, segments, anchors.

A page is one value of the type `sources.tables.PAGE` gives its blocks. Nothing
here explodes a page, so no shuffle is needed to put it together again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import tables as T
from attesta.functions import text as X
from attesta.functions.text import let
from attesta.operators.spatial import overlap
from attesta.sources.tables import WORD_FLOOR

#: Confidence from which a word belongs to a segment, and the gap, in line heights, that parts two segments.
SEGMENT_FLOOR, SEGMENT_GAP = 30.0, 1.0
WORDS = "array<struct<text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>>>"


def lines_of(blocks: Column) -> Column:
    """A page's lines in reading order; null for null blocks."""
    return F.flatten(F.transform(F.flatten(F.transform(blocks, lambda b: b["paragraphs"])), lambda p: p["lines"]))


def page_text(blocks: Column, own: Column) -> Column:
    """The cleaned text of a page's sure words, line by line; the page's own text where none is left."""
    sure = lambda l: F.filter(l["words"], lambda w: (w["confidence"] >= WORD_FLOOR) & (F.trim(w["text"]) != ""))
    texts = F.filter(F.transform(lines_of(blocks), lambda l: F.array_join(F.transform(sure(l), lambda w: w["text"]), " ")), lambda t: t != "")
    return X.clean_text(F.coalesce(F.nullif(F.array_join(texts, "\n"), F.lit("")), own))


def words_of(blocks: Column) -> Column:
    """A page's words in reading order; null for null blocks."""
    return F.flatten(F.transform(lines_of(blocks), lambda l: l["words"]))


def _near(a: Column, b: Column) -> Column:
    """Whether two words stand at one spot: half of the shorter one shared on both axes. Most boxes do not meet, which their edges tell sooner."""
    meet = (a["y0"] < b["y1"]) & (b["y0"] < a["y1"]) & (a["x0"] < b["x1"]) & (b["x0"] < a["x1"])
    return meet & (overlap(a["y0"], a["y1"], b["y0"], b["y1"]) >= 0.5) & (overlap(a["x0"], a["x1"], b["x0"], b["x1"]) >= 0.5)


def label_words(blocks: Column) -> Column:
    """The words of an English page that are words of printed labels, read surely enough."""
    return F.filter(words_of(blocks), lambda w: F.coalesce(X.english_label_word(w["text"], w["confidence"]), F.lit(False)))


def merge_labels(blocks: Column, english: Column) -> Column:
    """The blocks of a page with English label words in place of what was misread at their spot.

    A word takes text and confidence of the first label at its spot. A label
    goes in once, at the first word that it belongs to; later words at its spot
    are dropped. Lines, paragraphs and blocks that this leaves without words
    are dropped too, and a line's text is made anew of its words. Boxes stay.

    Null blocks stay null; without an English page only empty lines go. What is
    done is kept as a map from a word's path to its label, 0 for a word that is
    dropped, so words that no label touches are looked up, once, in few entries.
    """
    labels = F.coalesce(label_words(english), F.array().cast(WORDS))
    path = lambda i, j, k, n: F.struct(i.alias("b"), j.alias("p"), k.alias("l"), n.alias("w"))
    box_of = lambda i, j, k: lambda w, n: F.struct(path(i, j, k, n).alias("path"), w["bbox"].alias("bbox"))
    placed = F.flatten(F.flatten(F.flatten(F.transform(blocks, lambda b, i: F.transform(b["paragraphs"], lambda p, j: F.transform(p["lines"], lambda l, k: F.transform(l["words"], box_of(i, j, k))))))))

    def hits_of(boxes: Column) -> Column:
        first = lambda box: F.array_position(F.transform(boxes, lambda l: _near(box, l)), F.lit(True))
        # (path, label): the words at some label's spot, label counted from 1
        return F.filter(F.transform(placed, lambda w: F.struct(w["path"].alias("path"), first(w["bbox"]).alias("label"))), lambda h: h["label"] > 0)

    def overlaid(labels: Column) -> Column:
        hits = let(F.transform(labels, lambda l: l["bbox"]), hits_of)
        return let(hits, lambda h: let(_fates(h), lambda known: _rewritten(blocks, labels, known)))

    return F.when(blocks.isNotNull(), let(labels, overlaid))


def _fates(hits: Column) -> Column:
    """A map from the path of each hit to its label, for the first hit of a label, or to 0."""

    def told(numbers: Column) -> Column:
        first = lambda h, i: F.when(F.array_position(numbers, h["label"]) == i + 1, h["label"]).otherwise(0)
        return F.map_from_entries(F.transform(hits, lambda h, i: F.struct(h["path"].alias("path"), first(h, i).alias("label"))))

    return let(F.transform(hits, lambda h: h["label"]), told)


def _rewritten(blocks: Column, labels: Column, known: Column) -> Column:
    """The blocks with each word kept, replaced or dropped."""

    def line(i: Column, j: Column):
        def work(l: Column, k: Column) -> Column:
            at = lambda n: F.struct(i.alias("b"), j.alias("p"), k.alias("l"), n.alias("w"))
            marked = F.transform(l["words"], lambda w, n: F.struct(w.alias("w"), F.element_at(known, at(n)).alias("label")))
            kept = F.filter(marked, lambda m: F.coalesce(m["label"] > 0, F.lit(True)))
            put = lambda w, label: F.struct(label["text"].alias("text"), label["confidence"].alias("confidence"), w["bbox"].alias("bbox"))
            of = lambda m: let(F.get(labels, (m["label"] - 1).cast("int")), lambda label: put(m["w"], label))
            new = F.transform(kept, lambda m: F.when(m["label"].isNull(), m["w"]).otherwise(of(m)))
            text = lambda words: F.concat(F.array_join(F.transform(words, lambda w: w["text"]), " "), F.lit("\n"))
            return let(new, lambda words: F.struct(text(words).alias("text"), l["confidence"].alias("confidence"), l["bbox"].alias("bbox"), words.alias("words")))

        return work

    some = lambda name: lambda x: F.size(x[name]) > 0
    paragraph = lambda i: lambda p, j: F.struct(F.filter(F.transform(p["lines"], line(i, j)), some("words")).alias("lines"))
    return F.filter(F.transform(blocks, lambda b, i: F.struct(F.filter(F.transform(b["paragraphs"], paragraph(i)), some("lines")).alias("paragraphs"))), some("paragraphs"))


def segments(blocks: Column) -> Column:
    """array<struct<text, confidence, bbox>>: the runs of sure words of each line that no wide gap parts.

    Words go from left to right, those at one place as they were read. A
    segment has its words' text, their mean confidence and the box around them.
    """

    def of_line(l: Column) -> Column:
        height = l["bbox"]["y1"] - l["bbox"]["y0"]
        sure = F.filter(l["words"], lambda w: w["confidence"] >= SEGMENT_FLOOR)
        ordered = F.array_sort(F.transform(sure, lambda w, i: F.struct(w["bbox"]["x0"].alias("x"), i.alias("i"), w.alias("w"))))

        def cut(words: Column) -> Column:
            # a word begins a segment if it stands too far behind the one before it
            begins = lambda o, i: (i == 0) | (o["x"] - F.get(words, i - 1)["w"]["bbox"]["x1"] > SEGMENT_GAP * height)
            starts = F.filter(F.transform(words, lambda o, i: F.when(begins(o, i), i)), lambda i: i.isNotNull())
            runs = lambda at: F.transform(at, lambda s, i: F.slice(words, s + 1, F.coalesce(F.get(at, i + 1), F.size(words)) - s))
            return F.transform(let(starts, runs), lambda r: let(F.transform(r, lambda o: o["w"]), _joined))

        return let(ordered, cut)

    return F.flatten(F.transform(lines_of(blocks), of_line))


def _joined(words: Column) -> Column:
    edge = lambda pick, c: pick(F.transform(words, lambda w: w["bbox"][c])).alias(c)
    mean = F.aggregate(words, F.lit(0.0), lambda s, w: s + w["confidence"]) / F.size(words)
    box = F.struct(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))
    return F.struct(F.trim(F.array_join(F.transform(words, lambda w: w["text"]), " ")).alias("text"), mean.alias("confidence"), box.alias("bbox"))


def anchor_points(tajik: Column, english: Column) -> Column:
    """array<struct<tx, ty, x, y>>: template and page place of every segment that an anchor's pattern names.

    By anchor, then by segment; a segment can be several anchors'.
    """

    def of(source: str, pattern: str, excluded: str | None, x: int, y: int) -> Column:
        def hit(s: Column) -> Column:
            named = s["text"].rlike(f"(?iu){pattern}")
            return named & ~s["text"].rlike(f"(?iu){excluded}") if excluded else named

        found = F.filter(tajik if source == "tajik" else english, hit)
        return F.transform(found, lambda s: F.struct(F.lit(float(x)).alias("tx"), F.lit(float(y)).alias("ty"), s["bbox"]["x0"].alias("x"), s["bbox"]["y0"].alias("y")))

    return F.flatten(F.array(*[of(*a) for a in T.ANCHORS]))
