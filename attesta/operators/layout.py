"""Fields by the layout of a page: label lines, and the values beside or below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import tables as T
from attesta.functions import text as X
from attesta.sources.tables import WORD_FLOOR

#: Words that a label spans at most, and the confidence from which a word or line near it is its value.
LABEL_WORDS, VALUE_FLOOR = 5, 40.0
PAGE = ["doc_id", "side"]


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, side, block_no, par_no, line_no, text, confidence, bbox, words) in the order of the page.

    Texts are cleaned, empty words left out, and lines that are empty or below
    the floor dropped. `at` numbers the lines from the top, then from the left.
    """
    words = F.filter(F.transform("words", lambda w: F.struct(X.clean_value(w["text"]).alias("text"), w["confidence"].alias("confidence"), w["bbox"].alias("bbox"))), lambda w: w["text"] != "")
    kept = lines.withColumn("text", X.clean_value(F.col("text"))).withColumn("words", words).where((F.col("text") != "") & (F.col("confidence") >= WORD_FLOOR))
    w = Window.partitionBy(*PAGE).orderBy("bbox.y0", "bbox.x0", "block_no", "par_no", "line_no")
    return kept.select(*PAGE, F.row_number().over(w).alias("at"), "text", "confidence", "bbox", "words")


def _spans(words: Column) -> Column:
    """The runs of up to LABEL_WORDS words, by their first and then by their last word: struct(text, words)."""
    from_ = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LABEL_WORDS), F.size(words) - i)), lambda n: F.slice(words, i + 1, n))
    runs = F.flatten(F.transform(words, lambda w, i: from_(i)))
    return F.transform(runs, lambda r: F.struct(F.array_join(F.transform(r, lambda w: w["text"]), " ").alias("text"), r.alias("words")))


def _around(words: Column) -> Column:
    edge = lambda pick, c: pick(F.transform(words, lambda w: w["bbox"][c])).alias(c)
    return F.struct(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))


def _some(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def _by_field(field: Column, of) -> Column:
    """of(patterns) of the field whose labels they are."""
    out = None
    for f, patterns in T.FIELD_LABELS.items():
        out = F.when(field == f, of(patterns)) if out is None else out.when(field == f, of(patterns))
    return out


def _labels(field: Column, text: Column) -> Column:
    return _by_field(field, lambda patterns: text.rlike("|".join(f"(?:{X.label(p)})" for p in patterns)))


def _without_label(field: Column, text: Column) -> Column:
    def rest(patterns: list[str]) -> Column:
        out = text
        for p in patterns:
            out = X.remove_first(out, X.label(p))
        return out

    return X.clean_value(_by_field(field, rest))


def page_fields(lines: Column) -> Column:
    """array<struct<field, value, confidence>>: the layout fields of a page, from its lines in the order of the page.

    lines: array<struct<text, confidence, bbox, words>> as `cleaned` has them.
    A label's value stands beside it, else in a word below it, else in a line
    below it; of several the nearest valid one with enough confidence counts,
    of equally near ones the first. Confidence is the lower one of label and
    value. Of the labels of a field the one with the most confident value
    counts, the first of equal ones. A label's box is that of the first run of
    words that shows it, else the line's.

    Everything is searched for in the row: a page's lines are few, and only
    words and lines that stand right are validated. Null lines have no fields.
    The lines are read for every label, so they are put in order once before.
    """
    return X.let(lines, _page_fields)


def _page_fields(lines: Column) -> Column:
    names = F.array(*[F.lit(f) for f in T.FIELD_LABELS])
    # most lines show no label at all, which one pattern tells
    any_ = "|".join(f"(?:{X.label(p)})" for patterns in T.FIELD_LABELS.values() for p in patterns)
    labels = lambda l: F.when(l["text"].rlike(any_), F.filter(names, lambda f: _labels(f, l["text"]))).otherwise(F.slice(names, 1, 0))
    hits = F.flatten(F.transform(lines, lambda l, at: F.transform(labels(l), lambda f: F.struct(f.alias("field"), at.alias("at"), l.alias("line")))))
    key = lambda h, v: F.struct(h["field"].alias("field"), (-F.floor(v["confidence"] + 0.5)).cast("double").alias("k"), h["at"].alias("at"), v["value"].alias("value"))
    valued = F.transform(hits, lambda h: X.let(_value(h, lines), lambda v: F.when(v.isNotNull(), key(h, v))))
    best = lambda vs: _some(F.transform(names, lambda f: F.array_min(F.filter(vs, lambda v: v["field"] == f))))
    return F.transform(X.let(valued, best), lambda v: F.struct(v["field"].alias("field"), v["value"].alias("value"), (-v["k"]).alias("confidence")))


#: Ways in which a value stands by its label, in order of trust.
BESIDE, WORD_BELOW, LINE_BELOW = range(3)


def _value(h: Column, lines: Column) -> Column:
    """struct<value, confidence> of a label hit (field, at, line), or null."""
    seen, own = h["line"]["confidence"], h["line"]["bbox"]
    run = F.get(F.filter(_spans(h["line"]["words"]), lambda s: _labels(h["field"], s["text"])), F.lit(0))["words"]
    box = X.let(run, lambda r: F.coalesce(F.when(r.isNotNull(), _around(r)), own))

    def candidate(way: int, far: Column, at: Column, no: Column, raw: Column, sure: Column) -> Column:
        return F.struct(F.lit(way).alias("way"), far.cast("double").alias("far"), at.alias("at"), no.alias("no"), raw.alias("raw"), sure.alias("seen"))

    def around(label: Column) -> Column:
        height = F.greatest(F.lit(1.0), label["y1"] - label["y0"])

        def word(w: Column, at: Column, no: Column) -> Column:
            b = w["bbox"]
            gap = b["y0"] - label["y1"]
            aside = F.abs((b["x0"] + b["x1"]) / 2 - (label["x0"] + label["x1"]) / 2)
            ok = (w["confidence"] >= VALUE_FLOOR) & gap.between(-0.2 * height, 3.5 * height) & (aside <= F.greatest(label["x1"] - label["x0"], 3 * height))
            return F.when(ok, candidate(WORD_BELOW, F.greatest(F.lit(0.0), gap) + 0.25 * aside, at, no, w["text"], w["confidence"]))

        def line(l: Column, at: Column) -> Column:
            b = l["bbox"]
            drop = b["y0"] - label["y1"]
            ok = (at != h["at"]) & (l["confidence"] >= VALUE_FLOOR) & drop.between(-0.25 * height, 3.5 * height) & (b["x1"] >= own["x0"] - height) & (b["x0"] <= own["x1"] + 5 * height)
            return F.when(ok & ~l["text"].rlike(X.label(T.LINE_LABELS)), candidate(LINE_BELOW, F.greatest(F.lit(0.0), drop) + 0.2 * F.abs(b["x0"] - own["x0"]), at, F.lit(0), l["text"], l["confidence"]))

        beside = candidate(BESIDE, F.lit(0.0), h["at"], F.lit(0), _without_label(h["field"], h["line"]["text"]), seen)
        words = F.flatten(F.transform(lines, lambda l, at: F.transform(l["words"], lambda w, no: word(w, at, no))))
        return F.concat(F.array(beside), _some(words), _some(F.transform(lines, line)))

    def valid(c: Column) -> Column:
        known = lambda v: F.when(v.isNotNull(), F.struct(c["way"].alias("way"), c["far"].alias("far"), c["at"].alias("at"), c["no"].alias("no"), v.alias("value"), F.least(seen, c["seen"]).alias("confidence")))
        return X.let(X.validate_field(h["field"], c["raw"]), known)

    return F.array_min(_some(F.transform(X.let(box, around), valid)))


def cleaned(lines: Column) -> Column:
    """A page's lines as page_fields takes them: texts cleaned, empty words left out, lines empty or below the floor dropped, from the top and then from the left."""
    word = lambda w: F.struct(X.clean_value(w["text"]).alias("text"), w["confidence"].alias("confidence"), w["bbox"].alias("bbox"))
    kept = F.filter(F.transform(lines, lambda l, i: F.struct(
        l["bbox"]["y0"].alias("y"), l["bbox"]["x0"].alias("x"), i.alias("i"), X.clean_value(l["text"]).alias("text"), l["confidence"].alias("confidence"), l["bbox"].alias("bbox"), l["words"].alias("words")
    )), lambda l: (l["text"] != "") & (l["confidence"] >= WORD_FLOOR))
    whole = lambda l: F.struct(l["text"].alias("text"), l["confidence"].alias("confidence"), l["bbox"].alias("bbox"), F.filter(F.transform(l["words"], word), lambda w: w["text"] != "").alias("words"))
    return F.transform(F.array_sort(kept), whole)


def layout_fields(lines: DataFrame) -> DataFrame:
    """(doc_id, side, field, value, confidence) of pages from their lines as the readers give them; a page's lines meet in one row."""
    of_page = F.transform(F.sort_array(F.collect_list(F.struct("block_no", "par_no", "line_no", "text", "confidence", "bbox", "words"))), lambda l: F.struct(*[l[c].alias(c) for c in ("text", "confidence", "bbox", "words")]))
    found = lines.groupBy(*PAGE).agg(of_page.alias("l")).select(*PAGE, F.explode(X.let(cleaned(F.col("l")), page_fields)).alias("f"))
    return found.select(*PAGE, "f.*")


def drop_label_values(facts: DataFrame) -> DataFrame:
    """Facts without those whose value is a label's own text, and without implausible names."""
    value = F.col("value")
    label = F.trim(value).rlike(X.label(T.VALUE_LABELS)) | X.english_label_text(value)
    return facts.where(~label & (~F.col("field").isin(T.NAME_FIELDS) | X.plausible_name(value)))


def best_page(pages: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """Of a side's pages (keys, seq, confidence, …) the one with the highest confidence plus three for each layout field.

    fields: (keys, seq, field) of what the layout of each page gives. Ties fall to the first page.
    """
    n = fields.groupBy(*keys, "seq").agg(F.count(F.lit(1)).alias("n"))
    scored = pages.join(n, [*keys, "seq"], "left").withColumn("score", F.col("confidence") + 3 * F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "seq")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "n")


def zone_page_order(pages: DataFrame, best: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """The pages on which the machine-readable zone is read: the best one and then the first of the others."""
    first = best.select(*keys, F.col("seq").alias("_best"))
    w = Window.partitionBy(*keys).orderBy((F.col("seq") != F.col("_best")).cast("int"), "seq")
    return pages.join(first, keys).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most).drop("_best")


def best_zone_read(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Of (keys, turn, area, seq, score, confidence) zone reads the one with the most check points, counted tenfold, plus confidence.

    Of equal ones the earlier turn, then the earlier area, then the smaller seq counts. Areas are
    numbered from 0; where more than one was tried, the fallback area is read on the first page only.
    """
    areas = F.max("area").over(Window.partitionBy(*keys))
    w = Window.partitionBy(*keys).orderBy((F.coalesce("score", F.lit(0)) * 10 + F.col("confidence")).desc(), "turn", "area", "seq")
    tried = reads.withColumn("_areas", areas).where((F.col("turn") == 1) | (F.col("_areas") == 0) | (F.col("area") != 1))
    return tried.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_areas")


def zone_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The three lowest lines of 24 to 36 characters of the machine-readable alphabet, from the top."""
    n = F.length(F.regexp_replace(F.upper("text"), "[^A-Z0-9<]", ""))
    w = Window.partitionBy(*keys).orderBy(F.col("y0").desc(), F.col("seq").desc())
    low = lines.where(n.between(24, 36)).withColumn("_r", F.row_number().over(w)).where("_r <= 3")
    return low.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("y0", "seq"))).drop("_r")
