"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

Each source has a weight that changes over training, given as knots of a
piecewise-linear schedule. Its integral is the source's demand; the words
before a document in its source, as a share of that demand, are inverted
through the integral to the training position of the document.

Prefix sums are two-level: sums of small hash buckets first, then within a
bucket, so that no source is ever one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import SPACE, WORD

#: Hexadecimal digits of a document's hash that name its bucket: 65536 to a source.
BUCKET_DIGITS = 4
#: Weights by source in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: (time, factor) knots of the schedules, repeating likewise; each integrates to 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _hash(doc_id: Column, text: Column) -> Column:
    """The place of a row in its source's order: of id and text, so that rows without ids, or of one id, are dealt to all buckets."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(key, rank, source_size, target) for each source of (key, source, size) rows.

    Sources in code-point order, null last, weigh `weights`, repeating. They
    share `share` of all sizes; no target is over `most` times its source's
    size, and what is cut off goes to the others by weight. The level at which
    sources fill up is found from prefix sums over sources in the order in
    which they reach their limit. This table has a row per source.
    """
    per = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(
        order.rowsBetween(0, Window.unboundedFollowing)
    )
    per = per.withColumn("level", level)
    top = F.max(F.when(F.col("level") <= F.col("limit") / F.col("w"), F.col("level"))).over(Window.partitionBy())
    return per.select("key", "rank", "source_size", F.least("limit", F.coalesce(top, F.lit(float("inf"))) * F.col("w")).alias("target"))


def _position(y: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule's integral, as a share of the whole, reaches y."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    area, out = 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        need, slope = y * F.lit(total) - F.lit(area), (w1 - w0) / (t1 - t0)
        # w0*x + slope*x*x/2 = need, solved in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0)))
        time = F.lit(t0) + F.least(F.lit(2.0) * need / F.greatest(F.lit(w0) + root, F.lit(1e-300)), F.lit(t1 - t0))
        out = time if out is None else F.when(need > 0, time).otherwise(out)
        area += (t1 - t0) * (w0 + w1) / 2
    return F.greatest(F.least(out, F.lit(knots[-1][0])), F.lit(knots[0][0]))


def _scheduled(y: Column, rank: Column, schedules: tuple) -> Column:
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        out = F.when(F.pmod(rank, F.lit(len(schedules))) == i, _position(y, knots)).otherwise(out)
    return out


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column | None, weights: tuple, share: float, most: float) -> DataFrame:
    """Rows with what the mix decides on each: size, source_size, target, taken, passes, last_words, before, rank."""
    source = F.col(f"`{source_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), source.alias("source"), _key(source).alias("key"), word_count(F.col(f"`{text_col}`")).alias("size"),
        _hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"), *([row.alias("row")] if row is not None else []),
    ).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sums = rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(sums, weights, share, most)
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("base")).join(targets, "key")
    within = Window.partitionBy("key", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["key", "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    aim = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    full = F.coalesce(F.floor(F.try_divide(aim, F.col("source_size"))), F.lit(0)).cast("long")
    over = F.greatest(F.lit(0), F.least("size", aim - F.col("full") * F.col("source_size") - F.col("before"))).cast("long")
    placed = placed.withColumn("full", full).withColumn("over", over)
    whole = (F.col("over") == F.col("size")) & (F.col("size") > 0)
    return (
        placed.withColumn("taken", F.col("full") * F.col("size") + F.col("over"))
        .withColumn("passes", F.col("full") + whole.cast("long"))
        .withColumn("last_words", F.when(whole, F.lit(0)).otherwise(F.col("over")).cast("long"))
    )


def _time(copy: Column, words: Column, schedules: tuple) -> Column:
    """Training time of the middle of a copy; copy counts from 0."""
    done = (copy * F.col("source_size") + F.col("before")).cast("double") + words / F.lit(2.0)
    return _scheduled(F.try_divide(done, F.col("target")), F.col("rank"), schedules)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, schedules: tuple = SCHEDULES,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, passes, last_words, position.

    size is the number of words (null text: 0). A source gives whole passes
    over its documents and then, in hash order, as many words more as reach its
    target, the last document cut to fit: taken sums to the rounded target.
    `passes` counts whole copies, `last_words` the words of one more, partial
    copy; `position` in [0, 1] is the training time of the first copy, null if
    nothing is taken. Rows that repeat an id are separate rows, and ids may be
    null: the hash is of id and text, so such rows are many buckets unless
    their texts are equal too; those follow each other in one bucket, and
    reruns agree on what the equal rows get together. Sources may be null.
    An empty table gives no rows; other columns are ignored.
    """
    placed = _placed(docs, id_col, text_col, source_col, None, weights, share, most)
    first = _time(F.lit(0), F.least("size", "taken"), schedules)
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken", "passes", "last_words",
        F.when(F.col("taken") > 0, first).alias("position"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, for n below its number of words."""
    lead = F.when(text.rlike(f"^{SPACE}"), F.lit(1)).otherwise(F.lit(0))
    cut = F.split(text, F.lit(f"{SPACE}+"), (n + lead + F.lit(1)).cast("int"))
    return F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(F.element_at(cut, -1))), f"{SPACE}+$", "")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, schedules: tuple = SCHEDULES,
) -> DataFrame:
    """The mixed corpus in training order: the input's columns, a row for each copy taken.

    Documents that the mix does not take are absent; one taken twice is there
    twice; the partial copy that ends a source's share has its text cut after
    the words taken. Rows are range-sorted by training position.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    placed = _placed(docs, id_col, text_col, source_col, row, weights, share, most)
    whole = F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda k: k < F.col("passes")), lambda k: F.struct(k.alias("copy"), F.col("size").alias("words")))
    part = F.filter(F.array(F.struct(F.col("passes").cast("int").alias("copy"), F.col("last_words").alias("words"))), lambda c: c["words"] > 0)
    if most > 2:
        whole = F.transform(F.filter(F.sequence(F.lit(0), F.lit(int(most))), lambda k: k < F.col("passes")), lambda k: F.struct(k.alias("copy"), F.col("size").alias("words")))
    copies = placed.withColumn("c", F.explode(F.concat(whole, part))).withColumn("at", _time(F.col("c.copy"), F.col("c.words"), schedules))
    ordered = copies.select("at", "id", "c", "size", "row").repartitionByRange("at", "id").sortWithinPartitions("at", "id")
    out = []
    for i, c in enumerate(docs.columns):
        value = F.col(f"row.c{i}")
        if c == text_col:
            value = F.when(F.col("c.words") < F.col("size"), first_words(value, F.col("c.words"))).otherwise(value)
        out.append(value.alias(c))
    return ordered.select(*out)
