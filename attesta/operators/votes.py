"""Votes over repeated reads and merges of facts. Every order is total: ties fall to the earlier `seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def first_to_two(reads: DataFrame, keys: list[str], floor: float | None = None) -> DataFrame:
    """Winner of (keys, seq, value, confidence) reads that are taken in order until a value comes a second time.

    Its confidence is the largest of the reads taken; without a second one the
    most confident value wins, the first of equal ones. Null values are no
    reads. With a floor, one read alone must reach it.
    """
    by_value = Window.partitionBy(*keys, "value").orderBy("seq")
    some = reads.where(F.col("value").isNotNull()).withColumn("_n", F.row_number().over(by_value))
    stop = F.min(F.when(F.col("_n") == 2, F.col("seq"))).over(Window.partitionBy(*keys))
    taken = some.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("seq") <= F.col("_stop")))
    votes = taken.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("votes"), F.max("confidence").alias("confidence"), F.min("seq").alias("first_seq"))
    won = _one(votes, keys, F.col("votes").desc(), F.col("confidence").desc(), F.col("first_seq"))
    return won if floor is None else won.where((F.col("votes") >= 2) | (F.col("confidence") >= floor))


def best_read(reads: DataFrame, keys: list[str], enough: float = 92.0, floor: float = 0.0) -> DataFrame:
    """The first read with `enough` confidence, else the most confident one, the first of equal ones."""
    some = reads.where(F.col("value").isNotNull() & (F.col("confidence") >= floor))
    early = F.col("confidence") >= enough
    return _one(some, keys, early.desc(), F.when(early, F.col("seq")), F.col("confidence").desc(), F.col("seq"))


def first_read(reads: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """The first read that was parsed and reaches the floor."""
    return _one(reads.where(F.col("value").isNotNull() & (F.col("confidence") >= floor)), keys, F.col("seq"))


def distinct_reads(reads: DataFrame, keys: list[str], most: int = 2, first_confidence: bool = False) -> DataFrame:
    """The first `most` different values in read order, with the largest confidence of their reads, or that of the first one."""
    seen = F.min_by("confidence", "seq") if first_confidence else F.max("confidence")
    first = reads.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.min("seq").alias("seq"), seen.alias("confidence"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where(F.col("place") <= most)


def take_while(lines: DataFrame, keys: list[str], order: str, ok: Column) -> DataFrame:
    """Rows before the first that is not ok."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_ok", F.min(F.coalesce(ok, F.lit(False)).cast("int")).over(w)).where("_ok = 1").drop("_ok")


def joined_lines(lines: DataFrame, keys: list[str], order: str, low: float = 50.0, high: float = 90.0) -> DataFrame:
    """Lines joined with commas in order, with their mean confidence between two bounds."""
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    mean = F.floor(F.avg("confidence") + 0.5)
    return lines.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["t"]), ", ").alias("value"), F.greatest(F.lit(low), F.least(F.lit(high), mean)).alias("confidence"))


def merge_facts(facts: DataFrame, keys: list[str], floor: float = 35.0) -> DataFrame:
    """Of (keys, value, confidence, src_rank) facts the most confident of at least floor, then the earlier source."""
    return _one(facts.where(F.col("value").isNotNull() & (F.col("value") != "") & (F.col("confidence") >= floor)), keys, F.col("confidence").desc(), F.col("src_rank"))


def tiered_merge(facts: DataFrame, keys: list[str], floor: float = 35.0) -> DataFrame:
    """As merge_facts, but any fact of a lower tier number beats those of a higher one at any confidence."""
    ok = facts.where(F.col("value").isNotNull() & (F.col("value") != "") & (F.col("confidence") >= floor))
    return _one(ok, keys, F.col("tier"), F.col("confidence").desc(), F.col("src_rank"))


def wide(facts: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key with a column for each field; unknown is NULL."""
    return facts.groupBy(*keys).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def missing_fields(docs: DataFrame, facts: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, field) of the fields that a document has no value for."""
    every = docs.select("doc_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    known = facts.where(F.coalesce(F.trim("value"), F.lit("")) != "").select("doc_id", "field")
    return every.join(known, ["doc_id", "field"], "left_anti")


def anything_known(facts: DataFrame) -> DataFrame:
    """(doc_id, known): whether any field of a document is not blank."""
    return facts.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.trim("value"), F.lit("")) != "").alias("known"))


def latest_attempts(facts: DataFrame, keys: list[str], attempt: str) -> DataFrame:
    """Facts of the latest attempt only: results of superseded ones are dropped."""
    return facts.withColumn("_last", F.max(attempt).over(Window.partitionBy(*keys))).where(F.col(attempt) == F.col("_last")).drop("_last")


def with_edits(facts: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, confidence, source): facts with a log of corrections (keys, value, at) over them.

    Of the corrections of a field the last one counts, whatever the fact's
    confidence; of several at one time the largest text, null before any. A
    null takes the correction back, so the fact holds again; an empty text
    empties the field. A corrected field has neither confidence nor source. A
    field that only a correction names gets a row; facts have one row a key.

    Both sides are aggregated by key in one shuffle, corrections in part
    before it, however many there are of one field.
    """
    cols = [*keys, "value", "confidence", "source"]
    known = facts.select(*cols, F.lit(None).cast("struct<at: bigint, text: string>").alias("edit"), F.lit(True).alias("fact"))
    logged = edits.select(*keys, F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source"), F.struct(F.col("at").cast("bigint").alias("at"), F.col("value").alias("text")).alias("edit"), F.lit(False).alias("fact"))
    own = lambda c: F.max(F.when(F.col("fact"), F.col(c))).alias(c)
    both = known.unionByName(logged).groupBy(*keys).agg(own("value"), own("confidence"), own("source"), F.max("edit")["text"].alias("text"), F.bool_or("fact").alias("fact"))
    kept = both.where(F.col("fact") | F.col("text").isNotNull())
    edited = F.col("text").isNotNull()
    return kept.select(*keys, F.coalesce("text", "value").alias("value"), F.when(~edited, F.col("confidence")).alias("confidence"), F.when(~edited, F.col("source")).alias("source"))
