"""Exact deduplication: 128-bit content hash, byte comparison inside hash groups.

Texts are aggregated by (hash, bytes): the hash decides where a text goes and
the bytes decide what is equal, so two texts that collide stay apart. Copies
meet in the map-side combine before anything is shuffled, however many there
are of one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import salted_join


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per different text: h128, sha256, keep_id, group_size.

    A null text counts as the empty text. Should two different texts share
    both digests, the query stops with an error rather than merging them.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = rows.groupBy(F.unhex(F.md5("t")).alias("h128"), "t").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    named = texts.select("h128", F.sha2("t", 256).alias("sha256"), "keep_id", "group_size")
    once = named.groupBy("h128", "sha256").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both digests")).cast("long"))
    return once.select("h128", "sha256", "keep_id", checked.alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Equal means identical bytes after no change at all; null counts as empty.
    Of a group the row with the smallest (or largest) id stays. group_size
    counts rows. Rows that repeat both text and the kept id are all marked
    kept; `drop_exact` keeps one of them. An empty table gives no rows, and
    other columns of the input are ignored whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    keyed = rows.select("id", F.unhex(F.md5("t")).alias("h128"), F.sha2("t", 256).alias("sha256"))
    joined = salted_join(keyed, text_classes(docs, id_col, text_col, keep), ["h128", "sha256"], F.col("id"))
    return joined.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, whole and with all their columns; one for each different text.

    Whole rows travel through one aggregation by (hash, bytes), so a hot text
    shrinks to one row per task before the shuffle.
    """
    pick = {"smallest": F.min_by, "largest": F.max_by}[keep]
    cols = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # a null id loses against any other
    order = F.struct(F.col(f"`{id_col}`").isNull() if keep == "smallest" else F.col(f"`{id_col}`").isNotNull(), F.col(f"`{id_col}`"))
    kept = docs.select(F.unhex(F.md5(t)).alias("_h"), t.alias("_t"), row.alias("_row"), order.alias("_order")).groupBy("_h", "_t").agg(pick("_row", "_order").alias("_row"))
    return kept.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(cols)])
