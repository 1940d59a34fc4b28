"""Readers and writers: driver tables, recognised pages, image files and the wide form."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest image file and the types that are read.
MAX_BYTES = 20 * 1024 * 1024
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp")
WORD = "struct<text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>>"
PAGE = f"doc_id long, side string, blocks array<struct<paragraphs: array<struct<lines: array<struct<text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>, words: array<{WORD}>>>>>>>"
#: Confidence from which a word counts.
WORD_FLOOR = 25.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task takes where each stands for many.
DEALT_ROWS = 20_000


def dealt(df: DataFrame, key: str, rows: int = DEALT_ROWS) -> DataFrame:
    """df dealt by key to all cores, and to more tasks where these would have more than `rows` rows each: a task's memory does not grow with the table."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only on a local master where that is unset, as in tests, a temporary folder is made; elsewhere it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="attesta-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, kind: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, for a table that several plans read: it is worked out once and its lineage ends."""
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def image_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files under path by their leading bytes and size, from the binaryFile source."""
    files = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 12))
    kind = F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.rlike("^52494646.{8}57454250"), "image/webp")
    typed = files.withColumn("mime", kind)
    ok = F.col("mime").isin(*IMAGE_TYPES) & (F.col("length") <= MAX_BYTES)
    return typed.where(F.coalesce(ok, F.lit(False))), typed.where(~F.coalesce(ok, F.lit(False)))


def page_lines(pages: DataFrame) -> DataFrame:
    """Pages flattened to lines with block_no, par_no, line_no and their words."""
    # exploding only what is not empty would work out the blocks twice more, in a filter
    b = pages.select("doc_id", "side", F.posexplode_outer("blocks").alias("block_no", "b")).where("b is not null")
    p = b.select("doc_id", "side", "block_no", F.posexplode("b.paragraphs").alias("par_no", "p"))
    return p.select("doc_id", "side", "block_no", "par_no", F.posexplode("p.lines").alias("line_no", "l")).select("doc_id", "side", "block_no", "par_no", "line_no", "l.text", "l.confidence", "l.bbox", "l.words")


def page_words(pages: DataFrame) -> DataFrame:
    """Pages flattened to words in reading order."""
    lines = page_lines(pages).select("doc_id", "side", "block_no", "par_no", "line_no", F.posexplode("words").alias("word_no", "w"))
    return lines.select("doc_id", "side", "block_no", "par_no", "line_no", "word_no", "w.text", "w.confidence", "w.bbox.x0", "w.bbox.y0", "w.bbox.x1", "w.bbox.y1")


def line_text(lines: DataFrame, floor: float = WORD_FLOOR) -> DataFrame:
    """Lines with the text of their confident words; lines stay even if none is."""
    sure = F.filter("words", lambda w: (w["confidence"] >= floor) & (F.trim(w["text"]) != ""))
    return lines.withColumn("text", F.array_join(F.transform(sure, lambda w: w["text"]), " "))


def clean_page_text(pages: DataFrame, fallback: str = "text") -> DataFrame:
    """(doc_id, side, text): confident lines joined; a page's own text where none is left."""
    from attesta.functions.text import clean_text

    kept = line_text(page_lines(pages)).where("text <> ''")
    joined = kept.groupBy("doc_id", "side").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "par_no", "line_no", "text"))), lambda x: x["text"]), "\n").alias("joined"))
    own = F.col(fallback) if fallback in pages.columns else F.lit("")
    return pages.join(joined, ["doc_id", "side"], "left").select("doc_id", "side", clean_text(F.coalesce("joined", own)).alias("text"))


def write_wide(facts: DataFrame, path: str) -> None:
    """The wide form of facts as Parquet; unknown fields are empty strings."""
    from attesta.functions.tables import FIELDS
    from attesta.operators.votes import wide

    wide(facts, ["doc_id"], FIELDS).na.fill("", FIELDS).write.parquet(path)
