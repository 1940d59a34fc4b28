"""Helpers that the training-data operators share: inputs, shared storage, joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One white-space character of the word rule `[^\x20\x09-\x0D]+`.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Only where that is unset on a
    local master, as in tests, a temporary folder is made and kept for the
    session; elsewhere executors could not read it, which is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="attesta-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "table") -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage ends here."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared store that nothing reads any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 8, how: str = "inner") -> DataFrame:
    """Join big to small (one row per key) so that a hot key of big is dealt to `salts` tasks.

    `spread` is an expression over big that differs between rows of one key.
    Both sides get their own exchange, so adaptive execution can split further.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, at most `rows` at a time, so that what a task makes of them does not grow with its batches."""
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            yield whole.slice(start, rows)
