"""A training corpus from raw documents: toxicity, exact and near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes each stage's result as Parquet in the shared folder and
reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from attesta.llm.common import discard, materialize, read
from attesta.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, scores under one half."""
    return toxicity.keep_clean(docs, toxicity.fit_on(docs, read(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more in five-word shingles, the document with the smallest doc_id."""
    return near_dedup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the source mix takes, in training order."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, in training order.

    The order of the mix is that of its files and of the rows in them, which a
    reader does not keep: rows go back to one partition a file and are sorted
    there, so that sequence ids ascend with the training position.
    """
    path = tokenizer_path("word_bpe_49k.json")
    # workers go on to other stages: fewer words are remembered here, and none once a task is done
    return packing.pack(in_file_order(docs.select("doc_id", "text")), lambda: packing.WordTokenizer(path, 200_000, 125_000))


def in_file_order(docs: DataFrame) -> DataFrame:
    """The rows of files in the order of the files' names and of the rows in them; rows that come from no file as they are."""
    files = sorted(path.rsplit("/", 1)[-1] for path in docs.inputFiles())
    if not files:
        return docs
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "_file int, _name string")
    place = docs.metadataColumn("_metadata")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    placed = docs.select(row.alias("row"), place["file_name"].alias("_name"), place["row_index"].alias("_at"))
    known = placed.join(F.broadcast(numbers), "_name")  # a row per file
    ordered = known.repartitionById(len(files), "_file").sortWithinPartitions("_at")
    return ordered.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]
#: The toxicity model, SimHash and the tokenizer have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        out, new = materialize(stage(spark, docs, sf_dir), "stage")
        if path:
            discard(spark, path)
        docs, path = out, new
    return docs
