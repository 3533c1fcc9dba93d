"""The corpus pipeline: language, repeated lines, near-duplicates, source mix, packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` writes each
stage's rows as Parquet in the shared folder and reads them as the next one's documents.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codemix import session
from codemix.llm import langid, line_dedup, mixing, near_dedup, packing
from codemix.llm.registered import BPE, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the network's language; documents without a letter or text go.

    Where no language could be learned, documents with a letter stay with their lang.
    """
    session.small_batches(spark)
    network = langid.train(docs)
    if not network.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.identify(docs, network).filter(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go; n_chars follows the text."""
    session.small_batches(spark)
    kept = line_dedup.dedup_lines(docs, min_docs=10)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: the document of the smallest id stays of each group."""
    session.small_batches(spark)
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh as the square root of their size; copies are shuffled globally."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 by minimum bin slack, one row per piece."""
    session.small_batches(spark)
    return packing.pack(docs, tokenizer_file(BPE))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Language ID is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    session.ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = session.scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
