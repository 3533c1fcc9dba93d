"""Line corpora: one sentence per line, language as the last dot-suffix of the name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codemix.functions.text import unpaste
from codemix.session import broadcast_if_small

# A corpus is a file `name.lang` or a folder `name.lang` of part files.
NAME = r"([^/]+)\.([A-Za-z0-9_]+)(?:/part-[^/]*)?$"


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``corpus, lang, line_no, text`` with exact 0-based line numbers.

    Files are read in splits.  One counting pass gives every split its first
    line number; inside a split the position is the distance from its least
    monotonically increasing id.
    """
    raw = spark.read.text(list(paths)).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))
    corpus = F.regexp_extract("_file", NAME, 1)
    splits = raw.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    in_order = Window.partitionBy(F.regexp_replace("_file", r"/part-[^/]*$", "")).orderBy(
        F.length("_file"), "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_start", F.coalesce(F.sum("_lines").over(in_order), F.lit(0))).drop("_lines")
    return (
        raw.join(broadcast_if_small(starts), ["_file", "_block"])
        .select(corpus.alias("corpus"), F.regexp_extract("_file", NAME, 2).alias("lang"),
                (F.col("_start") + F.col("_id") - F.col("_first")).alias("line_no"), "text")
    )


def write_lines(df: DataFrame, path: str, order: str = "line_no", col: str = "text") -> None:
    """Write a text column in row order (a folder of part files; order = file order)."""
    df.select(order, col).orderBy(order).select(col).write.text(path)


def write_parallel(df: DataFrame, prefix: str, src_lang: str, tgt_lang: str, order: str = "line_no") -> None:
    """Write ``src`` and ``tgt`` as ``prefix.{lang}``; both sides share one order."""
    write_lines(df, f"{prefix}.{src_lang}", order, "src")
    write_lines(df, f"{prefix}.{tgt_lang}", order, "tgt")


def zip_lines(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Join corpora by line number; ``text`` of the k-th other becomes ``text_k``.

    Every line of the longest corpus stays; lines that a corpus lacks are null there
    and counted in ``n_missing``.
    """
    sides = [o.select("line_no", F.col("text").alias(f"text_{k}")) for k, o in enumerate(others, 1)]
    there = [F.col("_in").isNotNull()] + [F.col(f"_in_{k}").isNotNull() for k in range(1, len(others) + 1)]
    sides = [s.withColumn(f"_in_{k}", F.lit(True)) for k, s in enumerate(sides, 1)]
    out = reduce(lambda a, b: a.join(b, "line_no", "full"), sides, first.withColumn("_in", F.lit(True)))
    missing = reduce(lambda a, b: a + b, [(~t).cast("int") for t in there])
    return out.withColumn("n_missing", missing).drop("_in", *[f"_in_{k}" for k in range(1, len(others) + 1)])


def unpaste_lines(df: DataFrame, col: str = "text") -> DataFrame:
    """Split ``source ||| target`` lines."""
    return df.withColumn("src", unpaste(F.col(col), 1)).withColumn("tgt", unpaste(F.col(col), 2)).drop(col)
