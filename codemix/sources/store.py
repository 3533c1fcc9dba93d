"""Stored data sets: encoded pairs, vocabularies, splits in numbered parts, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codemix.operators.vocab import SPECIAL
from codemix.sources.lines import read_lines, write_lines


def write_encoded(df: DataFrame, path: str) -> None:
    """Parquet partitioned by ``split, direction, part`` (``direction`` is ``src-tgt``)."""
    df.write.partitionBy("split", "direction", "part").parquet(path)


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """``token count`` lines in id order; ``path`` ends in ``name.suffix``."""
    rows = vocab.select("id", F.concat_ws(" ", "token", F.col("cnt").cast("string")).alias("text"))
    write_lines(rows, path, "id")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``id, token, cnt``; the id follows from the line number."""
    line = F.col("text")
    return read_lines(spark, path).select(
        (F.col("line_no") + SPECIAL).alias("id"), F.regexp_extract(line, "^(.*) [0-9]+$", 1).alias("token"),
        F.substring_index(line, " ", -1).cast("bigint").alias("cnt"))


def load_split(spark: SparkSession, path: str, split: str, src: str, tgt: str, combine: bool = True) -> DataFrame:
    """Parts 0, 1, ... of a split up to the first gap; part 0 only without ``combine``.

    Each part may be stored as ``src-tgt`` or, failing that, as ``tgt-src``
    (then its sides are swapped).  A split without part 0 is an error.
    Partition pruning keeps the scan to the chosen folders.
    """
    stored = read_encoded(spark, path).filter(F.col("split") == split)
    forward, backward = f"{src}-{tgt}", f"{tgt}-{src}"
    known = {(r["part"], r["direction"]) for r in
             stored.filter(F.col("direction").isin(forward, backward)).select("part", "direction").distinct().collect()}
    chosen: list[tuple[int, str]] = []
    while True:
        k = len(chosen)
        found = next((d for d in (forward, backward) if (k, d) in known), None)
        if found is None or (chosen and not combine):
            break
        chosen.append((k, found))
    if not chosen:
        raise FileNotFoundError(f"split {split} for {forward} not found in {path}")

    ahead = [k for k, d in chosen if d == forward]
    swapped = [k for k, d in chosen if d == backward]
    cols = ["ex_id", "part"]
    a = stored.filter((F.col("direction") == forward) & F.col("part").isin(ahead)).select(
        *cols, "src", "tgt", "src_len", "tgt_len")
    b = stored.filter((F.col("direction") == backward) & F.col("part").isin(swapped)).select(
        *cols, F.col("tgt").alias("src"), F.col("src").alias("tgt"),
        F.col("tgt_len").alias("src_len"), F.col("src_len").alias("tgt_len"))
    return a if not swapped else b if not ahead else a.unionByName(b)


def rotate_part(df: DataFrame, epoch: int, n_parts: int, train: bool = True) -> DataFrame:
    """The part used in an epoch: ``(epoch - 1) mod n_parts`` for training, else part 0."""
    if epoch < 1:
        raise ValueError("epochs count from 1")
    return df.filter(F.col("part") == ((epoch - 1) % n_parts if train else 0))


def write_scores(df: DataFrame, path: str) -> None:
    """JSON lines, one folder per ``direction``."""
    df.write.partitionBy("direction").json(path)
