"""Sentence vectors: pooling, in-batch pairs, contrastive loss."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from codemix.functions.arrays import let
from codemix.session import BROADCAST_BYTES, broadcast_if_small, stored

MAX_BATCH = 4096
BLOCK = 4096
TILE = 512


def mean_pool(df: DataFrame, vecs: str = "vecs", mask: str = "mask") -> DataFrame:
    """Mean of the token vectors whose mask is set; row-local.

    ``vecs`` is an array of vectors, ``mask`` an array of booleans.
    """
    kept = F.filter(F.zip_with(vecs, mask, lambda v, m: F.when(m, v)), lambda v: v.isNotNull())

    def mean(ks: Column) -> Column:
        total = F.aggregate(
            ks, F.transform(F.get(ks, F.lit(0)), lambda _: F.lit(0.0)),
            lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
        return F.transform(total, lambda t: t / F.size(ks))

    return df.withColumn("pooled", let(kept, mean))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """Vector divided by its norm (the norm is floored at 1e-8)."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-8))
    return let(norm, lambda n: F.transform(v, lambda x: x.cast("double") / n))


def batch_pairs(anchors: DataFrame, contrasts: DataFrame, max_batch: int = MAX_BATCH) -> DataFrame:
    """All anchor-contrast pairs of a batch: an equi-join on ``batch_id``.

    A batch is bounded by construction; one with too many anchors or contrasts fails
    instead of growing with its square.  Inputs hold ``batch_id, pos, vec``.
    """
    a = _bounded(anchors, max_batch).select("batch_id", F.col("pos").alias("j"), F.col("vec").alias("a"))
    c = _bounded(contrasts, max_batch).select("batch_id", F.col("pos").alias("i"), F.col("vec").alias("c"))
    return a.join(c, "batch_id")


def _bounded(df: DataFrame, max_batch: int) -> DataFrame:
    sizes = df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.assert_true(
        F.col("n") <= max_batch, F.lit(f"a batch holds more than {max_batch} rows")).isNull()).select("batch_id")
    return df.join(small, "batch_id")


def collect_batches(vecpairs: DataFrame, max_batch: int = MAX_BATCH) -> DataFrame:
    """``batch_id, anchors, contrasts`` (arrays of unit vectors in batch order).

    Rows are counted before they are collected, so an oversized batch fails early.
    """
    rows = _bounded(vecpairs, max_batch).select("batch_id", "pos", unit(F.col("a")).alias("a"), unit(F.col("c")).alias("c"))
    cells = F.sort_array(F.collect_list(F.struct("pos", "a", "c")))
    return (rows.groupBy("batch_id").agg(cells.alias("cells"))
            .select("batch_id", F.col("cells.a").alias("anchors"), F.col("cells.c").alias("contrasts")))


def _matrix(rows: pa.Table) -> np.ndarray:
    vecs = rows.column("vec").combine_chunks()
    return vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1)


def _log_sums(tau: float):
    """Per anchor of a block: largest similarity to a block of contrasts, and the sum of exponentials above it."""

    def run(anchors: pa.Table, contrasts: pa.Table) -> pa.Table:
        a, c = _matrix(anchors), _matrix(contrasts)
        top, total = np.full(len(a), -np.inf), np.zeros(len(a))
        for at in range(0, len(c), TILE):
            sims = a @ c[at:at + TILE].T / tau
            high = np.maximum(top, sims.max(axis=1))
            total = total * np.exp(top - high) + np.exp(sims - high[:, None]).sum(axis=1)
            top = high
        return anchors.select(["batch_id", "pos", "own"]).append_column(
            "top", pa.array(top)).append_column("total", pa.array(total))

    return run


def contrastive_loss(vecpairs: DataFrame, tau: float = 0.1, max_batch: int | None = None, block: int = BLOCK,
                     limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per batch: sum over anchors of -log softmax over contrasts of cos / tau at the own pair.

    Rows are ``batch_id, pos, a, c``; positions are unique in a batch, vectors of a batch have one
    length, and pairs that lack a vector take no part.  A batch may be of any size, unless
    ``max_batch`` makes larger ones an error: it is cut
    into blocks of ``block`` positions, and a task multiplies one block of anchors with one of
    contrasts, TILE contrasts at a time, under a running maximum and sum.  Vectors travel once
    for every block of their batch, similarities never; a small ``tau`` does not overflow.
    """
    if max_batch is not None:
        vecpairs = _bounded(vecpairs, max_batch)
    whole = vecpairs.filter("a IS NOT NULL AND c IS NOT NULL").select(
        "batch_id", "pos", unit(F.col("a")).alias("a"), unit(F.col("c")).alias("c"),
        F.floor(F.col("pos") / block).alias("block"))
    # only batches of several blocks, so at most one number for every block of rows
    several = (whole.select("batch_id", "block").distinct().groupBy(F.col("batch_id").alias("_batch"))
               .agg(F.sort_array(F.collect_list("block")).alias("blocks")).filter(F.size("blocks") > 1))
    several = broadcast_if_small(stored(several, "blocks"), limit)
    cut = whole.join(several, F.col("batch_id").eqNullSafe(F.col("_batch")), "left").withColumn(
        "other", F.explode(F.coalesce("blocks", F.array("block"))))
    own = dot(F.col("a"), F.col("c")) / tau
    anchors = cut.select("batch_id", "pos", F.col("a").alias("vec"), own.alias("own"),
                         F.col("block").alias("mine"), F.col("other").alias("theirs"))
    contrasts = cut.select(F.col("batch_id").alias("batch"), F.col("c").alias("vec"),
                           F.col("other").alias("across"), F.col("block").alias("at"))
    types = {f.name: f.dataType for f in whole.schema}
    schema = StructType([StructField(n, types[n]) for n in ("batch_id", "pos")]
                        + [StructField(n, DoubleType()) for n in ("own", "top", "total")])
    parts = anchors.groupBy("batch_id", "mine", "theirs").cogroup(
        contrasts.groupBy("batch", "across", "at")).applyInArrow(_log_sums(tau), schema)
    each = parts.groupBy("batch_id", "pos", "own").agg(
        F.max("top").alias("top"), F.sort_array(F.collect_list(F.struct("top", "total"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["total"] * F.exp(p["top"] - F.col("top")))
    return each.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("nsentences"), F.sum(F.col("top") + F.log(total) - F.col("own")).alias("loss"))


def reduce_loss(per_batch: DataFrame, *keys: str) -> DataFrame:
    """Summed loss per sentence in bits, as reported over workers."""
    return per_batch.groupBy(*keys).agg(
        F.sum("loss").alias("loss"), F.sum("nsentences").alias("nsentences"),
        (F.sum("loss") / F.sum("nsentences") / F.log(F.lit(2.0))).alias("contrastive_loss"))
