"""Shuffles and samples whose outcome depends only on seed, epoch and row id."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from codemix.functions.draw import SPAN, draw, uniform
from codemix.session import BROADCAST_BYTES, broadcast_if_small, dense_order, fits_broadcast, stored

FINE = 1 << 20
BUCKETS = 1 << 16
CELL_BITS = 16
SALTS = 64


def shuffle_pairs(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    """Random order of whole rows; the key stays in ``shuffle_key``."""
    return df.withColumn("shuffle_key", draw(seed, F.col(row_id), 0, "shuffle")).orderBy("shuffle_key", row_id)


def _levels(key: Column, row_id: str) -> list[Column]:
    """Total order of the rows: the key, then a hash of the id, then the id."""
    return [key.cast("double"), F.xxhash64(F.col(row_id)).cast("double"), F.col(row_id)]


def cutoff(df: DataFrame, key: Column, row_id: str, k, fine: int = FINE):
    """The k-th smallest (key, hash of id, id), or None when all rows are wanted.

    Rows of a null key are never taken.  ``k`` may be a function of the number of all rows.
    Returns the cut-off and how many rows lie up to it.  One pass gives the number and the
    range; histograms of at most BUCKETS cells narrow the key range, and inside one heavily
    shared key the hash range, until ``fine`` rows remain; only those are ranked.  Nothing
    larger than a histogram reaches the driver.
    """
    value, spread, row = _levels(key, row_id)
    open_rows = df.select(value.alias("k0"), spread.alias("k1"), row.alias("id"))
    total, rows, low, high = open_rows.agg(F.count(F.lit(1)), F.count("k0"), F.min("k0"), F.max("k0")).first()
    k, below = k(total) if callable(k) else k, 0
    if k <= 0:
        return None, 0
    if rows <= k:
        return None, rows
    open_rows = open_rows.filter(F.col("k0").isNotNull())
    for level in ("k0", "k1"):
        if rows <= fine:
            break
        if level == "k1":
            low, high = open_rows.agg(F.min(level), F.max(level)).first()
        while rows > fine and low < high:
            cell = F.least(F.floor((F.col(level) - low) / ((high - low) / BUCKETS)), F.lit(BUCKETS - 1))
            hist = (open_rows.filter(F.col(level).between(low, high)).groupBy(cell.alias("cell"))
                    .agg(F.count(F.lit(1)).alias("n"), F.min(level).alias("lo"), F.max(level).alias("hi")))
            for r in hist.orderBy("cell").collect():
                if below + r["n"] >= k:
                    low, high, rows = r["lo"], r["hi"], r["n"]
                    break
                below += r["n"]
        open_rows = open_rows.filter(F.col(level).between(low, high))
    rank = F.row_number().over(Window.orderBy("k0", "k1", "id"))
    found = open_rows.withColumn("r", rank).filter(F.col("r") == k - below).first()
    return (found["k0"], found["k1"], found["id"]), k


def smallest(df: DataFrame, key: Column, row_id: str, k, fine: int = FINE) -> DataFrame:
    """The k rows with the smallest key (ties by hash of the id): a cut-off, then a plain filter.

    ``k`` is a number, or a function of the number of rows; rows of a null key are left out.
    """
    cut, taken = cutoff(df, key, row_id, k, fine)
    if cut is None:
        return df.filter(key.isNotNull()) if taken else df.filter(F.lit(False))
    value, spread, row = _levels(key, row_id)
    v, h, i = (F.lit(c) for c in cut)
    return df.filter((value < v) | ((value == v) & ((spread < h) | ((spread == h) & (row <= i)))))


def group_cutoffs(df: DataFrame, key: Column, row_id: str, size: Callable[[Column], Column], *groups: str) -> DataFrame:
    """Per group the ``size(n)``-th smallest (key, hash of id, id): ``_g0.., _v, _h, _i``.

    A histogram of the leading half of the keys finds the cell each cut-off lies in; ids are
    gathered from those cells only, about one row in 2**CELL_BITS.  Counts are combined before
    they shuffle, and a window holds at most 2**CELL_BITS cells of a group, never its rows.
    Groups whose size is 0 have no row.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*groups, key.alias("_key"), F.col(row_id).alias("_i")).withColumn(
        "_cell", F.shiftright("_key", CELL_BITS))

    def before(order: str) -> Column:
        return F.sum("_n").over(Window.partitionBy(*groups).orderBy(order)) - F.col("_n")

    total = F.sum("_n").over(Window.partitionBy(*groups))
    bounds = (rows.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", before("_cell")).withColumn("_k", F.least(size(total), total))
              .filter("_before < _k AND _k <= _before + _n")
              .select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)],
                      F.col("_cell").alias("_at"), (F.col("_k") - F.col("_before")).alias("_need")))
    bounds = broadcast_if_small(stored(bounds, "cells"))
    own = reduce(and_, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names, strict=True)],
                 F.col("_cell") == F.col("_at"))
    order = Window.partitionBy(*names).orderBy("_key")
    near = (rows.join(bounds, own).groupBy(*names, "_need", "_key")
            .agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("_i").cast("double").alias("h"), "_i"))).alias("_ids"))
            .withColumn("_n", F.size("_ids"))
            .withColumn("_place", F.col("_need") - F.sum("_n").over(order) + F.col("_n"))
            .filter("_place BETWEEN 1 AND _n").withColumn("_last", F.get("_ids", (F.col("_place") - 1).cast("int"))))
    return near.select(*names, F.col("_key").alias("_v"), F.col("_last.h").alias("_h"), F.col("_last._i").alias("_i"))


def smallest_draws(df: DataFrame, key: Column, row_id: str, size: Callable[[Column], Column], *groups: str,
                   limit: int = BROADCAST_BYTES) -> DataFrame:
    """Of every group the ``size(n)`` rows with the smallest keys, n being its number of rows.

    ``key`` is a draw in [0, SPAN) and ``size`` may use the group columns.  Ties go by hash of the
    id, then by id.  A null group is a group; without ``groups`` all rows are one.  Row ids are
    unique and not null.

    Three scans whatever the number of groups: a histogram, the ids around the cut-offs, and a
    filter.  The cut-offs, one row a group, are broadcast up to ``limit`` bytes; more are joined
    by group and a salt of the key, so that no group is one task.
    """
    cuts = group_cutoffs(df, key, row_id, size, *groups)
    spread, row = F.xxhash64(F.col(row_id)).cast("double"), F.col(row_id)

    def upto(v: Column, h: Column, i: Column) -> Column:
        return (key < v) | ((key == v) & ((spread < h) | ((spread == h) & (row <= i))))

    if not groups:
        cut = cuts.first()
        return df.filter(F.lit(False) if cut is None else upto(*(F.lit(cut[c]) for c in ("_v", "_h", "_i"))))
    cuts = stored(cuts, "cuts")
    own = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    if fits_broadcast(cuts, limit):
        cuts = F.broadcast(cuts)
    else:
        cuts = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own.append(F.pmod(key, F.lit(SALTS)) == F.col("_salt"))
    return df.join(cuts, reduce(and_, own, upto(F.col("_v"), F.col("_h"), F.col("_i"))), "left_semi")


def sample_n(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """n random rows without replacement."""
    return smallest_draws(df, draw(seed, F.col(row_id), 0, "sample"), row_id, lambda _: F.lit(n).cast("bigint"))


def _epoch_seed(seed: int, epoch: int) -> str:
    return f"42:{seed % SPAN}:{epoch}"


def sample_size(n: int, ratio: float) -> int:
    if ratio > 1:
        raise ValueError("ratio must not exceed 1")
    return math.ceil(n * ratio)


def subsample(df: DataFrame, row_id: str, ratio: float, seed: int = 0, epoch: int = 1,
              weight: str | None = None) -> DataFrame:
    """ceil(n * ratio) rows without replacement, fresh for every epoch.

    With weights the smallest keys -ln(u)/w win (Efraimidis & Spirakis 2006);
    rows of weight 0 are never drawn.
    """
    sample_size(0, ratio)  # a wrong ratio fails at once
    if weight is None:
        return subsample_groups(df, row_id, F.lit(float(ratio)), seed, epoch)
    u = uniform(_epoch_seed(seed, epoch), F.col(row_id), 0, "subsample")
    return smallest(df, F.when(F.col(weight) > 0, -F.log(u) / F.col(weight)), row_id, lambda n: sample_size(n, ratio))


def subsample_groups(df: DataFrame, row_id: str, ratio: Column, seed: int = 0, epoch: int = 1, *groups: str) -> DataFrame:
    """``subsample`` of every group by itself, all groups at once.

    ``ratio`` is a column over the group columns; each group gives the rows that
    ``subsample`` of its rows alone would give.
    """
    key = draw(_epoch_seed(seed, epoch), F.col(row_id), 0, "subsample")
    return smallest_draws(df, key, row_id, lambda n: F.ceil(n * ratio), *groups)


def subsample_with_replacement(df: DataFrame, row_id: str, ratio: float, seed: int = 0, epoch: int = 1,
                               weight: str | None = None, block: int = FINE) -> DataFrame:
    """ceil(n * ratio) draws with replacement; ``draw_no`` numbers them.

    Rows own half-open intervals of the cumulative weight (any weight above 0 counts,
    fractions as well).  Draws are points; both are cut into cells of equal weight and
    merged by position inside a cell, so the work is linear and a heavy row is spread
    over cells.  There are enough cells that none holds more than about ``block`` rows
    of mean weight or 1000 draws.
    """
    spark = df.sparkSession
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    ranked = dense_order(df.select(F.col(row_id).alias("row_id"), w.alias("w")).filter("w > 0"), F.col("row_id"))
    blocked = ranked.withColumn("b", F.floor(F.col("rank") / block))
    sums = blocked.groupBy("b").agg(F.sum("w").alias("s"))
    starts = sums.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("base"))
    inner = Window.partitionBy("b").orderBy("rank")
    spans = (blocked.join(broadcast_if_small(starts), "b")
             .withColumn("upto", F.col("base") + F.sum("w").over(inner))
             .select("row_id", (F.col("upto") - F.col("w")).alias("lo"), F.col("upto").alias("hi")))
    whole = ranked.agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).first()
    total = whole["w"] or 0.0
    size = sample_size(df.count(), ratio)
    if total == 0 or size == 0:
        return df.filter(F.lit(False)).select(F.lit(0).cast("bigint").alias("draw_no"), F.col(row_id))
    cell = total / max(1, size // 1000, whole["n"] // block)
    starts_at = F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell)))
    rows = spans.select("row_id", "lo", starts_at.alias("cell")).select(
        "cell", F.greatest("lo", F.col("cell") * F.lit(cell)).alias("at"), F.lit(0).alias("kind"), "lo",
        "row_id", F.lit(None).cast("bigint").alias("draw_no"))
    key = _epoch_seed(seed, epoch)
    # 52 random bits as a fraction, which a double holds exactly
    share = (draw(key, F.col("id"), 0, "replace") * F.lit(1 << 20)
             + draw(key, F.col("id"), 1, "replace") % (1 << 20)) / F.lit(float(1 << 52))
    draws = spark.range(size).select("id", (share * F.lit(total)).alias("at")).select(
        F.floor(F.col("at") / cell).alias("cell"), "at", F.lit(1).alias("kind"), F.lit(0.0).alias("lo"),
        F.lit(None).cast("bigint").alias("row_id"), F.col("id").alias("draw_no"))
    merged = rows.unionByName(draws)
    owner = F.last("row_id", ignorenulls=True).over(
        Window.partitionBy("cell").orderBy("at", "kind", "lo").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (merged.withColumn("row", owner).filter(F.col("kind") == 1)
            .select("draw_no", F.col("row").alias(row_id)))
