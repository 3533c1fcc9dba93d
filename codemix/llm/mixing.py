"""Mixing sources to target weights by Poisson replication.

A source whose share should be w of ``total`` rows gives each of its n documents a mean
number of copies of ``total * w / n``.  A document's number of copies inverts the Poisson
distribution of that mean at a draw that is hashed from (seed, doc_id): it depends on
nothing else, so retries, other partitions and other documents do not change it.  Copies
are exploded and dealt out by a hashed order key, which shuffles them globally and spreads
every source over all partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from codemix.functions.draw import draw, uniform

TEMPERATURE = 0.5
SEED = 17


def poisson_steps(mean: Column) -> Column:
    """Cumulated Poisson probabilities of 0, 1, 2, ... up to a tail below any draw.

    Terms are kept as logarithms, so large means neither overflow nor vanish.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    zero = F.struct((-mean).alias("log"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("steps"))

    def add(state: Column, k: Column) -> Column:
        total = state["sum"] + F.exp(state["log"])
        return F.struct((state["log"] + F.log(mean) - F.log((k + 1).cast("double"))).alias("log"), total.alias("sum"),
                        F.concat(state["steps"], F.array(total)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(0), last), zero, add, lambda s: s["steps"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None,
          temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n, rate): the mean number of copies of each source's documents.

    ``weights`` names relative target shares; sources it leaves out get none.  Without it
    a source weighs n ** ``temperature``.  ``total`` defaults to the number of rows.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        if any(not math.isfinite(w) or w < 0 for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()] or [(None, 0.0)],
                                                  "_source string, weight double")
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = sizes.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    whole, rows = sums["weight"] or 0.0, total if total is not None else sums["n"] or 0
    scale = rows / whole if whole else 0.0
    return sizes.select("source", "n", (F.lit(float(scale)) * F.col("weight") / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None,
                temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Replicate documents to the target weights and shuffle them.

    ``docs`` needs doc_id and source.  Returns its columns plus ``n_copies``, ``copy`` (from
    1) and ``order_key`` (columns of these names are replaced); rows come in the order of
    order_key within each partition.  A null source is a source of its own; rows that share
    a doc_id, null included, share their draw; a rate of 0 gives no copies; an empty table
    gives an empty one.  Documents of a rate below 1 may get no copy: that is the mixing.
    """
    own = ("n_copies", "copy", "order_key")
    keep = [c for c in docs.columns if c not in own]
    table = rates(docs, weights, total, temperature).select(
        F.col("source").alias("_mix_source"),
        F.when(F.col("rate") > 0, poisson_steps(F.col("rate"))).alias("_mix_steps"))
    drawn = docs.select(*keep).join(table, F.col("source").eqNullSafe(F.col("_mix_source")))
    point = uniform(seed, F.col("doc_id"), 0, "copies")
    copies = drawn.withColumn("_mix_at", point).withColumn("n_copies", F.when(
        F.col("_mix_steps").isNull(), 0).otherwise(F.size(F.filter("_mix_steps", lambda s: s <= F.col("_mix_at")))))
    dealt = (copies.filter(F.col("n_copies") > 0)
             .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
             .withColumn("order_key", draw(seed, F.col("doc_id"), F.col("copy"), "order")))
    return dealt.select(*keep, *own).repartition("order_key", "doc_id", "copy").sortWithinPartitions(
        "order_key", "doc_id", "copy")
