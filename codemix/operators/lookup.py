"""Left join of exploded tokens with a word table, safe for very frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codemix.session import BROADCAST_BYTES, fits_broadcast

SALTS = 64
HOT_PER_PARTITION = 4
CELLS = 1 << 16


def hot_keys(tokens: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys with more rows than a fraction of a fair partition; None if there is none.

    At most HOT_PER_PARTITION x partitions keys can exceed that share, so the
    list is bounded whatever the data.  Rows are counted by hash cells first; single keys only
    in cells that exceed the share, which every such key's cell does.  So the exchange holds no
    row per key of a large vocabulary.
    """
    spark = tokens.sparkSession
    bound = HOT_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS)).cast("int").alias("_cell")
    cells = tokens.groupBy(cell).agg(F.count(F.lit(1)).alias("_n")).collect()  # at most CELLS rows
    rows = sum(r["_n"] for r in cells)
    full = [(r["_cell"],) for r in cells if r["_n"] * bound > rows]
    if not full:
        return None
    few = tokens.select(*keys, cell).join(F.broadcast(spark.createDataFrame(full, "_cell int")), "_cell", "left_semi")
    counts = few.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") * bound > rows).select(*keys).collect()
    return spark.createDataFrame([tuple(r) for r in hot], tokens.select(*keys).schema) if hot else None


def lookup(tokens: DataFrame, table: DataFrame, keys: list[str], spread: Column,
           limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """``tokens LEFT JOIN table USING (keys)``; ``table`` is unique on ``keys``.

    A table of measured small size is broadcast.  A larger one is joined by
    shuffle; the rows of frequent keys are spread over ``salts`` tasks and only
    their table rows are copied that often.
    """
    if fits_broadcast(table, limit):
        return tokens.join(F.broadcast(table), keys, "left")
    hot = hot_keys(tokens, keys)
    if hot is None:
        return tokens.join(table, keys, "left")
    # keys with a null match nothing, but they are spread as well: as text, null is a key like any other
    name = lambda: F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    flagged = F.broadcast(hot.select(name().alias("_name"), F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = tokens.withColumn("_name", name()).join(flagged, "_name", "left").withColumn("_salt", salt).drop("_hot", "_name")
    copied = table.withColumn("_name", name()).join(flagged, "_name", "left").withColumn(
        "_salt", F.explode(copies)).drop("_hot", "_name")
    return salted.join(copied, [*keys, "_salt"], "left").drop("_salt")
