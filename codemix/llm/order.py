"""Places of rows in the order of their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codemix.session import broadcast_if_small, stored


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """Add ``pos``, the 0-based place of a row in its group, and ``m``, the size of the group.

    One range exchange by (group, order), so a large group is spread over tasks; places are
    counted per partition, and a table of one row per group and partition holds where they start.
    ``group`` is never null.
    """
    done = stored(rows.orderBy(group, *order).withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn(
        "_part", F.shiftright("_at", 33))
    parts = done.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = stored(parts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                                 F.sum("_n").over(W.partitionBy(group)).alias("m")), "starts")
    return (done.join(broadcast_if_small(starts), [group, "_part"])
            .withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_part", "_first", "_before"))
