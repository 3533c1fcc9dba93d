"""What the two vector searches share: clean vectors, classes of equal ones, Arrow to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codemix.session import stored


def usable(vec: Column, zero: bool) -> Column:
    """Not null, no null or non-finite component; a zero vector only if ``zero``."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.lit(True) if zero else F.exists(vec, lambda x: x != 0)
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite & some, F.lit(False))


def commonest_size(rows: DataFrame) -> int:
    """The number of components most vectors have (the smaller one on a tie); 0 without rows."""
    first = (rows.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "size").first())
    return first["size"] if first else 0


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(rep, ids, vec): one row per distinct vector with its ``keep`` smallest ids.

    No search returns more than ``keep`` members of a class, so the rest of a large class
    is never needed.  The cut is made before the exchange as well.
    """
    order = W.partitionBy("vec").orderBy("id")
    few = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return stored(few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                        .select(F.col("ids")[0].alias("rep"), "ids", "vec"))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A list column of equal sizes as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def sample(found: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``n`` classes by hash order: reps and vectors."""
    rows = found.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(n).collect()
    return np.array([r["rep"] for r in rows], np.int64), np.array([list(r["vec"]) for r in rows], np.float64)


def ranked(hits: DataFrame, queries: DataFrame, k: int, order: Column) -> DataFrame:
    """(query_id, rank, vec_id, score) from class hits (q, vec_id, score), without the query itself.

    ``hits`` holds at least the k + 1 best rows of each query class q; ``queries`` names
    the class of every query (query_id, q).
    """
    best = W.partitionBy("q").orderBy(order, "vec_id")
    few = (hits.dropDuplicates(["q", "vec_id"]).withColumn("rank", F.row_number().over(best))
           .filter(F.col("rank") <= k + 1).drop("rank"))
    own = few.join(queries, "q").filter(F.col("query_id") != F.col("vec_id"))
    last = W.partitionBy("query_id").orderBy(order, "vec_id")
    return (own.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
