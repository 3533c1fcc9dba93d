"""Word alignments and phrase extraction; everything is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codemix.functions.arrays import let
from codemix.functions.text import is_alpha
from codemix.operators.components import dropped_udf, edge_sums_udf, parse_udf, phrase_udf


def parse_alignment(alignment: Column) -> Column:
    """``"0-0 1-2"`` to sorted distinct ``array<struct<s:int,t:int>>``; malformed edges are dropped.

    Parsed over Arrow batches.
    """
    return parse_udf()(alignment)


def edge_sums(edges: Column) -> Column:
    """The number ``n`` of parsed edges and the sums ``s`` and ``t`` of their sides, in the batch that parsed them."""
    return edge_sums_udf()(edges)


def dropped_edges(alignment: Column, n_src: Column, n_tgt: Column) -> Column:
    """How many edges of an alignment are malformed or lie outside the sentences; null counts as none.

    Counted over Arrow batches: the sizes are computed once per row, not once per edge.
    """
    return dropped_udf()(alignment, n_src, n_tgt)


def phrases(df: DataFrame, one_to_one: bool = False, contiguous_only: bool = False) -> DataFrame:
    """Add ``phrases`` to rows that hold ``words`` (or ``alpha``: which of them are all letters), ``alignment`` and ``n_tgt``.

    Connected components of the alignment graph in source order, each with an
    all-letter source word; malformed and out-of-range edges are dropped.
    """
    alpha = F.col("alpha") if "alpha" in df.columns else F.transform("words", is_alpha)
    found = phrase_udf(one_to_one, contiguous_only)(F.array("alignment"), F.array("n_tgt"), alpha)
    return df.withColumn("phrases", F.get(found, F.lit(0)))


def align_embeddings(df: DataFrame, threshold: float = 1e-3) -> DataFrame:
    """Word alignment from token vectors.

    ``df`` holds ``src_vecs`` and ``tgt_vecs`` (arrays of vectors, one per
    word).  The similarity matrix is normalised by a softmax over each row and
    over each column; a pair is aligned when both exceed the threshold (Dou &
    Neubig 2021).  Row-local, so no pair ever becomes a row.
    """

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                           F.lit(0.0), lambda s, v: s + v)

    def total(row: Column) -> Column:
        return F.aggregate(row, F.lit(0.0), lambda s, v: s + v)

    sims = F.transform("src_vecs", lambda a: F.transform("tgt_vecs", lambda b: dot(a, b)))

    def column_fold(m: Column, start: float, join) -> Column:
        return F.aggregate(m, F.transform(F.get(m, F.lit(0)), lambda _: F.lit(start)),
                           lambda acc, row: F.zip_with(acc, row, join))

    def normed(m: Column) -> Column:
        """Softmax of rows and of columns, each less its largest entry: no exponential overflows."""
        by_row = F.transform(m, lambda row: let(F.array_max(row), lambda top: let(
            F.transform(row, lambda v: F.exp(v - top)),
            lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)))))
        shifted = let(column_fold(m, float("-inf"), lambda x, y: F.greatest(x, y)), lambda tops: F.transform(
            m, lambda row: F.zip_with(row, tops, lambda v, top: F.exp(v - top))))
        by_col = let(shifted, lambda e: let(column_fold(e, 0.0, lambda x, y: x + y), lambda sums: F.transform(
            e, lambda row: F.zip_with(row, sums, lambda v, t: v / t))))
        return F.zip_with(by_row, by_col, lambda a, b: F.zip_with(
            a, b, lambda p, q: F.struct(p.alias("p_row"), q.alias("p_col"))))

    def pick(m: Column) -> Column:
        return F.flatten(F.transform(normed(m), lambda row, i: F.filter(
            F.transform(row, lambda c, j: F.when(
                (c["p_row"] > threshold) & (c["p_col"] > threshold),
                F.struct(i.alias("s"), j.alias("t"), c["p_row"].alias("p_row"), c["p_col"].alias("p_col")))),
            lambda e: e.isNotNull())))

    return df.withColumn("edges", let(sims, pick))
