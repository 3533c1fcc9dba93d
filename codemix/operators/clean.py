"""Row filters: blank lines, length ratio, copies, positions limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codemix.functions.arrays import let
from codemix.functions.text import strip, words

DEFAULT_MIN_RATIO = 0.6


def drop_blank(df: DataFrame, col: str = "text") -> DataFrame:
    return df.filter(strip(F.col(col)) != "")


def length_ratio_ok(a: Column, b: Column, min_ratio: float) -> Column:
    """min(a/b, b/a) >= min_ratio for word counts; an empty side is never fine."""
    return F.when((a > 0) & (b > 0), F.least(a / b, b / a) >= F.lit(min_ratio)).otherwise(F.lit(False))


def clean_pairs(df: DataFrame, src: str = "src", tgt: str = "tgt",
                min_ratio: float = DEFAULT_MIN_RATIO, copy_check: bool = True) -> DataFrame:
    """Keep pairs of similar length that are not copies of each other."""
    # bound once: the rule names every count several times
    counts = F.struct(F.size(words(F.col(src))).alias("a"), F.size(words(F.col(tgt))).alias("b"))
    keep = let(counts, lambda n: length_ratio_ok(n["a"], n["b"], min_ratio))
    if copy_check:
        keep = keep & (strip(F.col(src)) != strip(F.col(tgt)))
    return df.filter(keep)


def filter_by_length(df: DataFrame, max_source: int, max_target: int, strict: bool = False) -> DataFrame:
    """Drop pairs beyond the position limits; in strict mode fail on the first one."""
    fits = (F.col("src_len") <= max_source) & (F.col("tgt_len") <= max_target)
    if strict:
        msg = F.lit(f"pair longer than ({max_source}, {max_target})")
        return df.filter(F.assert_true(fits, msg).isNull())
    return df.filter(fits)
