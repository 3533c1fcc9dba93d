"""Generation logs: ``H-<id>\\t<score>\\t<tokens>`` and the S, T, P variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LINE = r"^[SHPT]-[0-9]+"


def parse_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """All tagged lines as ``tag, id, score, text``; other lines are dropped.

    ``score`` is only set for lines with three fields whose second is a number; ``text`` is the last one.
    """
    parts = F.split(F.col(col), "\t")
    return lines.filter(F.col(col).rlike(LINE)).select(
        F.substring(col, 1, 1).alias("tag"),
        F.substring_index(F.get(parts, F.lit(0)), "-", -1).cast("bigint").alias("id"),
        F.when(F.size(parts) > 2, F.get(parts, F.lit(1)).try_cast("double")).alias("score"),
        F.element_at(parts, -1).alias("text"))


def read_hypotheses(lines: DataFrame, col: str = "value") -> DataFrame:
    """``id, text`` of the H lines; sort by ``id`` when writing."""
    return parse_log(lines, col).filter(F.col("tag") == "H").select("id", "text")
