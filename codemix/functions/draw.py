"""Keyed random draws: a pure function of (seed, row id, position, tag).

The value is the first 32 bits of an MD5 digest.  It is deterministic, so
Catalyst may push filters through it, retried tasks give the same rows, and a
plain SQL engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = 1 << 32


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hex_word(digest: Column, k: int) -> Column:
    """The k-th (0-3) 32-bit word of an MD5 hex digest as a bigint."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def digest(seed, row_id, k, tag) -> Column:
    parts = [_col(p).cast("string") for p in (seed, row_id, k, tag)]
    return F.md5(F.concat_ws(":", *parts))


def draw(seed, row_id, k, tag) -> Column:
    """Uniform bigint in [0, 2^32)."""
    return hex_word(digest(seed, row_id, k, tag), 0)


def uniform(seed, row_id, k, tag) -> Column:
    """Uniform double strictly inside (0, 1)."""
    return (draw(seed, row_id, k, tag) + F.lit(0.5)) / F.lit(float(SPAN))
