"""Small helpers for row-local array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

HALF = 1 << 31


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column referenced inside a lambda may be inlined by the optimizer and
    then runs once per element; a bound lambda variable does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pair(hi: Column, lo: Column) -> Column:
    """Two non-negative ints in one bigint that sorts by (hi, lo).

    Sorting, hashing and comparing bigints is much cheaper than structs.
    """
    return hi.cast("bigint") * F.lit(HALF) + lo.cast("bigint")


def hi(code: Column) -> Column:
    return F.shiftright(code, 31).cast("int")


def lo(code: Column) -> Column:
    return code.bitwiseAND(F.lit(HALF - 1)).cast("int")
