"""Column expressions that the dialect has and Spark hasn't."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_divide(x: Column, y: Column, divisor: float | int | None = None) -> Column:
    """x / y as doubles: x / 0 is infinite with the product of both signs (a zero has one too), 0 / 0 and NaN / 0 are NaN.
    divisor: y, if it is a literal.

    Spark would raise an error, and compares both zeros as equal; 1 / y by pow has the sign of a zero."""
    x, y = x.cast("double"), y.cast("double")
    if divisor:
        return x / y
    return F.when(y == 0, F.signum(x) * F.pow(y, F.lit(-1.0))).otherwise(F.try_divide(x, y))


def all_present(columns: Iterable[Column]) -> Column | None:
    """None of the columns is null; None for no columns."""
    tests = [c.isNotNull() for c in columns]
    return reduce(lambda a, b: a & b, tests) if tests else None


def strict(value: Column, columns: Iterable[Column]) -> Column:
    """value, or null if any of the columns is null: AND and OR give null for a null operand in the dialect, so that an
    expression is null exactly if a column in it is."""
    present = all_present(columns)
    return value if present is None else F.when(present, value)


def ordered(column: Column, descending: bool) -> Column:
    """Nulls come first either way."""
    return column.desc_nulls_first() if descending else column.asc_nulls_first()
