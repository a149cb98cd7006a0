"""Numeric column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression, so that ``body`` may use it repeatedly."""
    return F.transform(F.array(value), body)[0]


def round1(x: Column) -> Column:
    """Round a non-negative double to one decimal, ties judged on its exact binary value.

    ``round``/``bround`` look at the shortest decimal text, which turns 22.95 (stored slightly
    below) into a tie. Here ten times the value is formed as 8x + 2x, both exact, together with
    the rounding error of their sum, which tells a seeming tie from a true one; true ties go to
    the even digit.
    """
    tens = x * F.lit(8.0) + x * F.lit(2.0)
    lost = x * F.lit(2.0) - (tens - x * F.lit(8.0))
    # rounding the sum cannot carry it past a tie, only onto one
    seems_tied = (tens - F.floor(tens) == 0.5) & (lost != 0)
    return F.when(seems_tied, F.when(lost > 0, F.ceil(tens)).otherwise(F.floor(tens)).cast("double")).otherwise(
        F.rint(tens)) / F.lit(10.0)
