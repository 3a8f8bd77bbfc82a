"""Logarithms and quotients of doubles where a price is 0, as SQL on IEEE numbers has them: infinite, not null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def ln(x: Column | str) -> Column:
    """Natural logarithm: minus infinity at 0, null below."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c == 0, F.lit(-INF)).otherwise(F.log(c))


def over(a: Column, b: Column) -> Column:
    """a / b: by a divisor of 0 infinite with the sign of a, by one of -0 with the other sign, and NaN for 0 / 0."""
    # Spark takes -0 for 0 in comparisons; only its text differs.
    below = b.cast("double").cast("string") == "-0.0"
    return F.when(b == 0, a * F.when(below, F.lit(-INF)).otherwise(F.lit(INF))).otherwise(F.try_divide(a, b))
