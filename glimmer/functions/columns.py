"""Scalar and aggregate expressions that the operators share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(column: str | Column) -> Column:
    """Aggregate: the upper of the two middle values (element n // 2 of the sorted values)."""
    values = F.sort_array(F.collect_list(column))
    return F.get(values, F.expr("0") + F.floor(F.size(values) / 2).cast("int"))


def upper_median_of(values: Column) -> Column:
    """The upper median of an array column."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def iir_coefficients(sigma: float) -> tuple[float, float, float, float]:
    """Coefficients of the recursive Gaussian of Young and van Vliet (1995): gain, and three feedback terms.

    ``sigma`` must be 0.5 or more.
    """
    if sigma < 0.5:
        raise ValueError("the recursive Gaussian needs a sigma of 0.5 or more")
    # The published polynomials.
    q = 3.97156 - 4.14554 * math.sqrt(1 - 0.26891 * sigma) if sigma < 2.5 else 0.98711 * sigma - 0.9633
    b0 = 1.57825 + 2.44413 * q + 1.4281 * q**2 + 0.422205 * q**3
    b1 = (2.44413 * q + 2.85619 * q**2 + 1.26661 * q**3) / b0
    b2 = -(1.4281 * q**2 + 1.26661 * q**3) / b0
    b3 = 0.422205 * q**3 / b0
    return 1 - b1 - b2 - b3, b1, b2, b3


def iir_pass(values: Column, sigma: float) -> Column:
    """An array of doubles through the recursive Gaussian, forth and back, as a fold over the array.

    The first three values of each pass stay as they are; so do arrays of three
    values or fewer.  Meant for arrays of up to some thousand values.
    """
    gain, b1, b2, b3 = iir_coefficients(sigma)

    def step(done: Column, v: Column) -> Column:
        n = F.size(done)
        value = gain * v + b1 * F.get(done, n - 1) + b2 * F.get(done, n - 2) + b3 * F.get(done, n - 3)
        return F.concat(done, F.array(value))

    def one_way(a: Column) -> Column:
        return F.aggregate(F.slice(a, 4, F.size(a) - 3), F.slice(a, 1, 3).cast("array<double>"), step)

    def both(a: Column) -> Column:
        return let(F.reverse(one_way(a)), lambda back: F.reverse(one_way(back)))

    return let(values, lambda a: F.when(F.size(a) > 3, both(a)).otherwise(a))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, though it may stand in several places."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
