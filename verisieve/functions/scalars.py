"""Scalar Column functions shared by the operators: clipping, null-skipping row statistics, calibration maths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def num(name: str) -> Column:
    """A numeric reading of a column; text that is no number, NaN and blanks become NULL."""
    return F.nanvl(F.col(f"`{name}`").try_cast("double"), F.lit(None).cast("double"))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def filled(x: Column, default: float) -> Column:
    return clip(F.coalesce(x, F.lit(default)))


def row_sum(xs: Iterable[Column]) -> Column:
    """Sum of a row's values from left to right; none of them is null."""
    first, *rest = xs
    return sum(rest, first)


def row_mean(xs: Iterable[Column]) -> Column:
    """Mean of the non-null values of a row; NULL if there are none."""
    xs = list(xs)
    total = row_sum(F.nvl2(x, x, F.lit(0.0)) for x in xs)
    n = row_sum(x.isNotNull().cast("int") for x in xs)
    return F.when(n > 0, total / n)


def row_max(xs: Iterable[Column]) -> Column:
    xs = list(xs)
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def row_min(xs: Iterable[Column]) -> Column:
    xs = list(xs)
    return F.least(*xs) if len(xs) > 1 else xs[0]


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column) -> Column:
    q = clip(p, EPS, 1 - EPS)
    return F.log(q / (1 - q))


def hash01(*parts: Column) -> Column:
    """The first 48 bits of SHA-256 over the parts, as a number in [0, 1)."""
    digest = F.sha2(F.concat_ws("␟", *parts), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def bround6(x: Column) -> Column:
    """Rounds to six places, ties to even."""
    return F.bround(x, 6)
