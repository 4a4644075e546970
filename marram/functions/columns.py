"""Column functions for statistics: null where the reference statistic is undefined, never an error."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Six decimals, as results are compared; no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def clean(x: Column) -> Column:
    """NaN and infinities become null, once, at the border."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def both(x: str, y: str) -> tuple[Column, Column]:
    """x and y, each null where either is: the complete pairs."""
    whole = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.when(whole, F.col(x)), F.when(whole, F.col(y))


def pearson(x: str, y: str) -> Column:
    """r over the complete pairs, null for a constant column or fewer than two pairs."""
    a, b = both(x, y)
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.covar_pop(a, b) / (sx * sy))


def cosine(x: str, y: str) -> Column:
    """Over the complete pairs."""
    a, b = both(x, y)
    return ratio(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b)))


def average_rank(order: str, *by: str) -> Column:
    """Rank from 1; ties share the mean of their ranks."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, order)) - 1) / 2.0


def zscore(x: str, *by: str, sample: bool = True) -> Column:
    w = Window.partitionBy(*by)
    sd = (F.stddev_samp if sample else F.stddev_pop)(x).over(w)
    return ratio(F.col(x) - F.avg(x).over(w), sd)


def minmax(x: str, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return ratio(F.col(x) - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w))


def hash_order(seed: str, *ids: str) -> Column:
    """A random order that is the same on any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(i).cast("string") for i in ids]))
