"""Range joins: points in grid cells of the radius, so that only neighbouring cells are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(centres: DataFrame, points: DataFrame, key: str, radius: float) -> DataFrame:
    """(centre, key) of all points (x, y, z) within the radius of a centre."""
    cell = {c: F.floor(F.col(c) / radius) for c in "xyz"}
    near = centres.select(F.col(key).alias("centre"), *[F.col(c).alias("c" + c) for c in "xyz"])
    for c in "xyz":
        near = near.withColumn("g" + c, F.explode(F.sequence(F.floor(F.col("c" + c) / radius) - 1, F.floor(F.col("c" + c) / radius) + 1)))
    at = points.select(key, *[F.col(c) for c in "xyz"], *[cell[c].alias("g" + c) for c in "xyz"])
    d = sum(F.pow(F.col("c" + c) - F.col(c), F.lit(2)) for c in "xyz")
    return near.join(at, ["gx", "gy", "gz"]).where(d <= radius * radius).select("centre", key)
