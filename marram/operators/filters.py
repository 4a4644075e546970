"""Row, voxel and column filters on long images (dataset, subject, voxel, value) and on tables.

Nulls never pass a comparison; where a rule keeps them it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.columns import clean
from marram.functions.distributions import normal_ppf

COMPARE = {
    "equal": lambda c, v: c == v,
    "above": lambda c, v: c > v,
    "below": lambda c, v: c < v,
    "not": lambda c, v: c != v,
}


def split_rows(df: DataFrame, column: str, condition: str, value) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): rows that meet the condition are dropped, so rows with a null are kept."""
    hit = F.coalesce(COMPARE[condition](F.col(column), F.lit(value)), F.lit(False))
    return df.where(~hit), df.where(hit)


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without null or NaN in the columns (all by default)."""
    kinds = dict(df.dtypes)
    out = df
    for c in columns or df.columns:
        value = clean(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
        out = out.where(value.isNotNull())
    return out


def repair(df: DataFrame, x: str, policy: str = "finite") -> DataFrame:
    """NaN and null to 0, infinities to the largest and smallest finite value (``finite``) or to 0 (``zero``)."""
    if policy == "zero":
        return df.withColumn(x, F.coalesce(clean(F.col(x)), F.lit(0.0)))
    ends = F.broadcast(df.agg(F.max(clean(F.col(x))).alias("_hi"), F.min(clean(F.col(x))).alias("_lo")))
    fixed = F.when(F.col(x) == float("inf"), F.col("_hi")).when(F.col(x) == float("-inf"), F.col("_lo")).otherwise(F.coalesce(clean(F.col(x)), F.lit(0.0)))
    return df.crossJoin(ends).withColumn(x, fixed).drop("_hi", "_lo")


def threshold(x: Column, mode: str, low: float, high: float | None = None, fill: float = 0.0) -> Column:
    """keep_above, keep_below, keep_between, exclude_between; the boundary is kept, other values become ``fill``."""
    lo, hi = (low, high) if high is None or low <= high else (high, low)
    kept = {
        "keep_above": x >= lo,
        "keep_below": x <= lo,
        "keep_between": (x >= lo) & (x <= F.lit(hi)),
        "exclude_between": ~((x > lo) & (x < F.lit(hi))),
    }[mode]
    return F.when(x.isNull(), None).when(kept, x).otherwise(F.lit(fill))


def matrix_threshold(images: DataFrame, method: str, at: float, by: str = "subject", fill: float = 0.0) -> DataFrame:
    """Keeps values at or above a cut: ``raw`` at itself, ``percentile`` of each image, ``probability`` the normal quantile."""
    x = F.col("value")
    if method == "percentile":
        cuts = images.groupBy(by).agg(F.percentile("value", F.lit(at)).alias("_cut"))
        return images.join(cuts, by).withColumn("value", F.when(x < F.col("_cut"), fill).otherwise(x)).drop("_cut")
    cut = F.lit(at) if method == "raw" else normal_ppf(F.lit(at))
    return images.withColumn("value", F.when(x < cut, fill).otherwise(x))


def threshold_by(images: DataFrame, other: DataFrame, rule: str, fill: float = 0.0) -> DataFrame:
    """Keeps values that are less / greater than the other image's value at the voxel; others become ``fill``."""
    o = other.select("voxel", F.col("value").alias("_o"))
    kept = F.col("value") < F.col("_o") if rule in ("less", "under") else F.col("value") > F.col("_o")
    return images.join(o, "voxel").withColumn("value", F.when(kept, F.col("value")).otherwise(F.lit(fill))).drop("_o")


def mask(images: DataFrame, masks: DataFrame, above: float = 0.0) -> DataFrame:
    """The rows of voxels whose mask value is above the threshold."""
    return images.join(masks.where(F.col("value") > above).select("voxel").distinct(), "voxel", "left_semi")


def data_mask(images: DataFrame, above: float = 0.0) -> DataFrame:
    """The voxels at which the values above the threshold add up to more than 0."""
    return images.groupBy("voxel").agg(F.sum(F.when(F.col("value") > above, F.col("value")).otherwise(0.0)).alias("_s")).where("_s > 0").select("voxel")


def unmask(result: DataFrame, masks: DataFrame, value: str, fill: str = "zero") -> DataFrame:
    """One row for every voxel of the mask's grid; outside the result ``zero``, ``null``, or the mask's own value."""
    joined = masks.select("voxel", F.col("value").alias("_m")).join(result, "voxel", "left")
    other = {"zero": F.lit(0.0), "null": F.lit(None).cast("double"), "mask": F.col("_m")}[fill]
    return joined.withColumn(value, F.coalesce(F.col(value), other)).drop("_m")


def significant(maps: DataFrame, t: str, p: str, alpha: float = 0.05) -> DataFrame:
    return maps.withColumn(t, F.when(F.col(p) < alpha, F.col(t)))


def copy_unless(df: DataFrame, column: str, suffix: str, condition: Column) -> DataFrame:
    """A second column that is null where the condition holds."""
    return df.withColumn(column + suffix, F.when(~F.coalesce(condition, F.lit(False)), F.col(column)))


def every_nth(df: DataFrame, order: str, nth: int = 2, offset: int = 1, by: list[str] | None = None) -> DataFrame:
    """Rows ``offset``, ``offset + nth``, ... from 0 in the order of a number; ranks come from range buckets."""
    from marram.functions.transforms import running

    if by:
        placed = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    else:
        placed = running(df.withColumn("_one", F.lit(1)), order, "_one", "_k").drop("_one")
    return placed.where(F.pmod(F.col("_k"), F.lit(nth)) == offset).drop("_k")


def sample(df: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """n rows without replacement, by the order of md5(seed|key); the same rows on any partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def categorise(x: Column, low: float = -2.0, high: float = 2.0) -> Column:
    return F.when(x > high, 1).when(x < low, -1).otherwise(0)


def binarise_at_saddle(df: DataFrame, x: str, out: str, split: float | None = None, labels: tuple[str, str] = ("low", "high")) -> DataFrame:
    """At or below the split (the mean by default) is the first label; null has none."""
    if split is not None:
        return df.withColumn(out, F.when(F.col(x) <= split, labels[0]).when(F.col(x) > split, labels[1]))
    return df.crossJoin(F.broadcast(df.agg(F.avg(x).alias("_m")))).withColumn(out, F.when(F.col(x) <= F.col("_m"), labels[0]).when(F.col(x) > F.col("_m"), labels[1])).drop("_m")


def natural_sorted(df: DataFrame, label: str, descending: bool = False) -> DataFrame:
    from marram.functions.strings import natural_key

    key = natural_key(F.col(label))
    return df.orderBy(key.desc() if descending else key, label)
