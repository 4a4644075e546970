"""Element-wise and distribution-wise transforms. Names of groups (``by``) may be empty: then one scan gives the scalars.

Where a transform needs scalars of the whole column, they come from an aggregate joined as one row, never from a
window over one partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.columns import ratio

SCALARS = {
    "log1p": lambda x: F.log1p(x),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "exp": lambda x: F.exp(x),
    "inverse": lambda x: ratio(F.lit(1.0), x),
    "inverse1p": lambda x: ratio(F.lit(1.0), x + 1),
    "square": lambda x: x * x,
    "cube": lambda x: x * x * x,
    "logit": lambda x: F.when((x > 0) & (x < 1), F.log(x / (1 - x))),
    "logistic": lambda x: 1 / (1 + F.exp(-x)),
    "fisher_z": lambda x: F.when(F.abs(x) < 1, F.atanh(x)),
}


def box_cox(x: Column, power: float) -> Column:
    """Of x + 1; null below 0."""
    y = x + 1
    return F.when(y > 0, F.log(y) if power == 0 else (F.pow(y, F.lit(power)) - 1) / power)


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_power(df: DataFrame, x: str, low: float = -3.0, high: float = 3.0, step: float = 0.25) -> DataFrame:
    """One row: the power of the grid with the largest normal likelihood, all powers in one scan."""
    powers = [low + step * i for i in range(int(round((high - low) / step)) + 1)]
    c = F.col(x).cast("double")
    jacobian = F.sum(F.signum(c) * F.log1p(F.abs(c)))
    n = F.count(c)
    score = lambda p: -n / 2 * F.log(F.var_pop(yeo_johnson(c, p))) + (p - 1) * jacobian
    scored = df.agg(*[F.struct(score(p).alias("score"), F.lit(p).alias("power")).alias(f"p{i}") for i, p in enumerate(powers)])
    best = F.array_max(F.array(*[F.col(f"p{i}") for i in range(len(powers))]))
    return scored.select(best["power"].alias("power"), best["score"].alias("score"))


def with_scalars(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """df with the aggregates of its group (or of the whole) as columns; null groups are groups."""
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in aggregates.items()])))
    small = df.groupBy(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)]).agg(*[v.alias(k) for k, v in aggregates.items()])
    on = [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]
    return df.join(small, on).drop(*[f"_g{i}" for i in range(len(by))])


def standardise(df: DataFrame, x: str, out: str, by: list[str] = [], ddof: int = 0, guard: float | None = None) -> DataFrame:  # noqa: B006
    """(x - mean) / deviation; with ``guard``, columns whose deviation is no larger stay as they are."""
    sd = F.stddev_samp(x) if ddof else F.stddev_pop(x)
    got = with_scalars(df, by, _m=F.avg(x), _s=sd)
    z = ratio(F.col(x) - F.col("_m"), F.col("_s"))
    z = z if guard is None else F.when(F.col("_s") <= guard, F.col(x)).otherwise((F.col(x) - F.col("_m")) / (F.col("_s") + 1e-8))
    return got.withColumn(out, z).drop("_m", "_s")


def rescale(df: DataFrame, x: str, out: str, low: float = 0.0, high: float = 1.0, by: list[str] = [], reference: str | None = None) -> DataFrame:  # noqa: B006
    """x from its own range, or that of the reference column, onto [low, high]; null where the range is empty."""
    r = reference or x
    got = with_scalars(df, by, _lo=F.min(r), _hi=F.max(r))
    return got.withColumn(out, low + ratio((F.col(x) - F.col("_lo")) * (high - low), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def robust(df: DataFrame, x: str, out: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(x - median) / (q75 - q25)."""
    got = with_scalars(df, by, _q=F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    return got.withColumn(out, ratio(F.col(x) - F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0])).drop("_q")


def clip(df: DataFrame, x: str, out: str, low: float = 0.05, high: float = 0.95, by: list[str] = []) -> DataFrame:  # noqa: B006
    got = with_scalars(df, by, _q=F.percentile(x, F.array(F.lit(low), F.lit(high))))
    return got.withColumn(out, F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_q")[0]), F.col("_q")[1]))).drop("_q")


def invert(df: DataFrame, x: str, out: str, around: str = "range") -> DataFrame:
    """``range``: max + min - x; ``max``: max - x."""
    got = with_scalars(df, [], _lo=F.min(x), _hi=F.max(x))
    return got.withColumn(out, F.col("_hi") + (F.col("_lo") if around == "range" else F.lit(0)) - F.col(x)).drop("_lo", "_hi")


def ranks(df: DataFrame, x: str, out: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Average ranks from 1 over the non-null values; nulls have none.

    Counts per distinct value are summed over buckets of its quantile sketch, so no task sorts the whole column.
    """
    from pyspark.sql import Window

    counted = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        below = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v")) - F.col("_n")
        ranked = counted.withColumn("_below", below)
    else:
        ranked = running(counted, "_v", "_n", "_below")
    ranked = ranked.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], "_v", (F.col("_below") + (F.col("_n") + 1) / 2).alias(out))
    on = [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)] + [F.col(x) == F.col("_v")]
    return df.join(ranked, on, "left").drop("_v", *[f"_g{i}" for i in range(len(by))])


def running(df: DataFrame, order: str, amount: str, out: str, parts: int = 64) -> DataFrame:
    """df with the sum of ``amount`` over all rows of smaller ``order`` (a number), in range buckets of its quantiles."""
    from pyspark.sql import Window

    marks = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.005)))
    bucket = F.size(F.filter(F.array(*map(F.lit, marks)).cast("array<double>"), lambda m: m < F.col(order))) if marks else F.lit(0)
    placed = df.withColumn("_bucket", bucket)
    sums = placed.groupBy("_bucket").agg(F.sum(amount).alias("_total"))  # at most ``parts`` rows
    before = sums.select("_bucket", (F.sum("_total").over(Window.orderBy("_bucket")) - F.col("_total")).alias("_before"))
    w = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(before), "_bucket").withColumn(out, F.col("_before") + F.coalesce(F.sum(amount).over(w), F.lit(0))).drop("_bucket", "_before")


def quantile_uniform(df: DataFrame, x: str, out: str) -> DataFrame:
    """(average rank - 1) / (n - 1): the quantile transform to [0, 1]."""
    got = ranks(df, x, "_r").crossJoin(F.broadcast(df.agg(F.count(x).alias("_n"))))
    return got.withColumn(out, ratio(F.col("_r") - 1, (F.col("_n") - 1).cast("double"))).drop("_r", "_n")


# --- coordinates ---------------------------------------------------------------------------------------------------

#: Rows of the published piecewise affine maps between two brain atlases, at or above and below z = 0.
TO_TALAIRACH = (((0.99, 0, 0), (0, 0.9688, 0.0460), (0, -0.0485, 0.9189)), ((0.99, 0, 0), (0, 0.9688, 0.0420), (0, -0.0485, 0.8390)))


def affine(rows, x: Column, y: Column, z: Column) -> list[Column]:
    """The first three components of rows times (x, y, z, 1); a row of three has no shift."""
    return [F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3]) if len(r) > 3 else 0.0) for r in rows]


def invert_affine(rows) -> list[list[float]]:
    """The rows of the inverse of three rows with or without shift."""
    a = [[float(v) for v in r[:3]] for r in rows]
    t = [float(r[3]) if len(r) > 3 else 0.0 for r in rows]
    minor = lambda i, j: a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3]
    det = sum(a[0][j] * minor(0, j) for j in range(3))
    inverse = [[minor(j, i) / det for j in range(3)] for i in range(3)]
    return [[*row, -sum(row[j] * t[j] for j in range(3))] for row in inverse]


def mni_to_talairach(x: Column, y: Column, z: Column) -> list[Column]:
    up, down = (affine(m, x, y, z) for m in TO_TALAIRACH)
    return [F.when(z < 0, d).otherwise(u) for u, d in zip(up, down, strict=True)]


def talairach_to_mni(x: Column, y: Column, z: Column) -> list[Column]:
    up, down = (affine(invert_affine(m), x, y, z) for m in TO_TALAIRACH)
    return [F.when(z < 0, d).otherwise(u) for u, d in zip(up, down, strict=True)]


def voxel_to_world(matrix, i: Column, j: Column, k: Column) -> list[Column]:
    return affine(matrix, i, j, k)


def world_to_voxel(matrix, x: Column, y: Column, z: Column) -> list[Column]:
    return [F.floor(c + 0.5).cast("long") for c in affine(invert_affine(matrix), x, y, z)]


def ravel(shape: tuple[int, int, int], i: Column, j: Column, k: Column) -> Column:
    """The place in row-major order; null outside the shape."""
    inside = (i >= 0) & (i < shape[0]) & (j >= 0) & (j < shape[1]) & (k >= 0) & (k < shape[2])
    return F.when(inside, (i * shape[1] + j) * shape[2] + k)


def on_sphere(theta: Column, phi: Column, radius: float = 1.0) -> list[Column]:
    """theta from the pole, phi around it."""
    return [radius * F.sin(theta) * F.cos(phi), radius * F.sin(theta) * F.sin(phi), radius * F.cos(theta)]


def on_torus(theta: Column, phi: Column, major: float = 2.0, minor: float = 1.0) -> list[Column]:
    ring = major + minor * F.cos(theta)
    return [ring * F.cos(phi), ring * F.sin(phi), minor * F.sin(theta)]


def on_circle(angle: Column, radius: float = 1.0) -> list[Column]:
    return [radius * F.cos(angle), radius * F.sin(angle)]


# --- units ---------------------------------------------------------------------------------------------------------


def charge(milliamps: Column, microseconds: Column) -> Column:
    """Microcoulombs per pulse."""
    return milliamps * microseconds / 1000


def amperage(volts: Column, ohms: Column) -> Column:
    return ratio(volts, ohms)


def sphere_radius(volume: Column) -> Column:
    return F.pow(volume * 3 / (4 * math.pi), F.lit(1 / 3))


def cylinder_area(radius: Column, height: Column) -> Column:
    return 2 * math.pi * radius * height


def within_charge_density(charge_uc: Column, area_cm2: Column, limit: float = 30.0) -> Column:
    return ratio(charge_uc, area_cm2) <= limit


def goodness(target: Column, avoid: Column) -> Column:
    """(avoid - target) / (avoid + target) of two distances."""
    return ratio(avoid - target, avoid + target)
