"""Aggregates over many images or maps: composites, weighted means, conjunctions, scores against controls."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.columns import pearson, ratio

#: The usual threshold of each kind of map.
MAP_THRESHOLDS = {"roi": 1.0, "t": 7.0, "r": 0.1, "rfz": 5.0, "z": 2.0, "w": 2.0}


def percentiles(images: DataFrame, points: list[float], masks: DataFrame | None = None) -> DataFrame:
    """Per subject the percentiles of its values, of the whole image or inside a mask."""
    inside = images if masks is None else images.join(masks.select("voxel").distinct(), "voxel", "left_semi")
    got = inside.groupBy("subject").agg(F.percentile("value", F.array(*map(F.lit, points))).alias("_p"))
    return got.select("subject", *[F.col("_p")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(points)])


def weighted_mean(maps: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Mean of the maps (dataset, voxel, value) at each voxel, by weight (dataset, weight) if given; nulls weigh nothing."""
    if weights is None:
        return maps.groupBy("voxel").agg(F.avg("value").alias("value"))
    w = F.when(F.col("value").isNotNull(), F.col("weight"))
    return maps.join(F.broadcast(weights), "dataset").groupBy("voxel").agg(ratio(F.sum(F.col("value") * w), F.sum(w)).alias("value"))


def align_signs(maps: DataFrame, reference: int) -> DataFrame:
    """Maps that correlate negatively with the reference map are turned over."""
    ref = maps.where(F.col("dataset") == reference).select("voxel", F.col("value").alias("_r"))
    r = maps.join(ref, "voxel").groupBy("dataset").agg(pearson("value", "_r").alias("_c"))
    return maps.join(F.broadcast(r), "dataset").withColumn("value", F.when(F.col("_c") < 0, -F.col("value")).otherwise(F.col("value"))).drop("_c")


def conjunction(a: DataFrame, b: DataFrame, rule: str = "signed", at: float = 0.0) -> DataFrame:
    """Of two maps (voxel, value): ``unsigned`` 1 where both pass, ``signed`` the smaller size where both pass with one
    sign, ``agreement`` that sign; 0 elsewhere."""
    j = a.select("voxel", F.col("value").alias("x")).join(b.select("voxel", F.col("value").alias("y")), "voxel")
    x, y = F.col("x"), F.col("y")
    passed = (F.abs(x) > at) & (F.abs(y) > at)
    same = passed & (F.signum(x) == F.signum(y))
    value = {"unsigned": F.when(passed, 1.0), "signed": F.when(same, F.signum(x) * F.least(F.abs(x), F.abs(y))), "agreement": F.when(same, F.signum(x))}[rule]
    return j.select("voxel", F.coalesce(value, F.lit(0.0)).alias("value"))


def composites(tissues: DataFrame, names: list[str], signs: dict[str, int] | None = None) -> DataFrame:
    """(subject, voxel, composite, value): the sum of every two or more of the tissue maps, with signs."""
    sign = F.create_map(*[F.lit(x) for n in names for x in (n, float((signs or {}).get(n, 1)))])
    wide = tissues.groupBy("subject", "voxel").agg(*[F.sum(F.when(F.col("tissue") == n, F.col("value") * sign[F.lit(n)])).alias(n) for n in names])
    sets = [c for k in range(2, len(names) + 1) for c in combinations(names, k)]
    parts = F.array(*[F.struct(F.lit("+".join(c)).alias("composite"), sum((F.col(n) for n in c[1:]), F.col(c[0])).alias("value")) for c in sets])
    return wide.select("subject", "voxel", F.explode(parts).alias("_p")).select("subject", "voxel", "_p.*")


def atrophy_norm(tissues: DataFrame) -> DataFrame:
    """Per subject and voxel the length of the vector of losses: white matter left out, fluid turned over, gains as 0."""
    x = F.when(F.col("tissue") == "csf", -F.col("value")).otherwise(F.col("value"))
    loss = F.least(x, F.lit(0.0))
    return tissues.where("tissue <> 'white'").groupBy("subject", "voxel").agg(F.sqrt(F.sum(loss * loss)).alias("value"))


def control_scores(images: DataFrame, is_control: Column, by: list[str], fluid: Column | None = None) -> DataFrame:
    """z of the others against the controls (population deviation), with ``significant``: below -2, above 2 for fluid."""
    stats = images.where(is_control).groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = images.where(~is_control).join(stats, by).withColumn("z", ratio(F.col("value") - F.col("_m"), F.col("_s"))).drop("_m", "_s")
    return z.withColumn("significant", F.when(fluid if fluid is not None else F.lit(False), F.col("z") > 2).otherwise(F.col("z") < -2))


def w_scores(images: DataFrame, is_control: Column, covariate: str) -> DataFrame:
    """(value - fit) / residual deviation, the line and its deviation (n - 2) from the controls alone."""
    c = images.where(is_control & F.col("value").isNotNull())
    fit = c.groupBy("voxel").agg(F.regr_slope("value", covariate).alias("_b"), F.regr_intercept("value", covariate).alias("_a"), F.regr_sxx("value", covariate).alias("_sxx"), F.regr_syy("value", covariate).alias("_syy"), F.count(F.lit(1)).alias("_n"))
    rsd = F.sqrt(ratio(F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx"), F.col("_n") - 2))
    return images.where(~is_control).join(fit, "voxel").select("subject", "voxel", ratio(F.col("value") - F.col("_a") - F.col("_b") * F.col(covariate), rsd).alias("w"))


def intracranial_volume(tissues: DataFrame, edge: float) -> DataFrame:
    return tissues.groupBy("subject").agg((F.sum("value") * edge**3).alias("tiv"))


def volume_normalised(tissues: DataFrame, edge: float, above: float) -> DataFrame:
    """Values at or above the threshold over the subject's volume, others 0."""
    v = intracranial_volume(tissues, edge)
    kept = F.when(F.col("value") >= above, F.col("value")).otherwise(0.0)
    return tissues.join(v, "subject").withColumn("value", ratio(kept, F.col("tiv"))).drop("tiv")


def sign_flip(images: DataFrame, keep: Column) -> DataFrame:
    return images.withColumn("value", F.when(keep, F.col("value")).otherwise(-F.col("value")))


def overlap_matrix(masks: DataFrame) -> DataFrame:
    """For every pair of masks (id, voxel, on) the share of the first, in percent, that the second covers, and Dice."""
    on = masks.where("on").select("id", "voxel")
    n = masks.groupBy("id").agg(F.sum(F.col("on").cast("long")).alias("n"))
    both = on.select(F.col("id").alias("a"), "voxel").join(on.select(F.col("id").alias("b"), "voxel"), "voxel").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    pairs = n.select(F.col("id").alias("a"), F.col("n").alias("na")).crossJoin(n.select(F.col("id").alias("b"), F.col("n").alias("nb")))
    k = F.coalesce("both", F.lit(0))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", ratio(100.0 * k, F.col("na")).alias("percent"), F.when(F.col("na") + F.col("nb") == 0, 1.0).otherwise(2.0 * k / (F.col("na") + F.col("nb"))).alias("dice"))


def variance_specificity(table: DataFrame, target: str, others: list[str], n: Column) -> DataFrame:
    """n r^2 of the target minus the other r^2, best first (column ``rank``)."""
    s = n * F.col(target) * F.col(target)
    for o in others:
        s = s - F.col(o) * F.col(o)
    return table.withColumn("specificity", s)


def centroid(points: DataFrame, by: str) -> DataFrame:
    """Mean coordinates of the non-zero voxels; ``mirrored`` has a positive x."""
    c = points.where("value <> 0").groupBy(by).agg(*[F.avg(a).alias(a) for a in "xyz"])
    return c.withColumn("mirrored", F.abs("x"))


def centroid_gap(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    j = a.join(b.select(by, *[F.col(c).alias("_" + c) for c in "xyz"]), by)
    gap = {c: F.col(c) - F.col("_" + c) for c in "xyz"}
    return j.select(by, *[g.alias("d" + c) for c, g in gap.items()], F.sqrt(sum(g * g for g in gap.values())).alias("distance"))


def merged_masks(images: DataFrame, how: str = "sum", binary: bool = False) -> DataFrame:
    """Several images of a subject as one: sum or max at each voxel, as 0/1 if asked."""
    value = (F.sum if how == "sum" else F.max)("value")
    got = images.groupBy("subject", "voxel").agg(value.alias("value"))
    return got.withColumn("value", (F.col("value") > 0).cast("double")) if binary else got


def best_overlap(overlap: DataFrame, count: str, by: str) -> DataFrame:
    """The rows of the largest count of each group, ties included."""
    return overlap.withColumn("_r", F.rank().over(Window.partitionBy(by).orderBy(F.desc(count)))).where("_r = 1").drop("_r")


def marginal_means(df: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(predicted).alias("predicted"), F.avg(actual).alias("actual"), F.count(F.lit(1)).alias("n"))


def describe_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n, missing, mean, deviation, extremes, from one scan."""
    stats = lambda c: F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.sum(F.col(c).isNull().cast("long")).alias("missing"), F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
    return df.agg(F.array(*[stats(c) for c in columns]).alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*")


def shares(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all")))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")
