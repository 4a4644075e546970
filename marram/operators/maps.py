"""Statistics repeated for every voxel: one group-by over the voxel column, partial sums combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.columns import average_rank, both, cosine, pearson, ratio


def correlation_map(images: DataFrame) -> DataFrame:
    return images.groupBy("dataset", "voxel").agg(pearson("value", "outcome").alias("r"))


def rank_correlation_map(images: DataFrame) -> DataFrame:
    """Spearman with average ranks on both sides, over the subjects that have a value at the voxel.

    Where a dataset has no holes, the outcome's ranks are the same at every voxel: they are made once, on the
    subjects, and joined. Datasets with holes are ranked voxel by voxel.
    """
    people = images.groupBy("dataset", "subject").agg(F.min("outcome").alias("outcome"), F.count("value").alias("n"), F.count(F.lit(1)).alias("m"))
    holed = F.broadcast(people.groupBy("dataset").agg((F.min(F.col("n") - F.col("m")) < 0).alias("holed")))
    marked = images.where("value is not null and outcome is not null").withColumn("value", average_rank("value", "dataset", "voxel")).join(holed, "dataset")
    ranks = people.where("outcome is not null").select("dataset", "subject", average_rank("outcome", "dataset").alias("_k"))
    whole = marked.where("not holed").drop("outcome").join(ranks, ["dataset", "subject"]).withColumnRenamed("_k", "outcome")
    others = marked.where("holed").withColumn("outcome", average_rank("outcome", "dataset", "voxel"))
    return correlation_map(whole.unionByName(others))


def average_map(images: DataFrame) -> DataFrame:
    """Sum over what is there, divided by all rows; population deviation."""
    return images.groupBy("dataset", "voxel").agg((F.sum("value") / F.count(F.lit(1))).alias("mean"), F.stddev_pop("value").alias("sd"))


def signed_overlap(images: DataFrame, t: float) -> DataFrame:
    """+1 for each value at or above t, -1 at or below -t; opposite signs cancel."""
    sign = F.when(F.col("value") >= t, 1).when(F.col("value") <= -t, -1).otherwise(0)
    return images.groupBy("dataset", "voxel").agg(F.sum(sign).alias("overlap"), F.sum((F.col("value") >= t).cast("int")).alias("sensitivity"), F.count(F.lit(1)).alias("n"))


def step_overlap(overlap: DataFrame, step: int = 5) -> DataFrame:
    return overlap.withColumn("percent", F.floor(100.0 * F.col("sensitivity") / F.col("n") / step) * step)


def control_scores(images: DataFrame, control: float) -> DataFrame:
    """z of every other subject against the controls' voxel mean and population deviation."""
    stats = images.where(F.col("outcome") == control).groupBy("voxel").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return images.where(F.col("outcome") != control).join(stats, "voxel").select("subject", "voxel", ratio(F.col("value") - F.col("m"), F.col("s")).alias("z"))


def regression_map(images: DataFrame) -> DataFrame:
    """OLS of the outcome on the voxel: slope, intercept, R2 and the slope's t; null where undefined."""
    x, y = both("value", "outcome")
    g = images.groupBy("dataset", "voxel").agg(
        F.count(x).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my")
    )
    b = ratio(F.col("c"), F.col("vx"))
    r2 = ratio(F.col("c") * F.col("c"), F.col("vx") * F.col("vy"))
    g = g.withColumn("slope", b).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).withColumn("r2", r2)
    mse = F.col("vy") * (1 - F.col("r2")) * F.col("n") / (F.col("n") - 2)
    return g.withColumn("t", F.when((F.col("n") > 2) & (F.col("r2") < 1), F.col("slope") / F.sqrt(mse / (F.col("n") * F.col("vx"))))).select("dataset", "voxel", "slope", "intercept", "r2", "t")


def residuals(images: DataFrame) -> DataFrame:
    """Value minus its straight-line fit on the outcome, per dataset and voxel."""
    fit = images.groupBy("dataset", "voxel").agg(F.regr_slope("value", "outcome").alias("b"), F.avg("value").alias("mv"), F.avg("outcome").alias("mo"))
    return images.join(fit, ["dataset", "voxel"]).select("subject", "voxel", (F.col("value") - F.col("mv") - F.col("b") * (F.col("outcome") - F.col("mo"))).alias("residual"))


def agreement(maps: DataFrame, value: str) -> DataFrame:
    """The common sign of all maps at a voxel, else 0."""
    return maps.groupBy("voxel").agg(F.when(F.min(F.signum(value)) == F.max(F.signum(value)), F.min(F.signum(value))).otherwise(F.lit(0.0)).alias("agreement"))


def map_similarity(maps: DataFrame, value: str) -> DataFrame:
    """Pearson and cosine of every pair of maps, over shared voxels."""
    a = maps.select(F.col("dataset").alias("a"), "voxel", F.col(value).alias("x"))
    b = maps.select(F.col("dataset").alias("b"), "voxel", F.col(value).alias("y"))
    return a.join(b, "voxel").where("a <= b").groupBy("a", "b").agg(pearson("x", "y").alias("r"), cosine("x", "y").alias("cosine"))


def damage_scores(images: DataFrame, target: DataFrame) -> DataFrame:
    """Every subject against one target map (voxel, weight): dot, cosine, sum and mean inside the target."""
    j = images.join(target, "voxel")
    dot, inside = F.sum(F.col("value") * F.col("weight")), F.col("weight") > 0
    return j.groupBy("subject").agg(
        dot.alias("dot"),
        cosine("value", "weight").alias("cosine"),
        F.sum(F.when(inside, F.col("value"))).alias("inside"),
        F.avg(F.when(inside, F.col("value"))).alias("mean_inside"),
        F.sum((inside & (F.col("value") > 0)).cast("int")).alias("n_inside"),
    )


def dice_pairs(masks: DataFrame) -> DataFrame:
    """Dice of every pair of ids a < b of (id, voxel, on); two empty masks agree fully."""
    n = masks.groupBy("id").agg(F.sum(F.col("on").cast("int")).alias("n"))
    on = masks.where("on").select("id", "voxel")
    both = on.select(F.col("id").alias("a"), "voxel").join(on.select(F.col("id").alias("b"), "voxel"), "voxel").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    pairs = n.select(F.col("id").alias("a"), F.col("n").alias("na")).join(n.select(F.col("id").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    dice = F.when(F.col("na") + F.col("nb") == 0, 1.0).otherwise(2.0 * F.coalesce("both", F.lit(0)) / (F.col("na") + F.col("nb")))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", dice.alias("dice"))


def top_voxels(maps: DataFrame, value: str) -> DataFrame:
    """The voxels of the largest value in each dataset, ties included."""
    return maps.withColumn("k", F.rank().over(Window.partitionBy("dataset").orderBy(F.desc(value)))).where("k = 1").drop("k")
