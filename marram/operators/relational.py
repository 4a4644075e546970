"""Joins and reshapes of subject tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_all(tables: list[DataFrame], on: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on), tables)


def nearest(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, left_id: str) -> DataFrame:
    """For each left row the right row of its key nearest in time, the earlier on a tie; null if the key has none.

    Both sides are laid on one time line per key, and each left row takes the last right time before it and the first
    after it, so no key's rows are multiplied.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = F.struct(*[F.col(c) for c in left.columns])
    line = left.select(F.col(key).alias("_k"), micros(lt).alias("_t"), F.lit(1).alias("_s"), own.alias("_l"), F.lit(None).cast(dict(right.dtypes)[rt]).alias(rt))
    line = line.unionByName(right.select(F.col(key).alias("_k"), micros(rt).alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast(dict(line.dtypes)["_l"]).alias("_l"), F.col(rt)))
    w = Window.partitionBy("_k").orderBy("_t", "_s")
    back = F.last(rt, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first(rt, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = line.withColumn("_b", back).withColumn("_a", ahead).where("_s = 1")
    gap = lambda c: F.abs(F.col("_t") - micros(c))
    visit = F.when(F.col("_a").isNull() | (gap("_b") <= gap("_a")), F.col("_b")).otherwise(F.col("_a"))
    return near.withColumn(rt, visit).select("_l.*", rt, gap(rt).alias("gap"))


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The rows of the first table, and those of the second whose key the first lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def first_rows(df: DataFrame, by: str, order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_n = 1").drop("_n")


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "variable", "value")


def strata(df: DataFrame, x: str, by: str, cuts: list[float]) -> DataFrame:
    """Quantile strata: how many of the group's different cut points lie below the value; equal ones make fewer strata."""
    points = df.groupBy(by).agg(F.percentile(x, F.array(*map(F.lit, cuts))).alias("_cuts"))
    return df.join(points, by).withColumn("stratum", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(x)))).drop("_cuts")


def merge_suffixed(a: DataFrame, b: DataFrame, on: str, suffix: str = "_2") -> DataFrame:
    """Full outer join; columns of b whose names clash get the suffix."""
    clash = set(a.columns) & set(b.columns) - {on}
    return a.join(b.select(*[F.col(c).alias(c + suffix if c in clash else c) for c in b.columns]), on, "full")


def align(tables: list[DataFrame], on: str, order: str) -> list[DataFrame]:
    """Each table's first row (by ``order``) of the keys that all tables have."""
    keys = reduce(lambda a, b: a.join(b, on, "left_semi"), [t.select(on).distinct() for t in tables])
    return [first_rows(t.join(keys, on, "left_semi"), on, F.col(order)) for t in tables]


def align_images(images: DataFrame, covariates: DataFrame, required: bool = False) -> DataFrame:
    """Image rows of subjects with covariates, one covariate row each; with ``required`` an empty result is an error."""
    got = images.join(covariates.dropDuplicates(["subject"]), "subject")
    if required and got.isEmpty():
        raise ValueError("no subject has both an image and covariates")
    return got


def hstack(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Columns side by side by position in each table's order (a number); the longer table is padded with nulls."""
    from marram.functions.transforms import running

    place = lambda df, order: running(df.withColumn("_one", F.lit(1)), order, "_one", "_i").drop("_one")
    return place(a, order_a).join(place(b, order_b), "_i", "full").drop("_i")


def cartesian(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every pair; meant for small sides, such as two lists of maps."""
    return a.crossJoin(b)


def match_paths(paths: DataFrame, subjects: DataFrame, loose: bool = True) -> DataFrame:
    """subject and path: the first path, by pass and then by name, whose name holds the id.

    Passes: ``sub-<id>`` not followed by a digit; the same with leading zeros; with ``loose``, the id anywhere. Digit
    runs of names are the join keys of the first two passes, so only the loose pass compares texts; a path may serve
    several subjects.
    """
    ids = F.explode(F.regexp_extract_all("path", F.lit(r"sub-([0-9A-Za-z]+)"), F.lit(1)))
    named = paths.select("path", ids.alias("_id"))
    s = subjects.select(F.col("subject").cast("string").alias("subject")).distinct()
    exact = named.join(s, F.col("_id") == F.col("subject")).select("subject", "path", F.lit(0).alias("_p"))
    bare = lambda c: F.regexp_replace(c, "^0+(?=.)", "")
    zeros = named.join(s, (bare(F.col("_id")) == bare(F.col("subject"))) & F.endswith(F.col("_id"), F.col("subject"))).select("subject", "path", F.lit(1).alias("_p"))
    found = exact.unionByName(zeros)
    best = found.groupBy("subject").agg(F.min(F.struct("_p", "path")).alias("_m")).select("subject", F.col("_m.path").alias("path"))
    if loose:
        rest = s.join(best, "subject", "left_anti")
        anywhere = rest.join(paths.select("path"), F.contains(F.col("path"), F.col("subject"))).groupBy("subject").agg(F.min("path").alias("path"))
        best = best.unionByName(anywhere)
    return s.join(best, "subject", "left")


def stem_pairs(names: DataFrame) -> DataFrame:
    """(a, b): for every name the first later one, by name, that contains it or is contained; for lists of files."""
    x, y = names.select(F.col("name").alias("a")), names.select(F.col("name").alias("b"))
    hit = F.contains(F.col("a"), F.col("b")) | F.contains(F.col("b"), F.col("a"))
    return x.join(y, (F.col("a") < F.col("b")) & hit).groupBy("a").agg(F.min("b").alias("b"))


def fill(df: DataFrame, x: str, out: str, order: str, by: list[str], forward: bool = True) -> DataFrame:
    """Nulls take the last value before them in their group, or the next one after."""
    w = Window.partitionBy(*by).orderBy(order)
    if forward:
        return df.withColumn(out, F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return df.withColumn(out, F.first(x, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))


def per_category_and_all(df: DataFrame, category: str, *aggregates: Column) -> DataFrame:
    """Aggregates per category and once over all; a null category is a category of its own, told from the total."""
    return df.rollup(category).agg(F.grouping(category).cast("int").alias("is_total"), *aggregates).withColumn(category, F.when(F.col("is_total") == 1, "all_categories").otherwise(F.col(category)))


def folds(df: DataFrame, fold: str) -> DataFrame:
    """Every row once for each fold that it is not in (column ``held``): the training rows of leave-one-fold-out."""
    held = df.select(F.col(fold).alias("held")).distinct()
    return df.join(F.broadcast(held), F.col(fold) != F.col("held"))


def top_k(df: DataFrame, by: list[str], score: str, k: int, tie: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))).where(F.col("_r") <= k).drop("_r")


def pivot_padded(df: DataFrame, category: str, value: str, order: str, levels: list) -> DataFrame:
    """One column per category, values in order, padded with nulls; no aggregation."""
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(category).orderBy(order)))
    return placed.groupBy("_i").pivot(category, levels).agg(F.first(value)).withColumnRenamed("_i", "position")
