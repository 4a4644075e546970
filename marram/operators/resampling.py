"""Permutation inference. The replicate is a column; draws are hashes of (seed, replicate, id)."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.columns import hash_order, pearson, r6

DRAWS = 50_000_000  # numbers of a matrix of draws that may travel to the tasks
VOXELS = 4096  # voxels of a block
FEW = 500_000  # rows drawn from that are broadcast


def shuffled(subjects: DataFrame, replicates: int, block: str, value: str, seed: str) -> DataFrame:
    """(rep, block, subject, value): within each block the values are dealt to the subjects anew, for every replicate."""
    reps = subjects.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    place = Window.partitionBy("rep", block).orderBy("subject")
    drawn = Window.partitionBy("rep", block).orderBy(hash_order(seed, "rep", "subject"), "subject")
    to = reps.select("rep", block, "subject", F.row_number().over(place).alias("k"))
    of = reps.select("rep", block, F.col(value).alias(value), F.row_number().over(drawn).alias("k"))
    return to.join(of, ["rep", block, "k"]).drop("k")


def draw_matrix(people: DataFrame, replicates: int, value: str, seed: str) -> dict:
    """Per dataset the subjects in order and their values in every replicate, (replicates, subjects), row 0 as observed.

    One number per subject and replicate reaches the driver and travels to the tasks; ``DRAWS`` bounds them.
    """
    local = people.select("dataset", "subject", value).orderBy("dataset", "subject").limit(DRAWS // max(1, replicates) + 1).toPandas()
    if len(local) * replicates > DRAWS:
        raise ValueError(f"more than {DRAWS} draws; split the replicates")
    lists = {d: (f["subject"].to_numpy(), f[value].to_numpy(float)) for d, f in local.groupby("dataset")}

    def draw(batches):
        """The order of md5(seed|replicate|subject) within each dataset, as ``shuffled`` has it."""
        for frame in batches:
            for rep in frame["id"].tolist():
                for d, (subjects, values) in lists.items():
                    keys = [hashlib.md5(f"{seed}|{rep}|{s}".encode()).hexdigest() for s in subjects.tolist()]
                    order = sorted(range(len(keys)), key=lambda i: (keys[i], i))
                    yield pd.DataFrame({"dataset": [d], "rep": [rep], "v": [values[order].tobytes()]})

    spark = people.sparkSession
    rows = spark.range(1, replicates + 1, 1, min(replicates, 64)).mapInPandas(draw, "dataset int, rep long, v binary").orderBy("dataset", "rep").toPandas()
    return {d: (subjects, np.stack([values, *[np.frombuffer(v) for v in rows.loc[rows["dataset"] == d, "v"]]])) for d, (subjects, values) in lists.items()}


def block_correlations(images: DataFrame, draws: dict, emit, shape: str, block: int = VOXELS) -> DataFrame:
    """emit(key, voxels, r) of every dataset and block of voxels, r being (replicates, voxels) with NaN where undefined.

    One matrix product per block gives the r of all its voxels in all replicates, over the complete pairs of each voxel.
    """
    shared = images.sparkSession.sparkContext.broadcast(draws)

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        subjects, y = shared.value[key[0]]
        voxels, at = np.unique(frame["voxel"].to_numpy(), return_inverse=True)
        x = np.full((len(subjects), len(voxels)), np.nan)
        x[np.searchsorted(subjects, frame["subject"].to_numpy()), at] = frame["value"].to_numpy(float)
        return emit(key, voxels, correlations(y, x))

    placed = images.select("dataset", "subject", "voxel", "value").withColumn("_b", F.floor(F.col("voxel") / block))
    return placed.groupBy("dataset", "_b").applyInPandas(run, shape)


def correlations(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Pearson r of each row of y (replicates, n) with each column of x (n, voxels), over the complete pairs."""
    seen, own = ~np.isnan(x), ~np.isnan(y)
    x0, y0 = np.where(seen, x, 0.0), np.where(own, y, 0.0)
    m, w = seen.astype(float), own.astype(float)
    n = w @ m
    with np.errstate(divide="ignore", invalid="ignore"):
        sx, sy, sxy, sxx, syy = w @ x0, y0 @ m, y0 @ x0, w @ (x0 * x0), (y0 * y0) @ m
        vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
        r = (sxy / n - sx * sy / n / n) / np.sqrt(vx * vy)
    r[~((vx > 1e-20) & (vy > 1e-20))] = np.nan
    return r


def max_r(images: DataFrame, replicates: int = 100, seed: str = "fwe", percentile: float | None = None) -> DataFrame:
    """r of every voxel with its family-wise p: the share of replicates whose largest |r| reaches it.

    With ``percentile`` a replicate gives that percentile of its |r| in place of the largest, per block of voxels the
    largest such. Ties at six decimals count as reached.
    """
    people = images.groupBy("dataset", "subject").agg(F.min("outcome").alias("outcome"))
    draws = draw_matrix(people, replicates, "outcome", seed)

    def largest(key, voxels, r):
        size = np.abs(np.round(r, 6))
        top = np.where(np.isnan(size), -1.0, size)
        top = top.max(axis=1) if percentile is None else np.percentile(top, percentile, axis=1)
        return pd.DataFrame({"dataset": key[0], "rep": np.arange(len(top)), "m": top})

    null = block_correlations(images, draws, largest, "dataset int, rep int, m double").where("rep > 0").groupBy("dataset", "rep").agg(F.max("m").alias("m"))
    lists = null.groupBy("dataset").agg(F.collect_list("m").alias("null"))  # one number per replicate
    seen = images.groupBy("dataset", "voxel").agg(r6(pearson("value", "outcome")).alias("r"))
    p = F.size(F.filter("null", lambda m: m >= F.abs("r"))) / F.lit(float(replicates))
    return seen.join(F.broadcast(lists), "dataset").select("dataset", "voxel", "r", F.when(F.col("r").isNotNull(), p).alias("p"))


def similarity_permutation(images: DataFrame, replicates: int, seed: str = "sim") -> DataFrame:
    """Per pair of datasets: r of their correlation maps, and the share of replicates, outcomes permuted in each, whose
    |r| reaches it."""
    people = images.groupBy("dataset", "subject").agg(F.min("outcome").alias("outcome"))
    draws = draw_matrix(people, replicates, "outcome", seed)

    def maps(key, voxels, r):
        reps = np.repeat(np.arange(len(r)), len(voxels))
        return pd.DataFrame({"dataset": key[0], "rep": reps, "voxel": np.tile(voxels, len(r)), "r": r.ravel()})

    m = block_correlations(images, draws, maps, "dataset int, rep int, voxel int, r double").withColumn("r", F.nanvl("r", F.lit(None)))
    a, b = m.select("rep", "voxel", F.col("dataset").alias("a"), F.col("r").alias("x")), m.select("rep", "voxel", F.col("dataset").alias("b"), F.col("r").alias("y"))
    s = a.join(b, ["rep", "voxel"]).where("a < b").groupBy("a", "b", "rep").agg(r6(pearson("x", "y")).alias("r"))
    seen = s.where("rep = 0").select("a", "b", F.col("r").alias("seen"))
    return s.where("rep > 0").join(seen, ["a", "b"]).groupBy("a", "b", "seen").agg(F.avg((F.abs("r") >= F.abs("seen")).cast("double")).alias("p")).withColumnRenamed("seen", "r")


def bootstrap(df: DataFrame, key: str, replicates: int, seed: str) -> DataFrame:
    """(rep, draw, and the row drawn): n draws with replacement in every replicate, row = hash(seed, rep, draw) mod n in
    the order of the key. For tables of subjects: rows times replicates are made.

    The draws are a range of counted length, dealt to all tasks: made by explode they would look like one row to the
    planner, which then broadcasts them. Up to ``FEW`` rows travel to the draws; of more, both sides are shuffled.
    """
    from marram.functions.transforms import running

    n = df.count()
    placed = running(df.withColumn("_one", F.lit(1)), key, "_one", "_i").drop("_one")
    places = df.sparkSession.range(n * replicates)
    draws = places.select((F.expr(f"id div {max(1, n)}") + 1).cast("int").alias("rep"), (F.col("id") % max(1, n) + 1).alias("draw"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    return draws.withColumn("_i", number % max(1, n)).join(F.broadcast(placed) if n <= FEW else placed, "_i").drop("_i")


def bootstrap_summary(draws: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Of one statistic per replicate: mean, se, 2.5 and 97.5 percentiles, two-sided sign p."""
    up = F.avg((F.col(value) > 0).cast("double"))
    p = F.least(F.lit(1.0), 2 * F.least(up, 1 - up))
    return draws.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"), p.alias("p"))


def empirical_p(null: DataFrame, value: str, seen: str, by: list[str], side: str = "both", inclusive: bool = True, plus_one: bool = False) -> DataFrame:
    """The share of replicates that reach the observed value, by side (``both``, ``above``, ``below``)."""
    v, o = (F.abs(value), F.abs(seen)) if side == "both" else (F.col(value), F.col(seen))
    hit = (v <= o if inclusive else v < o) if side == "below" else (v >= o if inclusive else v > o)
    k, n = F.sum(hit.cast("double")), F.count(value)
    return null.groupBy(*by).agg(((k + 1) / (n + 1) if plus_one else k / n).alias("p"))


def label_permutation(people: DataFrame, x: str, y: str, group: str, replicates: int, seed: str) -> DataFrame:
    """r(x, y) in group 1 minus that in group 0, and the share of replicates with labels permuted that reach its size."""
    base = people.select("subject", x, y, F.lit(0).alias("block"), group)
    null = shuffled(base.select("subject", "block", F.col(group).alias("_g")), replicates, "block", "_g", seed)
    every = null.join(base.select("subject", x, y), "subject").unionByName(base.select(F.lit(0).alias("rep"), "block", "subject", F.col(group).alias("_g"), x, y))
    halves = every.groupBy("rep", "_g").agg(pearson(x, y).alias("r")).groupBy("rep").agg(r6(F.max(F.when(F.col("_g") == 1, F.col("r"))) - F.max(F.when(F.col("_g") == 0, F.col("r")))).alias("delta"))
    seen = halves.where("rep = 0").select(F.col("delta").alias("seen"))
    got = halves.where("rep > 0").crossJoin(F.broadcast(seen))
    return got.groupBy("seen").agg(F.avg((F.abs("delta") >= F.abs("seen")).cast("double")).alias("p")).withColumnRenamed("seen", "delta")


def paired_superiority(draws: DataFrame, a: str, b: str) -> DataFrame:
    """Of a paired statistic per replicate: mean gap, share of replicates in which a exceeds b, percentile interval."""
    gap = F.col(a) - F.col(b)
    return draws.agg(F.avg(gap).alias("gap"), F.avg((gap > 0).cast("double")).alias("share"), F.percentile(gap, F.lit(0.025)).alias("low"), F.percentile(gap, F.lit(0.975)).alias("high"))


def permuted_dice(a: DataFrame, b: DataFrame, replicates: int, seed: str, at: float = 0.95) -> DataFrame:
    """Dice of two maps (voxel, value) above their own percentile, and the share of replicates, b's voxels permuted,
    that exceed it."""
    on = lambda m: m.crossJoin(F.broadcast(m.agg(F.percentile("value", F.lit(at)).alias("_c")))).select("voxel", (F.col("value") >= F.col("_c")).cast("int").alias("on"))
    x, y = on(a).withColumnRenamed("on", "x"), on(b).select(F.col("voxel").alias("subject"), F.lit(0).alias("block"), F.col("on").alias("y"))
    null = shuffled(y, replicates, "block", "y", seed).select("rep", F.col("subject").alias("voxel"), "y").unionByName(y.select(F.lit(0).alias("rep"), F.col("subject").alias("voxel"), "y"))
    dice = null.join(x, "voxel").groupBy("rep").agg((2.0 * F.sum(F.col("x") * F.col("y")) / (F.sum("x") + F.sum("y"))).alias("dice"))
    seen = dice.where("rep = 0").select(F.col("dice").alias("seen"))
    return dice.where("rep > 0").crossJoin(F.broadcast(seen)).groupBy("seen").agg(F.avg((F.col("dice") > F.col("seen")).cast("double")).alias("p")).withColumnRenamed("seen", "dice")


def merged_counts(files: DataFrame, replicates: int) -> DataFrame:
    """p of every voxel from counts (file, voxel, p_count) that many runs of ``replicates`` wrote."""
    runs = F.broadcast(files.select("file").distinct().agg((F.count(F.lit(1)) * replicates).alias("_n")))
    return files.groupBy("voxel").agg(F.sum("p_count").alias("k")).crossJoin(runs).select("voxel", (F.col("k") / F.col("_n")).alias("p"))


def benjamini_hochberg(tests: DataFrame, p: str, by: str) -> DataFrame:
    """Adds q: the smallest p * n / rank at this p or a larger one; a null p is no test and has no q."""
    n = F.count(p).over(Window.partitionBy(by))
    w = Window.partitionBy(by).orderBy(F.desc("_k"))
    rank = F.rank().over(Window.partitionBy(by).orderBy(F.col(p).asc_nulls_last())) + F.count(F.lit(1)).over(Window.partitionBy(by, p)) - 1
    ranked = tests.withColumn("_k", F.when(F.col(p).isNotNull(), rank))
    return ranked.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(F.col(p) * n / F.col("_k")).over(w)))).drop("_k")


def bonferroni(tests: DataFrame, p: str, by: str, alpha: float = 0.05, capped: bool = True) -> DataFrame:
    """p times the number of tests, for p below alpha only; others stay as they are."""
    n = F.count(p).over(Window.partitionBy(by))
    scaled = F.col(p) * n
    return tests.withColumn("q", F.when(F.col(p) < alpha, F.least(F.lit(1.0), scaled) if capped else scaled).otherwise(F.col(p)))
