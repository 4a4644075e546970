"""Hypothesis tests as one-row frames: statistic, degrees of freedom and p. Nulls take no part; empty input gives nulls.

Ranks come from counts per distinct value (``transforms.ranks``), so no test sorts a whole column in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions import distributions as dist
from marram.functions.columns import ratio
from marram.functions.transforms import ranks, running


def of(x: str, group: str, level) -> Column:
    return F.when(F.col(group) == F.lit(level), F.col(x))


def moments(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    one, two = of(x, group, a), of(x, group, b)
    return df.agg(F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"), F.count(one).alias("n1"), F.count(two).alias("n2"))


def welch(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    return welch_from(moments(df, x, group, a, b))


def welch_from(summary: DataFrame) -> DataFrame:
    """Welch's t from means m1, m2, variances v1, v2 and sizes n1, n2."""
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    got = summary.select(ratio(F.col("m1") - F.col("m2"), F.sqrt(s1 + s2)).alias("t"), ratio((s1 + s2) * (s1 + s2), s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1)).alias("df"))
    return got.withColumn("p", dist.t_p(F.col("t"), F.col("df")))


def student(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    return from_summary(moments(df, x, group, a, b))


def from_summary(summary: DataFrame) -> DataFrame:
    """Two-sample t from means m1, m2, variances v1, v2 and sizes n1, n2."""
    n = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / n
    got = summary.select(ratio(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"), n.cast("double").alias("df"))
    return got.withColumn("p", dist.t_p(F.col("t"), F.col("df")))


def one_sample(df: DataFrame, x: Column, mean: float = 0.0) -> DataFrame:
    got = df.agg(ratio(F.avg(x) - mean, F.stddev_samp(x) / F.sqrt(F.count(x))).alias("t"), (F.count(x) - 1).cast("double").alias("df"))
    return got.withColumn("p", dist.t_p(F.col("t"), F.col("df")))


def anova(df: DataFrame, x: str, group: str) -> DataFrame:
    each = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    all_of = each.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    got = all_of.select(ratio(F.col("between") / d1, F.col("within") / d2).alias("f"), d1.cast("double").alias("df1"), d2.cast("double").alias("df2"))
    return got.withColumn("p", dist.f_p(F.col("f"), F.col("df1"), F.col("df2")))


def tie_term(df: DataFrame, x: str) -> DataFrame:
    """One row: n and the sum of t^3 - t over groups of ties."""
    return df.where(F.col(x).isNotNull()).groupBy(x).count().agg(F.sum("count").cast("double").alias("n"), F.sum(F.pow(F.col("count").cast("double"), F.lit(3)) - F.col("count")).alias("ties"))


def kruskal(df: DataFrame, x: str, group: str) -> DataFrame:
    """H with the correction for ties."""
    rows = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).select(x, group)
    sums = ranks(rows, x, "_k").groupBy(group).agg(F.sum("_k").alias("s"), F.count(F.lit(1)).alias("c"))
    got = sums.agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("q"), (F.count(F.lit(1)) - 1).cast("double").alias("df")).crossJoin(tie_term(rows, x))
    n = F.col("n")
    h = ratio(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    return got.select(h.alias("h"), "df").withColumn("p", dist.chi2_p(F.col("h"), F.col("df")))


def mann_whitney(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    """U of the first group, and two-sided p by the normal approximation with ties and continuity corrected."""
    rows = df.where(F.col(group).isin(a, b) & F.col(x).isNotNull()).select(x, group)
    got = ranks(rows, x, "_k").agg(F.sum(of("_k", group, a)).alias("r"), F.count(of("_k", group, a)).cast("double").alias("n1"), F.count(of("_k", group, b)).cast("double").alias("n2")).crossJoin(tie_term(rows, x))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n")
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    got = got.withColumn("u", F.col("r") - n1 * (n1 + 1) / 2)
    return got.select("u", (2 * dist.normal_sf(ratio(F.greatest(F.lit(0.0), F.abs(F.col("u") - n1 * n2 / 2) - 0.5), sd))).alias("p"))


def wilcoxon(df: DataFrame, difference: Column) -> DataFrame:
    """W (the smaller rank sum of signed differences, zeros dropped) and its normal p with ties corrected."""
    rows = df.select(difference.alias("_d")).where("_d is not null and _d <> 0").select("_d", F.abs("_d").alias("_a"))
    got = ranks(rows, "_a", "_k").agg(F.sum(F.when(F.col("_d") > 0, F.col("_k")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("_d") < 0, F.col("_k")).otherwise(0.0)).alias("down")).crossJoin(tie_term(rows, "_a"))
    n = F.col("n")
    got = got.withColumn("w", F.least("up", "down"))
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return got.select("w", (2 * dist.normal_sf(ratio(F.abs(F.col("w") - n * (n + 1) / 4), sd))).alias("p"))


def ks_two_sample(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    """D and its asymptotic p."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count(of(x, group, a)).alias("a"), F.count(of(x, group, b)).alias("b"))
    both = running(running(counts, "v", "a", "_a"), "v", "b", "_b")
    n = F.broadcast(counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2")))
    d = F.max(F.abs((F.col("_a") + F.col("a")) / F.col("n1") - (F.col("_b") + F.col("b")) / F.col("n2")))
    got = both.crossJoin(n).groupBy("n1", "n2").agg(d.alias("d"))
    z = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))) * F.col("d")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.pow(F.lit(-1.0), (k - 1).cast("double")) * F.exp(-2.0 * k * k * z * z))
    return got.select("d", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * terms)).alias("p"))


def variance_f(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    got = moments(df, x, group, a, b).select(ratio(F.col("v1"), F.col("v2")).alias("f"), (F.col("n1") - 1).cast("double").alias("df1"), (F.col("n2") - 1).cast("double").alias("df2"))
    up = dist.f_p(F.col("f"), F.col("df1"), F.col("df2"))
    return got.withColumn("p", 2 * F.least(up, 1 - up))


def table_2x2(df: DataFrame, x: str, y: str) -> DataFrame:
    """a, b, c, d of two 0/1 columns: both, x only, y only, neither."""
    cell = lambda i, j: F.sum(((F.col(x) == i) & (F.col(y) == j)).cast("double"))
    return df.agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))


def chi_square_2x2(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b, c, d = (F.col(k) for k in "abcd")
    cross = a * d - b * c
    got = table_2x2(df, x, y).select(ratio((a + b + c + d) * cross * cross, (a + b) * (c + d) * (a + c) * (b + d)).alias("chi2"), ratio((b - c) * (b - c), b + c).alias("mcnemar"))
    return got.withColumn("p", dist.chi2_p(F.col("chi2"), F.lit(1.0))).withColumn("p_mcnemar", dist.chi2_p(F.col("mcnemar"), F.lit(1.0)))


def chi_square(df: DataFrame, x: str, y: str) -> DataFrame:
    """Independence of two labels: counts per cell, expected from the margins."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("o"))
    rows, columns = cells.groupBy(x).agg(F.sum("o").alias("r")), cells.groupBy(y).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").cast("double").alias("n"))
    every = rows.crossJoin(columns).crossJoin(total).join(cells, [x, y], "left")  # levels by levels
    e = F.col("r") * F.col("c") / F.col("n")
    gap = F.coalesce("o", F.lit(0)) - e
    got = every.agg(F.sum(gap * gap / e).alias("chi2"), ((F.count_distinct(x) - 1) * (F.count_distinct(y) - 1)).cast("double").alias("df"))
    return got.withColumn("p", dist.chi2_p(F.col("chi2"), F.col("df")))


def fisher_exact(df: DataFrame, x: str, y: str) -> DataFrame:
    """Two-sided: all tables with the same margins that are no more probable. The sum runs over at most the smaller margin."""
    a, b, c, d = (F.col(k) for k in "abcd")
    ln = lambda k: dist.ln_gamma(k + 1)
    at = table_2x2(df, x, y).withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0.0), a - d).cast("long"), F.least(a + b, a + c).cast("long"))))
    i = F.col("i").cast("double")
    at = at.withColumn("lp", ln(a + b) + ln(c + d) + ln(a + c) + ln(b + d) - ln(a + b + c + d) - ln(i) - ln(a + b - i) - ln(a + c - i) - ln(d - a + i))
    seen = at.where(F.col("i") == a).select(F.col("lp").alias("own"))
    return at.crossJoin(seen).agg(F.sum(F.when(F.col("lp") <= F.col("own") + 1e-7, F.exp("lp"))).alias("p"))


def proportions(df: DataFrame, success: str, group: str) -> DataFrame:
    """z of the shares of 1 in group 1 and group 0, pooled, and its p."""
    one, two = of(success, group, 1).cast("double"), of(success, group, 0).cast("double")
    g = df.agg(F.avg(one).alias("p1"), F.avg(two).alias("p2"), F.count(one).alias("n1"), F.count(two).alias("n2"))
    p = (F.col("p1") * F.col("n1") + F.col("p2") * F.col("n2")) / (F.col("n1") + F.col("n2"))
    got = g.select(ratio(F.col("p1") - F.col("p2"), F.sqrt(p * (1 - p) * (1 / F.col("n1") + 1 / F.col("n2")))).alias("z"))
    return got.withColumn("p", 2 * dist.normal_sf(F.abs("z")))


def anderson_darling(df: DataFrame, x: str, by: str) -> DataFrame:
    """A squared against the normal with the group's own mean and deviation, per group."""
    from pyspark.sql import Window

    from marram.functions.transforms import standardise

    z = standardise(df.where(F.col(x).isNotNull()).select(by, x), x, "_z", [by], ddof=1).withColumn("_f", dist.normal_cdf(F.col("_z")))
    i = F.row_number().over(Window.partitionBy(by).orderBy("_z"))
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    placed = z.withColumn("_i", i).withColumn("_n", n)
    term = (2 * F.col("_i") - 1) * F.log("_f") + (2 * F.col("_n") + 1 - 2 * F.col("_i")) * F.log(1 - F.col("_f"))
    return placed.groupBy(by, "_n").agg(F.sum(term).alias("_s")).select(by, (-F.col("_n") - F.col("_s") / F.col("_n")).alias("a2"), F.col("_n").alias("n"))


def mean_interval(df: DataFrame, x: str, by: list[str], level: float = 0.95) -> DataFrame:
    g = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"))
    low, high = dist.pooled_interval(F.col("mean"), F.col("sd"), F.col("n"), level)
    return g.withColumn("low", low).withColumn("high", high)


def iqr_of_sd(sd: Column) -> Column:
    return sd * 1.349


# --- classifiers ---------------------------------------------------------------------------------------------------


def binary_metrics(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """0 where a share has an empty base."""
    share = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return {"sens": share(tp, tp + fn), "spec": share(tn, tn + fp), "ppv": share(tp, tp + fp), "npv": share(tn, tn + fn), "acc": share(tp + tn, tp + tn + fp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}


def one_vs_rest(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts and metrics of every class, from the confusion counts alone."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("q")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    labels = cells.select(F.explode(F.array("t", "q")).alias("label")).distinct()
    each = cells.crossJoin(labels)  # classes cubed, whatever the rows
    t, q = F.col("t") == F.col("label"), F.col("q") == F.col("label")
    cell = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0.0))
    g = each.groupBy("label").agg(cell(t & q).alias("tp"), cell(~t & ~q).alias("tn"), cell(~t & q).alias("fp"), cell(t & ~q).alias("fn"))
    return g.select("label", *[c.alias(n) for n, c in binary_metrics(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")).items()])


def roc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Per distinct score as cut (predicted positive at or above it): tpr, fpr, precision, accuracy."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("cut")).agg(F.sum(truth).alias("p"), F.sum(1 - F.col(truth)).alias("q"))
    total = F.broadcast(counts.agg(F.sum("p").cast("double").alias("np"), F.sum("q").cast("double").alias("nq")))
    below = running(running(counts, "cut", "p", "_p"), "cut", "q", "_q").crossJoin(total)
    tp, fp = F.col("np") - F.col("_p"), F.col("nq") - F.col("_q")
    return below.select("cut", ratio(tp, F.col("np")).alias("tpr"), ratio(fp, F.col("nq")).alias("fpr"), ratio(tp, tp + fp).alias("precision"), ((tp + F.col("_q")) / (F.col("np") + F.col("nq"))).alias("accuracy"))


def auc_delong(df: DataFrame, score: str, truth: str) -> DataFrame:
    """AUC and DeLong's variance from mid-ranks within and over the classes."""
    rows = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(truth).alias("t"))
    k = ranks(ranks(rows, "s", "_k"), "s", "_own", ["t"])
    n = F.broadcast(rows.agg(F.sum("t").cast("double").alias("n1"), F.sum(1 - F.col("t")).cast("double").alias("n0")))
    placed = k.crossJoin(n)
    v1 = F.when(F.col("t") == 1, (F.col("_k") - F.col("_own")) / F.col("n0"))
    v0 = F.when(F.col("t") == 0, 1 - (F.col("_k") - F.col("_own")) / F.col("n1"))
    return placed.agg(F.avg(v1).alias("auc"), (F.var_samp(v1) / F.max("n1") + F.var_samp(v0) / F.max("n0")).alias("variance"))


def delong_z(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two independent models: z of the difference of their AUCs, and p."""
    x, y = a.select(F.col("auc").alias("a1"), F.col("variance").alias("w1")), b.select(F.col("auc").alias("a2"), F.col("variance").alias("w2"))
    got = x.crossJoin(y).select("a1", "a2", ratio(F.col("a1") - F.col("a2"), F.sqrt(F.col("w1") + F.col("w2"))).alias("z"))
    return got.withColumn("p", 2 * dist.normal_sf(F.abs("z")))


def hanley_error(auc: Column, positives: Column, negatives: Column) -> Column:
    """Standard error of an AUC by Hanley and McNeil."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return F.sqrt((auc * (1 - auc) + (positives - 1) * (q1 - auc * auc) + (negatives - 1) * (q2 - auc * auc)) / (positives * negatives))


def by_thresholds(scores: dict[str, float]) -> Column:
    """The first class, in order, whose probability column reaches its threshold; null if none does."""
    out = F
    for name, t in scores.items():
        out = out.when(F.col(name) >= t, name)
    return out


def kappa(df: DataFrame, a: str, b: str, level: float = 0.95) -> DataFrame:
    """Cohen's kappa with its large-sample interval."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    x, y = cells.groupBy(F.col(a).alias("l")).agg(F.sum("o").alias("x")), cells.groupBy(F.col(b).alias("l")).agg(F.sum("o").alias("y"))
    chance = x.join(y, "l").agg(F.sum(F.col("x") * F.col("y")).alias("e"))
    g = cells.agg(F.sum("o").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("o")).otherwise(0.0)).alias("s")).crossJoin(chance)
    po, pe = F.col("s") / F.col("n"), F.coalesce("e", F.lit(0.0)) / (F.col("n") * F.col("n"))
    se = F.sqrt(po * (1 - po) / (F.col("n") * (1 - pe) * (1 - pe)))
    k, z = ratio(po - pe, 1 - pe), dist.normal_ppf(F.lit((1 + level) / 2))
    return g.select(k.alias("kappa"), (k - z * se).alias("low"), (k + z * se).alias("high"))
