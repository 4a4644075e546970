"""Regression per voxel and per table.

Least squares with several predictors: sums of products are aggregated per voxel in the JVM (they combine before the
shuffle), and only these small rows go to numpy, many voxels at a time, to be solved. Rows with a null in any term
take no part. Singular systems take the minimum-norm solution.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions import distributions as dist
from marram.functions.columns import ratio


def sums_of_products(df: DataFrame, by: list[str], y: Column, xs: list[Column], weight: Column | None = None) -> DataFrame:
    """Per group: n, xx (upper triangle of X'WX), xy, yy, sy, sw."""
    w = F.lit(1.0) if weight is None else weight
    whole = y.isNotNull() & w.isNotNull()
    for x in xs:
        whole = whole & x.isNotNull()
    rows = df.where(whole).select(*by, y.cast("double").alias("_y"), w.cast("double").alias("_w"), *[x.cast("double").alias(f"_x{i}") for i, x in enumerate(xs)])
    c = [F.col(f"_x{i}") for i in range(len(xs))]
    wy = F.col("_w") * F.col("_y")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("_w") * a * b) for a, b in combinations_with_replacement(c, 2)]).alias("xx"),
        F.array(*[F.sum(wy * a) for a in c]).alias("xy"), F.sum(wy * F.col("_y")).alias("yy"), F.sum(wy).alias("sy"), F.sum("_w").alias("sw"),
    )


def least_squares(df: DataFrame, by: list[str], y: Column, xs: dict[str, Column], weight: Column | None = None, contrasts: dict[str, list[float]] | None = None) -> DataFrame:
    """Per group and term (or contrast): estimate, se, t, df, p, and the group's r2. Terms are the names of xs.

    t is null where the residuals vanish or no degrees of freedom are left.
    """
    names = list(contrasts or xs)
    k = len(xs)
    matrix = np.array(list(contrasts.values()) if contrasts else np.eye(k), float)
    moments = sums_of_products(df, by, y, list(xs.values()), weight)
    kinds = dict(moments.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", n long, r2 double, estimates array<double>, errors array<double>"

    def solve(batches):
        upper = np.triu_indices(k)
        for f in batches:
            xx = np.zeros((len(f), k, k))
            xx[:, upper[0], upper[1]] = np.stack(f["xx"].to_numpy()) if len(f) else np.zeros((0, len(upper[0])))
            xx[:, upper[1], upper[0]] = xx[:, upper[0], upper[1]]
            xy = np.stack(f["xy"].to_numpy()) if len(f) else np.zeros((0, k))
            inverse = np.linalg.pinv(xx, hermitian=True)
            beta = np.einsum("gij,gj->gi", inverse, xy)
            yy, n = f["yy"].to_numpy(), f["n"].to_numpy()
            sse = np.maximum(yy - np.einsum("gi,gi->g", beta, xy), 0)
            sst = yy - f["sy"].to_numpy() ** 2 / f["sw"].to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                mse = np.where(n > k, sse / np.maximum(n - k, 1), np.nan)
                r2 = np.where(sst > 0, 1 - sse / sst, np.nan)
            spread = np.sqrt(np.maximum(np.einsum("ci,gij,cj->gc", matrix, inverse, matrix) * mse[:, None], 0))
            yield pd.concat([f[by], pd.DataFrame({"n": n, "r2": r2, "estimates": list(beta @ matrix.T), "errors": list(spread)}, index=f.index)], axis=1)

    got = moments.mapInPandas(solve, shape)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col("estimates")[i].alias("estimate"), F.col("errors")[i].alias("se")) for i, t in enumerate(names)]))
    out = got.select(*by, "n", F.nanvl("r2", F.lit(None)).alias("r2"), each.alias("e")).select(*by, "n", "r2", "e.*")
    out = out.withColumn("df", F.col("n") - k).withColumn("t", F.when((F.col("df") > 0) & (F.col("se") > 1e-12), F.col("estimate") / F.col("se")))
    return out.withColumn("p", F.when(F.col("t").isNotNull(), dist.t_p(F.col("t"), F.col("df"))))


def f_change(small: DataFrame, full: DataFrame, by: list[str], added: int, k: int) -> DataFrame:
    """F of the terms that the full model (k terms) adds, from the R2 of both."""
    a, b = small.select(*by, F.col("r2").alias("_a")).distinct(), full.select(*by, F.col("r2").alias("_b"), "n").distinct()
    f = ratio((F.col("_b") - F.col("_a")) / added, (1 - F.col("_b")) / (F.col("n") - k))
    return a.join(b, by).select(*by, f.alias("f"), dist.f_p(f, F.lit(float(added)), F.col("n") - k).alias("p"))


def residuals(df: DataFrame, by: list[str], y: str, xs: dict[str, Column], out: str) -> DataFrame:
    """y minus its fit on the terms, per group; null where a term is null."""
    fit = least_squares(df, by, F.col(y), xs).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("term", "estimate"))).alias("_b"))
    value = F.col(y)
    for name, x in xs.items():
        value = value - F.col("_b")[F.lit(name)] * x
    return df.join(fit, by).withColumn(out, value).drop("_b")


def logistic(df: DataFrame, by: list[str], y: str, xs: dict[str, Column], ridge: float = 1e-6, rounds: int = 50) -> DataFrame:
    """Per group and term: estimate, se, z, p and McFadden's R2, by iterated reweighting with linear predictors within
    +-20. A group's rows must fit one task, as those of a voxel do."""
    names = list(xs)
    rows = df.select(*by, F.col(y).cast("double").alias("_y"), *[x.cast("double").alias(f"_x{i}") for i, x in enumerate(xs.values())]).dropna()
    kinds = dict(rows.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", n long, r2 double, estimates array<double>, errors array<double>"

    def fit(key, f: pd.DataFrame) -> pd.DataFrame:
        x, t = f[[f"_x{i}" for i in range(len(names))]].to_numpy(), f["_y"].to_numpy()
        beta = np.zeros(len(names))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -20, 20)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(names))
            step = np.linalg.solve(hessian, x.T @ (t - p) - ridge * beta)
            beta = beta + step
            if np.abs(step).max() < 1e-10:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -20, 20))), 1e-12, 1 - 1e-12)
        mean = np.clip(t.mean(), 1e-12, 1 - 1e-12)
        own, null = (t * np.log(p) + (1 - t) * np.log(1 - p)).sum(), (t * np.log(mean) + (1 - t) * np.log(1 - mean)).sum()
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(names))
        return pd.DataFrame({**{c: [v] for c, v in zip(by, key, strict=True)}, "n": [len(f)], "r2": [1 - own / null if null else None], "estimates": [beta], "errors": [np.sqrt(np.diag(np.linalg.inv(hessian)))]})

    got = rows.groupBy(*by).applyInPandas(fit, shape)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col("estimates")[i].alias("estimate"), F.col("errors")[i].alias("se")) for i, t in enumerate(names)]))
    out = got.select(*by, "n", "r2", each.alias("e")).select(*by, "n", "r2", "e.*").withColumn("z", ratio(F.col("estimate"), F.col("se")))
    return out.withColumn("p", 2 * dist.normal_sf(F.abs("z")))


# --- simple regressions in closed form -----------------------------------------------------------------------------


def line(df: DataFrame, y: str, x: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """n, slope, intercept, sxx, xbar, s (residual deviation), r2."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.avg(x).alias("xbar"))
    sse = F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")
    return g.withColumn("sse", sse).withColumn("s", F.sqrt(ratio(F.greatest("sse", F.lit(0.0)), F.col("n") - 2))).withColumn("r2", 1 - ratio(F.col("sse"), F.col("syy")))


def fit_quality(df: DataFrame, y: str, x: str) -> DataFrame:
    """SSR, SSE, SSTO, MSR, MSE, F, p, R2 of a line."""
    g = line(df, y, x)
    ssr, df2 = F.col("syy") - F.col("sse"), F.col("n") - 2
    f = ratio(ssr, F.col("sse") / df2)
    return g.select(ssr.alias("ssr"), "sse", F.col("syy").alias("ssto"), ssr.alias("msr"), (F.col("sse") / df2).alias("mse"), f.alias("f"), dist.f_p(f, F.lit(1.0), df2).alias("p"), "r2")


def line_interval(df: DataFrame, y: str, x: str, points: list[float], level: float = 0.95) -> DataFrame:
    """Fitted mean and its interval at the points."""
    g = line(df, y, x).withColumn("at", F.explode(F.array(*map(F.lit, points)))).withColumn("q", dist.t_ppf(F.lit((1 + level) / 2), F.col("n") - 2))
    fit = F.col("intercept") + F.col("slope") * F.col("at")
    half = F.col("q") * F.col("s") * F.sqrt(1 / F.col("n") + (F.col("at") - F.col("xbar")) * (F.col("at") - F.col("xbar")) / F.col("sxx"))
    return g.select("at", fit.alias("fit"), (fit - half).alias("low"), (fit + half).alias("high"))


def diagnostics(df: DataFrame, y: str, x: str, key: str) -> DataFrame:
    """Per row: leverage, residual, studentised residual (leave one out), Cook's distance, partial residual."""
    g = F.broadcast(line(df, y, x).select("n", "slope", "intercept", "sxx", "xbar", "sse"))
    j = df.select(key, F.col(x).alias("_x"), F.col(y).alias("_y")).crossJoin(g)
    dx = F.col("_x") - F.col("xbar")
    j = j.withColumn("leverage", 1 / F.col("n") + dx * dx / F.col("sxx")).withColumn("residual", F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x"))
    e, h = F.col("residual"), F.col("leverage")
    own = (F.col("sse") - e * e / (1 - h)) / (F.col("n") - 3)
    mse = F.col("sse") / (F.col("n") - 2)
    return j.select(key, "leverage", "residual", ratio(e, F.sqrt(own * (1 - h))).alias("studentised"), ratio(e * e * h, 2 * mse * (1 - h) * (1 - h)).alias("cook"), (e + F.col("slope") * dx).alias("partial"))


def leave_one_out(df: DataFrame, y: str, x: str, key: str) -> DataFrame:
    """One row: RMSE, R2 (1 - PRESS / SST) and r of the predictions that each row's line without it makes of it."""
    d = diagnostics(df, y, x, key).join(df.select(key, F.col(y).alias("_y")), key)
    gap = F.col("residual") / (1 - F.col("leverage"))
    return d.withColumn("_p", F.col("_y") - gap).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), (1 - F.sum(gap * gap) / F.regr_syy("_y", "_y")).alias("r2"), F.corr("_y", "_p").alias("r"))


def cross_validated(df: DataFrame, y: str, x: str, fold: str) -> DataFrame:
    """Per fold: n and MSE of the line that the other folds make; sums of all folds minus the fold's own, one scan."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(fold).agg(*[F.sum(e).cast("double").alias(n) for n, e in (("n", F.lit(1)), ("x", F.col(x)), ("y", F.col(y)), ("xx", F.col(x) * F.col(x)), ("xy", F.col(x) * F.col(y)), ("yy", F.col(y) * F.col(y)))])
    total = F.broadcast(cells.agg(*[F.sum(c).alias("_" + c) for c in ("n", "x", "y", "xx", "xy")]))
    j = cells.crossJoin(total)
    o = {c: F.col("_" + c) - F.col(c) for c in ("n", "x", "y", "xx", "xy")}
    slope = (o["n"] * o["xy"] - o["x"] * o["y"]) / (o["n"] * o["xx"] - o["x"] * o["x"])
    j = j.withColumn("b", slope).withColumn("a", (o["y"] - F.col("b") * o["x"]) / o["n"])
    a, b = F.col("a"), F.col("b")
    sse = F.col("yy") + F.col("n") * a * a + b * b * F.col("xx") - 2 * a * F.col("y") - 2 * b * F.col("xy") + 2 * a * b * F.col("x")
    return j.select(fold, F.col("n").cast("long").alias("n"), (sse / F.col("n")).alias("mse"))


def zero_point(intercept: Column, slope: Column) -> Column:
    return ratio(-intercept, slope)


def two_stage(df: DataFrame, y: str, x: str, z: str) -> DataFrame:
    """Two-stage least squares with one instrument: effect, its se, and the F of the first stage."""
    s = df.dropna(subset=[x, y, z]).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(f"{p}{q}") for (p, a), (q, b) in combinations_with_replacement((("x", x), ("y", y), ("z", z)), 2)])
    b = ratio(F.col("yz"), F.col("xz"))
    error = F.col("yy") - 2 * F.col("b") * F.col("xy") + F.col("b") * F.col("b") * F.col("xx")
    first = ratio(F.col("xz") * F.col("xz") / F.col("zz"), (F.col("xx") - F.col("xz") * F.col("xz") / F.col("zz")) / (F.col("n") - 2))
    return s.withColumn("b", b).select(F.col("b").alias("effect"), F.sqrt(error * F.col("n") / (F.col("n") - 2) * F.col("zz") / F.col("n")) .alias("_e"), F.abs("xz").alias("_c"), first.alias("first_stage_f")).select("effect", (F.col("_e") / F.col("_c")).alias("se"), "first_stage_f")


def mediation(df: DataFrame, x: str, m: str, y: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Per group: a (m on x), b (y on m beside x), direct, indirect = a b, total."""
    v = {"x": x, "m": m, "y": y}
    s = df.dropna(subset=[x, m, y]).groupBy(*by).agg(*[F.covar_pop(v[p], v[q]).alias(p + q) for p, q in ("xx", "mm", "xm", "xy", "my")])
    d = F.col("xx") * F.col("mm") - F.col("xm") * F.col("xm")
    a, b = ratio(F.col("xm"), F.col("xx")), ratio(F.col("xx") * F.col("my") - F.col("xm") * F.col("xy"), d)
    direct = ratio(F.col("mm") * F.col("xy") - F.col("xm") * F.col("my"), d)
    return s.select(*by, a.alias("a"), b.alias("b"), direct.alias("direct"), (a * b).alias("indirect"), ratio(F.col("xy"), F.col("xx")).alias("total"))


def moderated_mediation(df: DataFrame, x: str, m: str, y: str, w: str, levels: list[float]) -> DataFrame:
    """First-stage moderation: m ~ x * w, y ~ x + m; the indirect effect (a1 + a3 w) b at each level of w."""
    first = {"1": F.lit(1.0), "x": F.col(x), "w": F.col(w), "xw": F.col(x) * F.col(w)}
    second = {"1": F.lit(1.0), "x": F.col(x), "m": F.col(m)}
    one = df.withColumn("_g", F.lit(0)).dropna(subset=[x, m, y, w])
    a = least_squares(one, ["_g"], F.col(m), first).groupBy("_g").agg(F.max(F.when(F.col("term") == "x", F.col("estimate"))).alias("a1"), F.max(F.when(F.col("term") == "xw", F.col("estimate"))).alias("a3"))
    b = least_squares(one, ["_g"], F.col(y), second).where("term = 'm'").select("_g", F.col("estimate").alias("b"))
    return a.join(b, "_g").select(F.explode(F.array(*map(F.lit, levels))).alias("level"), "a1", "a3", "b").select("level", ((F.col("a1") + F.col("a3") * F.col("level")) * F.col("b")).alias("indirect"))


def suppressors(df: DataFrame, y: str, xs: dict[str, Column]) -> DataFrame:
    """Per term: beta, and its structure coefficient r(x, fit); a sign that differs marks a suppressor."""
    one = df.withColumn("_g", F.lit(0))
    fit = residuals(one, ["_g"], y, xs, "_e").withColumn("_fit", F.col(y) - F.col("_e"))
    terms = [t for t in xs if t != "1"]
    r = fit.agg(F.array(*[F.struct(F.lit(t).alias("term"), F.corr(xs[t].cast("double"), F.col("_fit")).alias("structure")) for t in terms]).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return least_squares(one, ["_g"], F.col(y), xs).select("term", "estimate").join(r, "term").withColumn("suppressor", F.signum("estimate") != F.signum("structure"))


def surface(df: DataFrame, y: str, a: str, b: str, steps: int = 5) -> DataFrame:
    """y ~ a * b predicted on a grid over both ranges (response surface)."""
    xs = {"1": F.lit(1.0), "a": F.col(a), "b": F.col(b), "ab": F.col(a) * F.col(b)}
    fit = least_squares(df.withColumn("_g", F.lit(0)), ["_g"], F.col(y), xs).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("term", "estimate"))).alias("c"))
    ends = df.agg(F.min(a).alias("la"), F.max(a).alias("ha"), F.min(b).alias("lb"), F.max(b).alias("hb"))
    g = fit.crossJoin(ends).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    g = g.withColumn("a", F.col("la") + (F.col("ha") - F.col("la")) * F.col("i") / (steps - 1)).withColumn("b", F.col("lb") + (F.col("hb") - F.col("lb")) * F.col("j") / (steps - 1))
    c = lambda t: F.col("c")[F.lit(t)]
    return g.select("i", "j", "a", "b", (c("1") + c("a") * F.col("a") + c("b") * F.col("b") + c("ab") * F.col("a") * F.col("b")).alias("fit"))


def propensity_strata(df: DataFrame, treated: str, y: str, xs: dict[str, Column], strata: int = 5) -> DataFrame:
    """Strata of the logistic propensity score with the difference of medians, and its mean weighted by stratum size."""
    one = df.withColumn("_g", F.lit(0))
    fit = logistic(one, ["_g"], treated, xs).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("term", "estimate"))).alias("_b"))
    score = F.lit(0.0)
    for name, x in xs.items():
        score = score + F.col("_b")[F.lit(name)] * x
    scored = one.crossJoin(F.broadcast(fit.select("_b"))).withColumn("_s", score)
    cuts = F.broadcast(scored.agg(F.percentile("_s", F.array(*[F.lit(i / strata) for i in range(1, strata)])).alias("_c")))
    placed = scored.crossJoin(cuts).withColumn("stratum", F.size(F.filter("_c", lambda c: c < F.col("_s"))))
    med = lambda v: F.percentile(F.when(F.col(treated) == v, F.col(y)), F.lit(0.5))
    return placed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), (med(1) - med(0)).alias("difference"))
