"""Queries of regressions, mediation and validation; the SQL uses closed forms of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.operators import models as md

from .registry import HOLES, f_p_sql, holes, query, rounded, t_p_sql, table

#: Centred sums of the voxel on two predictors, by hand.
TWO = HOLES + """, d AS (SELECT voxel, value AS y, outcome AS a, CAST(subject * 7 % 13 AS DOUBLE) AS b, {w} AS w FROM holes WHERE value IS NOT NULL),
 c AS (SELECT voxel, count(*) AS n, sum(w) AS sw, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * y) / sum(w) AS my FROM d GROUP BY 1),
 s AS (SELECT voxel, any_value(n) AS n, sum(w * pow(a - ma, 2)) AS aa, sum(w * pow(b - mb, 2)) AS bb, sum(w * (a - ma) * (b - mb)) AS ab, sum(w * (a - ma) * (y - my)) AS ay, sum(w * (b - mb) * (y - my)) AS byy, sum(w * pow(y - my, 2)) AS yy FROM d JOIN c USING (voxel) GROUP BY 1),
 f AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ba, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS bbb FROM s), e AS (SELECT *, (yy - ba * ay - bbb * byy) / (n - 3) AS mse, ba * ay / yy + bbb * byy / yy AS r2 FROM f)"""

def terms():
    return {"1": F.lit(1.0), "a": F.col("outcome"), "b": (F.col("subject") * 7 % 13).cast("double")}



@query(TWO.format(w="1.0") + f""", t AS (SELECT voxel, n, r2, ba AS estimate, ba / sqrt(mse * bb / (aa * bb - ab * ab)) AS t FROM e) SELECT voxel, n, round(r2, 6) + 0.0 AS r2, round(estimate, 6) + 0.0 AS estimate, round(t, 5) + 0.0 AS t, round({t_p_sql('t', '(n - 3.0)')}, 6) AS p FROM t""")
def ols_multi(spark, sf_dir):
    got = md.least_squares(holes(spark, sf_dir), ["voxel"], F.col("value"), terms()).where("term = 'a'").select("voxel", "n", "r2", "estimate", "t", "p")
    return rounded(rounded(got, "r2", "estimate", "p"), "t", digits=5)


@query(TWO.format(w="1.0 + subject % 3") + """ SELECT voxel, round(r2, 6) + 0.0 AS r2, round(ba - bbb, 6) + 0.0 AS estimate, round((ba - bbb) / sqrt(mse * (aa + bb + 2 * ab) / (aa * bb - ab * ab)), 5) + 0.0 AS t FROM e""")
def wls_contrast(spark, sf_dir):
    w = 1.0 + F.col("subject") % 3
    got = md.least_squares(holes(spark, sf_dir), ["voxel"], F.col("value"), terms(), w, {"a - b": [0.0, 1.0, -1.0]}).select("voxel", "r2", "estimate", "t")
    return rounded(rounded(got, "r2", "estimate"), "t", digits=5)


@query(TWO.format(w="1.0") + f""", q AS (SELECT voxel, n, (r2 - ay * ay / (aa * yy)) / ((1 - r2) / (n - 3)) AS f FROM e) SELECT voxel, round(f, 5) + 0.0 AS f, round({f_p_sql('f', '1.0', '(n - 3.0)')}, 5) + 0.0 AS p FROM q""")
def nested_f_map(spark, sf_dir):
    i = holes(spark, sf_dir)
    full = md.least_squares(i, ["voxel"], F.col("value"), terms())
    small = md.least_squares(i, ["voxel"], F.col("value"), {k: terms()[k] for k in ("1", "a")})
    return rounded(md.f_change(small, full, ["voxel"], 1, 3), "f", "p", digits=5)


@query(TWO.format(w="1.0") + """ SELECT h.voxel, h.subject, round(h.value - my - ba * (outcome - ma) - bbb * (h.subject * 7 % 13 - mb), 6) + 0.0 AS residual FROM holes h JOIN e USING (voxel) JOIN c USING (voxel)""")
def residuals_of_covariates(spark, sf_dir):
    return rounded(md.residuals(holes(spark, sf_dir), ["voxel"], "value", terms(), "residual").select("voxel", "subject", "residual"), "residual")


@query(HOLES + """, o AS (SELECT voxel, value AS x, unnest([outcome, outcome * outcome]) AS y, unnest(['plain', 'squared']) AS outcome FROM holes WHERE value IS NOT NULL) SELECT outcome, voxel, round(regr_slope(y, x), 5) + 0.0 AS slope, round(regr_r2(y, x), 6) + 0.0 AS r2 FROM o GROUP BY 1, 2""")
def multi_output_regression(spark, sf_dir):
    i = holes(spark, sf_dir).withColumn("o", F.explode(F.array(F.struct(F.lit("plain").alias("k"), F.col("outcome").alias("v")), F.struct(F.lit("squared").alias("k"), (F.col("outcome") * F.col("outcome")).alias("v")))))
    i = i.select("voxel", "value", F.col("o.k").alias("outcome"), F.col("o.v").alias("y"))
    got = md.least_squares(i, ["outcome", "voxel"], F.col("y"), {"1": F.lit(1.0), "x": F.col("value")}).where("term = 'x'").select("outcome", "voxel", F.col("estimate").alias("slope"), "r2")
    return rounded(rounded(got, "slope", digits=5), "r2")


def newton(rounds: int = 9) -> str:
    """Newton's steps for y ~ 1 + x by voxel, one table each."""
    out = HOLES + ", d AS (SELECT voxel, value * 5 AS x, CAST(outcome > 4 AS INTEGER) AS y FROM holes WHERE value IS NOT NULL), b0 AS (SELECT DISTINCT voxel, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM d)"
    for i in range(rounds):
        out += f""", g{i} AS (SELECT voxel, any_value(a) AS a, any_value(b) AS b, sum(y - p) - 1e-6 * any_value(a) AS u, sum((y - p) * x) - 1e-6 * any_value(b) AS v, sum(p * (1 - p)) + 1e-6 AS h, sum(p * (1 - p) * x) AS i, sum(p * (1 - p) * x * x) + 1e-6 AS j FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS p FROM d JOIN b{i} USING (voxel)) GROUP BY 1),
 b{i + 1} AS (SELECT voxel, a + (j * u - i * v) / (h * j - i * i) AS a, b + (h * v - i * u) / (h * j - i * i) AS b FROM g{i})"""
    return out + f" SELECT voxel, round(b, 5) + 0.0 AS estimate, round(b / sqrt(h / (h * j - i * i)), 4) + 0.0 AS z FROM g{rounds - 1}"


@query(newton())
def logit_irls(spark, sf_dir):
    i = holes(spark, sf_dir).withColumn("hit", (F.col("outcome") > 4).cast("int"))
    got = md.logistic(i, ["voxel"], "hit", {"1": F.lit(1.0), "x": F.col("value") * 5}).where("term = 'x'").select("voxel", "estimate", "z")
    return rounded(rounded(got, "estimate", digits=5), "z", digits=4)


L = "(SELECT l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"), "l_linenumber", F.col("l_tax").alias("z"))


@query(f"WITH s AS (SELECT regr_syy(y, x) AS t, regr_syy(y, x) * (1 - regr_r2(y, x)) AS e, count(*) AS n FROM {L}) SELECT round(t - e, 3) AS ssr, round(e, 3) AS sse, round(t, 3) AS ssto, round(t - e, 3) AS msr, round(e / (n - 2), 6) AS mse, round((t - e) / (e / (n - 2)), 3) AS f, round(1 - e / t, 6) AS r2 FROM s")
def fit_quality(spark, sf_dir):
    return rounded(rounded(md.fit_quality(lines(spark, sf_dir), "y", "x").drop("p"), "mse", "r2"), "ssr", "sse", "ssto", "msr", "f", digits=3)


@query("""WITH s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS m, count(*) AS n, sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / (count(*) - 2)) AS s FROM (SELECT n_nationkey AS y, n_regionkey * 2.0 + n_nationkey % 7 AS x FROM nation)), p AS (SELECT unnest([0.0, 4.0, 9.0]) AS "at")
 SELECT CAST("at" AS DOUBLE) AS "at", round(a + b * "at", 6) AS fit, round(a + b * "at" - 2.068657610419041 * s * sqrt(1.0 / n + pow("at" - m, 2) / sxx), 6) AS low, round(a + b * "at" + 2.068657610419041 * s * sqrt(1.0 / n + pow("at" - m, 2) / sxx), 6) AS high FROM s, p""")
def line_interval(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("y"), (F.col("n_regionkey") * 2.0 + F.col("n_nationkey") % 7).alias("x"))
    return rounded(md.line_interval(n, "y", "x", [0.0, 4.0, 9.0]), "fit", "low", "high")


NATION = "d AS (SELECT n_nationkey AS k, n_nationkey * 1.0 AS y, n_regionkey * 2.0 + n_nationkey % 7 AS x FROM nation)"


@query(f"""WITH {NATION}, s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS m, count(*) AS n, regr_syy(y, x) * (1 - regr_r2(y, x)) AS e FROM d), r AS (SELECT *, 1.0 / n + pow(x - m, 2) / sxx AS h, y - a - b * x AS r FROM d, s)
 SELECT k, round(h, 6) AS leverage, round(r, 6) + 0.0 AS residual, round(r / sqrt((e - r * r / (1 - h)) / (n - 3) * (1 - h)), 6) + 0.0 AS studentised, round(r * r * h / (2 * e / (n - 2) * pow(1 - h, 2)), 6) AS cook, round(r + b * (x - m), 6) + 0.0 AS partial FROM r""")
def regression_diagnostics(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("double").alias("y"), (F.col("n_regionkey") * 2.0 + F.col("n_nationkey") % 7).alias("x"))
    return rounded(md.diagnostics(n, "y", "x", "k"), "leverage", "residual", "studentised", "cook", "partial")


@query(f"""WITH {NATION}, p AS (SELECT a.y, (SELECT regr_intercept(b.y, b.x) + regr_slope(b.y, b.x) * a.x FROM d b WHERE b.k <> a.k) AS p FROM d a) SELECT round(sqrt(avg(pow(y - p, 2))), 6) AS rmse, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(corr(y, p), 6) AS r FROM p""")
def leave_one_out(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("double").alias("y"), (F.col("n_regionkey") * 2.0 + F.col("n_nationkey") % 7).alias("x"))
    return rounded(md.leave_one_out(n, "y", "x", "k"), "rmse", "r2", "r")


@query("""WITH d AS (SELECT l_linenumber AS f, l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem), k AS (SELECT DISTINCT f AS held FROM d), m AS (SELECT held, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k JOIN d ON f <> held GROUP BY 1) SELECT held AS l_linenumber, count(*) AS n, round(avg(pow(y - a - b * x, 2)), 5) AS mse FROM m JOIN d ON f = held GROUP BY 1""")
def k_fold_error(spark, sf_dir):
    return rounded(md.cross_validated(lines(spark, sf_dir), "y", "x", "l_linenumber"), "mse", digits=5)


@query("SELECT l_returnflag, round(-regr_intercept(l_extendedprice, l_quantity) / regr_slope(l_extendedprice, l_quantity), 6) + 0.0 AS zero FROM lineitem GROUP BY 1")
def zero_points(spark, sf_dir):
    g = md.line(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return rounded(g.select("l_returnflag", md.zero_point(F.col("intercept"), F.col("slope")).alias("zero")), "zero")


@query("""WITH d AS (SELECT o_totalprice / 1000 AS x, o_totalprice / 500 + o_orderkey % 11 AS y, o_totalprice / 900 + o_custkey % 50 AS z FROM orders), f AS (SELECT regr_slope(x, z) AS s, regr_intercept(x, z) AS i, regr_r2(x, z) AS r2, count(*) AS n FROM d), p AS (SELECT x, y, i + s * z AS h FROM d, f), b AS (SELECT regr_slope(y, h) AS b, regr_intercept(y, h) AS a, regr_sxx(y, h) AS sxx FROM p)
 SELECT round(any_value(b), 6) AS effect, round(sqrt(sum(pow(y - a - b * x, 2)) / (any_value(n) - 2) / any_value(sxx)), 6) AS se, round(any_value(r2 * (n - 2) / (1 - r2)), 3) AS first_stage_f FROM p, b, f""")
def two_stage_least_squares(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("x"), (F.col("o_totalprice") / 500 + F.col("o_orderkey") % 11).alias("y"), (F.col("o_totalprice") / 900 + F.col("o_custkey") % 50).alias("z"))
    return rounded(rounded(md.two_stage(o, "y", "x", "z"), "effect", "se"), "first_stage_f", digits=3)


MED = HOLES + ", d AS (SELECT voxel, outcome AS x, value AS m, outcome * 0.1 + value * 2 + subject % 5 AS y FROM holes WHERE value IS NOT NULL)"


@query(f"""{MED}, r AS (SELECT d.voxel, y - iy - sy * x AS ey, m - im - sm * x AS em, sm, sy FROM d JOIN (SELECT voxel, regr_slope(y, x) AS sy, regr_intercept(y, x) AS iy, regr_slope(m, x) AS sm, regr_intercept(m, x) AS im FROM d GROUP BY 1) f USING (voxel)), b AS (SELECT voxel, any_value(sm) AS a, regr_slope(ey, em) AS b, any_value(sy) AS total FROM r GROUP BY 1)
 SELECT voxel, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(total - a * b, 6) + 0.0 AS direct, round(a * b, 6) + 0.0 AS indirect, round(total, 6) + 0.0 AS total FROM b""")
def voxelwise_mediation(spark, sf_dir):
    i = holes(spark, sf_dir).withColumn("y", F.col("outcome") * 0.1 + F.col("value") * 2 + F.col("subject") % 5)
    return rounded(md.mediation(i, "outcome", "value", "y", ["voxel"]), "a", "b", "direct", "indirect", "total")


@query("""WITH d AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS m, l_extendedprice / 700 + l_linenumber AS y, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS w FROM lineitem), a AS (SELECT w, regr_slope(m, x) AS a FROM d GROUP BY 1), f AS (SELECT regr_slope(y, x) AS sy, regr_intercept(y, x) AS iy, regr_slope(m, x) AS sm, regr_intercept(m, x) AS im FROM d), b AS (SELECT regr_slope(y - iy - sy * x, m - im - sm * x) AS b FROM d, f)
 SELECT CAST(w AS DOUBLE) AS level, round(a * b, 5) AS indirect FROM a, b""")
def moderated_mediation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("m"), (F.col("l_extendedprice") / 700 + F.col("l_linenumber")).alias("y"), F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0).alias("w"))
    return rounded(md.moderated_mediation(li, "x", "m", "y", "w", [0.0, 1.0]), "indirect", digits=5)


@query("""WITH d AS (SELECT l_extendedprice AS y, l_quantity AS a, l_tax AS b FROM lineitem), s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM d), f AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ba, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS bb2 FROM s), r AS (SELECT any_value(ba) AS ba, any_value(bb2) AS bb2, corr(a, ba * a + bb2 * b) AS ra, corr(b, ba * a + bb2 * b) AS rb FROM d, f)
 SELECT unnest(['a', 'b']) AS term, round(unnest([ba, bb2]), 3) AS estimate, round(unnest([ra, rb]), 6) AS structure, unnest([sign(ba) <> sign(ra), sign(bb2) <> sign(rb)]) AS suppressor FROM r""")
def structure_coefficients(spark, sf_dir):
    got = md.suppressors(table(spark, sf_dir, "lineitem"), "l_extendedprice", {"1": F.lit(1.0), "a": F.col("l_quantity"), "b": F.col("l_tax")})
    return rounded(rounded(got, "structure"), "estimate", digits=3)


@query("""WITH d AS (SELECT c_custkey * 1.0 AS y, CASE WHEN c_mktsegment < 'F' THEN 1 ELSE 0 END AS a, c_nationkey AS b FROM customer), f AS (SELECT a, regr_slope(y, b) AS s, regr_intercept(y, b) AS i FROM d GROUP BY 1), e AS (SELECT min(b) AS lo, max(b) AS hi FROM d), g AS (SELECT unnest(range(5))::INT AS i), h AS (SELECT unnest(range(5))::INT AS j)
 SELECT g.i, h.j, g.i / 4.0 AS a, lo + (hi - lo) * h.j / 4.0 AS b, round((1 - g.i / 4.0) * (f0.i + f0.s * (lo + (hi - lo) * h.j / 4.0)) + g.i / 4.0 * (f1.i + f1.s * (lo + (hi - lo) * h.j / 4.0)), 4) AS fit FROM g, h, e, f f0, f f1 WHERE f0.a = 0 AND f1.a = 1""")
def response_surface(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("y"), F.when(F.col("c_mktsegment") < "F", 1).otherwise(0).alias("a"), F.col("c_nationkey").alias("b"))
    return rounded(md.surface(c, "y", "a", "b"), "fit", digits=4)


@query()
def propensity_strata(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("treated", (F.col("c_mktsegment") < "F").cast("int"))
    return rounded(md.propensity_strata(c, "treated", "c_acctbal", {"1": F.lit(1.0), "n": F.col("c_nationkey") / 10}), "difference", digits=4)
