"""Queries of hypothesis tests and classifier metrics, with p-values; the SQL integrates the densities itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.operators import hypothesis as h
from marram.operators import relational, resampling

from .registry import HOLES, chi2_p_sql, f_p_sql, holes, img, normal_p_sql, query, r6, rounded, t_p_sql, table

LABELLED = "SELECT quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)"


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "quality", "toxic", "n_chars")


def small_events(spark, sf_dir):
    """Values with ties and holes."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 9 != 0, F.round("value", 0)).alias("value"))


EVENTS = "e AS (SELECT event_id, event_type, CASE WHEN event_id % 9 <> 0 THEN round(value, 0) END AS value FROM events)"
PAIR = f"WITH {EVENTS}, m AS (SELECT avg(value) FILTER (event_type = 'view') AS m1, avg(value) FILTER (event_type = 'click') AS m2, var_samp(value) FILTER (event_type = 'view') AS v1, var_samp(value) FILTER (event_type = 'click') AS v2, CAST(count(value) FILTER (event_type = 'view') AS DOUBLE) AS n1, CAST(count(value) FILTER (event_type = 'click') AS DOUBLE) AS n2 FROM e)"


@query(f"""{PAIR}, t AS (SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM m)
 SELECT round(t, 6) AS t, round(df, 4) AS df, round({t_p_sql('t', 'df')}, 6) AS p FROM t""")
def welch_with_p(spark, sf_dir):
    return rounded(rounded(h.welch(small_events(spark, sf_dir), "value", "event_type", "view", "click"), "t", "p"), "df", digits=4)


@query(f"""{PAIR}, t AS (SELECT (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t, n1 + n2 - 2 AS df FROM m) SELECT round(t, 6) AS t, df, round({t_p_sql('t', 'df')}, 6) AS p FROM t""")
def student_with_p(spark, sf_dir):
    return rounded(h.student(small_events(spark, sf_dir), "value", "event_type", "view", "click"), "t", "p")


@query(f"""WITH {EVENTS}, t AS (SELECT (avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))) AS t, CAST(count(value) - 1 AS DOUBLE) AS df FROM e) SELECT round(t, 6) AS t, df, round({t_p_sql('t', 'df')}, 6) AS p FROM t""")
def one_sample_t(spark, sf_dir):
    return rounded(h.one_sample(small_events(spark, sf_dir), F.col("value"), 50.0), "t", "p")


@query(f"""WITH x AS (SELECT l_quantity - l_tax * 600 AS d FROM lineitem), t AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, CAST(count(d) - 1 AS DOUBLE) AS df FROM x) SELECT round(t, 6) AS t, df, round({t_p_sql('t', '2.0 * df / 2')}, 6) AS p FROM t""")
def paired_t_with_p(spark, sf_dir):
    return rounded(h.one_sample(table(spark, sf_dir, "lineitem"), F.col("l_quantity") - F.col("l_tax") * 600), "t", "p")


@query(f"""WITH {EVENTS}, g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM e GROUP BY 1), s AS (SELECT sum(n * pow(m - (SELECT avg(value) FROM e), 2)) AS b, sum(n * v) AS w, count(*) - 1.0 AS d1, CAST(sum(n) - count(*) AS DOUBLE) AS d2 FROM g),
 f AS (SELECT CAST(b / d1 / (w / d2) AS DOUBLE) AS f, CAST(d1 AS DOUBLE) AS df1, d2 AS df2 FROM s) SELECT round(f, 6) AS f, df1, df2, round({f_p_sql('f', 'df1', 'df2')}, 6) AS p FROM f""")
def anova_with_p(spark, sf_dir):
    return rounded(h.anova(small_events(spark, sf_dir), "value", "event_type"), "f", "p")


RANKED = f"WITH {EVENTS}, k AS (SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS k, CAST(count(*) OVER () AS DOUBLE) AS n FROM e WHERE value IS NOT NULL {{where}}), z AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM k GROUP BY value))"


@query(f"""{RANKED.replace('{where}', '')}, g AS (SELECT sum(k) AS s, count(*) AS c, max(n) AS n FROM k GROUP BY event_type), r AS (SELECT CAST((12 / (max(n) * (max(n) + 1)) * sum(s * s / c) - 3 * (max(n) + 1)) / (1 - max(ties) / (pow(max(n), 3) - max(n))) AS DOUBLE) AS h, count(*) - 1.0 AS df FROM g, z)
 SELECT round(h, 6) AS h, CAST(df AS DOUBLE) AS df, round({chi2_p_sql('h', 'CAST(df AS DOUBLE)')}, 6) AS p FROM r""")
def kruskal_with_ties(spark, sf_dir):
    return rounded(h.kruskal(small_events(spark, sf_dir), "value", "event_type"), "h", "p")


@query(f"""{RANKED.replace('{where}', "AND event_type IN ('view', 'click')")}, g AS (SELECT sum(CASE WHEN event_type = 'view' THEN k END) AS r, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS n1, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS n2, max(n) AS n FROM k),
 u AS (SELECT CAST(r - n1 * (n1 + 1) / 2 AS DOUBLE) AS u, n1, n2, n, ties FROM g, z), q AS (SELECT u, greatest(0, abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u) SELECT u, round({normal_p_sql('z')}, 6) AS p FROM q""")
def mann_whitney_with_p(spark, sf_dir):
    return rounded(h.mann_whitney(small_events(spark, sf_dir), "value", "event_type", "view", "click"), "p")


@query(f"""WITH {EVENTS}, d AS (SELECT value - 50 AS d FROM e WHERE value <> 50), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS k FROM d), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY abs(d))),
 w AS (SELECT least(sum(CASE WHEN d > 0 THEN k ELSE 0 END), sum(CASE WHEN d < 0 THEN k ELSE 0 END)) AS w, CAST(count(*) AS DOUBLE) AS n FROM k), z AS (SELECT CAST(w AS DOUBLE) AS w, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w, t) SELECT w, round({normal_p_sql('z')}, 6) AS p FROM z""")
def wilcoxon_signed(spark, sf_dir):
    return rounded(h.wilcoxon(small_events(spark, sf_dir), F.col("value") - 50), "p")


@query(f"""WITH {EVENTS}, g AS (SELECT value, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM e WHERE value IS NOT NULL GROUP BY 1),
 c AS (SELECT CAST(sum(a) OVER w AS DOUBLE) / sum(a) OVER () AS fa, CAST(sum(b) OVER w AS DOUBLE) / sum(b) OVER () AS fb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM g WINDOW w AS (ORDER BY value)), d AS (SELECT max(abs(fa - fb)) AS d, max(n1) AS n1, max(n2) AS n2 FROM c),
 s AS (SELECT d, n1 * n2 / CAST(n1 + n2 AS DOUBLE) * d * d AS z2 FROM d) SELECT round(d, 6) AS d, round(least(1, greatest(0, (SELECT 2 * sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * i * i * z2)) FROM (SELECT unnest(range(1, 101)) AS i)))), 6) AS p FROM s""")
def ks_with_p(spark, sf_dir):
    return rounded(h.ks_two_sample(small_events(spark, sf_dir), "value", "event_type", "view", "click"), "d", "p")


@query(f"""{PAIR}, q AS (SELECT v1 / v2 AS f, n1 - 1 AS df1, n2 - 1 AS df2 FROM m), u AS (SELECT f, df1, df2, {f_p_sql('f', 'df1', 'df2')} AS up FROM q) SELECT round(f, 6) AS f, df1, df2, round(2 * least(up, 1 - up), 6) AS p FROM u""")
def variance_f_with_p(spark, sf_dir):
    return rounded(h.variance_f(small_events(spark, sf_dir), "value", "event_type", "view", "click"), "f", "p")


@query(f"""WITH t AS (SELECT CAST(sum(quality * toxic) AS DOUBLE) AS a, CAST(sum(quality * (1 - toxic)) AS DOUBLE) AS b, CAST(sum((1 - quality) * toxic) AS DOUBLE) AS c, CAST(sum((1 - quality) * (1 - toxic)) AS DOUBLE) AS d FROM labels),
 x AS (SELECT (a + b + c + d) * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS x, pow(b - c, 2) / (b + c) AS y FROM t) SELECT round(x, 6) AS chi2, round(y, 6) AS mcnemar, round({chi2_p_sql('x', '1.0')}, 6) AS p, round({chi2_p_sql('y', '1.0')}, 6) + 0.0 AS p_mcnemar FROM x""")
def chi_square_with_p(spark, sf_dir):
    return rounded(h.chi_square_2x2(table(spark, sf_dir, "labels"), "quality", "toxic"), "chi2", "mcnemar", "p", "p_mcnemar")


@query(f"""WITH c AS (SELECT o_orderpriority AS x, o_orderstatus AS y, count(*) AS o FROM orders GROUP BY 1, 2), r AS (SELECT x, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT y, sum(o) AS k FROM c GROUP BY 1), e AS (SELECT coalesce(o, 0) AS o, CAST(r * k AS DOUBLE) / (SELECT count(*) FROM orders) AS e FROM r CROSS JOIN k LEFT JOIN c USING (x, y)),
 s AS (SELECT sum(pow(o - e, 2) / e) AS s, CAST((SELECT count(*) - 1 FROM r) * (SELECT count(*) - 1 FROM k) AS DOUBLE) AS df FROM e) SELECT round(s, 6) AS chi2, df, round({chi2_p_sql('s', 'df')}, 6) AS p FROM s""")
def chi_square_labels(spark, sf_dir):
    return rounded(h.chi_square(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"), "chi2", "p")


@query("""WITH t AS (SELECT sum(quality * toxic)::INT AS a, sum(quality * (1 - toxic))::INT AS b, sum((1 - quality) * toxic)::INT AS c, sum((1 - quality) * (1 - toxic))::INT AS d FROM labels), i AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM t),
 l AS (SELECT i = a AS own, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS lp FROM i)
 SELECT round(sum(exp(lp)), 6) AS p FROM l WHERE lp <= (SELECT lp FROM l WHERE own) + 1e-7""")
def fisher_exact(spark, sf_dir):
    return rounded(h.fisher_exact(table(spark, sf_dir, "labels"), "quality", "toxic"), "p")


@query(f"""WITH g AS (SELECT avg(toxic) FILTER (quality = 1) AS p1, avg(toxic) FILTER (quality = 0) AS p2, avg(toxic) AS p, CAST(sum(quality) AS DOUBLE) AS n1, CAST(sum(1 - quality) AS DOUBLE) AS n2 FROM labels), z AS (SELECT (p1 - p2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) AS z FROM g) SELECT round(z, 6) AS z, round({normal_p_sql('z')}, 6) AS p FROM z""")
def proportions_with_p(spark, sf_dir):
    return rounded(h.proportions(table(spark, sf_dir, "labels"), "toxic", "quality"), "z", "p")


@query(f"""WITH c AS (SELECT c_mktsegment, (c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w AS z, count(*) OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment)), f AS (SELECT c_mktsegment, n, z, CASE WHEN z > 0 THEN 1 - {normal_p_sql('z')} / 2 ELSE {normal_p_sql('z')} / 2 END AS f FROM c),
 i AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY z) AS i FROM f) SELECT c_mktsegment, round(-n - sum((2 * i - 1) * ln(f) + (2 * n + 1 - 2 * i) * ln(1 - f)) / n, 5) AS a2, n FROM i GROUP BY c_mktsegment, n""")
def normality_by_group(spark, sf_dir):
    return rounded(h.anderson_darling(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment"), "a2", digits=5)


@query("""WITH g AS (SELECT c_nationkey, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey, round(m, 6) AS mean, round(s * 1.349, 6) AS iqr, n FROM g WHERE n > 1""")
def sd_to_iqr(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"), h.iqr_of_sd(F.stddev_samp("c_acctbal")).alias("iqr"), F.count("c_acctbal").alias("n"))
    return rounded(g.where("n > 1"), "mean", "iqr")


@query(f"""WITH c AS (SELECT quality AS t, CASE WHEN n_chars > 2500 THEN 1 ELSE 0 END AS q FROM ({LABELLED})), s AS (SELECT unnest([0, 1]) AS label), g AS (SELECT label, CAST(count(*) FILTER (t = label AND q = label) AS DOUBLE) AS tp, CAST(count(*) FILTER (t <> label AND q <> label) AS DOUBLE) AS tn, CAST(count(*) FILTER (t <> label AND q = label) AS DOUBLE) AS fp, CAST(count(*) FILTER (t = label AND q <> label) AS DOUBLE) AS fn FROM c, s GROUP BY 1)
 SELECT label, round(tp / (tp + fn), 6) AS sens, round(tn / (tn + fp), 6) AS spec, round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv, round((tp + tn) / (tp + tn + fp + fn), 6) AS acc, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM g""")
def one_vs_rest_metrics(spark, sf_dir):
    c = labelled(spark, sf_dir).select("quality", F.when(F.col("n_chars") > 2500, 1).otherwise(0).alias("q"))
    return rounded(h.one_vs_rest(c, "quality", "q"), "sens", "spec", "ppv", "npv", "acc", "f1")


@query(f"""WITH c AS (SELECT CAST(n_chars AS DOUBLE) AS cut, sum(quality) AS p, sum(1 - quality) AS q FROM ({LABELLED}) GROUP BY 1), s AS (SELECT cut, CAST(sum(p) OVER w AS DOUBLE) AS tp, CAST(sum(q) OVER w AS DOUBLE) AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM c WINDOW w AS (ORDER BY cut DESC))
 SELECT cut, round(tp / np, 6) AS tpr, round(fp / nq, 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round((tp + nq - fp) / (np + nq), 6) AS accuracy FROM s""")
def roc_curve(spark, sf_dir):
    return rounded(h.roc(labelled(spark, sf_dir), "n_chars", "quality"), "tpr", "fpr", "precision", "accuracy")


AUC = """(SELECT avg(v1) AS auc, var_samp(v1) / count(v1) + (SELECT var_samp(v0) / count(v0) FROM (SELECT avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS v0 FROM x a JOIN x b ON a.t = 1 AND b.t = 0 GROUP BY b.i)) AS variance
 FROM (SELECT avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS v1 FROM x a JOIN x b ON a.t = 1 AND b.t = 0 GROUP BY a.i))"""
ROWS = "SELECT doc_id AS i, CAST({0} AS DOUBLE) AS s, quality AS t FROM labels JOIN documents USING (doc_id)"


@query(f"WITH x AS ({ROWS.format('n_chars')}) SELECT round(auc, 6) AS auc, round(variance, 8) AS variance FROM {AUC}")
def auc_variance(spark, sf_dir):
    return rounded(rounded(h.auc_delong(labelled(spark, sf_dir), "n_chars", "quality"), "auc"), "variance", digits=8)


@query(f"""WITH a AS (WITH x AS ({ROWS.format('n_chars')}) SELECT * FROM {AUC}), b AS (WITH x AS ({ROWS.format('n_chars % 97')}) SELECT * FROM {AUC}), z AS (SELECT a.auc AS a1, b.auc AS a2, (a.auc - b.auc) / sqrt(a.variance + b.variance) AS z FROM a, b)
 SELECT round(a1, 6) AS a1, round(a2, 6) AS a2, round(z, 5) AS z, round({normal_p_sql('z')}, 5) AS p FROM z""")
def delong_comparison(spark, sf_dir):
    d = labelled(spark, sf_dir)
    got = h.delong_z(h.auc_delong(d, "n_chars", "quality"), h.auc_delong(d.withColumn("m", F.col("n_chars") % 97), "m", "quality"))
    return rounded(rounded(got, "a1", "a2"), "z", "p", digits=5)


@query("""SELECT n_nationkey, round(sqrt((a * (1 - a) + (n - 1) * (a / (2 - a) - a * a) + (2 * n - 1) * (2 * a * a / (1 + a) - a * a)) / (n * 2 * n)), 6) AS se FROM (SELECT n_nationkey, 0.55 + n_nationkey / 100.0 AS a, 10.0 + n_nationkey AS n FROM nation)""")
def auc_standard_error(spark, sf_dir):
    n = F.col("n_nationkey") + 10.0
    return table(spark, sf_dir, "nation").select("n_nationkey", r6(h.hanley_error(0.55 + F.col("n_nationkey") / 100.0, n, 2 * n)).alias("se"))


@query("SELECT vec_id, CASE WHEN a >= 0.3 THEN 'a' WHEN b >= 0.1 THEN 'b' END AS label FROM (SELECT vec_id, embedding[1] AS a, embedding[2] AS b FROM embeddings)")
def class_thresholds(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("a"), F.element_at("embedding", 2).cast("double").alias("b"))
    return e.select("vec_id", h.by_thresholds({"a": 0.3, "b": 0.1}).alias("label"))


@query("""WITH s AS (SELECT avg(CAST(quality = toxic AS INTEGER)) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe, count(*) AS n FROM labels), k AS (SELECT (po - pe) / (1 - pe) AS k, sqrt(po * (1 - po) / (n * pow(1 - pe, 2))) AS se FROM s) SELECT round(k, 6) AS kappa, round(k - 1.959963984540054 * se, 6) AS low, round(k + 1.959963984540054 * se, 6) AS high FROM k""")
def kappa_interval(spark, sf_dir):
    return rounded(h.kappa(table(spark, sf_dir, "labels"), "quality", "toxic"), "kappa", "low", "high")


# --- corrections and fills over data with nulls and ties -------------------------------------------------------------


@query(f"""{HOLES}, v AS (SELECT dataset, voxel, CASE WHEN voxel % 5 <> 0 THEN round(stddev_pop(value), 2) END AS p FROM holes GROUP BY 1, 2), t AS (SELECT * FROM v WHERE p IS NOT NULL),
 q AS (SELECT a.dataset, a.voxel, min(b.p * n / k) AS q FROM t a JOIN (SELECT t.*, (SELECT count(*) FROM t u WHERE u.dataset = t.dataset AND u.p <= t.p) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM t) b ON a.dataset = b.dataset AND b.p >= a.p GROUP BY 1, 2)
 SELECT v.dataset, v.voxel, v.p, round(CASE WHEN q < 1 THEN q WHEN q >= 1 THEN 1.0 END, 6) AS q FROM v LEFT JOIN q USING (dataset, voxel)""")
def fdr_with_nulls_and_ties(spark, sf_dir):
    p = holes(spark, sf_dir).groupBy("dataset", "voxel").agg(F.round(F.stddev_pop("value"), 2).alias("p")).withColumn("p", F.when(F.col("voxel") % 5 != 0, F.col("p")))
    return rounded(resampling.benjamini_hochberg(p, "p", "dataset"), "q")


@query(f"{HOLES}, v AS (SELECT dataset, voxel, round(abs(avg(value)), 6) AS p FROM holes GROUP BY 1, 2) SELECT dataset, voxel, p, round(CASE WHEN p < 0.05 THEN least(1.0, p * count(*) OVER (PARTITION BY dataset)) ELSE p END, 6) AS q FROM v")
def bonferroni_correction(spark, sf_dir):
    p = holes(spark, sf_dir).groupBy("dataset", "voxel").agg(F.round(F.abs(F.avg("value")), 6).alias("p"))
    return rounded(resampling.bonferroni(p, "p", "dataset"), "q")


@query(f"WITH {EVENTS}, c AS (SELECT CASE WHEN event_id % 4 <> 0 THEN event_type END AS k, value FROM e) SELECT coalesce(k, '') AS k, 0 AS is_total, count(*) AS n, round(avg(value), 6) AS m FROM c GROUP BY k UNION ALL SELECT 'all_categories', 1, count(*), round(avg(value), 6) FROM c")
def category_with_null_and_all(spark, sf_dir):
    e = small_events(spark, sf_dir).withColumn("k", F.when(F.col("event_id") % 4 != 0, F.col("event_type")))
    got = relational.per_category_and_all(e, "k", F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("m"))
    return got.withColumn("k", F.coalesce("k", F.lit("")))


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events) SELECT event_id, (SELECT arg_max(b.v, b.event_id) FROM e b WHERE b.user_id = e.user_id AND b.event_id <= e.event_id AND b.v IS NOT NULL) AS forward, (SELECT arg_min(b.v, b.event_id) FROM e b WHERE b.user_id = e.user_id AND b.event_id >= e.event_id AND b.v IS NOT NULL) AS backward FROM e""")
def fill_both_ways(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return relational.fill(relational.fill(e, "v", "forward", "event_id", ["user_id"]), "v", "backward", "event_id", ["user_id"], False).select("event_id", "forward", "backward")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS g, floor(c_acctbal / 5000) AS x FROM customer), q AS (SELECT g, list_distinct([quantile_cont(x, 0.2), quantile_cont(x, 0.4), quantile_cont(x, 0.6), quantile_cont(x, 0.8)]) AS q FROM c GROUP BY 1) SELECT c_custkey, CAST(len(list_filter(q, lambda v: v < x)) AS INTEGER) AS stratum FROM c JOIN q USING (g)""")
def strata_with_ties(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("x", F.floor(F.col("c_acctbal") / 5000).cast("double"))
    return relational.strata(c, "x", "c_mktsegment", [0.2, 0.4, 0.6, 0.8]).select("c_custkey", "stratum")


@query(f"{HOLES} SELECT dataset, voxel, round(corr(value, outcome), 6) + 0.0 AS r, round(regr_slope(outcome, value), 6) + 0.0 AS slope, round(regr_r2(outcome, value), 6) + 0.0 AS r2 FROM holes GROUP BY 1, 2")
def maps_with_holes(spark, sf_dir):
    from marram.operators import maps

    i = holes(spark, sf_dir)
    r = rounded(maps.correlation_map(i), "r")
    return r.join(rounded(maps.regression_map(i).select("dataset", "voxel", "slope", "r2"), "slope", "r2"), ["dataset", "voxel"])


@query(f"""{HOLES}, w AS (SELECT * FROM holes WHERE value IS NOT NULL), k AS (SELECT dataset, voxel, rank() OVER (PARTITION BY dataset, voxel ORDER BY value) + (count(*) OVER (PARTITION BY dataset, voxel, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY dataset, voxel ORDER BY outcome) + (count(*) OVER (PARTITION BY dataset, voxel, outcome) - 1) / 2.0 AS b FROM w)
 SELECT dataset, voxel, round(corr(a, b), 6) + 0.0 AS r FROM k GROUP BY 1, 2""")
def spearman_with_holes(spark, sf_dir):
    from marram.operators import maps

    return rounded(maps.rank_correlation_map(holes(spark, sf_dir)), "r")


@query(f"""{HOLES}, m AS (SELECT dataset AS d, voxel, CASE WHEN (voxel + dataset) % 6 <> 0 THEN avg(value) END AS r FROM holes GROUP BY 1, 2) SELECT x.d AS a, y.d AS b, round(corr(x.r, y.r), 6) + 0.0 AS r, round(sum(x.r * y.r) / sqrt(sum(x.r * x.r) FILTER (y.r IS NOT NULL) * sum(y.r * y.r) FILTER (x.r IS NOT NULL)), 6) + 0.0 AS cosine FROM m x JOIN m y ON x.voxel = y.voxel AND x.d <= y.d GROUP BY 1, 2""")
def similarity_with_holes(spark, sf_dir):
    from marram.operators import maps

    m = holes(spark, sf_dir).groupBy("dataset", "voxel").agg(F.avg("value").alias("r"))
    m = m.withColumn("r", F.when((F.col("voxel") + F.col("dataset")) % 6 != 0, F.col("r")))
    return rounded(maps.map_similarity(m, "r"), "r", "cosine")
