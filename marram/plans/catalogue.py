"""Every query by name, with the SQL that DuckDB runs on the same tables.

Queries on images use the operators of this library. Table queries are declared in SQL: names in braces are the
tables, given to Spark as DataFrames, so nothing is registered in the session.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.functions.columns import r6
from marram.operators import maps, relational, resampling
from marram.sources.tables import table

from .registry import IMG, ORACLES, QUERIES, R, declared, img, query, rounded

# --- maps ---------------------------------------------------------------------------------------------------------


@query(f"""{IMG}, s AS (SELECT DISTINCT dataset, subject, outcome FROM img), reps AS (SELECT *, CAST(unnest(range(1, 101)) AS INTEGER) AS rep FROM s),
 a AS (SELECT rep, dataset, subject, row_number() OVER (PARTITION BY rep, dataset ORDER BY subject) AS k FROM reps),
 b AS (SELECT rep, dataset, outcome, row_number() OVER (PARTITION BY rep, dataset ORDER BY md5(concat_ws('|', 'fwe', CAST(rep AS VARCHAR), CAST(subject AS VARCHAR))), subject) AS k FROM reps),
 n AS (SELECT a.rep, a.dataset, img.voxel, round({R.format("img.value", "b.outcome")}, 6) AS r FROM a JOIN b ON a.rep = b.rep AND a.dataset = b.dataset AND a.k = b.k JOIN img ON img.dataset = a.dataset AND img.subject = a.subject GROUP BY 1, 2, 3),
 m AS (SELECT dataset, rep, max(abs(r)) AS m FROM n GROUP BY 1, 2), o AS (SELECT dataset, voxel, round({R.format("value", "outcome")}, 6) + 0.0 AS r FROM img GROUP BY 1, 2)
 SELECT o.dataset, o.voxel, o.r, CAST(count(CASE WHEN m.m >= abs(o.r) THEN 1 END) AS DOUBLE) / 100.0 AS p FROM o JOIN m ON o.dataset = m.dataset GROUP BY 1, 2, 3""")
def fwe_max_r(spark, sf_dir):
    return resampling.max_r(img(spark, sf_dir), 100)


@query(f"{IMG} SELECT dataset, voxel, round({R.format('value', 'outcome')}, 6) + 0.0 AS r FROM img GROUP BY 1, 2")
def rmap_pearson(spark, sf_dir):
    return rounded(maps.correlation_map(img(spark, sf_dir)), "r")


@query(f"""{IMG}, k AS (SELECT dataset, voxel, rank() OVER (PARTITION BY dataset, voxel ORDER BY value) + (count(*) OVER (PARTITION BY dataset, voxel, value) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY dataset, voxel ORDER BY outcome) + (count(*) OVER (PARTITION BY dataset, voxel, outcome) - 1) / 2.0 AS b FROM img)
 SELECT dataset, voxel, round({R.format('a', 'b')}, 6) + 0.0 AS r FROM k GROUP BY 1, 2""")
def rmap_spearman_avg(spark, sf_dir):
    return rounded(maps.rank_correlation_map(img(spark, sf_dir)), "r")


@query(f"{IMG}, m AS (SELECT dataset, voxel, {R.format('value', 'outcome')} AS r FROM img GROUP BY 1, 2) SELECT dataset, voxel, round(atanh(r), 6) + 0.0 AS z FROM m")
def rmap_fisher_z(spark, sf_dir):
    return maps.correlation_map(img(spark, sf_dir)).select("dataset", "voxel", r6(F.atanh("r")).alias("z"))


@query(f"""{IMG}, m AS (SELECT voxel, dataset, avg(outcome) OVER (PARTITION BY dataset, voxel) AS mid, value, outcome FROM img),
 h AS (SELECT dataset, voxel, outcome > mid AS up, {R.format('value', 'outcome')} AS r FROM m GROUP BY 1, 2, 3)
 SELECT dataset, voxel, round(max(CASE WHEN up THEN r END) - max(CASE WHEN NOT up THEN r END), 6) + 0.0 AS delta FROM h GROUP BY 1, 2""")
def delta_rmap(spark, sf_dir):
    from pyspark.sql import Window

    from marram.functions.columns import pearson

    halves = img(spark, sf_dir).withColumn("up", F.col("outcome") > F.avg("outcome").over(Window.partitionBy("dataset", "voxel")))
    r = halves.groupBy("dataset", "voxel", "up").agg(pearson("value", "outcome").alias("r"))
    return r.groupBy("dataset", "voxel").agg(r6(F.max(F.when(F.col("up"), F.col("r"))) - F.max(F.when(~F.col("up"), F.col("r")))).alias("delta"))


@query(f"{IMG} SELECT dataset, voxel, round(sum(value) / count(*), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS sd FROM img GROUP BY 1, 2")
def avg_stdev_map(spark, sf_dir):
    return rounded(maps.average_map(img(spark, sf_dir)), "mean", "sd")


@query(f"""{IMG}, o AS (SELECT dataset, voxel, CAST(sum(CASE WHEN value >= 0.1 THEN 1 WHEN value <= -0.1 THEN -1 ELSE 0 END) AS BIGINT) AS overlap, CAST(sum(CAST(value >= 0.1 AS INTEGER)) AS BIGINT) AS sensitivity, count(*) AS n FROM img GROUP BY 1, 2)
 SELECT *, CAST(floor(100.0 * sensitivity / n / 5) * 5 AS BIGINT) AS percent FROM o""")
def signed_step_overlap(spark, sf_dir):
    return maps.step_overlap(maps.signed_overlap(img(spark, sf_dir), 0.1))


@query(f"""{IMG}, c AS (SELECT voxel, avg(value) AS m, stddev_pop(value) AS s FROM img WHERE outcome = 0 GROUP BY 1)
 SELECT subject, img.voxel, CASE WHEN s <> 0 THEN round((value - m) / s, 6) + 0.0 END AS z FROM img JOIN c ON img.voxel = c.voxel WHERE outcome <> 0""")
def zscore_vs_controls(spark, sf_dir):
    return rounded(maps.control_scores(img(spark, sf_dir), 0.0), "z")


@query(f"""{IMG}, g AS (SELECT dataset, voxel, count(*) AS n, covar_pop(value, outcome) AS c, var_pop(value) AS vx, var_pop(outcome) AS vy, avg(value) AS mx, avg(outcome) AS my FROM img GROUP BY 1, 2),
 f AS (SELECT *, c / vx AS b, c * c / (vx * vy) AS r2 FROM g)
 SELECT dataset, voxel, round(b, 6) + 0.0 AS slope, round(my - b * mx, 6) + 0.0 AS intercept, round(r2, 6) + 0.0 AS r2, round(b / sqrt(vy * (1 - r2) * n / (n - 2) / (n * vx)), 6) + 0.0 AS t FROM f""")
def ols_tmap(spark, sf_dir):
    return rounded(maps.regression_map(img(spark, sf_dir)), "slope", "intercept", "r2", "t")


@query(f"""{IMG}, f AS (SELECT dataset, voxel, regr_slope(value, outcome) AS b, avg(value) AS mv, avg(outcome) AS mo FROM img GROUP BY 1, 2)
 SELECT subject, img.voxel, round(value - mv - b * (outcome - mo), 6) + 0.0 AS residual FROM img JOIN f ON img.dataset = f.dataset AND img.voxel = f.voxel""")
def residualise_1cov(spark, sf_dir):
    return rounded(maps.residuals(img(spark, sf_dir)), "residual")


@query(f"""{IMG}, m AS (SELECT dataset, voxel, {R.format('value', 'outcome')} AS r FROM img GROUP BY 1, 2)
 SELECT voxel, CAST(CASE WHEN min(sign(r)) = max(sign(r)) THEN min(sign(r)) ELSE 0 END AS DOUBLE) AS agreement FROM m GROUP BY 1""")
def agreement_map(spark, sf_dir):
    return maps.agreement(maps.correlation_map(img(spark, sf_dir)), "r")


@query(f"""{IMG}, m AS (SELECT dataset, voxel, {R.format('value', 'outcome')} AS r FROM img GROUP BY 1, 2)
 SELECT x.dataset AS a, y.dataset AS b, round({R.format('x.r', 'y.r')}, 6) + 0.0 AS r, round(sum(x.r * y.r) / (sqrt(sum(x.r * x.r)) * sqrt(sum(y.r * y.r))), 6) + 0.0 AS cosine
 FROM m x JOIN m y ON x.voxel = y.voxel AND x.dataset <= y.dataset GROUP BY 1, 2""")
def map_similarity(spark, sf_dir):
    return rounded(maps.map_similarity(maps.correlation_map(img(spark, sf_dir)), "r"), "r", "cosine")


@query(f"""{IMG}, t AS (SELECT voxel, avg(value) AS w FROM img WHERE outcome = 0 GROUP BY 1)
 SELECT subject, round(sum(value * w), 6) + 0.0 AS dot, round(sum(value * w) / (sqrt(sum(value * value)) * sqrt(sum(w * w))), 6) + 0.0 AS cosine, round(sum(CASE WHEN w > 0 THEN value END), 6) + 0.0 AS inside,
 round(avg(CASE WHEN w > 0 THEN value END), 6) + 0.0 AS mean_inside, CAST(sum(CASE WHEN w > 0 AND value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_inside FROM img JOIN t ON img.voxel = t.voxel GROUP BY 1""")
def damage_scores(spark, sf_dir):
    i = img(spark, sf_dir)
    target = i.where("outcome = 0").groupBy("voxel").agg(F.avg("value").alias("weight"))
    return rounded(maps.damage_scores(i, target), "dot", "cosine", "inside", "mean_inside")


@query(f"""{IMG}, m AS (SELECT CAST(outcome AS INTEGER) AS id, voxel, avg(value) > 0 AS o FROM img GROUP BY 1, 2), n AS (SELECT id, count(*) FILTER (o) AS n FROM m GROUP BY 1)
 SELECT x.id AS a, y.id AS b, round(CASE WHEN x.n + y.n = 0 THEN 1.0 ELSE 2.0 * (SELECT count(*) FROM m p JOIN m q ON p.voxel = q.voxel WHERE p.id = x.id AND q.id = y.id AND p.o AND q.o) / (x.n + y.n) END, 6) AS dice FROM n x JOIN n y ON x.id < y.id""")
def dice_pairs(spark, sf_dir):
    masks = img(spark, sf_dir).groupBy(F.col("outcome").cast("int").alias("id"), "voxel").agg((F.avg("value") > 0).alias("on"))
    return rounded(maps.dice_pairs(masks), "dice")


@query(f"{IMG}, m AS (SELECT dataset, voxel, round(avg(value), 6) + 0.0 AS mean FROM img GROUP BY 1, 2) SELECT dataset, voxel, mean FROM m QUALIFY rank() OVER (PARTITION BY dataset ORDER BY mean DESC) = 1")
def argmax_voxel(spark, sf_dir):
    return maps.top_voxels(rounded(maps.average_map(img(spark, sf_dir)), "mean").select("dataset", "voxel", "mean"), "mean")


@query(f"""{IMG}, v AS (SELECT dataset, voxel, round(stddev_pop(value), 6) AS p FROM img GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY p) + count(*) OVER (PARTITION BY dataset, p) - 1 AS k, count(*) OVER (PARTITION BY dataset) AS n FROM v)
 SELECT dataset, voxel, p, round(least(1.0, min(p * n / k) OVER (PARTITION BY dataset ORDER BY k DESC)), 6) AS q FROM k""")
def bh_fdr(spark, sf_dir):
    p = rounded(maps.average_map(img(spark, sf_dir)).select("dataset", "voxel", F.col("sd").alias("p")), "p")
    return rounded(resampling.benjamini_hochberg(p, "p", "dataset"), "q")


# --- joins and reshapes -------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts AS visit FROM events WHERE event_type = 'error')
 SELECT a.event_id, a.user_id, b.visit, abs(epoch_us(a.ts) - epoch_us(b.visit)) AS gap FROM a LEFT JOIN b ON a.user_id = b.user_id
 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.visit)) NULLS LAST, b.visit NULLS LAST) = 1""")
def asof_nearest_visit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("visit"))
    return relational.nearest(a, b, "user_id", "ts", "visit", "event_id").select("event_id", "user_id", "visit", "gap")


@query("""WITH s AS (SELECT user_id, event_id, event_type FROM events WHERE event_type = 'signup'), v AS (SELECT user_id, event_id, event_type FROM events WHERE event_type = 'view'),
 u AS (SELECT * FROM s UNION ALL SELECT * FROM v WHERE user_id NOT IN (SELECT user_id FROM s))
 SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def prefer_baseline_else(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return relational.first_rows(relational.prefer(e.where("event_type = 'signup'"), e.where("event_type = 'view'"), "user_id"), "user_id", F.col("event_id"))


@query("""SELECT o_orderkey, 'price' AS variable, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS DOUBLE) FROM orders""")
def wide_to_long(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    return relational.melt(o, ["o_orderkey"], ["price", "customer"])


@query("""WITH c AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS d FROM customer GROUP BY 1)
 SELECT c_custkey, CAST(c_acctbal > a AS INTEGER) + CAST(c_acctbal > b AS INTEGER) + CAST(c_acctbal > d AS INTEGER) AS stratum FROM customer JOIN c USING (c_mktsegment)""")
def qcut_strata(spark, sf_dir):
    return relational.strata(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", [0.25, 0.5, 0.75]).select("c_custkey", "stratum")


DECLARED = {
    "inner_chain": "SELECT o_orderkey, c_name, n_name, r_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey",
    "outer_merge": "SELECT c_custkey, o_orderkey FROM {customer} FULL JOIN {orders} ON c_custkey = o_custkey",
    "left_merge": "SELECT c_custkey, n_name FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey AND n_regionkey < 3",
    "conditional_merge": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN n_name END AS n_name FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey",
    "semi_join_list": "SELECT c_custkey, c_name FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)",
    "anti_join_keys": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "align_keys": "SELECT n_nationkey FROM {nation} WHERE n_nationkey IN (SELECT c_nationkey FROM {customer}) AND n_nationkey IN (SELECT s_nationkey FROM {supplier})",
    "intersect_keys": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}",
    "except_keys": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey AS k FROM {orders} WHERE o_totalprice > 400000",
    "union_rows": "SELECT c_name AS name, c_acctbal AS bal FROM {customer} UNION ALL SELECT s_name AS name, s_acctbal AS bal FROM {supplier}",
    "drop_duplicates_first": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {orders}) WHERE n = 1",
    "pivot_mean": "SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS f, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS o, round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 4) AS p FROM {orders} GROUP BY 1",
    "group_zscore": "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment)) / nullif(stddev_samp(c_acctbal) OVER (PARTITION BY c_mktsegment), 0), 6) AS z FROM {customer}",
    "minmax_by_group": "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER (PARTITION BY c_mktsegment)) / nullif(max(c_acctbal) OVER (PARTITION BY c_mktsegment) - min(c_acctbal) OVER (PARTITION BY c_mktsegment), 0), 6) AS x FROM {customer}",
    "scalar_transforms": "SELECT o_orderkey, round(ln(o_totalprice + 1), 6) AS log1, round(sqrt(o_totalprice), 6) AS root, round(1 / (o_totalprice + 1), 9) AS inv1, round(o_totalprice * o_totalprice, 2) AS sq FROM {orders}",
    "logit_logistic": "SELECT part.p_partkey, round(ln(q / (1 - q)), 6) AS logit, round(1 / (1 + exp(-q)), 6) AS logistic FROM (SELECT p_partkey, (p_size + 5e-1) / 52e0 AS q FROM {part}) part",
    "rolling_mean3": "SELECT event_id, CASE WHEN count(value) OVER w = 3 THEN round(avg(value) OVER w, 6) END AS m FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "cumcount": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM {events}",
    "ecdf": "SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS f FROM {events}",
    "rank_pct": "SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0) / count(*) OVER (PARTITION BY event_type), 6) AS r FROM {events}",
    "histogram40": "SELECT CAST(least(39, floor((c_acctbal - lo) / (hi - lo) * 40)) AS BIGINT) AS bin, count(*) AS n FROM {customer} CROSS JOIN (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM {customer}) s GROUP BY 1",
    "np_select": "SELECT event_id, CASE WHEN value > 60 THEN 1 WHEN value < 30 THEN -1 ELSE 0 END AS c FROM {events}",
    "threshold_fill": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 THEN 0.0 ELSE l_quantity END AS kept FROM {lineitem}",
    "mean_sem_2way": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS m, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS sem FROM {lineitem} GROUP BY 1, 2",
    "contingency_odds": "SELECT sum(quality * toxic) AS a, sum(quality * (1 - toxic)) AS b, sum((1 - quality) * toxic) AS c, sum((1 - quality) * (1 - toxic)) AS d, round(CAST(sum(quality * toxic) * sum((1 - quality) * (1 - toxic)) AS DOUBLE) / nullif(sum(quality * (1 - toxic)) * sum((1 - quality) * toxic), 0), 6) AS odds_ratio FROM {labels}",
    "chi_square_2x2": "SELECT round(n * pow(a * d - b * c, 2) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0), 6) AS chi2, round(pow(b - c, 2) / nullif(b + c, 0), 6) AS mcnemar FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality * toxic) AS DOUBLE) AS a, CAST(sum(quality * (1 - toxic)) AS DOUBLE) AS b, CAST(sum((1 - quality) * toxic) AS DOUBLE) AS c, CAST(sum((1 - quality) * (1 - toxic)) AS DOUBLE) AS d FROM {labels}) t",
    "cohen_kappa": "SELECT round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM (SELECT avg(CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END) AS po, avg(CAST(quality AS DOUBLE)) * avg(CAST(toxic AS DOUBLE)) + (1 - avg(CAST(quality AS DOUBLE))) * (1 - avg(CAST(toxic AS DOUBLE))) AS pe FROM {labels}) t",
    "confusion_metrics": "SELECT round(tp / nullif(tp + fn, 0), 6) AS sens, round(tn / nullif(tn + fp, 0), 6) AS spec, round(tp / nullif(tp + fp, 0), 6) AS ppv, round((tp + tn) / (tp + tn + fp + fn), 6) AS acc, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT CAST(sum(quality * toxic) AS DOUBLE) AS tp, CAST(sum((1 - quality) * (1 - toxic)) AS DOUBLE) AS tn, CAST(sum((1 - quality) * toxic) AS DOUBLE) AS fp, CAST(sum(quality * (1 - toxic)) AS DOUBLE) AS fn FROM {labels}) t",
    "auc_midrank": "SELECT round((sum(CASE WHEN quality = 1 THEN k END) - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0), 6) AS auc FROM (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k, CAST(sum(quality) OVER () AS DOUBLE) AS n1, CAST(sum(1 - quality) OVER () AS DOUBLE) AS n0 FROM {labels} JOIN {documents} USING (doc_id)) t GROUP BY n1, n0",
    "youden_cut": "SELECT n_chars AS cut, round(j, 6) AS j FROM (SELECT n_chars, j, row_number() OVER (ORDER BY round(j, 9) DESC, n_chars) AS r FROM (SELECT n_chars, CAST(sum(p) OVER w AS DOUBLE) / sum(p) OVER () - CAST(sum(q) OVER w AS DOUBLE) / sum(q) OVER () AS j FROM (SELECT n_chars, sum(quality) AS p, sum(1 - quality) AS q FROM {labels} JOIN {documents} USING (doc_id) GROUP BY 1) g WINDOW w AS (ORDER BY n_chars DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) y) z WHERE r = 1",
    "welch_t": "SELECT round((m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / nullif(pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1), 0), 4) AS df FROM (SELECT avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS m1, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS m2, var_samp(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS v1, var_samp(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS v2, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS n1, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n2 FROM {lineitem}) s",
    "paired_t": "SELECT round(avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0), 6) AS t, count(d) - 1 AS df FROM (SELECT l_quantity - l_tax * 100 AS d FROM {lineitem}) x",
    "anova_oneway": "SELECT round(ssb / 1e6, 3) AS ssb_m, round(ssw / 1e6, 3) AS ssw_m, k - 1 AS df1, n - k AS df2, round((ssb / (k - 1)) / nullif(ssw / (n - k), 0), 6) AS f FROM (SELECT sum(c * (m - gm) * (m - gm)) AS ssb, sum(c * v) AS ssw, count(*) AS k, sum(c) AS n FROM (SELECT o_orderpriority, count(*) AS c, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM {orders} GROUP BY 1) g CROSS JOIN (SELECT avg(o_totalprice) AS gm FROM {orders}) a) s",
    "mannwhitney_u": "SELECT sum(CASE WHEN event_type = 'view' THEN k END) - n1 * (n1 + 1) / 2 AS u FROM (SELECT event_type, CAST(rank() OVER (ORDER BY value) AS DOUBLE) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS k, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER () AS DOUBLE) AS n1 FROM {events} WHERE event_type IN ('view', 'click')) t GROUP BY n1",
    "ks_2samp": "SELECT round(max(abs(f1 - f2)), 6) AS d FROM (SELECT CAST(sum(a) OVER w AS DOUBLE) / sum(a) OVER () AS f1, CAST(sum(b) OVER w AS DOUBLE) / sum(b) OVER () AS f2 FROM (SELECT value, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS b FROM {events} GROUP BY 1) g WINDOW w AS (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) s",
    "variance_f": "SELECT round(v1 / nullif(v2, 0), 6) AS f FROM (SELECT var_samp(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS v1, var_samp(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS v2 FROM {lineitem}) s",
    "goodness_of_fit": "SELECT round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM {lineitem}",
    "did_timecourse": "SELECT event_type, CAST(floor(event_id / 500) AS BIGINT) AS period, count(*) AS n, round(avg(value), 6) AS m, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem FROM {events} GROUP BY 1, 2",
    "icc_two_raters": "SELECT round((msr - mse) / nullif(msr, 0), 6) AS icc3k FROM (SELECT 2 * var_samp(m) AS msr, sum(d * d) / (count(*) - 1) - count(*) * avg(e) * avg(e) * 2 / (count(*) - 1) AS mse FROM (SELECT (quality + toxic) / 2e0 AS m, (quality - toxic) / sqrt(2e0) AS d, (quality - toxic) / 2e0 AS e FROM {labels}) t) s",
    "two_proportions_z": "SELECT round((p1 - p2) / nullif(sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n2)), 0), 6) AS z FROM (SELECT avg(CASE WHEN quality = 1 THEN CAST(toxic AS DOUBLE) END) AS p1, avg(CASE WHEN quality = 0 THEN CAST(toxic AS DOUBLE) END) AS p2, avg(CAST(toxic AS DOUBLE)) AS p, sum(quality) AS n1, sum(1 - quality) AS n2 FROM {labels}) s",
    "log_odds_probability": "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS p FROM {customer}",
    "summary_stats": "SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS m, round(stddev_samp(c_acctbal), 4) AS sd, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal), 4) AS med FROM {customer}",
}
for _name, _sql in DECLARED.items():
    declared(_name, _sql)


# --- arrays and strings -------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total, round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def array_sum_mean_norm(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 5).alias("total"), F.round(total / F.size(x), 6).alias("mean"), F.round(F.sqrt(square), 5).alias("norm"))


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
 SELECT c.vec_id AS centre, p.vec_id AS vec_id FROM p c JOIN p ON pow(c.x - p.x, 2) + pow(c.y - p.y, 2) + pow(c.z - p.z, 2) <= 0.01""")
def sphere_range_join(spark, sf_dir):
    from marram.operators.ranges import within

    p = table(spark, sf_dir, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")])
    return within(p, p, "vec_id", 0.1)


from marram.plans import imaging, inference, modelling, prep, relations, replicates  # noqa: E402, F401
