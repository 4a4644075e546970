"""Queries of permutation and bootstrap inference; draws are hashes, so the SQL makes the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.functions.columns import pearson, r6
from marram.operators import models as md
from marram.operators import resampling as rs

from .registry import HOLES, IMG, R, holes, img, query, rounded, table

BOOT = "b AS (SELECT rep, draw, CAST('0x' || substr(md5('{seed}|' || rep || '|' || draw), 1, 8) AS BIGINT) % n AS i FROM (SELECT unnest(range(1, {reps} + 1)) AS rep, n FROM (SELECT count(*) AS n FROM d)), LATERAL (SELECT unnest(range(1, n + 1)) AS draw))"
ORDER = "p AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i FROM d)"
DEALT = """a AS (SELECT rep, block, subject, row_number() OVER (PARTITION BY rep, block ORDER BY subject) AS k FROM s), z AS (SELECT rep, block, v, row_number() OVER (PARTITION BY rep, block ORDER BY md5(concat_ws('|', '{seed}', CAST(rep AS VARCHAR), CAST(subject AS VARCHAR))), subject) AS k FROM s), n AS (SELECT rep, block, subject, v FROM a JOIN z USING (rep, block, k))"""


@query(f"{HOLES}, s AS (SELECT rep, dataset AS block, subject, outcome AS v FROM (SELECT DISTINCT dataset, subject, outcome FROM img), (SELECT unnest(range(1, 51)) AS rep)), {DEALT.format(seed='fwe')}, m AS (SELECT block, rep, max(abs(r)) AS m FROM (SELECT block, rep, voxel, round(corr(value, v), 6) AS r FROM n JOIN holes USING (subject) GROUP BY 1, 2, 3) GROUP BY 1, 2), o AS (SELECT dataset, voxel, round(corr(value, outcome), 6) + 0.0 AS r FROM holes GROUP BY 1, 2) SELECT dataset, voxel, r, count(*) FILTER (m >= abs(r)) / 50.0 AS p FROM o JOIN m ON dataset = block GROUP BY 1, 2, 3")
def fwe_with_holes(spark, sf_dir):
    return rs.max_r(holes(spark, sf_dir), 50)


@query(f"{IMG}, s AS (SELECT rep, dataset AS block, subject, outcome AS v FROM (SELECT DISTINCT dataset, subject, outcome FROM img), (SELECT unnest(range(1, 41)) AS rep)), {DEALT.format(seed='sim')}, r AS (SELECT rep, block, voxel, corr(value, v) AS r FROM n JOIN img USING (subject) GROUP BY 1, 2, 3 UNION ALL SELECT 0, dataset, voxel, corr(value, outcome) FROM img GROUP BY 1, 2, 3), c AS (SELECT x.block AS a, y.block AS b, x.rep, round(corr(x.r, y.r), 6) + 0.0 AS r FROM r x JOIN r y ON x.rep = y.rep AND x.voxel = y.voxel AND x.block < y.block GROUP BY 1, 2, 3) SELECT o.a, o.b, o.r, avg(CASE WHEN abs(c.r) >= abs(o.r) THEN 1.0 ELSE 0.0 END) AS p FROM c JOIN c o ON c.a = o.a AND c.b = o.b AND o.rep = 0 AND c.rep > 0 GROUP BY 1, 2, 3")
def similarity_permutation(spark, sf_dir):
    return rs.similarity_permutation(img(spark, sf_dir), 40)


@query(f"WITH d AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_nationkey < 12), {BOOT.format(seed='b1', reps=60)}, {ORDER}, m AS (SELECT rep, avg(v) - 4500 AS m FROM b JOIN p USING (i) GROUP BY 1) SELECT round(avg(m), 5) AS mean, round(stddev_samp(m), 5) AS se, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high, round(least(1.0, 2 * least(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END))), 6) + 0.0 AS p FROM m")
def bootstrap_mean(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey < 12").select("c_custkey", "c_acctbal")
    m = rs.bootstrap(c, "c_custkey", 60, "b1").groupBy("rep").agg((F.avg("c_acctbal") - 4500).alias("m"))
    return rounded(rounded(rs.bootstrap_summary(m, "m"), "p"), "mean", "se", "low", "high", digits=5)


@query(f"WITH d AS (SELECT n_nationkey AS k, n_nationkey * 1.0 AS y, n_regionkey * 2.0 + n_nationkey % 7 AS x FROM nation), {BOOT.format(seed='b2', reps=80)}, {ORDER}, m AS (SELECT rep, regr_r2(y, x) AS m FROM b JOIN p USING (i) GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS se, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m")
def bootstrap_r2(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("double").alias("y"), (F.col("n_regionkey") * 2.0 + F.col("n_nationkey") % 7).alias("x"))
    m = rs.bootstrap(n, "k", 80, "b2").groupBy("rep").agg(F.regr_r2("y", "x").alias("m"))
    return rounded(rs.bootstrap_summary(m, "m").drop("p"), "mean", "se", "low", "high")


@query(f"WITH d AS (SELECT vec_id AS k, label * 1.0 AS x, embedding[1]::DOUBLE AS m, label * 0.2 + embedding[1]::DOUBLE * 3 + vec_id % 5 AS y FROM embeddings), {BOOT.format(seed='b3', reps=40)}, {ORDER}, j AS (SELECT * FROM b JOIN p USING (i)), f AS (SELECT rep, regr_slope(m, x) AS a, regr_intercept(m, x) AS ia, regr_slope(y, x) AS sy, regr_intercept(y, x) AS iy FROM j GROUP BY 1), m AS (SELECT rep, any_value(a) * regr_slope(y - iy - sy * x, m - ia - a * x) AS m FROM j JOIN f USING (rep) GROUP BY 1) SELECT round(avg(m), 6) + 0.0 AS mean, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high FROM m")
def bootstrap_mediation(spark, sf_dir):
    m = F.element_at("embedding", 1).cast("double")
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("label").cast("double").alias("x"), m.alias("m"), (F.col("label") * 0.2 + m * 3 + F.col("vec_id") % 5).alias("y"))
    draws = md.mediation(rs.bootstrap(d, "k", 40, "b3"), "x", "m", "y", ["rep"])
    return rounded(rs.bootstrap_summary(draws, "indirect").select("mean", "low", "high"), "mean", "low", "high")


@query(f"WITH d AS (SELECT vec_id AS k, label * 1.0 AS y, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), {BOOT.format(seed='b4', reps=40)}, {ORDER}, m AS (SELECT rep, abs(corr(y, a)) - abs(corr(y, b)) AS g FROM b JOIN p USING (i) GROUP BY 1) SELECT round(avg(g), 6) + 0.0 AS gap, avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) AS share, round(quantile_cont(g, 0.025), 6) + 0.0 AS low, round(quantile_cont(g, 0.975), 6) + 0.0 AS high FROM m")
def paired_superiority(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("label").alias("y"), F.element_at("embedding", 1).cast("double").alias("a"), F.element_at("embedding", 2).cast("double").alias("b"))
    m = rs.bootstrap(d, "k", 40, "b4").groupBy("rep").agg(F.abs(pearson("y", "a")).alias("a"), F.abs(pearson("y", "b")).alias("b"))
    return rounded(rs.paired_superiority(m, "a", "b"), "gap", "low", "high")


@query(f"WITH d AS (SELECT vec_id AS subject, label % 2 AS g, label * 1.0 AS x, embedding[1]::DOUBLE AS y FROM embeddings), s AS (SELECT rep, 0 AS block, subject, g AS v FROM d, (SELECT unnest(range(1, 61)) AS rep)), {DEALT.format(seed='lp')}, e AS (SELECT rep, subject, v FROM n UNION ALL SELECT 0, subject, g FROM d), r AS (SELECT rep, v, {R.format('x', 'y')} AS r FROM e JOIN d USING (subject) GROUP BY 1, 2), t AS (SELECT rep, round(max(CASE WHEN v = 1 THEN r END) - max(CASE WHEN v = 0 THEN r END), 6) + 0.0 AS t FROM r GROUP BY 1) SELECT o.t AS delta, avg(CASE WHEN abs(t.t) >= abs(o.t) THEN 1.0 ELSE 0.0 END) AS p FROM t, t o WHERE o.rep = 0 AND t.rep > 0 GROUP BY 1")
def delta_r_permutation(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subject"), (F.col("label") % 2).alias("g"), F.col("label").cast("double").alias("x"), F.element_at("embedding", 1).cast("double").alias("y"))
    return rs.label_permutation(d, "x", "y", "g", 60, "lp")


@query(f"{IMG}, m AS (SELECT dataset, voxel, avg(value) AS v FROM img GROUP BY 1, 2), c AS (SELECT dataset, quantile_cont(v, 0.9) AS c FROM m GROUP BY 1), o AS (SELECT dataset, voxel, CAST(v >= c AS INTEGER) AS o FROM m JOIN c USING (dataset)), s AS (SELECT rep, 0 AS block, voxel AS subject, o AS v FROM o, (SELECT unnest(range(1, 61)) AS rep) WHERE dataset = 1), {DEALT.format(seed='pd')}, e AS (SELECT rep, subject AS voxel, v FROM n UNION ALL SELECT 0, voxel, o FROM o WHERE dataset = 1), d AS (SELECT rep, 2.0 * sum(v * o) / (sum(v) + sum(o)) AS d FROM e JOIN o USING (voxel) WHERE dataset = 0 GROUP BY 1) SELECT x.d AS dice, avg(CASE WHEN d.d > x.d THEN 1.0 ELSE 0.0 END) AS p FROM d, d x WHERE x.rep = 0 AND d.rep > 0 GROUP BY 1")
def permuted_dice(spark, sf_dir):
    m = img(spark, sf_dir).groupBy("dataset", "voxel").agg(F.avg("value").alias("value"))
    return rs.permuted_dice(m.where("dataset = 0").select("voxel", "value"), m.where("dataset = 1").select("voxel", "value"), 60, "pd", 0.9)


@query("SELECT l_linenumber AS voxel, round(CAST(sum(l_suppkey % 7) AS DOUBLE) / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * 100000), 6) AS p FROM lineitem GROUP BY 1")
def merged_counts(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("voxel"), (F.col("l_suppkey") % 7).alias("p_count"))
    return rounded(rs.merged_counts(f, 100_000), "p")


@query("SELECT l_returnflag, round(avg(CASE WHEN abs(l_discount) >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS both_sides, round((count(*) FILTER (l_discount > 0.05) + 1.0) / (count(*) + 1), 6) AS above, round(count(*) FILTER (l_discount <= 0.05) * 1.0 / count(*), 6) AS below FROM lineitem GROUP BY 1")
def empirical_p_values(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", F.lit(0.05).alias("o"))
    by = ["l_returnflag"]
    one = lambda name, **k: rs.empirical_p(n, "l_discount", "o", by, **k).withColumnRenamed("p", name)
    got = one("both_sides").join(one("above", side="above", inclusive=False, plus_one=True), by).join(one("below", side="below"), by)
    return rounded(got, "both_sides", "above", "below")


@query("SELECT c_nationkey, round(atanh(r), 6) + 0.0 AS z, round(1.0 / sqrt(n - 3), 6) AS se, n FROM (SELECT c_nationkey, corr(c_acctbal, c_custkey) AS r, count(*) AS n FROM customer GROUP BY 1) WHERE n > 3")
def fisher_meta_rows(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(pearson("c_acctbal", "c_custkey").alias("r"), F.count(F.lit(1)).alias("n")).where("n > 3")
    return g.select("c_nationkey", r6(F.atanh("r")).alias("z"), F.round(1 / F.sqrt(F.col("n") - 3), 6).alias("se"), "n")
