"""Queries on images, maps and voxel grids. Grids are the 64 components as 4 x 4 x 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.functions.columns import pearson
from marram.operators import combine as cb
from marram.operators import grid as gr
from marram.operators import hypothesis as h
from marram.operators import similarity as sm

from .registry import HOLES, IMG, holes, img, query, rounded, t_p_sql, table

TISSUE = IMG + ", tis AS (SELECT subject, outcome, voxel % 21 AS voxel, CASE voxel // 21 WHEN 0 THEN 'grey' WHEN 1 THEN 'white' ELSE 'csf' END AS tissue, value FROM img WHERE voxel < 63)"
MAPS = HOLES + ", m AS (SELECT dataset, voxel, avg(value) AS value FROM holes GROUP BY 1, 2)"
GRID = IMG + ", g AS (SELECT subject AS image, voxel // 16 AS x, voxel // 4 % 4 AS y, voxel % 4 AS z, CASE WHEN value > 0.1 THEN value ELSE 0.0 END AS value FROM img)"


def tissue(spark, sf_dir):
    t = F.floor(F.col("voxel") / 21)
    name = F.when(t == 0, "grey").when(t == 1, "white").otherwise("csf")
    return img(spark, sf_dir).where("voxel < 63").select("subject", "outcome", (F.col("voxel") % 21).alias("voxel"), name.alias("tissue"), "value")


def mean_maps(spark, sf_dir):
    return holes(spark, sf_dir).groupBy("dataset", "voxel").agg(F.avg("value").alias("value"))


def cells(spark, sf_dir):
    x, y, z = gr.unravel(F.col("voxel"), (4, 4, 4))
    return img(spark, sf_dir).select(F.col("subject").alias("image"), x.alias("x"), y.alias("y"), z.alias("z"), F.when(F.col("value") > 0.1, F.col("value")).otherwise(0.0).alias("value"))


# --- aggregates (§2.8) ---------------------------------------------------------------------------------------------


@query(f"{HOLES} SELECT subject, round(quantile_cont(value, 0.05), 6) + 0.0 AS p5, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95 FROM holes WHERE voxel IN (SELECT voxel FROM img GROUP BY 1 HAVING avg(value) > 0) GROUP BY 1")
def image_percentiles(spark, sf_dir):
    m = img(spark, sf_dir).groupBy("voxel").agg(F.avg("value").alias("value")).where("value > 0")
    return rounded(cb.percentiles(holes(spark, sf_dir), [0.05, 0.5, 0.95], m), "p5", "p50", "p95")


@query(f"{MAPS}, w AS (SELECT dataset, CAST(count(DISTINCT subject) AS DOUBLE) AS w FROM img GROUP BY 1) SELECT voxel, round(sum(value * w) / sum(w), 6) + 0.0 AS weighted, round(avg(value), 6) + 0.0 AS plain FROM m JOIN w USING (dataset) GROUP BY 1")
def weighted_mean_map(spark, sf_dir):
    m = mean_maps(spark, sf_dir)
    w = img(spark, sf_dir).groupBy("dataset").agg(F.count_distinct("subject").cast("double").alias("weight"))
    got = cb.weighted_mean(m, w).withColumnRenamed("value", "weighted").join(cb.weighted_mean(m).withColumnRenamed("value", "plain"), "voxel")
    return rounded(got, "weighted", "plain")


@query(f"{MAPS}, c AS (SELECT a.dataset, corr(a.value, b.value) AS c FROM m a JOIN m b ON a.voxel = b.voxel AND b.dataset = 0 GROUP BY 1) SELECT dataset, voxel, round(CASE WHEN c < 0 THEN -value ELSE value END, 6) + 0.0 AS value FROM m JOIN c USING (dataset)")
def sign_alignment(spark, sf_dir):
    return rounded(cb.align_signs(mean_maps(spark, sf_dir), 0), "value").select("dataset", "voxel", "value")


@query(f"""{MAPS}, j AS (SELECT a.voxel, a.value AS x, b.value AS y FROM m a JOIN m b ON a.voxel = b.voxel AND a.dataset = 0 AND b.dataset = 1)
 SELECT voxel, CASE WHEN abs(x) > 0.005 AND abs(y) > 0.005 THEN 1.0 ELSE 0.0 END AS unsigned, round(CASE WHEN abs(x) > 0.005 AND abs(y) > 0.005 AND sign(x) = sign(y) THEN sign(x) * least(abs(x), abs(y)) ELSE 0 END, 6) + 0.0 AS signed, CASE WHEN abs(x) > 0.005 AND abs(y) > 0.005 AND sign(x) = sign(y) THEN CAST(sign(x) AS DOUBLE) ELSE 0.0 END AS agreement FROM j""")
def conjunction_maps(spark, sf_dir):
    m = mean_maps(spark, sf_dir)
    a, b = m.where("dataset = 0"), m.where("dataset = 1")
    one = lambda rule: cb.conjunction(a, b, rule, 0.005).withColumnRenamed("value", rule)
    return rounded(one("unsigned").join(one("signed"), "voxel").join(one("agreement"), "voxel"), "signed")


@query(f"""{TISSUE}, w AS (SELECT subject, voxel, sum(value) FILTER (tissue = 'grey') AS g, sum(value) FILTER (tissue = 'white') AS w, -sum(value) FILTER (tissue = 'csf') AS c FROM tis GROUP BY 1, 2)
 SELECT subject, voxel, unnest(['grey+white', 'grey+csf', 'white+csf', 'grey+white+csf']) AS composite, round(unnest([g + w, g + c, w + c, g + w + c]), 6) + 0.0 AS value FROM w""")
def composite_sums(spark, sf_dir):
    return rounded(cb.composites(tissue(spark, sf_dir), ["grey", "white", "csf"], {"csf": -1}), "value")


@query(f"""{TISSUE}, n AS (SELECT subject, outcome, voxel, sqrt(sum(pow(least(CASE WHEN tissue = 'csf' THEN -value ELSE value END, 0), 2))) AS v FROM tis WHERE tissue <> 'white' GROUP BY 1, 2, 3), c AS (SELECT voxel, avg(v) AS m, stddev_pop(v) AS s FROM n WHERE outcome = 0 GROUP BY 1)
 SELECT subject, n.voxel, round((v - m) / s, 6) + 0.0 AS z, (v - m) / s < -2 AS significant FROM n JOIN c ON n.voxel = c.voxel WHERE outcome <> 0""")
def atrophy_composite(spark, sf_dir):
    t = tissue(spark, sf_dir)
    n = cb.atrophy_norm(t).join(t.select("subject", "outcome").distinct(), "subject")
    return rounded(cb.control_scores(n, F.col("outcome") == 0, ["voxel"]).select("subject", "voxel", "z", "significant"), "z")


@query(f"""{TISSUE}, c AS (SELECT tissue, voxel, avg(value) AS m, stddev_pop(value) AS s FROM tis WHERE outcome = 0 GROUP BY 1, 2) SELECT subject, tissue, voxel, round((value - m) / s, 6) + 0.0 AS z, CASE WHEN tissue = 'csf' THEN (value - m) / s > 2 ELSE (value - m) / s < -2 END AS significant FROM tis JOIN c USING (tissue, voxel) WHERE outcome <> 0""")
def control_scores_by_tissue(spark, sf_dir):
    got = cb.control_scores(tissue(spark, sf_dir), F.col("outcome") == 0, ["tissue", "voxel"], F.col("tissue") == "csf")
    return rounded(got.select("subject", "tissue", "voxel", "z", "significant"), "z")


@query(f"""{HOLES}, c AS (SELECT voxel, regr_slope(value, k) AS b, regr_intercept(value, k) AS a FROM (SELECT *, subject % 17 AS k FROM holes WHERE outcome < 3) GROUP BY 1), r AS (SELECT voxel, sqrt(sum(pow(value - a - b * (subject % 17), 2)) / (count(*) - 2)) AS s FROM holes JOIN c USING (voxel) WHERE outcome < 3 AND value IS NOT NULL GROUP BY 1)
 SELECT subject, voxel, round((value - a - b * (subject % 17)) / s, 6) + 0.0 AS w FROM holes JOIN c USING (voxel) JOIN r USING (voxel) WHERE outcome >= 3""")
def w_score_map(spark, sf_dir):
    i = holes(spark, sf_dir).withColumn("age", (F.col("subject") % 17).cast("double"))
    return rounded(cb.w_scores(i, F.col("outcome") < 3, "age"), "w")


@query(f"""{TISSUE}, v AS (SELECT subject, sum(abs(value)) * 27.0 AS tiv FROM tis GROUP BY 1) SELECT subject, tissue, voxel, round(CASE WHEN abs(value) >= 0.1 THEN abs(value) ELSE 0 END / tiv, 9) + 0.0 AS value FROM tis JOIN v USING (subject)""")
def volume_normalised(spark, sf_dir):
    t = tissue(spark, sf_dir).withColumn("value", F.abs("value"))
    return rounded(cb.volume_normalised(t, 3.0, 0.1).select("subject", "tissue", "voxel", "value"), "value", digits=9)


@query(f"{TISSUE} SELECT subject, tissue, voxel, CASE WHEN tissue = 'csf' THEN value ELSE -value END AS value FROM tis")
def sign_flip_tissue(spark, sf_dir):
    return cb.sign_flip(tissue(spark, sf_dir), F.col("tissue") == "csf").select("subject", "tissue", "voxel", "value")


@query(f"""{IMG}, m AS (SELECT CAST(outcome AS INTEGER) AS id, voxel, avg(value) > 0 AS o FROM img GROUP BY 1, 2), p AS (SELECT x.id AS a, y.id AS b, count(*) FILTER (x.o AND y.o) AS k, count(*) FILTER (x.o) AS na, count(*) FILTER (y.o) AS nb FROM m x JOIN m y ON x.voxel = y.voxel GROUP BY 1, 2)
 SELECT a, b, round(100.0 * k / na, 6) AS percent, round(2.0 * k / (na + nb), 6) AS dice FROM p""")
def overlap_matrix(spark, sf_dir):
    m = img(spark, sf_dir).groupBy(F.col("outcome").cast("int").alias("id"), "voxel").agg((F.avg("value") > 0).alias("on"))
    return rounded(cb.overlap_matrix(m), "percent", "dice")


@query("WITH t AS (SELECT o_orderpriority AS map, corr(o_totalprice, o_custkey) AS a, corr(o_totalprice, o_orderkey) AS b, count(*) AS n FROM orders GROUP BY 1) SELECT map, round(n * a * a - b * b, 6) + 0.0 AS specificity, row_number() OVER (ORDER BY n * a * a - b * b DESC) AS rank FROM t")
def variance_specificity(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("map")).agg(pearson("o_totalprice", "o_custkey").alias("a"), pearson("o_totalprice", "o_orderkey").alias("b"), F.count(F.lit(1)).alias("n"))
    s = cb.variance_specificity(o, "a", ["b"], F.col("n"))
    return rounded(s.select("map", "specificity", F.row_number().over(Window.orderBy(F.desc("specificity"))).cast("long").alias("rank")), "specificity")


@query(f"""{GRID}, c AS (SELECT image, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM g WHERE value <> 0 GROUP BY 1), o AS (SELECT image + 1 AS image, x, y, z FROM c) SELECT image, round(c.x - o.x, 6) + 0.0 AS dx, round(c.y - o.y, 6) + 0.0 AS dy, round(c.z - o.z, 6) + 0.0 AS dz, round(sqrt(pow(c.x - o.x, 2) + pow(c.y - o.y, 2) + pow(c.z - o.z, 2)), 6) AS distance FROM c JOIN o USING (image)""")
def centroid_gaps(spark, sf_dir):
    c = cb.centroid(cells(spark, sf_dir), "image")
    return rounded(cb.centroid_gap(c, c.withColumn("image", F.col("image") + 1), "image"), "dx", "dy", "dz", "distance")


@query(f"{IMG} SELECT subject % 50 AS subject, voxel, round(sum(value), 6) + 0.0 AS total, round(max(value), 6) + 0.0 AS top, CASE WHEN sum(value) > 0 THEN 1.0 ELSE 0.0 END AS binary FROM img GROUP BY 1, 2")
def merged_subject_masks(spark, sf_dir):
    i = img(spark, sf_dir).withColumn("subject", F.col("subject") % 50)
    keys = ["subject", "voxel"]
    got = cb.merged_masks(i).withColumnRenamed("value", "total").join(cb.merged_masks(i, "max").withColumnRenamed("value", "top"), keys).join(cb.merged_masks(i, binary=True).withColumnRenamed("value", "binary"), keys)
    return rounded(got, "total", "top")


@query(f"{IMG}, o AS (SELECT dataset, voxel, count(*) FILTER (value >= 0.1) AS n FROM img GROUP BY 1, 2) SELECT dataset, voxel, n FROM o QUALIFY rank() OVER (PARTITION BY dataset ORDER BY n DESC) = 1")
def best_overlap_voxels(spark, sf_dir):
    o = img(spark, sf_dir).groupBy("dataset", "voxel").agg(F.count(F.when(F.col("value") >= cb.MAP_THRESHOLDS["r"], 1)).alias("n"))
    return cb.best_overlap(o, "n", "dataset")


@query("""SELECT 'l_quantity' AS name, count(l_quantity) AS n, 0 AS missing, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem UNION ALL SELECT 'l_tax', count(t), count(*) - count(t), round(avg(t), 6), round(stddev_samp(t), 6), min(t), max(t) FROM (SELECT CASE WHEN l_linenumber <> 2 THEN l_tax END AS t FROM lineitem)""")
def describe_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") != 2, F.col("l_tax")))
    return rounded(cb.describe_all(lines, ["l_quantity", "l_tax"]), "mean", "sd")


@query("SELECT k, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM (SELECT CASE WHEN event_id % 4 <> 0 THEN event_type END AS k FROM events) GROUP BY 1")
def label_shares(spark, sf_dir):
    return rounded(cb.shares(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("k")), "k"), "share")


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity * 1000), 4) AS predicted, round(avg(l_extendedprice), 4) AS actual, count(*) AS n FROM lineitem GROUP BY 1, 2")
def marginal_means(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") * 1000)
    return rounded(cb.marginal_means(lines, ["l_returnflag", "l_linestatus"], "p", "l_extendedprice"), "predicted", "actual", digits=4)


# --- correlation and similarity (§2.10) ----------------------------------------------------------------------------


@query(f"{HOLES}, c AS (SELECT dataset, voxel, corr(value, outcome) AS r, count(value) AS n FROM holes GROUP BY 1, 2), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c) SELECT dataset, voxel, round(r, 6) + 0.0 AS r, round(r * r, 6) AS r2, n, round({t_p_sql('t', '(n - 2.0)')}, 6) AS p FROM t")
def correlation_map_with_p(spark, sf_dir):
    return rounded(sm.correlation_tests(holes(spark, sf_dir)), "r", "r2", "p")


@query(f"""{HOLES}, k AS (SELECT dataset, voxel, row_number() OVER (PARTITION BY dataset, voxel ORDER BY value, subject) AS a, row_number() OVER (PARTITION BY dataset, voxel ORDER BY outcome, subject) AS b FROM holes WHERE value IS NOT NULL)
 SELECT dataset, voxel, round(1 - 6 * sum(pow(a - b, 2)) / (count(*) * (pow(count(*), 2) - 1)), 6) + 0.0 AS rho FROM k GROUP BY 1, 2""")
def spearman_ordinal(spark, sf_dir):
    return rounded(sm.ordinal_rank_map(holes(spark, sf_dir)), "rho")


@query("SELECT unnest(['l_quantity', 'l_quantity', 'l_tax', 'l_tax']) AS x, unnest(['l_extendedprice', 'l_discount', 'l_extendedprice', 'l_discount']) AS y, round(unnest([corr(l_quantity, l_extendedprice), corr(l_quantity, l_discount), corr(l_tax, l_extendedprice), corr(l_tax, l_discount)]), 6) + 0.0 AS r FROM lineitem")
def cross_correlation(spark, sf_dir):
    return rounded(sm.cross_correlation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], ["l_extendedprice", "l_discount"]), "r")


PAIRS = "j AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(abs(sign(a.x - b.x))) AS p, sum(abs(sign(a.y - b.y))) AS q FROM t a JOIN t b ON a.i < b.i)"


@query(f"WITH t AS (SELECT vec_id AS i, label AS x, round(embedding[1]::DOUBLE, 1) AS y FROM embeddings), {PAIRS} SELECT round(s / sqrt(p * q), 6) AS tau FROM j")
def kendall_tau(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("x"), F.round(F.element_at("embedding", 1).cast("double"), 1).alias("y"))
    return rounded(sm.kendall(e, "x", "y", "vec_id"), "tau")


@query("""WITH t AS (SELECT vec_id AS i, label::DOUBLE AS x, embedding[1]::DOUBLE AS y FROM embeddings), d AS (SELECT a.i, b.i AS j, abs(a.x - b.x) AS p, abs(a.y - b.y) AS q FROM t a, t b),
 c AS (SELECT p - avg(p) OVER (PARTITION BY i) - avg(p) OVER (PARTITION BY j) + avg(p) OVER () AS p, q - avg(q) OVER (PARTITION BY i) - avg(q) OVER (PARTITION BY j) + avg(q) OVER () AS q FROM d) SELECT round(sqrt(avg(p * q) / sqrt(avg(p * p) * avg(q * q))), 6) AS dcor FROM c""")
def distance_correlation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("x"), F.element_at("embedding", 1).alias("y"))
    return rounded(sm.distance_correlation(e, "x", "y", "vec_id"), "dcor")


@query(f"""{MAPS}, k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value) AS k FROM m) SELECT a.dataset AS a, b.dataset AS b, round(corr(a.value, b.value), 6) + 0.0 AS r, round(pow(corr(a.value, b.value), 2), 6) AS r2, round(abs(corr(a.value, b.value)), 6) AS absolute,
 round(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)), 6) + 0.0 AS cosine, round(sqrt(sum(pow(a.value - b.value, 2))), 6) AS euclid, round(corr(a.k, b.k), 6) + 0.0 AS rho FROM k a JOIN k b ON a.voxel = b.voxel AND a.dataset < b.dataset GROUP BY 1, 2""")
def map_pair_measures(spark, sf_dir):
    return rounded(sm.map_pairs(mean_maps(spark, sf_dir)), "r", "r2", "absolute", "cosine", "euclid", "rho")


@query(f"{IMG}, s AS (SELECT * FROM img WHERE dataset = 0) SELECT a.subject AS a, b.subject AS b, round(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)), 6) + 0.0 AS cosine FROM s a JOIN s b ON a.voxel = b.voxel AND a.subject < b.subject GROUP BY 1, 2")
def image_cosines_within(spark, sf_dir):
    return rounded(sm.image_cosines(img(spark, sf_dir).where("dataset = 0")), "cosine")


@query(f"""{IMG}, c AS (SELECT 'within' AS k, sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS c FROM img a JOIN img b ON a.voxel = b.voxel AND a.subject < b.subject AND a.dataset = 0 AND b.dataset = 0 GROUP BY a.subject, b.subject
 UNION ALL SELECT 'cross', sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) FROM img a JOIN img b ON a.voxel = b.voxel AND a.dataset = 0 AND b.dataset = 1 GROUP BY a.subject, b.subject),
 m AS (SELECT avg(c) FILTER (k = 'within') AS m1, avg(c) FILTER (k = 'cross') AS m2, var_samp(c) FILTER (k = 'within') AS v1, var_samp(c) FILTER (k = 'cross') AS v2, count(*) FILTER (k = 'within') AS n1, count(*) FILTER (k = 'cross') AS n2 FROM c)
 SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS t FROM m""")
def cosine_within_against_cross(spark, sf_dir):
    i = img(spark, sf_dir)
    a = i.where("dataset = 0")
    one, two = (m.toDF(f"n{k}", f"m{k}", f"v{k}") for k, m in enumerate((sm.image_cosine_moments(a), sm.image_cosine_moments(a, i.where("dataset = 1"))), 1))
    return rounded(h.welch_from(one.crossJoin(two)).select("t"), "t", digits=5)


@query(f"""{IMG}, t AS (SELECT voxel, avg(value) AS w FROM img WHERE outcome = 0 GROUP BY 1), j AS (SELECT subject, value AS v, w FROM img JOIN t USING (voxel))
 SELECT subject, round(corr(v, w), 6) + 0.0 AS spatial_correlation, round(avg(v) FILTER (w > 0), 6) + 0.0 AS avg_in_target, round(avg(w) FILTER (v > 0), 6) + 0.0 AS avg_in_subject, count(*) FILTER (w > 0 AND v > 0.2) AS num_in_roi, max(v) FILTER (w > 0) AS max_in_roi, min(v) FILTER (w > 0) AS min_in_roi,
 round(sum(v * w) / count(*) FILTER (w > 0), 6) + 0.0 AS dot_per_target, round(sum(v * w) / count(*) FILTER (v > 0), 6) + 0.0 AS dot_per_subject, round(2.0 * count(*) FILTER (w > 0 AND v > 0) / (count(*) FILTER (w > 0) + count(*) FILTER (v > 0)), 6) AS dice FROM j GROUP BY 1""")
def target_scores(spark, sf_dir):
    i = img(spark, sf_dir)
    got = sm.scores(i, i.where("outcome = 0").groupBy("voxel").agg(F.avg("value").alias("weight")), 0.2).drop("cosine", "dot")
    return rounded(got, "spatial_correlation", "avg_in_target", "avg_in_subject", "dot_per_target", "dot_per_subject", "dice")


@query(f"""{HOLES}, o AS (SELECT a.subject, a.voxel, a.value, (SELECT avg(b.value) FROM holes b WHERE b.voxel = a.voxel AND b.subject <> a.subject) AS o FROM holes a WHERE a.value IS NOT NULL) SELECT subject, round(sum(value * o) / sqrt(sum(value * value) * sum(o * o)), 6) + 0.0 AS cosine FROM o GROUP BY 1""")
def held_out_similarity(spark, sf_dir):
    return rounded(sm.held_out_similarity(holes(spark, sf_dir)), "cosine")


@query("""WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM lineitem) SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax']) AS name, round(unnest([(1 - c * c), (1 - b * b), (1 - a * a)]) / (1 + 2 * a * b * c - a * a - b * b - c * c), 6) AS vif FROM r""")
def variance_inflation(spark, sf_dir):
    return rounded(sm.vif(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), "vif")


@query("""WITH n AS (SELECT n_nationkey AS k, n_nationkey * 7.0 - 80 AS lat, n_nationkey * 13.0 - 160 AS lon FROM nation) SELECT a.k AS a, b.k AS b, round(2 * 6371 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 4) AS distance FROM n a JOIN n b ON a.k < b.k""")
def haversine_matrix(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 7.0 - 80).alias("lat"), (F.col("n_nationkey") * 13.0 - 160).alias("lon"))
    return rounded(sm.point_distances(n, "k", "haversine"), "distance", digits=4)


@query("""WITH e AS (SELECT vec_id AS k, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings WHERE label = 1) SELECT a.k AS a, b.k AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) AS euclid, round(1 - (a.x * b.x + a.y * b.y + a.z * b.z) / (sqrt(a.x * a.x + a.y * a.y + a.z * a.z) * sqrt(b.x * b.x + b.y * b.y + b.z * b.z)), 6) + 0.0 AS cosine FROM e a JOIN e b ON a.k < b.k""")
def point_distance_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label = 1").select(F.col("vec_id").alias("k"), *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")])
    got = sm.point_distances(e, "k", "euclid").withColumnRenamed("distance", "euclid").join(sm.point_distances(e, "k", "cosine").withColumnRenamed("distance", "cosine"), ["a", "b"])
    return rounded(got, "euclid", "cosine")


# --- grids (§2.11) -------------------------------------------------------------------------------------------------


@query(f"{GRID} SELECT image, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z FROM g WHERE value <> 0 GROUP BY 1")
def bounding_boxes(spark, sf_dir):
    return gr.bounding_box(cells(spark, sf_dir), ["image"])


@query(f"{GRID}, b AS (SELECT min(x) AS a, min(y) AS b, min(z) AS c FROM g WHERE value <> 0) SELECT x - a AS x, y - b AS y, z - c AS z, round(sum(value), 6) AS value, CASE WHEN sum(value) > 10 THEN 1.0 END AS mask FROM g, b WHERE value <> 0 GROUP BY 1, 2, 3")
def collapsed_box(spark, sf_dir):
    c = cells(spark, sf_dir)
    return rounded(gr.collapse(c).join(gr.collapse(c, 10.0).withColumnRenamed("value", "mask"), ["x", "y", "z"], "left"), "value")


@query(f"{GRID}, f AS (SELECT unnest(range(2))::INT AS d), s AS (SELECT image, x, y, z, value FROM g WHERE image < 40) SELECT image, x * 2 + a.d AS x, y * 2 + b.d AS y, z * 2 + c.d AS z, value FROM s, f a, f b, f c")
def resample_finer(spark, sf_dir):
    return gr.resample_nearest(cells(spark, sf_dir).where("image < 40"), 2).select("image", "x", "y", "z", "value")


@query(f"{GRID} SELECT image, x // 2 AS x, y // 2 AS y, z // 2 AS z, round(avg(value), 6) AS mean, max(CASE WHEN x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0 THEN value END) AS first FROM g GROUP BY 1, 2, 3, 4")
def resample_coarser(spark, sf_dir):
    c = cells(spark, sf_dir)
    keys = ["image", "x", "y", "z"]
    return rounded(gr.downsample_mean(c, 2, ["image"]).withColumnRenamed("value", "mean").join(gr.resample_nearest(c, 0.5).withColumnRenamed("value", "first"), keys), "mean")


@query(f"{GRID} SELECT image, 3 - x AS x, y, z, value FROM g")
def flip_axis(spark, sf_dir):
    return gr.flip(cells(spark, sf_dir), "x", 4).select("image", "x", "y", "z", "value")


@query("""WITH c AS (SELECT n_nationkey AS id, n_nationkey * 1.5 AS a, n_nationkey * 0.5 AS b, 3.0 AS c FROM nation), o AS (SELECT unnest(range(-4, 60))::INT AS x), p AS (SELECT unnest(range(-4, 60))::INT AS y), q AS (SELECT unnest(range(-4, 60))::INT AS z), d AS (SELECT id, x, y, z, sqrt(pow(x - a, 2) + pow(y - b, 2) + pow(z - c, 2)) AS d FROM c, o, p, q)
 SELECT id, x, y, z, round(1 - d / 2.5, 6) + 0.0 AS near, round(d / 2.5, 6) AS far FROM d WHERE d <= 2.5""")
def sphere_rois(spark, sf_dir):
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 1.5).alias("x"), (F.col("n_nationkey") * 0.5).alias("y"), F.lit(3.0).alias("z"))
    keys = ["id", "x", "y", "z"]
    return rounded(gr.spheres(c, 2.5, "concentric").withColumnRenamed("value", "near").join(gr.spheres(c, 2.5, "eccentric").withColumnRenamed("value", "far"), keys), "near", "far")


@query(f"{GRID} SELECT a.image, a.x, a.y, a.z, round(sum(b.value), 6) + 0.0 AS value FROM g a JOIN g b ON a.image = b.image AND b.x BETWEEN a.x AND a.x + 2 AND b.y BETWEEN a.y AND a.y + 2 AND b.z BETWEEN a.z AND a.z + 2 GROUP BY 1, 2, 3, 4")
def box_convolution(spark, sf_dir):
    return rounded(gr.box_sums(cells(spark, sf_dir)), "value")


CLUSTERS = GRID.replace("WITH img", "WITH RECURSIVE img") + """, o AS (SELECT image, x, y, z, value, x * 16 + y * 4 + z AS i FROM g WHERE value > 0.1 AND image < 60), e AS (SELECT a.image, a.i AS a, b.i AS b FROM o a JOIN o b ON a.image = b.image AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
 r AS (SELECT image, i, i AS s FROM o UNION SELECT r.image, e.b, r.s FROM r JOIN e ON r.image = e.image AND r.i = e.a), l AS (SELECT image, i, min(s) AS cluster FROM r GROUP BY 1, 2)"""


@query(f"{CLUSTERS} SELECT image, x, y, z, cluster::INT AS cluster, size FROM (SELECT o.*, cluster, count(*) OVER (PARTITION BY image, cluster) AS size FROM o JOIN l USING (image, i)) WHERE size >= 3")
def connected_clusters(spark, sf_dir):
    c = gr.clusters(cells(spark, sf_dir).where("image < 60"), 0.1, full=False)
    place = (F.col("cluster.x") * 16 + F.col("cluster.y") * 4 + F.col("cluster.z")).alias("cluster")
    return gr.large_clusters(c, 3).select("image", "x", "y", "z", place, "size")


@query(f"{CLUSTERS}, c AS (SELECT o.*, cluster FROM o JOIN l USING (image, i)), h AS (SELECT image, x, y, z, cluster, unnest(range(1, greatest(1, floor(value / 0.02 + 1e-9))::INT + 1)) AS k, value FROM c), n AS (SELECT *, count(*) OVER (PARTITION BY image, cluster, k) AS n FROM h WHERE k * 0.02 <= value + 1e-9) SELECT image, x, y, z, round(sum(sqrt(n) * pow(k * 0.02, 2) * 0.02), 8) AS tfce FROM n GROUP BY 1, 2, 3, 4")
def tfce_map(spark, sf_dir):
    return rounded(gr.tfce(gr.clusters(cells(spark, sf_dir).where("image < 60"), 0.1, full=False), 0.02), "tfce", digits=8)


@query(f"""{GRID}, p AS (SELECT x, y, z, (x * 16 + y * 4 + z) % 25 AS i FROM g GROUP BY ALL), r AS (SELECT DISTINCT n_regionkey AS k, x, y, z FROM p JOIN nation ON n_nationkey = i), s AS (SELECT k, count(*) AS n FROM r GROUP BY 1)
 SELECT image, k AS \"group\", round(count(*) / any_value(n), 6) AS share FROM g JOIN r USING (x, y, z) JOIN s USING (k) WHERE value > 0 GROUP BY 1, 2""")
def atlas_coverage(spark, sf_dir):
    c = cells(spark, sf_dir)
    parcels = c.select("x", "y", "z").distinct().withColumn("index", (F.col("x") * 16 + F.col("y") * 4 + F.col("z")) % 25)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("index"), "n_regionkey")
    return rounded(gr.coverage(c, gr.atlas_groups(parcels, names, F.col("n_regionkey"))), "share")


@query(f"{GRID}, p AS (SELECT n_nationkey AS id, n_nationkey / 6.0 AS x, n_nationkey / 9.0 AS y, 1.2 AS z FROM nation) SELECT id, value FROM p LEFT JOIN (SELECT * FROM g WHERE image = 7) g ON g.x = floor(p.x + 0.5) AND g.y = floor(p.y + 0.5) AND g.z = 1")
def value_at_points(spark, sf_dir):
    n = F.col("n_nationkey")
    p = table(spark, sf_dir, "nation").select(n.alias("id"), (n / 6.0).alias("x"), (n / 9.0).alias("y"), F.lit(1.2).alias("z"))
    return gr.value_at(cells(spark, sf_dir).where("image = 7"), p)


@query(f"{GRID}, d AS (SELECT unnest(range(-1, 2))::INT AS d) SELECT DISTINCT image, x + a.d AS x, y + b.d AS y, z + c.d AS z, 1.0 AS value FROM g, d a, d b, d c WHERE value > 0.2 AND image < 30")
def dilated_masks(spark, sf_dir):
    c = cells(spark, sf_dir).where("image < 30").withColumn("value", F.when(F.col("value") > 0.2, F.col("value")).otherwise(0.0))
    return gr.dilate(c)


@query(f"{GRID} SELECT image, x, y, z, value, CAST(dense_rank() OVER (ORDER BY image DESC) - 1 AS INTEGER) AS frame FROM g")
def stacked_frames(spark, sf_dir):
    return gr.stack(cells(spark, sf_dir).withColumn("k", -F.col("image")), "k").drop("k")


@query(f"""{GRID}, m AS (SELECT x, y, z FROM g WHERE image = 3 AND value > 0), p AS (SELECT n_nationkey AS id, n_nationkey / 5.0 AS a, 2.2 AS b, n_nationkey / 8.0 AS c FROM nation), d AS (SELECT id, x, y, z, round(pow(x - a, 2) + pow(y - b, 2) + pow(z - c, 2), 9) AS d FROM p, m)
 SELECT id, x, y, z, round(sqrt(d), 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, x, y, z) = 1""")
def nearest_mask_voxel(spark, sf_dir):
    n = F.col("n_nationkey")
    p = table(spark, sf_dir, "nation").select(n.alias("id"), (n / 5.0).alias("x"), F.lit(2.2).alias("y"), (n / 8.0).alias("z"))
    return rounded(gr.nearest_voxel(p, cells(spark, sf_dir).where("image = 3 and value > 0")), "distance")
