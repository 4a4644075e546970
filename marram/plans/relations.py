"""Queries of joins, reshapes and partitions that the table catalogue does not declare."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.functions.columns import r6
from marram.operators import relational as rl

from .registry import IMG, img, query, rounded, table


@query("SELECT coalesce(c_nationkey, s_nationkey) AS k, c_acctbal AS bal, s_acctbal AS bal_2, n FROM (SELECT c_nationkey, round(sum(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, round(sum(s_acctbal), 2) AS s_acctbal, count(*) AS n FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def outer_merge_suffixed(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("bal"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.sum("s_acctbal"), 2).alias("bal"), F.count(F.lit(1)).alias("n"))
    return rl.merge_suffixed(a, b, "k")


@query("SELECT c_nationkey AS k, min(c_custkey) AS first FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY 1")
def align_first_rows(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("first"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("first"))
    return rl.align([a, b], "k", "first")[0]


@query(f"{IMG} SELECT subject, voxel, value, c_acctbal FROM img JOIN customer ON subject = c_custkey WHERE c_nationkey < 5")
def align_subject_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("subject"), "c_acctbal")
    return rl.align_images(img(spark, sf_dir).select("subject", "voxel", "value"), c.unionByName(c))


@query("SELECT n_nationkey, r_regionkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) FULL JOIN (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)")
def positional_hstack(spark, sf_dir):
    return rl.hstack(table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "region").select("r_regionkey"), "n_nationkey", "r_regionkey")


@query("SELECT n_name, r_name FROM nation, region")
def cartesian_pairs(spark, sf_dir):
    return rl.cartesian(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"))


@query("""WITH s AS (SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS subject FROM nation), p AS (SELECT '/d/sub-' || CASE WHEN n_nationkey % 3 = 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 4, '0') ELSE CAST(n_nationkey AS VARCHAR) END || '_' || n_name || '.nii' AS path FROM nation WHERE n_nationkey % 5 <> 0),
 m AS (SELECT subject, path, CASE WHEN regexp_matches(path, 'sub-' || subject || '([^0-9]|$)') THEN 0 WHEN regexp_matches(path, 'sub-0*' || subject || '([^0-9]|$)') THEN 1 WHEN contains(path, subject) THEN 2 END AS pass FROM s, p)
 SELECT s.subject, path FROM s LEFT JOIN (SELECT * FROM m WHERE pass IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject ORDER BY pass, path) = 1) USING (subject)""")
def fuzzy_path_match(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    label = F.when(F.col("n_nationkey") % 3 == 0, F.lpad(k, 4, "0")).otherwise(k)
    paths = n.where("n_nationkey % 5 <> 0").select(F.concat(F.lit("/d/sub-"), label, F.lit("_"), F.col("n_name"), F.lit(".nii")).alias("path"))
    return rl.match_paths(paths, n.select(F.col("n_nationkey").alias("subject")))


@query("WITH n AS (SELECT CAST(n_nationkey AS VARCHAR) AS name FROM nation) SELECT x.name AS a, min(y.name) AS b FROM n x JOIN n y ON x.name < y.name AND (contains(x.name, y.name) OR contains(y.name, x.name)) GROUP BY 1")
def stem_containment(spark, sf_dir):
    return rl.stem_pairs(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name")))


@query("SELECT held, count(*) AS n, round(avg(c_acctbal), 4) AS m FROM customer JOIN (SELECT DISTINCT c_mktsegment AS held FROM customer) ON c_mktsegment <> held GROUP BY 1")
def leave_fold_out(spark, sf_dir):
    f = rl.folds(table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal"), "c_mktsegment")
    return rounded(f.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m")), "m", digits=4)


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_contacts(spark, sf_dir):
    return rl.top_k(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], "c_acctbal", 3, "c_custkey")


@query("""WITH p AS (SELECT o_orderstatus AS s, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS position FROM orders) SELECT CAST(position AS INTEGER) AS position, max(v) FILTER (s = 'F') AS "F", max(v) FILTER (s = 'O') AS "O", max(v) FILTER (s = 'P') AS "P" FROM p GROUP BY 1""")
def pivot_padded(spark, sf_dir):
    return rl.pivot_padded(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "o_orderkey", ["F", "O", "P"])


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS from_one, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS from_zero FROM orders")
def ordinal_ranks(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", k.alias("from_one"), (k - 1).alias("from_zero"))


@query("SELECT c_mktsegment, round(median(c_acctbal), 4) AS m, row_number() OVER (ORDER BY median(c_acctbal) DESC) AS place FROM customer GROUP BY 1")
def order_by_median(spark, sf_dir):
    from pyspark.sql import Window

    g = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("m"))
    return g.select("c_mktsegment", F.round("m", 4).alias("m"), F.row_number().over(Window.orderBy(F.desc("m"))).alias("place"))


@query("SELECT k, round(sum(v), 4) AS total FROM (SELECT CASE WHEN event_id % 6 <> 0 THEN event_type END AS k, value AS v FROM events) GROUP BY 1")
def sum_by_label_with_null(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 6 != 0, F.col("event_type")).alias("k"), "value")
    return e.groupBy("k").agg((F.round(F.sum("value"), 4)).alias("total"))


@query(f"{IMG} SELECT voxel, round(sum(value), 6) + 0.0 AS total FROM img GROUP BY 1")
def sum_of_images(spark, sf_dir):
    return img(spark, sf_dir).groupBy("voxel").agg(r6(F.sum("value")).alias("total"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(corr(value, event_id % 17), 5) + 0.0 AS r, round(regr_slope(event_id % 17, value), 5) + 0.0 AS slope FROM events GROUP BY 1, 2 HAVING count(*) > 2")
def windowed_moments(spark, sf_dir):
    from marram.streaming import moments as mo

    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 17)
    got = mo.statistics(mo.moments(e, "ts", "event_type", "value", "k")).where("n > 2")
    return rounded(got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "r", "slope"), "r", "slope", digits=5)
