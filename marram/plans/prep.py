"""Queries on rows, names, strings and element-wise transforms, with SQL written from their definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.functions import distributions as dist
from marram.functions import strings as st
from marram.functions import transforms as tr
from marram.operators import filters as fl

from .registry import HOLES, IMG, chi2_p_sql, f_p_sql, holes, img, normal_p_sql, query, r6, rounded, t_p_sql, table

# --- filters (§2.4) ------------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN c_acctbal > 5000 THEN 'dropped' ELSE 'kept' END AS part, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal FROM customer) GROUP BY 1")
def split_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("x"))
    kept, dropped = fl.split_rows(c, "x", "above", 5000.0)
    return kept.select(F.lit("kept").alias("part")).unionByName(dropped.select(F.lit("dropped").alias("part"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, value FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 0 AND value IS NOT NULL")
def drop_missing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    return fl.drop_missing(e, ["value"])


@query("""WITH x AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'i' WHEN 2 THEN 'm' WHEN 3 THEN NULL ELSE 'v' END AS k, value FROM events), s AS (SELECT max(value) AS hi, min(value) AS lo FROM x WHERE k = 'v')
 SELECT event_id, CASE k WHEN 'i' THEN hi WHEN 'm' THEN lo WHEN 'v' THEN value ELSE 0.0 END AS value FROM x, s""")
def repair_special_values(spark, sf_dir):
    k = F.col("event_id") % 10
    x = F.when(k == 0, None).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 3, float("nan")).otherwise(F.col("value"))
    return fl.repair(table(spark, sf_dir, "events").select("event_id", x.alias("value")), "value")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN l_quantity ELSE 0.0 END AS above, CASE WHEN l_quantity <= 25 THEN l_quantity ELSE 0.0 END AS below,
 CASE WHEN l_quantity >= 10 AND l_quantity <= 20 THEN l_quantity ELSE 0.0 END AS inside, CASE WHEN l_quantity > 10 AND l_quantity < 20 THEN 0.0 ELSE l_quantity END AS outside FROM lineitem""")
def threshold_modes(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", fl.threshold(q, "keep_above", 25).alias("above"), fl.threshold(q, "keep_below", 25).alias("below"),
        fl.threshold(q, "keep_between", 20, 10).alias("inside"), fl.threshold(q, "exclude_between", 10, 20).alias("outside"),
    )


@query(f"{IMG}, c AS (SELECT subject, quantile_cont(value, 0.9) AS cut FROM img GROUP BY 1) SELECT subject, voxel, CASE WHEN value < cut THEN 0.0 ELSE value END AS value FROM img JOIN c USING (subject)")
def threshold_percentile(spark, sf_dir):
    return fl.matrix_threshold(img(spark, sf_dir), "percentile", 0.9).select("subject", "voxel", "value")


@query(f"{IMG} SELECT subject, voxel, CASE WHEN value < -0.2533471031357997 THEN 0.0 ELSE value END AS value FROM img")
def threshold_probability(spark, sf_dir):
    return fl.matrix_threshold(img(spark, sf_dir), "probability", 0.4).select("subject", "voxel", "value")


@query(f"{IMG}, o AS (SELECT voxel, avg(value) AS o FROM img WHERE outcome = 0 GROUP BY 1) SELECT subject, voxel, CASE WHEN value > o THEN value ELSE 0.0 END AS value FROM img JOIN o USING (voxel)")
def threshold_by_other(spark, sf_dir):
    i = img(spark, sf_dir)
    return fl.threshold_by(i, i.where("outcome = 0").groupBy("voxel").agg(F.avg("value").alias("value")), "greater").select("subject", "voxel", "value")


@query(f"{IMG}, m AS (SELECT voxel FROM img GROUP BY 1 HAVING avg(value) > 0) SELECT subject, voxel, value FROM img WHERE voxel IN (SELECT voxel FROM m)")
def mask_voxels(spark, sf_dir):
    i = img(spark, sf_dir)
    return fl.mask(i, i.groupBy("voxel").agg(F.avg("value").alias("value"))).select("subject", "voxel", "value")


@query(f"{HOLES} SELECT voxel FROM holes GROUP BY 1 HAVING sum(CASE WHEN value > 0.35 THEN value ELSE 0 END) > 0")
def data_driven_mask(spark, sf_dir):
    return fl.data_mask(holes(spark, sf_dir), 0.35)


@query(f"""{IMG}, m AS (SELECT voxel, avg(value) AS w FROM img GROUP BY 1), r AS (SELECT voxel, round(stddev_pop(value), 6) AS sd FROM img WHERE voxel IN (SELECT voxel FROM m WHERE w > 0) GROUP BY 1)
 SELECT m.voxel, coalesce(sd, 0.0) AS zero, sd AS empty, round(coalesce(sd, w), 6) + 0.0 AS own FROM m LEFT JOIN r USING (voxel)""")
def unmask_three_ways(spark, sf_dir):
    i = img(spark, sf_dir)
    m = i.groupBy("voxel").agg(F.avg("value").alias("value"))
    r = fl.mask(i, m).groupBy("voxel").agg(F.round(F.stddev_pop("value"), 6).alias("sd"))
    one = lambda fill, name: fl.unmask(r, m, "sd", fill).select("voxel", F.col("sd").alias(name))
    return rounded(one("zero", "zero").join(one("null", "empty"), "voxel").join(one("mask", "own"), "voxel"), "own")


@query(f"{IMG}, m AS (SELECT voxel, round(avg(value), 6) AS t, round(stddev_pop(value), 6) AS p FROM img GROUP BY 1) SELECT voxel, CASE WHEN p < 0.125 THEN t END AS t FROM m")
def significance_filter(spark, sf_dir):
    m = img(spark, sf_dir).groupBy("voxel").agg(F.round(F.avg("value"), 6).alias("t"), F.round(F.stddev_pop("value"), 6).alias("p"))
    return fl.significant(m, "t", "p", 0.125).select("voxel", "t")


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal_other FROM customer")
def copy_unless(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return fl.copy_unless(c, "c_acctbal", "_other", F.col("c_mktsegment") == "BUILDING").drop("c_mktsegment")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) WHERE n % 3 = 2")
def every_third_row(spark, sf_dir):
    return fl.every_nth(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 3, 1)


@query("SELECT c_custkey FROM customer ORDER BY md5('s1|' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 50")
def sample_rows(spark, sf_dir):
    return fl.sample(table(spark, sf_dir, "customer").select("c_custkey"), 50, "c_custkey", "s1")


@query("SELECT c_custkey, CASE WHEN c_acctbal <= (SELECT avg(c_acctbal) FROM customer) THEN 'low' ELSE 'high' END AS by_mean, CASE WHEN c_acctbal <= 1000 THEN 'low' ELSE 'high' END AS by_split FROM customer")
def saddle_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return fl.binarise_at_saddle(fl.binarise_at_saddle(c, "c_acctbal", "by_mean"), "c_acctbal", "by_split", 1000.0).drop("c_acctbal")


@query("SELECT p_partkey, regexp_replace(p_name || ' ' || CAST(p_size AS VARCHAR), '^.* ', '') AS last, lpad(CAST(p_size AS VARCHAR), 12, '0') AS key FROM part")
def natural_sort_key(spark, sf_dir):
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("last"), st.natural_key(size).alias("key"))


# --- names (§2.5) --------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS \"c_custkey\", c_acctbal AS \"acct_bal___\", c_nationkey AS \"var_1st_key\", c_name AS \"acct_bal____1\" FROM customer")
def clean_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("acct-bal (%"), F.col("c_nationkey").alias("1st key"), F.col("c_name").alias("acct bal (%"))
    return st.renamed(c, st.clean_name)


@query('SELECT c_custkey AS "c_custkey", c_acctbal AS "07", c_nationkey AS "x" FROM customer')
def splice_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("sub-07_ses"), F.col("c_nationkey").alias("mwp1x"))
    return st.renamed(c, lambda n: st.tissue_subject(st.splice(n, "sub-", "_ses")))


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS segment, dense_rank() OVER (ORDER BY f) - 1 AS seen FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS f FROM customer)")
def encode_labels(spark, sf_dir):
    from marram.operators import design

    c = table(spark, sf_dir, "customer")
    return design.factorize(design.ordinal_codes(c, "c_mktsegment", "segment"), "c_mktsegment", "seen", "c_custkey").select("c_custkey", "segment", "seen")


@query("SELECT event_id, TRY_CAST(v AS DOUBLE) AS num, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS code FROM (SELECT event_id, event_type, CAST(event_id AS VARCHAR) || '.5' AS v FROM events)")
def coerce_numeric(spark, sf_dir):
    from marram.operators import design

    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.col("event_id").cast("string"), F.lit(".5")).alias("num"), F.col("event_type").alias("code"))
    return design.numeric(e, ["num", "code"])


@query("""SELECT c_custkey, 1.0 AS "Intercept", c_acctbal, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS "c_mktsegment[T.BUILDING]", CAST(c_mktsegment = 'FURNITURE' AS DOUBLE) AS "c_mktsegment[T.FURNITURE]",
 CAST(c_mktsegment = 'HOUSEHOLD' AS DOUBLE) AS "c_mktsegment[T.HOUSEHOLD]", CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS "c_mktsegment[T.MACHINERY]", CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal * c_nationkey AS "c_acctbal:c_nationkey" FROM customer""")
def design_matrix(spark, sf_dir):
    from marram.operators import design

    c = table(spark, sf_dir, "customer")
    return design.matrix(c, "c_acctbal * c_nationkey + C(c_mktsegment)", keep=["c_custkey"])


@query("SELECT c_custkey, c_acctbal * c_nationkey AS \"c_acctbal:c_nationkey\", c_acctbal * c_custkey AS \"c_acctbal:c_custkey\", CAST(c_nationkey * c_custkey AS DOUBLE) AS \"c_nationkey:c_custkey\" FROM customer")
def interaction_columns(spark, sf_dir):
    from marram.operators import design

    return design.interactions(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey", "c_custkey"]).select("c_custkey", "`c_acctbal:c_nationkey`", "`c_acctbal:c_custkey`", "`c_nationkey:c_custkey`")


@query("SELECT r.i AS \"row\", c.j AS \"column\", CASE WHEN r.i = c.j THEN 1.0 WHEN c.j = 0 AND r.i > 0 THEN -1.0 ELSE 0.0 END AS weight FROM (SELECT unnest(range(4))::INT AS i) r, (SELECT unnest(range(4))::INT AS j) c")
def contrast_matrix(spark, sf_dir):
    from marram.operators import design

    return design.contrasts(spark, ["Intercept", "a", "b", "c"], against_intercept=True)


@query("""SELECT unnest(['y ~ a', 'y ~ b', 'y ~ c', 'y ~ a + b', 'y ~ a * b', 'y ~ a + c', 'y ~ a * c', 'y ~ b + c', 'y ~ b * c', 'y ~ a + b + c', 'y ~ a * b * c']) AS formula""")
def formula_enumeration(spark, sf_dir):
    from marram.operators import design

    return spark.createDataFrame([(f,) for f in design.formulas("y", ["a", "b", "c"])], "formula string")


# --- transforms (§2.6) ---------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, round(ln(1 + x), 6) + 0.0 AS log1p, round(sqrt(x), 6) + 0.0 AS sqrt, round(exp(x / 25.0), 6) + 0.0 AS exp, round(1 / x, 9) + 0.0 AS inverse, round(1 / (x + 1), 9) + 0.0 AS inverse1p, round(x * x, 3) AS square, round(x * x * x, 3) AS cube
 FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)""")
def scalar_functions(spark, sf_dir):
    x = F.col("p_size").cast("double")
    s = tr.SCALARS
    return table(spark, sf_dir, "part").select("p_partkey", *[r6(s[n](x)).alias(n) for n in ("log1p", "sqrt")], r6(s["exp"](x / 25)).alias("exp"), *[(F.round(s[n](x), 9) + 0.0).alias(n) for n in ("inverse", "inverse1p")], F.round(s["square"](x), 3).alias("square"), F.round(s["cube"](x), 3).alias("cube"))


@query("""SELECT c_custkey, round((pow(abs(c_acctbal) + 1, 0.3) - 1) / 0.3, 6) + 0.0 AS bc, round(ln(abs(c_acctbal) + 1), 6) + 0.0 AS bc0,
 round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.7) - 1) / 0.7 ELSE -(pow(1 - c_acctbal, 1.3) - 1) / 1.3 END, 5) + 0.0 AS yj FROM customer""")
def power_transforms(spark, sf_dir):
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", r6(tr.box_cox(F.abs(x), 0.3)).alias("bc"), r6(tr.box_cox(F.abs(x), 0.0)).alias("bc0"), (F.round(tr.yeo_johnson(x, 0.7), 5) + 0.0).alias("yj"))


@query("""WITH p AS (SELECT unnest(range(25)) * 0.25 - 3.0 AS power), x AS (SELECT p_retailprice AS x FROM part),
 y AS (SELECT power, CASE WHEN power = 0 THEN ln(1 + x) ELSE (pow(x + 1, power) - 1) / power END AS y, ln(1 + x) AS l FROM x, p),
 s AS (SELECT power, -count(*) / 2.0 * ln(var_pop(y)) + (power - 1) * sum(l) AS score FROM y GROUP BY 1) SELECT CAST(power AS DOUBLE) AS power FROM s ORDER BY score DESC LIMIT 1""")
def yeo_johnson_power(spark, sf_dir):
    return tr.yeo_johnson_power(table(spark, sf_dir, "part"), "p_retailprice").select("power")


@query("""SELECT c_custkey, round(-1 + 2 * (c_acctbal - lo) / (hi - lo), 6) + 0.0 AS wide, round((c_acctbal - rlo) / (rhi - rlo), 6) + 0.0 AS by_reference
 FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_nationkey) AS rlo, max(c_nationkey) AS rhi FROM customer)""")
def rescale_ranges(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return rounded(tr.rescale(tr.rescale(c, "c_acctbal", "wide", -1.0, 1.0), "c_acctbal", "by_reference", reference="c_nationkey").select("c_custkey", "wide", "by_reference"), "wide", "by_reference")


@query("""SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) + 0.0 AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def group_standardise(spark, sf_dir):
    return rounded(tr.standardise(table(spark, sf_dir, "customer"), "c_acctbal", "z", ["c_nationkey"]).select("c_custkey", "z"), "z")


@query(f"""{HOLES}, s AS (SELECT dataset, voxel, avg(value) AS m, stddev_pop(value) AS s FROM holes GROUP BY 1, 2)
 SELECT subject, voxel, round(CASE WHEN s <= 0.12 THEN value ELSE (value - m) / (s + 1e-8) END, 6) + 0.0 AS z FROM holes JOIN s USING (dataset, voxel)""")
def tensor_standardise(spark, sf_dir):
    return rounded(tr.standardise(holes(spark, sf_dir), "value", "z", ["dataset", "voxel"], guard=0.12).select("subject", "voxel", "z"), "z")


@query(f"{HOLES} SELECT subject, voxel, CASE WHEN value IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY dataset, voxel ORDER BY value NULLS LAST, subject) AS BIGINT) END AS k FROM holes")
def rank_across_subjects(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("dataset", "voxel").orderBy(F.col("value").asc_nulls_last(), "subject")
    return holes(spark, sf_dir).select("subject", "voxel", F.when(F.col("value").isNotNull(), F.row_number().over(w).cast("long")).alias("k"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS b, quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders)
 SELECT o_orderkey, round((o_totalprice - m) / (b - a), 6) + 0.0 AS robust, round(least(greatest(o_totalprice, lo), hi), 4) AS clipped FROM orders, q""")
def robust_and_clip(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(rounded(tr.clip(tr.robust(o, "o_totalprice", "robust"), "o_totalprice", "clipped").drop("o_totalprice"), "robust"), "clipped", digits=4)


@query("SELECT p_partkey, CAST(hi + lo - p_size AS BIGINT) AS around_range, CAST(hi - p_size AS BIGINT) AS around_max FROM part, (SELECT max(p_size) AS hi, min(p_size) AS lo FROM part)")
def invert_two_ways(spark, sf_dir):
    p = tr.invert(tr.invert(table(spark, sf_dir, "part"), "p_size", "around_range"), "p_size", "around_max", "max")
    return p.select("p_partkey", F.col("around_range").cast("long").alias("around_range"), F.col("around_max").cast("long").alias("around_max"))


@query("""WITH k AS (SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS k, count(*) OVER () AS n FROM part) SELECT p_partkey, CAST(k AS DOUBLE) AS k, round((k - 1) / (n - 1), 6) + 0.0 AS u FROM k""")
def quantile_transform(spark, sf_dir):
    p = tr.quantile_uniform(table(spark, sf_dir, "part"), "p_size", "u")
    return rounded(tr.ranks(p, "p_size", "k").select("p_partkey", "k", "u"), "u")


@query(f"""WITH x AS (SELECT n_nationkey, n_nationkey / 4.0 - 3 AS t, 5.0 + n_nationkey AS df FROM nation) SELECT n_nationkey, round({t_p_sql('t', 'df')}, 6) + 0.0 AS p, round({normal_p_sql('t')}, 6) + 0.0 AS p_normal, round(t, 6) + 0.0 AS z FROM x""")
def p_from_t_and_normal(spark, sf_dir):
    x = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") / 4.0 - 3).alias("t"), (F.col("n_nationkey") + 5.0).alias("df"))
    z = F.col("t")
    return x.select("n_nationkey", r6(dist.t_p(z, F.col("df"))).alias("p"), r6(2 * dist.normal_sf(F.abs(z))).alias("p_normal"), r6(dist.normal_ppf(dist.normal_cdf(z))).alias("z"))


@query(f"""WITH x AS (SELECT n_nationkey, 0.1 + n_nationkey / 6.0 AS f, 1.0 + n_nationkey % 5 AS a, 4.0 + n_nationkey AS b FROM nation) SELECT n_nationkey, round({f_p_sql('f', 'a', 'b')}, 6) + 0.0 AS pf, round({chi2_p_sql('4 * f', 'a')}, 6) + 0.0 AS pc FROM x""")
def p_from_f_and_chi2(spark, sf_dir):
    n = F.col("n_nationkey")
    x = table(spark, sf_dir, "nation").select("n_nationkey", (0.1 + n / 6.0).alias("f"), (1.0 + n % 5).alias("a"), (4.0 + n).alias("b"))
    return x.select("n_nationkey", r6(dist.f_p(F.col("f"), F.col("a"), F.col("b"))).alias("pf"), r6(dist.chi2_p(4 * F.col("f"), F.col("a"))).alias("pc"))


@query(f"""WITH x AS (SELECT n_nationkey, n_nationkey / 5.0 + 0.2 AS z FROM nation), p AS (SELECT n_nationkey, z, {normal_p_sql('z')} / 2 AS p FROM x) SELECT n_nationkey, round(z, 5) + 0.0 AS z FROM p""")
def z_from_p(spark, sf_dir):
    z = F.col("n_nationkey") / 5.0 + 0.2
    return table(spark, sf_dir, "nation").select("n_nationkey", (F.round(dist.p_to_z(dist.normal_sf(z)), 5) + 0.0).alias("z"))


@query(f"""WITH x AS (SELECT n_nationkey, n_nationkey / 4.0 - 3 AS t, 9.0 AS df FROM nation) SELECT n_nationkey, round({t_p_sql('t', 'df')}, 6) + 0.0 AS p, CAST(sign(t) AS DOUBLE) AS s FROM x""")
def z_from_t(spark, sf_dir):
    t = F.col("n_nationkey") / 4.0 - 3
    z = dist.t_to_z(t, F.lit(9.0))
    return table(spark, sf_dir, "nation").select("n_nationkey", r6(2 * dist.normal_sf(F.abs(z))).alias("p"), F.signum(z).alias("s"))


@query("""WITH x AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings)
 SELECT vec_id, round(0.99 * x, 6) + 0.0 AS tx, round(CASE WHEN z < 0 THEN 0.9688 * y + 0.042 * z ELSE 0.9688 * y + 0.046 * z END, 6) + 0.0 AS ty, round(CASE WHEN z < 0 THEN -0.0485 * y + 0.839 * z ELSE -0.0485 * y + 0.9189 * z END, 6) + 0.0 AS tz FROM x""")
def mni_to_talairach(spark, sf_dir):
    x, y, z = [F.element_at("embedding", i).cast("double") * 100 for i in (1, 2, 3)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *[r6(c).alias(n) for c, n in zip(tr.mni_to_talairach(x, y, z), ("tx", "ty", "tz"), strict=True)])


@query("""WITH x AS (SELECT p_partkey, p_partkey % 91 AS i, p_partkey % 113 AS j, p_size AS k FROM part)
 SELECT p_partkey, CASE WHEN j < 109 THEN (i * 109 + j) * 91 + k END AS flat, CAST(90 - 2 * i AS DOUBLE) AS wx, CAST(-126 + 2 * j AS DOUBLE) AS wy, CAST(-72 + 2 * k AS DOUBLE) AS wz, i AS i2, j AS j2, CAST(k AS BIGINT) AS k2 FROM x""")
def voxel_world_ravel(spark, sf_dir):
    rows = ((-2, 0, 0, 90), (0, 2, 0, -126), (0, 0, 2, -72))
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 91).alias("i"), (F.col("p_partkey") % 113).alias("j"), F.col("p_size").cast("long").alias("k"))
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    world = p.select("p_partkey", tr.ravel((91, 109, 91), i, j, k).alias("flat"), *[c.alias(n) for c, n in zip(tr.voxel_to_world(rows, i, j, k), ("wx", "wy", "wz"), strict=True)])
    back = tr.world_to_voxel(rows, F.col("wx"), F.col("wy"), F.col("wz"))
    return world.select("*", *[c.alias(n) for c, n in zip(back, ("i2", "j2", "k2"), strict=True)])


@query("""SELECT vec_id, round(sin(t) * cos(p), 6) + 0.0 AS sx, round(cos(t), 6) + 0.0 AS sz, round((2 + cos(t)) * cos(p), 6) + 0.0 AS ux, round(sin(t), 6) + 0.0 AS uz, round(cos(p), 6) + 0.0 AS cx, round(sin(p), 6) + 0.0 AS cy FROM (SELECT vec_id, embedding[1]::DOUBLE * 3 AS t, embedding[2]::DOUBLE * 3 AS p FROM embeddings)""")
def manifold_projections(spark, sf_dir):
    t, p = [F.element_at("embedding", i).cast("double") * 3 for i in (1, 2)]
    s, u, c = tr.on_sphere(t, p), tr.on_torus(t, p), tr.on_circle(p)
    return table(spark, sf_dir, "embeddings").select("vec_id", *[r6(v).alias(n) for v, n in ((s[0], "sx"), (s[2], "sz"), (u[0], "ux"), (u[2], "uz"), (c[0], "cx"), (c[1], "cy"))])


@query("""SELECT p_partkey, round(p_size * 60.0 / 1000, 6) AS charge, round(p_retailprice / p_size, 6) AS amps, round(pow(p_size * 3 / (4 * pi()), 1.0 / 3), 6) AS radius, round(2 * pi() * 0.7 * p_size, 6) AS area,
 p_size * 60.0 / 1000 / 0.06 <= 30 AS allowed, round((p_retailprice - p_size) / (p_retailprice + p_size), 6) AS score FROM part""")
def stimulation_units(spark, sf_dir):
    s, v = F.col("p_size").cast("double"), F.col("p_retailprice")
    q = tr.charge(s, F.lit(60.0))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", q.alias("charge"), tr.amperage(v, s).alias("amps"), tr.sphere_radius(s).alias("radius"), tr.cylinder_area(F.lit(0.7), s).alias("area"), tr.within_charge_density(q, F.lit(0.06)).alias("allowed"), tr.goodness(s, v).alias("score")), "charge", "amps", "radius", "area", "score")


# --- strings (§2.7) ------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CAST(array_to_string(regexp_extract_all(p, '\\d+'), ',') AS VARCHAR) AS digits, event_id + 0.5 AS x, -(event_id + 0.25) AS y, CAST(user_id AS VARCHAR) AS subject, 'anat' AS part, 'sub-' || user_id || '_T1' AS stem, event_type AS side_free, CASE event_id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' END AS side
 FROM (SELECT *, '/data/sub-' || user_id || '/anat/sub-' || user_id || '_' || event_id || '.5_-' || event_id || '.25_3.0_T1.nii.gz' AS p FROM events)""")
def path_functions(spark, sf_dir):
    user, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    path = F.concat(F.lit("/data/sub-"), user, F.lit("/anat/sub-"), user, F.lit("_"), e, F.lit(".5_-"), e, F.lit(".25_3.0_T1.nii.gz"))
    label = F.concat(F.when(F.col("event_id") % 3 == 0, "left_").when(F.col("event_id") % 3 == 1, "R_").otherwise(""), F.col("event_type"))
    x, y, _ = st.xyz(path)
    short = F.concat(F.lit("/a/sub-"), user, F.lit("_T1.nii.gz"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(st.digit_runs(path), ",").alias("digits"), x.alias("x"), y.alias("y"), st.between(path, "sub-", "/").alias("subject"),
        st.path_part(path, -2).alias("part"), st.stem(short).alias("stem"), st.without_side(label).alias("side_free"), st.side(label).alias("side"),
    )


@query("SELECT c_custkey, c_mktsegment AS inner_part, CASE WHEN c_custkey % 2 = 0 THEN 'a_' || c_nationkey ELSE 'plain' END AS shorter, CAST(c_nationkey AS VARCHAR) AS tail, lower(c_mktsegment) AS tidy FROM customer")
def label_functions(spark, sf_dir):
    n = F.col("c_nationkey").cast("string")
    token = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("a_"), n, F.lit("_x"))).otherwise("plain")
    return table(spark, sf_dir, "customer").select("c_custkey", st.in_parentheses(F.concat(F.lit("x ("), F.col("c_mktsegment"), F.lit(") y"))).alias("inner_part"), st.drop_last_token(token).alias("shorter"), st.after(F.concat(F.lit("id="), n), "=").alias("tail"), st.tidy(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))).alias("tidy"))


@query("SELECT n_nationkey, r_name AS shared FROM nation JOIN region ON n_regionkey = r_regionkey")
def shared_substrings(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", st.shared_substring(F.concat(F.lit("1"), F.col("r_name"), F.lit("2")), F.concat(F.lit("3"), F.col("r_name"), F.lit("4"))).alias("shared"))


@query("SELECT c_custkey, p AS part FROM (SELECT c_custkey, unnest([CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS p FROM customer)")
def split_list_cell(spark, sf_dir):
    cell = F.concat(F.col("c_nationkey").cast("string"), F.lit(" ; ;"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(st.list_cell(cell)).alias("part"))


@query("SELECT vec_id, CAST(label AS DOUBLE) AS x, 2.5 AS y, CAST(vec_id AS DOUBLE) AS z FROM embeddings WHERE vec_id % 2 = 0")
def literal_triplets(spark, sf_dir):
    text = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("[["), F.col("label").cast("string"), F.lit(", 2.5, "), F.col("vec_id").cast("string"), F.lit("]]"))).otherwise("[1, 2]")
    got = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(st.triplets(text)).alias("t"))
    return got.select("vec_id", *[F.col("t")[i].alias(n) for i, n in enumerate("xyz")])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1995-06-17')) END AS gap FROM orders")
def day_gaps(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 4 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", st.day_gap(text, F.lit("1995-06-17"), "yyyy-MM-dd").cast("long").alias("gap"))


@query("SELECT vec_id, round((e[1] + e[3]) / 2, 6) + 0.0 AS first_mean, e[2] AS second, CAST(2 AS INTEGER) AS kept, round(list_inner_product(e, f), 6) + 0.0 AS dot, round(list_cosine_similarity(e, f), 6) + 0.0 AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_reverse(embedding::DOUBLE[]) AS f FROM embeddings)")
def vector_functions(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    picked = st.pick(e, [0, 1, 900])
    mean = st.vector("mean2", e, F.slice(e, 3, 64 - 2))
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(mean[0]).alias("first_mean"), picked[1].alias("second"), F.size(picked).alias("kept"), r6(st.vector("dot", e, F.reverse(e))).alias("dot"), r6(st.vector("cosine", e, F.reverse(e))).alias("cosine"))


@query("SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def json_property(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", st.json_number(F.col("props"), "k").alias("k"))
