"""Edge cases on tables made by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.functions.columns import average_rank, clean, cosine, pearson
from marram.operators import maps, relational, resampling, similarity


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(pearson("x", "y")).first()[0] is None


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0)], "id int, v double").withColumn("k", average_rank("v"))
    assert [r["k"] for r in df.orderBy("id").collect()] == [1.5, 1.5, 3.0]


def test_clean_makes_nan_and_infinity_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,)], "v double")
    assert sorted([r[0] for r in df.select(clean(F.col("v"))).collect()], key=str) == [2.0, None, None]


def test_nearest_takes_the_earlier_on_a_tie_and_keeps_the_lonely(spark):
    day = dt.datetime(2020, 1, 2)
    left = spark.createDataFrame([(1, "a", day), (2, "b", day)], "id int, key string, ts timestamp")
    right = spark.createDataFrame([("a", day - dt.timedelta(1)), ("a", day + dt.timedelta(1))], "key string, visit timestamp")
    got = {r["id"]: r["visit"] for r in relational.nearest(left, right, "key", "ts", "visit", "id").collect()}
    assert got == {1: day - dt.timedelta(1), 2: None}


def test_two_empty_masks_agree_fully(spark):
    masks = spark.createDataFrame([(1, 0, False), (2, 0, False), (3, 0, True)], "id int, voxel int, on boolean")
    got = {(r["a"], r["b"]): r["dice"] for r in maps.dice_pairs(masks).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.0, (2, 3): 0.0}


def test_permutations_stay_in_their_block(spark):
    people = spark.createDataFrame([(s, s % 2, float(s)) for s in range(6)], "subject int, block int, y double")
    for r in resampling.shuffled(people, 5, "block", "y", "s").groupBy("rep", "block").agg(F.collect_set("y").alias("v")).collect():
        assert set(r["v"]) == {float(s) for s in range(6) if s % 2 == r["block"]}


def test_opposite_signs_cancel(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, -1.0)], "dataset int, voxel int, value double")
    r = maps.signed_overlap(df, 0.5).first()
    assert (r["overlap"], r["sensitivity"], r["n"]) == (0, 1, 2)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bootstrap_draws_are_dealt_and_the_same_either_way(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i)) for i in range(40)], "k long, v double")
    few = resampling.bootstrap(df, "k", 3, "s")
    plan = few._jdf.queryExecution().toString()
    assert "Range (0, 120" in plan and "explode" not in plan
    monkeypatch.setattr(resampling, "FEW", 0)
    assert sorted(few.collect()) == sorted(resampling.bootstrap(df, "k", 3, "s").collect()) and few.count() == 120
    assert resampling.bootstrap(df.limit(0), "k", 3, "s").count() == 0


@pytest.mark.parametrize("strip", [(16_384, 512), (20, 512)])
def test_distance_correlation_makes_no_pairs(spark, monkeypatch, strip):
    monkeypatch.setattr(similarity, "STRIP", strip)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, 150).astype(float)
    y = np.round(x * x + rng.normal(size=150), 1)
    a, b = (np.abs(v[:, None] - v[None, :]) for v in (x, y))
    a, b = (d - d.mean(0)[None, :] - d.mean(1)[:, None] + d.mean() for d in (a, b))
    want = np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))
    df = spark.createDataFrame([(i, float(u), float(v)) for i, (u, v) in enumerate(zip(x, y))] + [(999, None, 1.0)], "k long, x double, y double")
    got = similarity.distance_correlation(df, "x", "y", "k")
    plan = got._jdf.queryExecution().toString()
    assert abs(got.first()[0] - want) < 1e-9 and "Join Cross" not in plan and "CartesianProduct" not in plan
    assert similarity.distance_correlation(df.withColumn("y", F.lit(0.1)), "x", "y", "k").first()[0] is None
    assert similarity.distance_correlation(df.limit(0), "x", "y", "k").first()[0] is None


@pytest.mark.parametrize("tile", [(4096, 2_000_000), (7, 2_000_000), (4096, 50)])
def test_image_cosines_meet_by_blocks(spark, monkeypatch, tile):
    monkeypatch.setattr(similarity, "TILE", tile)
    monkeypatch.setattr(similarity, "CHUNK", 30)
    rng = np.random.default_rng(6)
    rows = [(s, v, None if rng.random() < 0.1 else float(rng.normal())) for s in range(40) for v in range(int(rng.integers(2, 9)))]
    rows += [(3, 1, 0.5), (3, 1, 2.0), (50, 99, 1.0), (51, 0, 0.0)]  # repeats, a voxel of its own, a zero image
    images = spark.createDataFrame(rows, "subject long, voxel int, value double")
    left = images.select(F.col("subject").alias("a"), "voxel", F.col("value").alias("x"))
    right = images.select(F.col("subject").alias("b"), "voxel", F.col("value").alias("y"))
    for other, rule in ((None, "a < b"), (images.where("subject < 20"), "b < 20")):
        want = left.join(right, "voxel").where(rule).groupBy("a", "b").agg(cosine("x", "y").alias("c"))
        got = similarity.image_cosines(images, other)
        plan = got._jdf.queryExecution().toString()
        assert "Join" not in plan
        flat = lambda df: {(r[0], r[1]): r[2] for r in df.collect()}
        one, two = flat(got), flat(want)
        assert one.keys() == two.keys() and got.count() == len(one)
        assert all((one[k] is None) == (c is None) and (c is None or abs(one[k] - c) < 1e-12) for k, c in two.items())
        m = similarity.image_cosine_moments(images, other).first()
        known = [c for c in two.values() if c is not None]
        assert m["n"] == len(known) and np.allclose([m["mean"], m["var"]], [np.mean(known), np.var(known, ddof=1)])
