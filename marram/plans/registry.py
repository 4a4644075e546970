"""Where queries and their SQL are put, and what they share."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marram.functions.columns import r6
from marram.sources.tables import images, table

QUERIES: dict = {}
ORACLES: dict = {}

IMG = """WITH img AS (SELECT CAST(vec_id % 3 AS INTEGER) AS dataset, vec_id AS subject, CAST(label AS DOUBLE) AS outcome,
 CAST(unnest(range(0, len(embedding))) AS INTEGER) AS voxel, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
#: The same images with a null in every eleventh place.
HOLES = IMG + ", holes AS (SELECT dataset, subject, outcome, voxel, CASE WHEN (subject * 5 + voxel) % 11 <> 0 THEN value END AS value FROM img)"
R = "CASE WHEN stddev_pop({0}) > 1e-12 AND stddev_pop({1}) > 1e-12 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def declared(name: str, sql: str) -> None:
    """One SQL text for both engines; {table} names a table."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    QUERIES[name] = lambda spark, sf_dir: spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", sql)


def img(spark, sf_dir):
    return images(table(spark, sf_dir, "embeddings"))


def holes(spark, sf_dir):
    return img(spark, sf_dir).withColumn("value", F.when((F.col("subject") * 5 + F.col("voxel")) % 11 != 0, F.col("value")))


def rounded(df, *columns, digits: int = 6):
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def integral(density: str, top: str, steps: int = 2000) -> str:
    """SQL for Simpson's rule over u from 0 to top; density is an expression in u."""
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    f = density.replace("{u}", f"(({top}) * i / {steps}.0)")
    return f"(SELECT sum({weight} * ({f})) * ({top}) / {3 * steps}.0 FROM (SELECT CAST(unnest(range({steps + 1})) AS DOUBLE) AS i))"


def t_p_sql(t: str, df: str) -> str:
    front = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    return f"(1 - 2 * {front} * " + integral(f"pow(1 + {{u}} * {{u}} / ({df}), -(({df}) + 1) / 2.0)", f"abs({t})") + ")"


def f_p_sql(f: str, d1: str, d2: str) -> str:
    front = f"ln(2) + lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0) + ({d1}) / 2.0 * ln({d1}) + ({d2}) / 2.0 * ln({d2})"
    density = f"CASE WHEN i = 0 THEN CASE WHEN ({d1}) = 1 THEN exp({front} - (({d1}) + ({d2})) / 2.0 * ln({d2})) ELSE 0 END ELSE exp({front} + (({d1}) - 1) * ln(greatest(1e-300, {{u}})) - (({d1}) + ({d2})) / 2.0 * ln(({d2}) + ({d1}) * {{u}} * {{u}})) END"
    return "(1 - " + integral(density, f"sqrt({f})") + ")"


def chi2_p_sql(x: str, k: str) -> str:
    front = f"2 * exp(-lgamma(({k}) / 2.0) - ({k}) / 2.0 * ln(2))"
    return f"(1 - {front} * " + integral(f"pow({{u}}, ({k}) - 1) * exp(-{{u}} * {{u}} / 2)", f"sqrt({x})") + ")"


def normal_p_sql(z: str) -> str:
    """Two-sided."""
    return "(1 - sqrt(2 / pi()) * " + integral("exp(-{u} * {u} / 2)", f"abs({z})") + ")"


__all__ = ["HOLES", "IMG", "ORACLES", "QUERIES", "R", "chi2_p_sql", "declared", "f_p_sql", "holes", "img", "images", "integral", "normal_p_sql", "query", "r6", "rounded", "t_p_sql", "table"]
