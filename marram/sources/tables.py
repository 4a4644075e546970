"""Sources: Parquet and CSV tables, JSON arrays, and images as long tables of (subject, voxel, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marram.functions.columns import clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def path_table(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """One row per file whose name matches the pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def images(vectors: DataFrame, datasets: int = 3) -> DataFrame:
    """Long images: dataset, subject, outcome, voxel (from 0), value as double with null for NaN and infinity."""
    return vectors.select(
        (F.col("vec_id") % datasets).cast("int").alias("dataset"), F.col("vec_id").alias("subject"), F.col("label").cast("double").alias("outcome"), F.posexplode("embedding").alias("voxel", "value")
    ).withColumn("value", clean(F.col("value").cast("double")))


def json_numbers(column: str) -> Column:
    """A JSON list as array<double>; null if it is none."""
    return F.from_json(column, "array<double>")
