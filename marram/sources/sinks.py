"""Sinks: CSV, JSON, partitioned trees, and image files. Image files are written one per group where its rows are."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.strings import clean_name

from .volumes import write_nifti


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def csv_set(parts: dict[str, list[DataFrame]], folder: str) -> list[str]:
    """Numbered CSV folders by role (outcome, covariate, voxelwise); their paths."""
    out = []
    for role, tables in parts.items():
        for i, df in enumerate(tables):
            csv(df, f"{folder}/{role}_{i}")
            out.append(f"{folder}/{role}_{i}")
    return out


def metadata(df: DataFrame, folder: str) -> None:
    csv(df, f"{folder}/metadata")


def json_lists(df: DataFrame, values: str, out: str) -> DataFrame:
    """The list column as JSON text beside the others."""
    return df.withColumn(out, F.to_json(values))


def bids(images: DataFrame, folder: str, subject: Column, session: Column, analysis: Column) -> None:
    """Parquet under sub=/ses=/analysis=."""
    images.select(subject.alias("sub"), session.alias("ses"), analysis.alias("analysis"), "voxel", "value").write.mode("overwrite").partitionBy("sub", "ses", "analysis").parquet(folder)


def result_maps(results: DataFrame, folder: str, alpha: float = 0.05) -> None:
    """(stat, voxel, value): estimate, t, r2, and t where p < alpha, of a regression's voxels, partitioned by stat."""
    cells = [F.struct(F.lit(s).alias("stat"), v.cast("double").alias("value")) for s, v in (("beta", F.col("estimate")), ("t", F.col("t")), ("r2", F.col("r2")), ("fwe", F.when(F.col("p") < alpha, F.col("t"))))]
    results.select("voxel", F.explode(F.array(*cells)).alias("c")).select("c.stat", "voxel", "c.value").write.mode("overwrite").partitionBy("stat").parquet(folder)


def nifti(images: DataFrame, name: str, shape: tuple[int, ...], affine: np.ndarray) -> DataFrame:
    """(name, content): one NIfTI file per value of the name column, its name cleaned; voxels without a row are 0.

    The rows of one image must fit one task. Write the result as binary, or save it with ``save``.
    """
    size = int(np.prod(shape))

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        flat = np.zeros(size)
        flat[frame["voxel"].to_numpy()] = np.nan_to_num(frame["value"].to_numpy(float))
        return pd.DataFrame({"name": [clean_name(key[0])], "content": [write_nifti(flat.reshape(shape), affine)]})

    return images.select(F.col(name).cast("string").alias("name"), "voxel", "value").groupBy("name").applyInPandas(build, "name string, content binary")


def nifti_stack(images: DataFrame, shape: tuple[int, int, int], affine: np.ndarray) -> DataFrame:
    """(name, content): all frames (frame, voxel, value) as one four-dimensional file."""
    frames = images.agg(F.max("frame")).first()[0] + 1
    flat = images.select(F.lit("stack").alias("name"), (F.col("voxel") * frames + F.col("frame")).alias("voxel"), "value")
    return nifti(flat, "name", (*shape, frames), affine)


def save(built: DataFrame, folder: str, suffix: str = ".nii.gz") -> None:
    """Writes each (name, content) as a file of a folder that all executors share, from the task that holds it."""
    import os

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        for frame in batches:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                part = f"{folder}/.{name}{suffix}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, f"{folder}/{name}{suffix}")  # a task that is run again leaves one whole file
            yield pd.DataFrame({"name": frame["name"]})

    built.mapInPandas(write, "name string").count()


def manifest(spark, folder: str) -> DataFrame:
    """A written study: (dataset, files) from its partitions."""
    return spark.read.parquet(folder).groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))


def as_json(rows: list) -> str:
    return json.dumps(rows)
