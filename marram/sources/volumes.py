"""Image files as long tables: NIfTI-1 (.nii, .nii.gz), NPY and GIFTI, read by Spark and decoded where they lie.

Formats are public: a 348-byte NIfTI-1 header with its voxels after it, the NPY header, GIFTI's XML with base64 data.
A file is one row of ``binaryFile``; each becomes (path, voxel, value) rows, or one header row of shape and affine.
"""

from __future__ import annotations

import base64
import gzip
import io
import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions import strings as st
from marram.functions.columns import clean
from marram.operators import relational

#: NIfTI-1 data type codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: GIFTI data type names.
GIFTI_TYPES = {"NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8"}
SUFFIXES = {"nifti": (".nii", ".nii.gz"), "npy": (".npy",), "gifti": (".gii", ".gii.gz")}


def plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_nifti(data: bytes) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """Shape, affine (4 x 4), and the voxels in row-major order of (i, j, k, frame)."""
    data = plain(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", data[:4])[0] != 348:
        raise ValueError("no NIfTI-1 header")
    dim = struct.unpack(order + "8h", data[40:56])
    code = struct.unpack(order + "h", data[70:72])[0]
    pixdim = struct.unpack(order + "8f", data[76:108])
    at = int(struct.unpack(order + "f", data[108:112])[0])
    slope, shift = struct.unpack(order + "2f", data[112:120])
    sform = struct.unpack(order + "h", data[254:256])[0]
    shape = tuple(dim[1 : 1 + dim[0]])
    values = np.frombuffer(data, np.dtype(order + NIFTI_TYPES[code]), int(np.prod(shape)), at).reshape(shape, order="F").astype(float)
    if slope not in (0.0, 1.0) or (slope and shift):
        values = values * slope + shift
    affine = np.eye(4)
    if sform > 0:
        affine[:3] = np.array(struct.unpack(order + "12f", data[280:328])).reshape(3, 4)
    else:
        affine[:3, :3] = np.diag(pixdim[1:4])
    return shape, affine, values.ravel()


def write_nifti(values: np.ndarray, affine: np.ndarray, compressed: bool = True) -> bytes:
    """A float64 NIfTI-1 file of the array."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1.0, *np.sqrt((affine[:3, :3] ** 2).sum(axis=0)), 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    data = bytes(head) + np.asarray(values, "<f8").tobytes(order="F")
    return gzip.compress(data, mtime=0) if compressed else data


def read_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False).astype(float)


def read_gifti(data: bytes) -> np.ndarray:
    """The first data array."""
    item = ET.fromstring(plain(data)).find("DataArray")
    kind, text = GIFTI_TYPES[item.get("DataType")], item.findtext("Data") or ""
    if item.get("Encoding") == "ASCII":
        return np.array(text.split(), float)
    raw = base64.b64decode(text)
    raw = zlib.decompress(raw) if item.get("Encoding") == "GZipBase64Binary" else raw
    return np.frombuffer(raw, ("<" if item.get("Endian") != "BigEndian" else ">") + kind).astype(float)


def format_of(path: Column) -> Column:
    out = F
    for name, endings in SUFFIXES.items():
        for e in endings:
            out = out.when(F.endswith(F.lower(path), F.lit(e)), name)
    return out


def files(spark: SparkSession, folders: dict[str, str] | str) -> DataFrame:
    """path, length, content of the files of {folder: pattern}, or of one folder."""
    some = folders if isinstance(folders, dict) else {folders: "*"}
    out = None
    for folder, pattern in some.items():
        one = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")
        out = one if out is None else out.unionByName(one)
    return out


def paths(spark: SparkSession, folders: dict[str, str] | str) -> DataFrame:
    """The path table of the folders; contents are not read."""
    return files(spark, folders).select("path", "length")


def decode(found: DataFrame) -> DataFrame:
    """(path, column, voxel, value) of all files by their suffix; other files are left out. NaN and infinity are null.

    NPY arrays of two axes are observations by voxels: ``column`` tells the observation, as frames of a NIfTI do.
    """

    def run(batches):
        for frame in batches:
            for path, kind, content in zip(frame["path"], frame["kind"], frame["content"], strict=True):
                if kind == "nifti":
                    shape, _, flat = read_nifti(content)
                    values = flat.reshape(-1, shape[3]).T if len(shape) > 3 else flat[None, :]
                elif kind == "npy":
                    values = np.atleast_2d(read_npy(content))
                else:
                    values = np.atleast_2d(read_gifti(content))
                for c, row in enumerate(values):
                    yield pd.DataFrame({"path": path, "column": c, "voxel": np.arange(len(row)), "value": row})

    known = found.withColumn("kind", format_of(F.col("path"))).where("kind is not null").select("path", "kind", "content")
    return known.mapInPandas(run, "path string, column int, voxel int, value double").withColumn("value", clean(F.col("value")))


def headers(found: DataFrame) -> DataFrame:
    """(path, shape, affine) of the NIfTI files; the affine row by row."""

    def run(batches):
        for frame in batches:
            got = [read_nifti(c)[:2] for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "shape": [list(s) for s, _ in got], "affine": [a.ravel().tolist() for _, a in got]})

    return found.where(format_of(F.col("path")) == "nifti").select("path", "content").mapInPandas(run, "path string, shape array<int>, affine array<double>")


def import_folder(spark: SparkSession, folder: str, pattern: str = "*", subject=lambda p: st.stem(p)) -> DataFrame:
    """Long images with a subject made of each path by a column function."""
    return decode(files(spark, {folder: pattern})).withColumn("subject", subject(F.col("path")))


def import_table(spark: SparkSession, table: DataFrame, column: str, folder: str) -> DataFrame:
    """Images of the paths in a column, joined by their base names to the files of the folder."""
    wanted = table.select(F.explode(st.list_cell(F.col(column))).alias("_p")).select(st.basename(F.col("_p")).alias("_n")).distinct()
    return decode(files(spark, folder).join(wanted, st.basename(F.col("path")) == F.col("_n"), "left_semi"))


def import_any(spark: SparkSession, source, **kwargs) -> DataFrame:
    """A table of paths, a CSV file of paths (its first column), or a folder, by the type of the source."""
    if isinstance(source, DataFrame):
        return import_table(spark, source, kwargs.pop("column", source.columns[0]), **kwargs)
    if str(source).endswith(".csv"):
        t = spark.read.csv(str(source), header=True)
        return import_table(spark, t, t.columns[0], **kwargs)
    return import_folder(spark, str(source), **kwargs)


def import_tissues(spark: SparkSession, folders: dict[str, str], **kwargs) -> DataFrame:
    """Folders of tissue segments as one table with the tissue's name."""
    out = None
    for tissue, folder in folders.items():
        one = import_folder(spark, folder, **kwargs).withColumn("tissue", F.lit(tissue))
        out = one if out is None else out.unionByName(one)
    return out


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with cleaned names and numbers where a column holds nothing else."""
    return st.renamed(spark.read.csv(path, header=True, inferSchema=True), st.clean_name)


def compose_study(path_table: DataFrame, people: DataFrame, subject: str, covariates: list[str], dataset: str) -> DataFrame:
    """Dataset, Subject, Nifti_File_Path and covariates: one row per subject, in natural order descending."""
    first = people.select(F.col(subject).cast("string").alias("subject"), *covariates).dropDuplicates(["subject"])
    got = first.join(relational.match_paths(path_table, first), "subject", "left")
    out = got.select(F.lit(dataset).alias("Dataset"), F.col("subject").alias("Subject"), F.col("path").alias("Nifti_File_Path"), *covariates)
    return out.orderBy(st.natural_key(F.col("Subject")).desc())


def bundle(images: DataFrame, masks: DataFrame, people: DataFrame) -> DataFrame:
    """A regression bundle in long form: masked voxels with nulls as 0, z within dataset and voxel, beside the subject's
    columns. Written with ``partitionBy('dataset')`` it is the manifest of a study."""
    from marram.functions.transforms import standardise

    inside = images.join(masks.where("value > 0").select("voxel").distinct(), "voxel", "left_semi").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return standardise(inside, "value", "z", ["dataset", "voxel"], guard=1e-12).join(people, "subject")
