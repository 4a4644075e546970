"""Image files, sinks and the stream: round trips on generated files."""

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.functions import strings as st
from marram.sources import sinks, volumes
from marram.streaming import moments


@pytest.fixture
def study(tmp_path):
    rng = np.random.default_rng(1)
    affine = np.array([[-2.0, 0, 0, 90], [0, 2, 0, -126], [0, 0, 2, -72], [0, 0, 0, 1]])
    arrays = {f"sub-{i:02d}": rng.normal(size=(3, 4, 2)) for i in (1, 2, 12)}
    (tmp_path / "img").mkdir()
    for name, a in arrays.items():
        (tmp_path / "img" / f"{name}_T1.nii.gz").write_bytes(volumes.write_nifti(a, affine))
    return tmp_path, arrays, affine


def test_nifti_round_trip_headers_and_scaling(spark, study):
    tmp, arrays, affine = study
    got = volumes.import_folder(spark, str(tmp / "img"), "*.nii.gz", lambda p: st.between(p, "img/", "_T1")).toPandas()
    for name, a in arrays.items():
        assert np.allclose(got[got["subject"] == name].sort_values("voxel")["value"], a.ravel())
    head = volumes.headers(volumes.files(spark, str(tmp / "img"))).collect()
    assert all(h["shape"] == [3, 4, 2] and np.allclose(np.reshape(h["affine"], (4, 4)), affine) for h in head)
    raw = bytearray(volumes.write_nifti(arrays["sub-01"], affine, compressed=False))
    import struct

    struct.pack_into("<2f", raw, 112, 2.0, 5.0)
    assert np.allclose(volumes.read_nifti(bytes(raw))[2], arrays["sub-01"].ravel() * 2 + 5)
    with pytest.raises(ValueError):
        volumes.read_nifti(b"\0" * 400)


def test_npy_and_gifti(spark, tmp_path):
    a = np.array([[1.0, np.nan, 3.0], [4.0, 5.0, np.inf]])
    np.save(tmp_path / "x.npy", a)
    data = base64.b64encode(zlib.compress(np.array([1, 2.5], "<f4").tobytes())).decode()
    (tmp_path / "s.gii").write_text(f'<GIFTI><DataArray DataType="NIFTI_TYPE_FLOAT32" Encoding="GZipBase64Binary" Endian="LittleEndian"><Data>{data}</Data></DataArray></GIFTI>')
    (tmp_path / "notes.txt").write_text("no image")
    got = {(r["path"][-5:], r["column"], r["voxel"]): r["value"] for r in volumes.decode(volumes.files(spark, str(tmp_path))).collect()}
    assert got[("x.npy", 0, 0)] == 1.0 and got[("x.npy", 0, 1)] is None and got[("x.npy", 1, 2)] is None and got[("s.gii", 0, 1)] == 2.5
    assert len(got) == 8


def test_study_table_and_dispatch(spark, study):
    tmp, arrays, _ = study
    people = spark.createDataFrame([(1, 50.0), (2, 60.0), (12, 70.0), (3, 80.0)], "id long, age double")
    got = volumes.compose_study(volumes.paths(spark, {str(tmp / "img"): "*.nii.gz"}), people, "id", ["age"], "D").collect()
    assert [r["Subject"] for r in got] == ["12", "3", "2", "1"]
    names = {r["Subject"]: (r["Nifti_File_Path"] or "").rsplit("/", 1)[-1] for r in got}
    assert names == {"12": "sub-12_T1.nii.gz", "2": "sub-02_T1.nii.gz", "1": "sub-01_T1.nii.gz", "3": ""}
    table = spark.createDataFrame([("sub-01_T1.nii.gz; sub-12_T1.nii.gz",)], "files string")
    assert volumes.import_any(spark, table, folder=str(tmp / "img")).select("path").distinct().count() == 2
    assert volumes.import_any(spark, str(tmp / "img")).count() == 72
    assert set(volumes.import_tissues(spark, {"grey": str(tmp / "img")}).columns) >= {"tissue", "subject", "value"}


def test_sinks(spark, study):
    tmp, arrays, affine = study
    images = spark.createDataFrame([("a b", i, float(i)) for i in range(24)] + [("c", 3, None)], "name string, voxel int, value double")
    sinks.save(sinks.nifti(images, "name", (3, 4, 2), affine), str(tmp / "out"))
    back = volumes.read_nifti((tmp / "out" / "a_b.nii.gz").read_bytes())
    assert back[0] == (3, 4, 2) and np.allclose(back[2], np.arange(24)) and np.allclose(back[1], affine)
    frames = spark.createDataFrame([(f, v, float(10 * f + v)) for f in range(2) for v in range(24)], "frame int, voxel int, value double")
    content = sinks.nifti_stack(frames, (3, 4, 2), affine).first()["content"]
    assert volumes.read_nifti(bytes(content))[0] == (3, 4, 2, 2)
    sinks.csv_set({"outcome": [images], "covariate": [images, images]}, str(tmp / "csv"))
    assert volumes.csv_table(spark, str(tmp / "csv" / "covariate_1")).count() == 25
    results = spark.createDataFrame([(1, 2.0, 3.0, 0.5, 0.01), (2, 1.0, 1.0, 0.1, 0.5)], "voxel int, estimate double, t double, r2 double, p double")
    sinks.result_maps(results, str(tmp / "maps"))
    assert {(r["voxel"], r["value"]) for r in spark.read.parquet(str(tmp / "maps")).where("stat = 'fwe'").collect()} == {(1, 3.0), (2, None)}
    sinks.bids(images, str(tmp / "bids"), F.col("name"), F.lit("01"), F.lit("x"))
    assert spark.read.parquet(str(tmp / "bids")).where("sub = 'c'").count() == 1


def test_moments_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "g" if i % 2 else "h", float(i), float(i * i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "t string, g string, x double, y double").withColumn("t", F.to_timestamp("t"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    want = {(r["start"], r["g"]): (r["n"], round(r["r"], 9)) for r in moments.statistics(moments.moments(df, "t", "g", "x", "y")).collect()}
    stream = moments.moments(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", "g", "x", "y")
    q = moments.run_once(stream, "sums", str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = {(r["start"], r["g"]): (r["n"], round(r["r"], 9)) for r in moments.statistics(spark.table("sums")).collect()}
    assert got == want and len(got) == 6
