"""What the operators of this subpackage share: table reading, word rules, partition counts, lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The six characters between words, for TRIM.
BLANKS = " \t\n\x0b\x0c\r"
SLICE = 1000  # texts of a batch that are in Python at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's ``spark.checkpoint.dir`` as it is.

    Where none is set, a session on one machine (master local) gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder, so that lost executors cost no recomputation of its past."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of texts hold at most ``SLICE`` rows: the session's limit counts rows, and texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= SLICE:
        spark.conf.set(key, str(SLICE))


def by_text(docs: DataFrame, columns: Callable[[list[str | None]], list], shape: str) -> DataFrame:
    """doc_id as it came, in any type, and the columns (arrays or lists, one value a row) made of the texts.

    Ids stay in Arrow, so nulls beside them do not change them.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = spark.createDataFrame([], shape).schema
    arrow = [(f.name, to_arrow(f.dataType)) for f in types.fields]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                made = columns(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, (_, t) in zip(made, arrow, strict=True)]], names=["doc_id", *[n for n, _ in arrow]])

    return docs.mapInArrow(run, f"doc_id {kind}, {shape}")


def to_arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
