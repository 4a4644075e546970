"""The training-corpus pipeline: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Between stages the rows are written as Parquet to the shared checkpoint folder and read again, so a lost executor
costs one stage at most.
"""

from __future__ import annotations

import uuid

from marram.llm import language, mixing, packing, secrets, simhash
from marram.llm.common import shared_dir


def language_id(spark, docs, sf_dir):
    """Rows whose language the byte network finds with a score of 0.4 or more; null and letterless texts go.

    Ties, repeated rows and very long texts are judged each as it is; an empty table stays empty.
    """
    return language.keep_identified(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Rows that repeat that id stay, and so do rows without an id; null and empty texts are one group.
    """
    return simhash.keep_first(docs)


def secret_scans(spark, docs, sf_dir):
    """All rows; live-looking secrets are replaced by a mark in the text. Null texts stay null."""
    return secrets.redact(docs)


def mixing_sources(spark, docs, sf_dir):
    """Rows repeated or left out so that sources come near their targets; a null source is one of its own."""
    return mixing.mix(docs)


def packing_stage(spark, docs, sf_dir):
    """The pieces of the sequences with their token ids; a null text is the end token alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing", mixing_sources),
    ("packing", packing_stage),
]

#: Trained networks, shingle similarity and tokenizer ids are beyond SQL; tests/llm holds each stage's operator against
#: brute force and the whole run against its parts.
ORACLE_SQL = None


def drop(spark, path):
    """Deletes a written stage that a later one has replaced."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark, sf_dir):
    """The stages applied to documents; the last one's rows. Columns beyond those of documents are carried along.

    Of the written stages only the newest is kept, which the result reads.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, last = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if last is not None:
            drop(spark, last)
        last = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
