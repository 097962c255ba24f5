"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the one before it kept.  Null and empty texts are kept by the
first and folded into one row by the second; rows with a null id pass the near-copy stage as they
are.  Rows that repeat both id and text become one.  Columns beside id and text go along unread, so long
as their names do not begin with ``_k_`` or ``_g_``.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from argentum.llm import decontaminate, exact_dedup, minhash, packing, toxicity
from argentum.llm.common import fresh_path, store, sweep, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the most code points stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return minhash.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their places in the sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages; a stage's intermediate tables go when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        docs = store(stage(spark, docs, sf_dir), path)
        sweep(spark, keep=[*before, path])
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the signatures and the packing are not SQL.
ORACLE_SQL = None
