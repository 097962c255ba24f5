"""Exact deduplication by skew-safe combining.

Copies are folded three times, and each time whole normalised texts are
compared, never digests alone:

1. inside one Arrow batch, where the scan reads the rows;
2. inside a salted digest group, so that a text that a third of all rows repeat
   is spread over as many tasks as the shuffle has partitions;
3. across the salts of a digest, where at most one row per salt is left.

A digest that two different texts share ends the job; so, once the texts have been
compared, a digest names one text, and decisions go back to rows by digest and
salt: no text moves a second time, and the order in which rows are read doesn't matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from argentum.llm.common import materialise, salt, salted_lookup, salts, small_batches

#: Bytes that do not count: space, and tab to carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"


def _winners(ids: pa.Array, texts: pa.Array):
    """(ids, bodies, code points, winner's row of each body, rows of each body) of a batch."""
    ids = ids.to_pylist()
    texts = pc.fill_null(texts.cast(pa.string()), "")
    points = pc.utf8_length(texts).to_pylist()
    bodies = [t.translate(None, BLANKS) for t in texts.cast(pa.binary()).to_pylist()]
    best: dict[bytes, int] = {}
    count: dict[bytes, int] = {}
    rank = lambda i: (-points[i], ids[i] is None, ids[i] or 0)
    for i, own in enumerate(bodies):
        count[own] = count.get(own, 0) + 1
        if rank(i) < rank(best.setdefault(own, i)):
            best[own] = i
    return ids, bodies, points, best, count


def _fold_batch(batches):
    """The winner of each text of a batch, with its text and the number of rows."""
    for batch in batches:
        ids, _, points, best, count = _winners(batch.column(0), batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in best.values()], pa.int64()),
                pa.array([points[i] for i in best.values()], pa.int64()),
                pa.array([hashlib.sha256(b).digest() for b in best], pa.binary()),
                pa.array([count[b] for b in best], pa.int64()),
                pa.array(list(best), pa.binary()),
            ],
            names=["id", "points", "sha", "n", "body"],
        )


def _digest_rows(batches):
    """id, code points and digest of each row."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
        sha = [hashlib.sha256(t.translate(None, BLANKS)).digest() for t in texts.cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pc.utf8_length(texts).cast(pa.int64()), pa.array(sha, pa.binary())], names=["id", "points", "sha"]
        )


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, points.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``;
    null counts as empty, and all empty texts are one group.  The row with the
    most code points stays, then the one with the smallest id (a null id comes
    last).  Rows that repeat both id and text share their decision.  Texts may be of any
    length.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = salts(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    # salted digest groups: one window over whole texts
    won = rows.mapInArrow(_fold_batch, "id long, points long, sha binary, n long, body binary").withColumn("salt", salt("id", n))
    group = Window.partitionBy("sha", "salt", "body")
    order = group.orderBy(F.desc("points"), F.asc_nulls_last("id"))
    salted = won.select("*", F.row_number().over(order).alias("place"), F.sum("n").over(group).alias("rows")).where("place = 1")

    # salt winners: at most one row per salt and text
    group = Window.partitionBy("sha", "body")
    order = group.orderBy(F.desc("points"), F.asc_nulls_last("id"))
    told = (
        salted.select("sha", "id", "points", F.row_number().over(order).alias("place"), F.sum("rows").over(group).alias("group_size"))
        .where("place = 1")
        .select("sha", F.col("id").alias("keep_id"), F.col("points").alias("keep_points"), "group_size")
    )
    clash = F.when(F.count("*").over(Window.partitionBy("sha")) > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
    told = told.withColumn("group_size", F.coalesce(clash, "group_size"))

    # rows hear the answer of their digest, through salts again
    own = materialise(rows.mapInArrow(_digest_rows, "id long, points long, sha binary"), "digests")
    return salted_lookup(own, "sha", "id", told).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "points",
    )


def body(text: Column) -> Column:
    """What ``copies`` compares, as a column."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANK_CLASS, "")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, each once, with all columns of docs.

    See ``copies`` for which row of a group stays, for nulls, empty and very long texts; the
    same three steps are taken here with whole rows, so none is looked up again.  Repeats
    of the row that stays are dropped as well.  An empty table gives an empty result.
    Other columns may have any name that does not begin with ``_k_``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("_k_sha", StringType()), StructField("_k_points", LongType())])

    def fold(batches):
        for batch in batches:
            ids, bodies, points, best, _ = _winners(batch.column(at_id), batch.column(at_text))
            keep = sorted(best.values())
            held = batch.take(pa.array(keep, pa.int64()))
            sha = pa.array([hashlib.sha256(bodies[i]).hexdigest() for i in keep], pa.string())
            own = [*held.columns, sha, pa.array([points[i] for i in keep], pa.int64())]
            yield pa.RecordBatch.from_arrays(own, names=[*batch.schema.names, "_k_sha", "_k_points"])

    rows = docs.mapInArrow(fold, schema).withColumn("_k_salt", salt(id_col, salts(spark)))
    for keys in (["_k_sha", "_k_salt"], ["_k_sha"]):
        rows = rows.repartition(*keys).withColumn("_k_body", body(F.col(text_col)))
        group = Window.partitionBy(*keys, "_k_body").orderBy(F.desc("_k_points"), F.asc_nulls_last(id_col))
        rows = rows.withColumn("_k_place", F.row_number().over(group)).where("_k_place = 1").drop("_k_body", "_k_place")
    return rows.select(docs.columns)
