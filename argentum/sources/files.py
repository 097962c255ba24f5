"""Listing image folders, and reading the tables of a catalogue."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.functions.media import filename
from argentum.operators.predicates import has_extension
from argentum.plans.query_parser import EXTENSIONS
from argentum.sources import listing


def modified_ns(time: Column) -> Column:
    """Nanoseconds since 1970, as fine as the file source tells the time; null before."""
    micros = F.unix_micros(time)
    return F.when(micros >= 0, micros * 1000)


def supported(listing: DataFrame, limit: int | None = None) -> DataFrame:
    """Files with a supported extension; with a limit the first so many by path."""
    found = listing.where(has_extension(F.col("filename"), EXTENSIONS))
    return found if limit is None else found.orderBy("path").limit(limit)


def listed(files: DataFrame, root: str) -> DataFrame:
    """root, path, filename, bytes, modified_at and modified_ns of rows of the folder source."""
    return files.select(
        F.lit(root).alias("root"),
        "path",
        filename(F.col("path")).alias("filename"),
        "bytes",
        F.expr("modified_ns div 1000000000").cast("string").alias("modified_at"),
        "modified_ns",
    )


def contents(rows: DataFrame) -> DataFrame:
    """rows with ``content``, the bytes of the file at ``path``; null where it can't be read.  Each file is a batch of its own."""
    schema = rows.withColumn("content", F.lit(None).cast("binary")).schema
    return rows.mapInArrow(listing.with_content, schema)


def scan(spark: SparkSession, root: str, with_content: bool = False, limit: int | None = None) -> DataFrame:
    """One row per image under root: see ``listed``; content only if asked for.

    Files of every name are listed, empty ones too, with times in nanoseconds.  Links to files
    count, links to folders are not followed, and what can't be read is left out.  A time before
    1970 is null.  A missing root, or one that is a file, is an error.  With a limit the first so many by path are
    taken.  A root with a scheme is read by pyarrow's file systems; executors must see the same folder.
    """
    listing.check_root(root)
    listing.register(spark)
    found = supported(listed(spark.read.format("folder").load(root), root), limit)
    return contents(found) if with_content else found


def read_snapshot(spark: SparkSession, path: str, schema: str, root: str | None = None) -> DataFrame:
    """A table of the catalogue as Parquet, or an empty one where there is none yet; of one root if it is given."""
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows if root is None else rows.where(F.col("root") == root)
