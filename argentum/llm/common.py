"""What the operators share: table access, shared-folder tables, batch sizes, joins with hot keys."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []
_WRITTEN = threading.local()

#: Rows of one batch between the JVM and Python, and their bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one the session names in ``spark.checkpoint.dir``.  Where that is unset, a
    local master gets a temporary folder; on any other it is an error, as each
    executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _LOCAL_ROOT[0]


def _written() -> list[str]:
    if not hasattr(_WRITTEN, "paths"):
        _WRITTEN.paths = []
    return _WRITTEN.paths


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; ``sweep`` removes it."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written().append(path)
    return path


def store(df: DataFrame, path: str) -> DataFrame:
    """Write df to path and read it back: lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    return store(df, fresh_path(df.sparkSession, name))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written():
        _written().remove(path)


def written() -> list[str]:
    """What this thread's calls left in the shared folder so far."""
    return list(_written())


def sweep(spark: SparkSession, keep: list[str] = ()) -> None:
    """Remove what this thread's calls left in the shared folder, but for ``keep``.

    Call it when results have been written: a result that is still to be computed reads
    such tables.
    """
    for path in [p for p in _written() if p not in keep]:
        remove(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold when texts are long.

    Spark reads these settings when a query runs, so they stay set in the session; a bound
    that is smaller already is left.
    """
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= bound):
            spark.conf.set(name, str(bound))


def salts(spark: SparkSession) -> int:
    """Parts into which a hot key is split: one for each shuffle partition."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt(key: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), key), F.lit(n)).cast("int")


def salted_lookup(rows: DataFrame, key: str, by: str, answers: DataFrame, how: str = "left") -> DataFrame:
    """rows with the columns of answers, which have one row for each ``key``; null keys have no answer.

    Many rows may share a key: they are dealt by key and a salt of ``by``, and the answer
    goes to each salt of its key once.
    """
    n = salts(rows.sparkSession)
    dealt = rows.withColumn("_l_salt", salt(by, n))
    slots = dealt.select(F.col(key).alias("_l_key"), "_l_salt").distinct()
    told = slots.join(answers, F.col("_l_key") == F.col(key)).drop(key).withColumnRenamed("_l_salt", "_l_part")
    on = (F.col(key) == F.col("_l_key")) & (F.col("_l_salt") == F.col("_l_part"))
    return dealt.join(told, on, how).drop("_l_key", "_l_salt", "_l_part")
