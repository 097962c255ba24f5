"""New files as a stream: each micro-batch is written as a change set that a snapshot takes in."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from argentum.operators import ranking
from argentum.operators.maintenance import KEY, last_of
from argentum.sources import files, listing

PRINT = ["root", "path", "bytes", "modified_ns"]


class Gate:
    """Holds a stream between micro-batches: ``pause`` and ``resume`` may be called from any thread."""

    def __init__(self):
        self._open = threading.Event()
        self._open.set()

    def pause(self) -> None:
        self._open.clear()

    def resume(self) -> None:
        self._open.set()

    @property
    def paused(self) -> bool:
        return not self._open.is_set()

    def wait(self) -> None:
        self._open.wait()


def remaining(done: int, total: int, elapsed: float) -> int | None:
    """Whole seconds left: 0 when all is done, none before anything can be told."""
    if total and done >= total:
        return 0
    if not done or elapsed < 0.5:
        return None
    return -int(-(total - done) * elapsed // done)


def follow(
    spark: SparkSession,
    root: str,
    target: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    gate: Gate | None = None,
    report: Callable[[dict], None] | None = None,
    total: int = 0,
) -> StreamingQuery:
    """Append the listing of new and changed files under root to target until all present ones are taken.

    A micro-batch lists what may have changed; what target has with the same size and time is left out.  It is
    written in steps of files_per_batch files at most, each with a folder of its own, which a
    repeated batch writes again, so no file is listed twice.  A paused gate holds the next step.
    After each step ``report`` gets done, total, elapsed and eta (seconds left, or none), counted by the writing itself.
    """
    listing.check_root(root)
    listing.register(spark)
    began, seen = time.monotonic(), {}

    def take(batch: DataFrame, number: int) -> None:
        known = files.read_snapshot(spark, target, f"{', '.join(f'{c} string' if c in KEY else f'{c} long' for c in PRINT)}, batch long").where(F.col("batch") != number)
        same = [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in PRINT]
        fresh = batch.alias("new").join(known.alias("old"), same, "left_anti")
        staged, n = in_steps(fresh, files_per_batch, f"{target}/_staged/batch={number}")
        for step in range(n):
            if gate:
                gate.wait()
            told = Observation()
            rows = staged.where(F.col("step") == step).drop("step").observe(told, F.count(F.lit(1)).alias("rows"))
            rows.write.mode("overwrite").parquet(f"{target}/batch={number}/step={step}")
            seen[number, step] = told.get["rows"]
            if report:
                done, elapsed = sum(seen.values()), time.monotonic() - began
                report({"done": done, "total": max(total, done), "elapsed": elapsed, "eta": remaining(done, max(total, done), elapsed)})

    found = files.supported(files.listed(spark.readStream.format("folder").load(root), root))
    return found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_steps(rows: DataFrame, size: int | None, path: str) -> tuple[DataFrame, int]:
    """(rows with ``step``, number of steps), written to path: ``size`` rows in a step by file name, or all in one."""
    rows.write.mode("overwrite").parquet(f"{path}/listed")
    kept = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/listed")
    n = kept.count()
    if not n or not size or n <= size:
        return kept.withColumn("step", F.lit(0)), min(n, 1)
    placed = ranking.positions(kept, "path").withColumn("step", F.floor(F.col("position") / size).cast("int")).drop("position")
    placed.write.mode("overwrite").partitionBy("step").parquet(f"{path}/steps")
    return rows.sparkSession.read.schema(placed.schema).parquet(f"{path}/steps"), -(-n // size)


def latest(changes: DataFrame) -> DataFrame:
    """The newest row of each file in a folder of change sets."""
    rows = changes.drop("batch", "step")
    return last_of(rows.withColumn("_time", F.col("modified_at").try_cast("bigint")), KEY, ["_time", "bytes"]).select(rows.columns)
