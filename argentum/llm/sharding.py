"""Sharding by sampled splitters, with DataFrame functions only.

1. A size-weighted sample of keys is drawn (a row is drawn with probability
   ``size * sample / total``, by a hash of the row, so that a retry draws the same).
2. Weighted quantiles of the sample are the splitters of ``ranges`` key ranges.
3. A range that holds more than its share is subdivided evenly over its keys.
4. Rows are ordered inside their cell; cell totals place each cell; the middle
   byte of a row decides its shard.  So ``law`` is ``bytes``: a shard differs
   from the mean by less than the largest row.

The key is 32 bits of the text's hash over 31 bits of the id's hash: equal texts
are neighbours, and a text that a third of all rows repeat still splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.llm.common import materialise, salts

#: Sampled keys for each range.  The sample on the driver is about
#: ``ranges * PER_RANGE`` longs, whatever the size of the table.
PER_RANGE = 16


def _ranges(df: DataFrame) -> int:
    """A power of two, four ranges for each shuffle partition, at least 64 and at most 8192."""
    n = 64
    while n < min(8192, 4 * salts(df.sparkSession)):
        n *= 2
    return n


def _splitters(keyed: DataFrame, ranges: int, total: int) -> list[int]:
    draws = ranges * PER_RANGE
    drawn = (
        keyed.where(
            F.pmod(F.xxhash64(F.lit("draw"), "key", "id"), F.lit(1 << 30)) / float(1 << 30)
            < F.col("size") * F.lit(draws / max(total, 1))
        )
        .select("key", F.greatest(F.col("size").cast("double"), F.lit(total / draws)).alias("weight"))
        .collect()
    )
    drawn = sorted((r["key"], r["weight"]) for r in drawn)
    whole, seen, out = sum(w for _, w in drawn), 0.0, []
    for key, weight in drawn:
        seen += weight
        while len(out) < ranges - 1 and seen >= whole * (len(out) + 1) / ranges:
            out.append(key)
    return out + [(1 << 63) - 1] * (ranges - 1 - len(out))


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at most key: a binary search over a constant array."""
    at = F.array(*[F.lit(x) for x in splitters])
    steps, n = [], (len(splitters) + 1) // 2
    while n:
        steps.append(n)
        n //= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda p, s: F.when(F.get(at, p + s - F.lit(1)) <= key, p + s).otherwise(p),
    )


def shards(
    docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes, so its size is 16, like that of an empty one; texts may be of any
    length.  Equal texts (groups) are neighbours, but a group may lie in two or more shards: sizes
    near equal, the law, goes first.  Rows that repeat id and text get neighbouring
    slots.  A null id orders first.  An empty table gives an empty result; other columns
    are ignored.  ``grown_shard`` is null, as the law is ``bytes``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            _key(text, F.col(id_col).cast("long")).alias("key"),
        ),
        "shard-keys",
    )
    placed = _placed(keyed, n_shards)
    first = placed.groupBy("shard").agg(F.min("row").alias("first")).withColumnRenamed("shard", "f_shard")
    return placed.join(F.broadcast(first), F.col("shard") == F.col("f_shard")).select(  # a row for each shard
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _key(text: Column, id_: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 32), 31).bitwiseOR(F.xxhash64(id_).bitwiseAND(F.lit((1 << 31) - 1)))


def _placed(keyed: DataFrame, n_shards: int) -> DataFrame:
    """keyed (id, size, crc, key; a written table) with shard and row, its place among all rows."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = _ranges(keyed)
    splitters = _splitters(keyed, ranges, total)
    ranged = keyed.withColumn("range", _range_of(F.col("key"), splitters))

    # a row for each range: at most 8192
    share = max(1.0, total / ranges)
    low, high = [0, *splitters], [*splitters, (1 << 63) - 1]
    parts = ranged.groupBy("range").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("size") / F.lit(1.5 * share))).cast("int").alias("parts")
    ).select(F.col("range").alias("p_range"), "parts")
    at = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("range"))
    cells = ranged.join(F.broadcast(parts), F.col("range") == F.col("p_range")).withColumn(
        "part",
        F.when(F.col("parts") == 1, 0).otherwise(
            F.least(
                F.col("parts") - 1,
                F.floor((F.col("key") - at(low)) / F.greatest(at(high) - at(low), F.lit(1)) * F.col("parts")),
            )
        ).cast("int"),
    )
    sums = cells.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("range").alias("o_range"),
        F.col("part").alias("o_part"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"),
    )
    order = Window.partitionBy("range", "part").orderBy("key", "id")
    placed = (
        cells.join(F.broadcast(offsets), (F.col("range") == F.col("o_range")) & (F.col("part") == F.col("o_part")))
        .withColumn("row", F.row_number().over(order) + F.col("row_offset") - 1)
        .withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("byte_offset"))
        .withColumn(
            "shard",
            F.least(
                F.lit(n_shards - 1),
                F.floor((2 * F.col("end") - F.col("size")) * n_shards / F.lit(2.0 * max(total, 1))),
            ).cast("int"),
        )
    )
    return materialise(placed.select("id", "size", "crc", "key", "shard", "row"), "shard-rows")


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write docs as Parquet under ``path/shard=N``, in the order of their slots; the name of the folders' column.

    Where docs has a column ``shard``, the folders' column gets underscores in front until its name
    is free.  Nulls, odd texts and empty tables: see ``shards``; of rows that repeat
    id and text all go where the first of them goes.  Each text moves once, to its
    shard; a shard may have several files.
    """
    folder, own = "shard", [c.lower() for c in docs.columns]
    while folder in own:
        folder = "_" + folder
    text, id_ = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    keyed = materialise(
        docs.select(id_.alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"), _key(text, id_).alias("key")),
        "shard-keys",
    )
    # rows of one id and key are repeats: one place for all
    where = _placed(keyed, n_shards).groupBy(F.col("id").alias("_s_id"), F.col("key").alias("_s_key")).agg(F.min(F.struct("shard", "row")).alias("_s_at"))
    met = docs.withColumn("_s_own", _key(text, id_)).join(where, id_.eqNullSafe(F.col("_s_id")) & (F.col("_s_own") == F.col("_s_key")))
    (
        met.select(*docs.columns, F.col("_s_at.shard").alias(folder), F.col("_s_at.row").alias("_s_row"))
        .repartitionByRange(max(n_shards, salts(docs.sparkSession)), "_s_row")
        .sortWithinPartitions(folder, "_s_row")
        .drop("_s_row")
        .write.partitionBy(folder)
        .parquet(path)
    )
    return folder
