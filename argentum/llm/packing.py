"""Packing of token sequences into fixed windows by minimum bin slack.

1. Texts become ids; a document longer than a window is cut into full windows and a
   rest, so every piece has a length from 1 to the capacity.
2. The multiset of lengths is a histogram of at most ``capacity`` rows, whatever the
   size of the table.  ``plan`` fills one window after the other: the longest piece
   left opens it, a bitset subset-sum over the lengths left (each with its count)
   finds the fullest sum, and backtracking gives the count of each length.  A
   pattern is used as often as the counts allow, so the plan stays as small as the
   histogram.
3. Pieces of a length are numbered, within salts first, and the plan, whose size the
   capacity bounds, says which window and offset a number gets: a binary search.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from argentum.llm.common import materialise, salts, small_batches

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary(name: str) -> str:
    """The file of a tokenizer: a path, or the name of a public one."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for.

    A null text counts as empty; its only id is ``end_id``.  Rows that repeat an id have
    pieces of their own.  An empty table gives an empty result; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    schema = PIECES + ", ids array<int>" * with_ids

    def cut(batches):
        from argentum.llm.tokens import encoded, encoder

        by = encoder(vocabulary(tokenizer))
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows, ids = [], []
            for i, body in encoded(batch.column(1), by):
                whole = np.append(body, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(whole), capacity):
                    piece = whole[start : start + capacity]
                    rows.append((names[i], start, len(piece), zlib.crc32(piece.tobytes()), len(whole)))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            columns += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, schema)


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The counts of lengths whose sum is the largest up to room.

    Lengths of which most are left are tried first, and kept where sums are equal.
    Bit s of a bitset says that a sum s can be reached; a count enters in powers of
    two, so that any number up to it can be made.
    """
    mask, bits, target = (1 << (room + 1)) - 1, 1, 1 << room
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in left if x <= room), key=lambda x: (-left[x], -x)):
        count, copies = min(left[length], room // length), 1
        while count and not bits & target:
            copies = min(copies, count)
            steps.append((bits, length, copies))
            bits |= (bits << (length * copies)) & mask
            count -= copies
            copies *= 2
        if bits & target:
            break
    at, used = bits.bit_length() - 1, {}
    for before, length, copies in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + copies
            at -= length * copies
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(length -> count, times) of the windows, which together hold every piece once."""
    left = {x: n for x, n in counts.items() if n > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fullest({x: n for x, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[x] // n for x, n in pattern.items())
        out.append((pattern, times))
        for x, n in pattern.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def _plan_rows(windows):
    """(length, first number, end number, copies, first window, offset) of each pattern's lengths."""
    rows, numbered, window = [], {}, 0
    for pattern, times in windows:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            first = numbered.get(length, 0)
            numbered[length] = first + copies * times
            rows.append((length, first, numbered[length], copies, window, offset))
            offset += length * copies
        window += times
    return rows


def _placing(windows: list[tuple], columns: list[str]):
    """Puts the pieces of Arrow batches, numbered in their last column, into the plan's windows."""
    length, first, end, copies, window, offset = np.array(sorted(windows), np.int64).reshape(-1, 6).T
    spread = int(end.max(initial=0)) + 1  # numbers of one length lie below
    starts = length * spread + first

    def place(batches):
        for batch in batches:
            own = batch.column(columns.index("length")).to_numpy()
            number = batch.column(len(columns)).to_numpy()
            at = np.searchsorted(starts, own * spread + number, "right") - 1
            nth = number - first[at]
            found = pa.array(window[at] + nth // copies[at]), pa.array(offset[at] + nth % copies[at] * own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*columns, "sequence_id", "offset"])

    return place


def assign(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces_ with sequence_id and offset; pieces_ must be a written table."""
    n = salts(pieces_.sparkSession)
    salted = pieces_.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "start")
    numbered = (
        salted.withColumn("_place", F.row_number().over(order))
        .join(firsts, ["length", "_salt"])
        .select(*pieces_.columns, (F.col("_place") + F.col("_before") - 1).cast("long").alias("_number"))
    )
    schema = StructType([*pieces_.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return numbered.mapInArrow(_placing(_plan_rows(plan(counts, capacity)), pieces_.columns), schema)


def pack(docs: DataFrame, with_ids: bool = False, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per piece (see ``pieces``) with sequence_id and offset.

    Pieces of a sequence lie gapless from offset 0.  Nulls, repeats and empty tables:
    as in ``pieces``.
    """
    cut = materialise(pieces(docs, with_ids=with_ids, capacity=capacity, **options), "pieces")
    return assign(cut, capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, pad_id: int = 0, **options) -> DataFrame:
    """The training sequences: sequence_id, ids, used.

    ``ids`` is padded with ``pad_id`` to the capacity, except where the number of used
    ids is a power of two.
    """
    packed = pack(docs, with_ids=True, capacity=capacity, **options)
    used = F.col("used")
    return (
        packed.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("used"))
        .select(
            "sequence_id",
            F.concat(
                F.flatten("parts.ids"),
                F.when(used.bitwiseAND(used - 1) == 0, F.array().cast("array<int>")).otherwise(
                    F.array_repeat(F.lit(pad_id), (F.lit(capacity) - used).cast("int"))
                ),
            ).alias("ids"),
            "used",
        )
    )
