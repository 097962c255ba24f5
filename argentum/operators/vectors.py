"""Exact vector search: array functions for a search's own vectors, a block join of matrix products for many.

The block join deals the looked-through vectors to cells around a few pivots and cuts large cells into blocks.
Each query goes to the blocks that can hold one of its answers: a cell whose nearest point is farther
away, by the triangle inequality, than enough vectors of other cells, or than the least similarity allows, is
skipped.  Both sides meet in the tasks, block by block; of the vectors only the pivots reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

MIN_SIMILARITY, MARGIN = 0.20, 0.07
#: Pivots at most, and the rows of a block: looked-through vectors, and queries that meet them.
PIVOTS, BLOCK, ABREAST = 64, 4096, 16384
#: Rows that are dealt at a time.
DEALT = 8192
#: Similarities are told with 12 digits; distances get so much leeway.
LEEWAY = 1e-5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, zero and differently long vectors."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    good = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0)
    return F.when(good, dot(a, b) / length).otherwise(0.0)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def best_similarity(vector: Column, queries: list[list[float]]) -> Column:
    """The best similarity over a search's query vectors; null without a vector or one of their length.

    Queries are brought to unit length here, once; a row's length is computed once for each of their lengths.
    """

    def of(q: list[float]) -> Column:
        x = np.array(q, np.float64)
        norm = np.linalg.norm(x)
        if not norm:
            return F.when(F.size(vector) == len(q), 0.0)
        length = F.sqrt(dot(vector, vector))
        sim = F.when(length > 0, dot(vector, F.expr(f"array({', '.join(f'{v!r}D' for v in (x / norm).tolist())})")) / length).otherwise(0.0)
        return F.when(F.size(vector) == len(q), F.greatest(F.least(sim, F.lit(1.0)), F.lit(-1.0)))

    sims = [of(list(map(float, q))) for q in queries]
    return F.greatest(*sims) if len(sims) > 1 else sims[0] if sims else F.lit(None).cast("double")


def similarities(vectors: DataFrame, queries: list[list[float]], key: str, vector: str = "embedding") -> DataFrame:
    """(key, sim): the best similarity over the query vectors, where a row has any.

    The query vectors are part of the plan: nothing is joined or moved.
    """
    return vectors.select(key, best_similarity(F.col(vector), queries).alias("sim")).where("sim is not null")


def nearest(scores: DataFrame, k: int, key: str) -> DataFrame:
    """The k most similar; of equal ones the smaller key first."""
    return scores.orderBy(F.desc("sim"), key).limit(k)


def threshold(best: Column) -> Column:
    """What a similarity must reach: a little below the best, and never little."""
    return F.greatest(F.coalesce(best - MARGIN, F.lit(MIN_SIMILARITY)), F.lit(MIN_SIMILARITY))


def _unit(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (rows, unit rows)} of the vectors of a batch; nulls, empty and zero vectors are left out."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        x = pc.list_flatten(lists.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        with np.errstate(invalid="ignore", over="ignore"):
            norms = np.linalg.norm(x, axis=1)
        good = (norms > 0) & np.isfinite(norms)
        if good.any():
            out[int(n)] = rows[good], x[good] / norms[good, None]
    return out


def _similarities(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of unit rows; equal vectors have equal similarities wherever they stand in a product."""
    return np.round(np.clip(x @ y.T, -1.0, 1.0), 12)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit rows, from their similarities."""
    return np.sqrt(np.maximum(2.0 - 2.0 * np.clip(x @ y.T, -1.0, 1.0), 0.0))


@dataclass
class Cells:
    """Cells of one length: pivots (one cell without any if there are none), how many vectors each has, and its radius."""

    pivots: np.ndarray | None
    first: int
    count: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x), np.int64) if self.pivots is None else _apart(x, self.pivots).argmin(1)

    def routes(self, x: np.ndarray, k: int, least: float | None) -> np.ndarray:
        """(queries, cells): whether a cell can hold one of the k nearest vectors of a query, at ``least`` or over."""
        if self.pivots is None:
            return np.ones((len(x), 1), bool)
        far = _apart(x, self.pivots)
        order = np.argsort(far + self.radius, axis=1)
        sure = np.take_along_axis(far + self.radius, order, 1)  # all vectors of a cell are at least so near
        enough = np.cumsum(self.count[order], axis=1) >= k
        bound = np.where(enough.any(1), sure[np.arange(len(x)), enough.argmax(1)], 2.0)
        if least is not None:
            bound = np.minimum(bound, np.sqrt(2.0 - 2.0 * max(least, -1.0)))
        return (far - self.radius <= bound[:, None] + LEEWAY) & (self.count > 0)


def cells(vectors: DataFrame, key: str, vector: str, rows: int = BLOCK, pivots: int = PIVOTS) -> dict[int, Cells]:
    """The cells of a table of vectors, by their length; what reaches the driver is a bounded number of pivots, and counts."""
    own = vectors.select(key, vector)
    sizes = {r["n"]: r["count"] for r in own.groupBy(F.size(vector).alias("n")).count().where("n > 0").collect()}
    wanted = [n for n, count in sizes.items() if count > rows]
    drawn: dict[int, list] = {}
    if wanted:
        for r in own.where(F.size(vector).isin(wanted)).orderBy(F.xxhash64(key), key).limit(pivots).collect():
            drawn.setdefault(len(r[1]), []).append(r[1])
    found, first = {}, 0
    for n in sorted(sizes):
        units = _unit(pa.array(drawn[n], pa.list_(pa.float64()))).get(n) if n in drawn else None
        some = None if units is None else units[1]
        size = 1 if some is None else len(some)
        found[n] = Cells(some, first, np.zeros(size, np.int64), np.zeros(size), np.ones(size, np.int64))
        first += size

    def measured(batches):
        """(cell, number, radius) of each batch."""
        for batch in batches:
            out = []
            for n, (_, x) in _unit(batch.column(1)).items():
                of = found[n].of(x)
                far = np.zeros(len(x)) if found[n].pivots is None else _apart(x, found[n].pivots)[np.arange(len(x)), of]
                out += [(found[n].first + c, int((of == c).sum()), float(far[of == c].max())) for c in np.unique(of)]
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["cell", "n", "radius"])

    told = own.mapInArrow(measured, "cell long, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    at = {c.first + i: (c, i) for c in found.values() for i in range(len(c.count))}
    for r in told.collect():
        c, i = at[r["cell"]]
        c.count[i], c.radius[i], c.blocks[i] = r["n"], r["radius"], -(-r["n"] // rows)
    return found


def _dealt(side: DataFrame, key: str, vector: str, route) -> DataFrame:
    """(block, strip, key, vector): rows of a side, once for each block and strip that ``route`` tells of them."""
    kind = side.schema[key].dataType
    schema = StructType([StructField("block", LongType()), StructField("strip", LongType()), StructField("key", kind), StructField("vector", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(schema)
    own = side.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("deal"))

    def deal(batches):
        for batch in batches:
            deals = batch.column(2).to_numpy(zero_copy_only=False)
            for n, (rows, x) in _unit(batch.column(1)).items():
                row, block, strip = route(n, x, deals[rows])
                for at in range(0, len(row), DEALT):
                    some = slice(at, at + DEALT)
                    taken = batch.take(pa.array(rows[row[some]]))
                    yield pa.RecordBatch.from_arrays([pa.array(block[some], pa.int64()), pa.array(strip[some], pa.int64()), taken.column(0), taken.column(1)], schema=arrow)

    return own.mapInArrow(deal, schema)


def block_join(
    vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, best, schema: StructType, k: int, least: float | None, rows: int, abreast: int
) -> DataFrame:
    """``best(query keys, their unit rows, keys, unit rows)`` over all blocks of vectors and strips of queries that can matter.

    Each side is read once for this; cells and the number of queries are counted before.
    """
    found = cells(vectors, key, vector, rows)
    first_block, n_blocks = {}, 0
    for n, c in found.items():
        first_block[n] = n_blocks + np.cumsum(c.blocks) - c.blocks
        n_blocks += int(c.blocks.sum())
    strips = max(1, -(-queries.count() // abreast))

    def of_vector(n, x, deal):
        """A vector's block, for each strip of queries."""
        of = found[n].of(x)
        block = first_block[n][of] + deal % found[n].blocks[of]
        return np.repeat(np.arange(len(x)), strips), np.repeat(block, strips), np.tile(np.arange(strips), len(x))

    def of_query(n, x, deal):
        """All blocks of the cells that can matter to a query, in its strip."""
        if n not in found:
            return (np.zeros(0, np.int64),) * 3
        row, cell = np.nonzero(found[n].routes(x, k, least))
        times = found[n].blocks[cell]
        row_, start = np.repeat(row, times), np.repeat(first_block[n][cell], times)
        nth = np.arange(len(row_)) - np.repeat(np.cumsum(times) - times, times)
        return row_, start + nth, deal[row_] % strips

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, held = left.combine_chunks(), right.combine_chunks()
        if not len(asked) or not len(held):
            return to_arrow_schema(schema).empty_table()
        parts = []
        own, theirs = ({n: (rows_, x) for n, (rows_, x) in _unit(t.column("vector").combine_chunks()).items()} for t in (asked, held))
        for n in own.keys() & theirs.keys():
            (a, x), (b, y) = own[n], theirs[n]
            parts.append(best(asked.column("key").take(pa.array(a)), x, held.column("key").take(pa.array(b)), y))
        return pa.concat_tables(parts).cast(to_arrow_schema(schema))

    by = ["block", "strip"]
    left = _dealt(queries, query, query_vector, of_query).groupBy(*by)
    right = _dealt(vectors, key, vector, of_vector).groupBy(*by)
    return left.cogroup(right).applyInArrow(meet, schema)


def nearest_group(
    vectors: DataFrame, groups: DataFrame, key: str, vector: str, centroid: str, least: float, group: str = "group_id", rows: int = BLOCK, abreast: int = ABREAST
) -> DataFrame:
    """(key, group_id, sim): for each vector the most similar centroid at or over ``least``; of equal ones the last.

    Keys and groups are unique.  A vector keeps the best one of a block of at most about ``rows`` centroids, and blocks
    are merged by key: no pair of vector and centroid is ever a row.  Vectors and centroids of different lengths,
    nulls and zero vectors don't meet.
    """
    named = groups.withColumn(group, F.col(group).cast("string"))
    schema = StructType([StructField("key", vectors.schema[key].dataType), StructField(group, StringType()), StructField("sim", DoubleType())])

    def best(asked, x, names, y):
        order = np.argsort(names.to_numpy(zero_copy_only=False).astype(str), kind="stable")[::-1]  # argmax takes the first of equal ones
        sims = _similarities(x, y[order])
        top = sims.argmax(1)
        sim = sims[np.arange(len(x)), top]
        good = np.flatnonzero(sim >= least)
        return pa.table([asked.take(pa.array(good)), names.take(pa.array(order[top[good]])), pa.array(sim[good])], names=["key", group, "sim"])

    found = block_join(named, vectors, group, centroid, key, vector, best, schema, 1, least, rows, abreast)
    return found.groupBy(F.col("key").alias(key)).agg(F.max(F.struct("sim", group)).alias("top")).select(key, f"top.{group}", "top.sim")


def nearest_each(
    vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, rows: int = BLOCK, abreast: int = ABREAST
) -> DataFrame:
    """(query, key, sim, place): the k most similar vectors of each query vector; of equal ones the smaller key.

    Keys are unique on either side.  Each block of at most about ``rows`` vectors keeps the best k of each query that
    meets it, and they are merged by query.  Exact; the query itself counts as well.
    """
    kind = vectors.schema[key].dataType
    schema = StructType([StructField("query", kind), StructField(key, kind), StructField("sim", DoubleType())])

    def best(asked, x, keys, y):
        order = np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")
        sims = _similarities(x, y[order])
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # equal ones by key
        rows_ = np.repeat(np.arange(len(x)), top.shape[1])
        columns = asked.take(pa.array(rows_)), keys.take(pa.array(order[top.ravel()])), pa.array(np.take_along_axis(sims, top, 1).ravel())
        return pa.table(list(columns), names=["query", key, "sim"])

    found = block_join(vectors, queries, key, vector, key, vector, best, schema, k, None, rows, abreast)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), key))
    return found.withColumn("place", place).where(F.col("place") <= k)
