"""Centroid clustering: Lloyd's rounds on whole numbers, exact at every size.

Distances come from |x|² - 2 x·c + |c|² as matrix products of blocks of rows.  A bound on the
magnitudes keeps all of it below 2**53, where doubles are exact; other rows and centroids
take Python's integers (see ``exact``).  Each task adds up its own rows, and an RDD's ``treeAggregate``
combines the tasks' sums: what reaches the driver is one sum for each centroid.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm.common import small_batches
from argentum.llm.exact import distances, integers, long, means, numbers, sums, whole

CLUSTERS, ROUNDS, SCALE, DIM, SEED = 40, 5, 256, 64, 2
RESULT = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row; of equally near ones the first."""
    far = distances(x, centroids)
    nearest = far.argmin(1) if len(far) else np.zeros(0, np.int64)
    return nearest, far[np.arange(len(far)), nearest]


def _folded(rows: DataFrame, centroids: np.ndarray, dim: int, scale: int):
    """(rows, sum, summed distance) of each centroid over all vectors."""

    def fold(batches):
        """One row for each task: its sums."""
        n = len(centroids)
        count, total, inertia = (np.zeros(s, int).astype(object) for s in (n, (n, dim), n))
        for batch in batches:
            _, x = whole(batch.column(1), dim, scale)
            nearest, distance = _assigned(x, centroids)
            more, added = sums(x, nearest, n)
            count, total = count + more, total + added
            np.add.at(inertia, nearest, integers(distance))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((count, total, inertia))], pa.binary())], names=["sums"])

    def add(a, b):
        return b if a is None else a if b is None else tuple(p + q for p, q in zip(a, b))

    parts = rows.mapInArrow(fold, "sums binary").rdd.map(lambda r: pickle.loads(r[0]))
    return parts.treeAggregate(None, add, add)


def _first(rows: DataFrame, k: int, dim: int, scale: int, seed: int) -> np.ndarray:
    """The kept vectors with the smallest digest of ``seed:id``, in that order; k rows at most come to the driver."""

    def keep(batches):
        for batch in batches:
            kept, _ = whole(batch.column(1), dim, scale)
            yield batch.take(pa.array(kept))

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.where("id is not null").mapInArrow(keep, rows.schema).orderBy(digest, "vector").limit(k).collect()
    x = np.floor(np.array([r["vector"] for r in found], np.float64).reshape(len(found), dim) * scale)
    return integers(x)


def cluster(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    dim: int = DIM,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly ``dim`` components, none null, and none that ``scale`` times is not finite.
    A component x becomes floor(scale * x); scale is a power of two.  Centroids begin as
    the k kept vectors with the smallest SHA-256 of ``seed:id`` (equal ids: the smaller vector
    first; null ids never), fewer where there are fewer.  Of equally near centroids the smaller number wins; a
    centroid without vectors stays.  All results are exact; distances and inertias beyond a long are
    given as the largest long.  Rows with a null or repeated id are vectors like any other.  An
    empty table, or one whose kept vectors all lack an id, gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), numbers(vectors, vector_col).alias("vector"))
    centroids = _first(rows, k, dim, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT).withColumnRenamed("id", id_col)
    for _ in range(rounds):
        count, total, _ = _folded(rows, centroids, dim, scale)
        centroids = means(count, total, centroids)
    _, _, inertia = _folded(rows, centroids, dim, scale)
    of_cluster = np.array([long(i) for i in inertia], np.int64)
    overall = long(inertia.sum())
    digests = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids])

    def tell(batches):
        for batch in batches:
            kept, x = whole(batch.column(1), dim, scale)
            nearest, distance = _assigned(x, centroids)
            columns = [
                batch.column(0).take(pa.array(kept)),
                pa.array(nearest, pa.int32()),
                pa.array([long(d) for d in distance], pa.int64()),
                pa.array(of_cluster[nearest]),
                pa.array(np.full(len(kept), overall)),
                digests.take(pa.array(nearest)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(tell, RESULT).withColumnRenamed("id", id_col)


def cluster_sql(k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: int = SEED) -> str:
    """The same in SQL, round by round."""
    steps = [
        f"""rows_ as (select vec_id, row_number() over () as n, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
          from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""c0 as (select row_number() over (order by h, v) - 1 as c, v from (select v, sha256('{seed}:' || vec_id) as h from rows_ where vec_id is not null order by h, v limit {k}))""",
    ]
    gap = "list_sum(list_transform(list_zip(r.v, c.v), lambda p: ((p[1] - p[2]) * (p[1] - p[2]))::hugeint))"
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} as materialized (select n, vec_id, v, best.c as c, best.d as d from (
              select r.n, any_value(r.vec_id) as vec_id, any_value(r.v) as v, min(struct_pack(d := {gap}, c := c.c)) as best from rows_ r, c{r} c group by r.n))"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} as materialized (select c.c, coalesce(m.v, c.v) as v from c{r} c left join (
                  select c, list(((s - ((s % k) + k) % k) // k)::bigint order by i) as v from (
                    select c, i, sum(x) as s, count(*) as k from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by c, i) group by c) m on m.c = c.c)"""
            )
    steps_ = ",\n".join(steps)
    return f"""with {steps_}
select vec_id, a.c::integer as cluster, d::bigint as distance, sum(d) over (partition by a.c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
       sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.c = a.c"""
