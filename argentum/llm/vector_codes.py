"""Vector codes: product quantisation with Yinyang's bounds.

A vector of whole numbers is cut into parts, and each part position has a codebook that Lloyd's rounds move.
The entries of a codebook are gathered in groups.  For each part of a vector its row carries an
upper bound on the distance to its entry and one lower bound per group on the distance to the
group's other entries.  When entries move, the bounds move by the entry's and by the group's largest drift, and
only groups whose lower bound doesn't exceed the upper one are looked at again.  Bounds are
rounded outwards; what is looked at is compared in exact whole numbers, so ties go to the lower index.

The rows with their bounds are written to the shared folder in each round, together with each task's sums for
the codebook, and those of the round before are removed.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm.common import fresh_path, materialise, remove, salted_lookup, small_batches, store
from argentum.llm.exact import LONGEST, distances, integers, long, means, numbers, sums, whole

PARTS, ENTRIES, ROUNDS, SCALE, DIM, GROUPS = 4, 256, 4, 1024, 64, 16
#: A computed bound is widened by this share, far more than its rounding.
SLACK = 1e-9


@dataclass
class Book:
    """One part position's entries, the group of each, and how far entries moved since the bounds were made."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    @classmethod
    def first(cls, entries: np.ndarray, groups: int) -> Book:
        """Groups by a few rounds of Lloyd on the entries themselves; they only decide how tight bounds are."""
        x = entries.astype(np.float64)
        n = max(1, min(groups, len(x)))
        centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
        of = np.zeros(len(x), np.int64)
        for _ in range(5):
            of = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([x[of == g].mean(0) if (of == g).any() else centres[g] for g in range(n)])
        return cls(entries, of, np.zeros(len(x)))

    def moved(self, entries: np.ndarray) -> Book:
        gaps = entries - self.entries
        return Book(entries, self.group, np.sqrt((gaps * gaps).sum(1).astype(np.float64)) * (1 + SLACK))


def _above(values: np.ndarray) -> np.ndarray:
    return np.nextafter((values * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def _below(values: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((values * (1 - SLACK)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def own_distances(x: np.ndarray, book: Book, code: np.ndarray) -> np.ndarray:
    """The exact squared distance of each row to its own entry."""
    mine = book.entries[code]
    near = x.shape[1] * (np.abs(x).max(initial=0) + float(np.abs(mine).max(initial=0))) ** 2 < float(1 << 53)
    gaps = x - mine.astype(np.float64) if near else integers(x) - mine
    return (gaps * gaps).sum(1)


def assign(x: np.ndarray, book: Book, code: np.ndarray | None, upper: np.ndarray, lower: np.ndarray):
    """(code, upper, lower, number of distances): the next assignment of rows whose bounds are given.

    Without a code all groups are looked at.
    """
    n, width = lower.shape
    members = [np.flatnonzero(book.group == g) for g in range(width)]
    if code is None:
        code, upper, lower = np.full(n, -1), np.full(n, np.inf, np.float32), np.zeros((n, width), np.float32)
        rows, asked = np.arange(n), 0
        best = np.full(n, np.inf)
    else:
        drift = np.array([book.drift[m].max(initial=0) for m in members])
        upper = _above(upper.astype(np.float64) + book.drift[code])
        lower = _below(np.maximum(lower.astype(np.float64) - drift, 0))
        rows = np.flatnonzero(upper >= lower.min(1))
        best = own_distances(x[rows], book, code[rows])
        upper[rows] = _above(_root(best))
        still = upper[rows] >= lower[rows].min(1)
        asked = len(rows)
        rows, best = rows[still], best[still]
    if not len(rows):
        return code, upper, lower, asked
    old = code[rows]
    index, held = old.copy(), lower[rows]
    first_best = best
    second = np.full(held.shape, np.inf, np.float32)  # the bound of a looked-at group without its nearest entry
    for g, own in enumerate(members):
        pick = np.flatnonzero(held[:, g] <= _above(_root(best)))
        if not len(own):
            held[:, g] = np.inf
            continue
        if not len(pick):
            continue
        far = distances(x[rows[pick]], book.entries[own])
        asked += far.size
        if far.dtype == object or best.dtype == object:  # one kind of number for all
            far, best = far.astype(object), best.astype(object)
        far[old[pick][:, None] == own] = np.inf  # the entry held so far is in ``best`` already
        at = far.argmin(1)
        nearest = far[np.arange(len(pick)), at]
        name = own[at]
        held[pick, g] = _below(_root(nearest))
        if len(own) > 1:
            far[np.arange(len(pick)), at] = np.inf
            second[pick, g] = _below(_root(far.min(1)))
        wins = (nearest < best[pick]) | ((nearest == best[pick]) & (name < index[pick]))
        won = pick[wins]
        if best.dtype != nearest.dtype:
            best = best.astype(object)
        best[won], index[won] = nearest[wins], name[wins]
    changed = np.flatnonzero(index != old)
    to = book.group[index[changed]]
    held[changed, to] = second[changed, to]
    left = changed[old[changed] >= 0]
    group = book.group[old[left]]
    held[left, group] = np.minimum(held[left, group], _below(_root(first_best[left])))
    code[rows], upper[rows], lower[rows] = index, _above(_root(best)), held
    return code, upper, lower, asked


def _lists(values: np.ndarray, kind) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, width).copy()


STATE = "id long, label string, vector {}, code array<int>, upper array<float>, lower array<float>, asked long, sums binary"


@dataclass
class Coder:
    """The parameters of a run; ``books`` are the codebooks of the round."""

    parts: int
    dim: int
    scale: int
    groups: int
    books: list[Book]

    @property
    def width(self) -> int:
        return self.dim // self.parts

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.ascontiguousarray(x[:, p * self.width : (p + 1) * self.width]) for p in range(self.parts)]

    def step(self, started: bool):
        """A round: rows with their next codes and bounds, and one row more for each task, with its sums."""

        def run(batches):
            total = [(0, 0) for _ in self.books]
            empty = None
            for batch in batches:
                rows, x = whole(batch.column(2), self.dim, self.scale)
                n = len(rows)
                kept = batch.take(pa.array(rows))
                shapes = self.parts, self.parts, self.parts * self.groups
                code, upper, lower = (
                    [_flat(kept.column(3 + i), w) for i, w in enumerate(shapes)] if started else [np.zeros((n, w)) for w in shapes]
                )
                lower = lower.reshape(n, self.parts, self.groups)
                out, asked = [], 0
                for p, (part, book) in enumerate(zip(self.cut(x), self.books)):
                    c, u, low, scanned = assign(part, book, code[:, p].astype(np.int64) if started else None, upper[:, p].copy(), lower[:, p].copy())
                    out.append((c, u, low))
                    asked += scanned
                    count, added = sums(part, c, len(book.entries))
                    total[p] = (total[p][0] + count, total[p][1] + added)
                codes, uppers, lowers = (np.stack([o[i] for o in out], 1) for i in range(3))
                spent = np.zeros(n, np.int64)
                spent[:1] = asked
                columns = [
                    *[kept.column(i) for i in range(3)],
                    _lists(codes, pa.int32()),
                    _lists(uppers, pa.float32()),
                    _lists(lowers.reshape(n, -1), pa.float32()),
                    pa.array(spent),
                    pa.nulls(n, pa.binary()),
                ]
                made = pa.RecordBatch.from_arrays(columns, names=NAMES)
                empty = made.schema
                yield made
            if empty is not None:
                last = [*[pa.nulls(1, f.type) for f in empty][:-1], pa.array([pickle.dumps(total)], pa.binary())]
                yield pa.RecordBatch.from_arrays(last, names=NAMES)

        return run

    def tell(self, batches):
        """id, label, code in hex and error of each row."""
        for batch in batches:
            rows, x = whole(batch.column(2), self.dim, self.scale)
            kept = batch.take(pa.array(rows))
            codes = _flat(kept.column(3), self.parts).astype(np.int64)
            errors = np.zeros(len(rows), object)
            for p, (part, book) in enumerate(zip(self.cut(x), self.books)):
                errors = errors + integers(own_distances(part, book, codes[:, p])[:, None])[:, 0]
            names = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            columns = [kept.column(0), kept.column(1), pa.array(names, pa.string()), pa.array([long(e) for e in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])


NAMES = [c.split()[0] for c in STATE.split(", ")]


def _start(rows: DataFrame, entries: int, dim: int, scale: int) -> np.ndarray:
    """The kept vectors with the smallest ids; ``entries`` rows at most come to the driver."""

    def keep(batches):
        for batch in batches:
            kept, _ = whole(batch.column(1), dim, scale)
            yield batch.take(pa.array(kept))

    own = rows.select("id", "vector").where("id is not null")
    found = own.mapInArrow(keep, own.schema).orderBy("id", "vector").limit(entries).collect()
    return integers(np.floor(np.array([r["vector"] for r in found], np.float64).reshape(len(found), dim) * scale))


def train(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, groups: int = GROUPS,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """(rows, codebooks, distances computed in each round): rows have id, label, code and error, and lie in the shared folder.

    See ``encode`` for what is kept and how odd rows count.
    """
    if dim % parts or not 1 <= entries <= 256:
        raise ValueError("dim must be a multiple of parts, and a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), numbers(vectors, vector_col).alias("vector"))
    first = _start(rows, entries, dim, scale)
    if not len(first):
        return spark.createDataFrame([], "id long, label string, code string, error long"), [], []
    width = dim // parts
    coder = Coder(parts, dim, scale, groups, [Book.first(first[:, p * width : (p + 1) * width], groups) for p in range(parts)])
    schema = STATE.format(dict(rows.dtypes)["vector"])
    state, path, asked = rows, None, []
    for turn in range(rounds + 1):
        next_path = fresh_path(spark, "codes")
        state = store(state.mapInArrow(coder.step(turn > 0), schema), next_path)
        if path:
            remove(spark, path)
        path = next_path
        asked.append(state.agg(F.sum("asked")).first()[0])
        if turn < rounds:
            total = _added(state.where("sums is not null").select("sums").rdd.map(lambda r: pickle.loads(r[0])))
            coder.books = [book.moved(means(count, added, book.entries)) for book, (count, added) in zip(coder.books, total)]
        state = state.where("sums is null")
    found = materialise(state.mapInArrow(coder.tell, "id long, label string, code string, error long"), "coded")
    remove(spark, path)
    return found, [b.entries for b in coder.books], asked


def _added(parts):
    """The tasks' sums, added up by tasks; what reaches the driver is one sum for each entry."""

    def add(a, b):
        return b if a is None else a if b is None else [(p[0] + q[0], p[1] + q[1]) for p, q in zip(a, b)]

    return parts.treeAggregate(None, add, add)


def encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per kept vector: id, code (two hex digits for each part), error, label_error, codebooks_sha256.

    Kept are vectors of ``dim`` components, none null and none that ``scale`` times is not finite; others
    can't be cut into the same parts.  A component x becomes floor(scale * x); scale is a power of two.  Codebooks begin
    with the parts of the kept vectors with the smallest ids (equal ids: the smaller vector first; null ids never), fewer
    where there are fewer.  Each round takes the nearest entries, of equally near ones the lower index, and then floors the
    means; an entry without parts stays.  ``error`` is the squared distance over all parts, ``label_error`` its
    sum over rows with the same label, those without one together; what exceeds a long is
    given as the largest long.  Rows with a null or repeated id are vectors like any other.  An empty table, or one whose
    kept vectors all lack an id, gives an empty result; other columns are ignored.
    """
    found, books, _ = train(vectors, parts, entries, rounds, scale, dim, GROUPS, id_col, vector_col, label_col)
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    named = found.withColumn("label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    whole_ = named.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("long").alias("label_error"))
    return salted_lookup(named, "label", "id", whole_).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def encode_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM) -> str:
    """The same in SQL, round by round; every part is a row."""
    width = dim // parts
    steps = [
        f"""kept as (select vec_id, label, row_number() over () as n, list_transform(embedding, lambda x: floor({scale} * x::double)) as v
          from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"parts as materialized (select n, p, v[p * {width} + 1 : (p + 1) * {width}] as v from kept, (select unnest(range({parts})) as p))",
        f"""firsts as (select n, row_number() over (order by vec_id, v) - 1 as e from (select n, vec_id, v from kept where vec_id is not null order by vec_id, v limit {entries}))""",
        "b0 as materialized (select p, e, v from parts join firsts using (n))",
    ]
    for r in range(rounds + 1):
        # doubles are exact here: all terms are whole numbers below 2**53
        gap = "list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v)"
        steps.append(f"a{r} as materialized (select x.n, x.p, any_value(x.v) as v, min(struct_pack(d := ({gap})::bigint, e := b.e)) as best from parts x join b{r} b on b.p = x.p group by x.n, x.p)")
        if r < rounds:
            steps.append(
                f"""b{r + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from b{r} b left join (
                  select p, e, list(floor(s / k) order by i) as v from (
                    select p, e, i, sum(x) as s, count(*) as k from (select p, best.e as e, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by p, e, i)
                  group by p, e) m on m.p = b.p and m.e = b.e)"""
            )
    steps_ = ",\n".join(steps)
    return f"""with {steps_},
coded as (select n, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from a{rounds} group by n),
books as (select sha256(string_agg(array_to_string(list_transform(v, lambda x: x::bigint), ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from kept join coded using (n), books"""
