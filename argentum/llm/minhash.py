"""Near-duplicate detection with BagMinHash signatures.

A text is the multiset of its five-word runs.  Each run drives hierarchical Poisson
processes over the integer weight levels: node 0 covers weights [0, 1), node j
covers [2**(j-1), 2**j).  A process is seeded by run and node, its points carry a
time, a level and a signature slot, and those with a level below the run's count
belong to the text.  The first point of each slot is the signature; two texts agree
in a slot with the probability of their weighted Jaccard similarity.

Candidates share a band of the signature and are verified on the whole multisets.
In a bucket all members are first compared with one of them; those still outside
its largest component with another one, a few times.  Where a bucket then still holds
more than one component, all members outside the largest are compared, in blocks,
with every member.  So every pair that shares a band is either compared or already in
one class, and no task holds more than a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.llm import textops
from argentum.llm.common import materialise, salt, salted_lookup, salts, small_batches
from argentum.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
SLOTS, ROWS = 64, 4
#: Members streamed past one block, and members held in one; members compared with a pivot at a time.
STREAMED, HELD, ABREAST = 128, 128, 32
#: Rounds in which the members of a bucket are compared with one of them.
PIVOTS = 2

SIGNED = "id long, row binary, times long, s1 long, s2 long, n long, bands array<long>"
FEATURES = "node long, features array<long>"


def signatures(text: np.ndarray, code: np.ndarray, count: np.ndarray, n_texts: int) -> np.ndarray:
    """BagMinHash signatures, (n_texts, SLOTS); texts without codes are left 0."""
    signature = np.zeros((n_texts, SLOTS), np.uint64)
    weight = np.bincount(text, count, n_texts)
    # enough points for all slots nearly always; texts that lack some try again, further
    reach = np.full(n_texts, SLOTS * (math.log(SLOTS) + 5)) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        pick = todo[text]
        t, c, w = text[pick], code[pick], count[pick]
        points = []
        node = 0
        while len(t):
            rate = 1.0 if node == 0 else float(2 ** (node - 1))
            points.append(_points(t, c, w, node, rate, reach))
            more = w > (1 if node == 0 else 2**node)
            t, c, w = t[more], c[more], w[more]
            node += 1
        text_of, slot, time, name = (np.concatenate(x) for x in zip(*points))
        order = np.argsort(-time, kind="stable")  # the earliest is written last
        at = text_of[order] * SLOTS + slot[order]
        flat = np.zeros(n_texts * SLOTS, np.uint64)
        filled = np.zeros(n_texts * SLOTS, bool)
        flat[at] = name[order]
        filled[at] = True
        done = todo & filled.reshape(n_texts, SLOTS).all(1)
        signature[done] = flat.reshape(n_texts, SLOTS)[done]
        todo &= ~done
        reach[todo] *= 4
    return signature


def _points(text, code, count, node, rate, reach):
    """The points (text, slot, time, name) of one node's processes within reach."""
    with np.errstate(over="ignore"):
        seed = textops.mix(code ^ (textops.ODD * np.uint64(node + 1)))
        out, time, step = [], np.zeros(len(code)), 0
        low = 0.0 if node == 0 else rate
        while len(text):
            step += 1
            name = textops.mix(seed + textops.ODD * np.uint64(step))
            u = ((name >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            left = reach[text] - time
            alive = np.flatnonzero(u > np.exp(-rate * left))
            text, seed, count, name = text[alive], seed[alive], count[alive], name[alive]
            time = time[alive] - np.log(u[alive]) / rate
            second = textops.mix(name ^ textops.ODD)
            slot = (second & np.uint64(SLOTS - 1)).astype(np.int64)
            level = low + (second >> np.uint64(11)).astype(np.float64) * 2.0**-53 * rate
            own = level < count
            out.append((text[own], slot[own], time[own], textops.mix(name)[own]))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(empty, *out))


def _sign(batches):
    """Columns id, row (digest of the text as it is) and text: signature bands and word digest of each.

    Rows that repeat in a batch go on once, with their number.
    """
    hasher = textops.Hasher()
    for batch in batches:
        seen: dict = {}
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            seen.setdefault(key, []).append(i)
        times = pa.array([len(x) for x in seen.values()], pa.int64())
        if len(seen) < batch.num_rows:
            batch = batch.take(pa.array([x[0] for x in seen.values()], pa.int64()))
        ids, row_of = batch.column(0), batch.column(1)
        for row, data, cuts in textops.chunks(batch.column(2)):
            n = len(cuts) - 1
            hashes, firsts, a, b = hasher.words(data, cuts)
            text, _, code = textops.windows(hashes, firsts, WIDTH)
            sign = signatures(*textops.multiset(text, code), n)
            with np.errstate(over="ignore"):
                codes = np.zeros((n, SLOTS // ROWS), np.uint64)
                for k in range(ROWS):
                    codes = codes * textops.ODD + sign.reshape(n, -1, ROWS)[:, :, k]
                codes = textops.mix(codes + np.arange(SLOTS // ROWS, dtype=np.uint64))
            s1, s2 = textops.word_digests(data, cuts, a, b, firsts)
            some = np.diff(firsts) > 0
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(row, n),
                    row_of.slice(row, n),
                    times.slice(row, n),
                    pa.array(s1),
                    pa.array(s2),
                    pa.array(np.diff(firsts).astype(np.int64)),
                    textops.list_array(codes[some].astype(np.int64).ravel(), np.where(some, SLOTS // ROWS, 0)),
                ],
                names=[c.split()[0] for c in SIGNED.split(", ")],
            )


def _features(batches):
    hasher = textops.Hasher()
    for batch in batches:
        for row, data, cuts in textops.chunks(batch.column(1)):
            hashes, firsts, _, _ = hasher.words(data, cuts)
            text, _, code = textops.windows(hashes, firsts, WIDTH)
            at = np.searchsorted(text, np.arange(len(cuts)))
            sets = [textops.occurrences(code[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, len(sets)),
                    textops.list_array(np.concatenate(sets), np.diff(at)),
                ],
                names=["node", "features"],
            )


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    shared = int((a[at] == b).sum())
    return shared / (len(a) + len(b) - shared)


def _compare(threshold):
    def compare(batches):
        """Held rows of a group come first; each streamed row is compared with them."""
        group, held, root = None, [], {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for batch in batches:
            g = list(zip(*(batch.column(i).to_pylist() for i in range(2))))
            streamed, ids, labels = (batch.column(i).to_pylist() for i in (2, 3, 4))
            lists = batch.column(5)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = []
            for i, key in enumerate(g):
                mine = values[offsets[i] : offsets[i + 1]]
                if key != group:
                    group, held, root = key, [], {}
                if not streamed[i]:
                    held.append((ids[i], labels[i], mine.copy()))
                    continue
                for other, label, theirs in held:
                    short, long_ = sorted((len(mine), len(theirs)))
                    if other == ids[i] or short < threshold * long_ or find(label) == find(labels[i]):
                        continue
                    if overlap(theirs, mine) >= threshold:
                        root[find(label)] = find(labels[i])
                        out.append((other, ids[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"]
            )

    return compare


def with_representative(rows: DataFrame, keys: list[str], low: Column, by: str) -> DataFrame:
    """rows with ``rep``, the least ``low`` among rows of equal keys; copies fold by salt first."""
    salted = rows.withColumn("_salt", salt(by, salts(rows.sparkSession)))
    parts = salted.groupBy(*keys, "_salt").agg(F.min(low).alias("low"))
    whole = parts.groupBy(*keys).agg(F.min("low").alias("rep"))
    answer = parts.drop("low").join(whole, keys)
    return salted.join(answer, [*keys, "_salt"]).drop("_salt")


def _verify(grouped: DataFrame, threshold: float, name: str) -> DataFrame:
    """Edges found in groups (g1, g2).  The groups of one bucket, numbered by g2, go to one task after the other."""
    n = salts(grouped.sparkSession)
    laid = grouped.select("g1", "g2", "streamed", "id", "label", "features")
    laid = laid.repartitionById(n, F.pmod(F.pmod(F.xxhash64("g1"), F.lit(n)) + F.col("g2"), F.lit(n)).cast("int"))
    laid = laid.sortWithinPartitions("g1", "g2", "streamed")
    return materialise(laid.mapInArrow(_compare(threshold), "a long, b long"), name)


def _digest(text_col: str) -> Column:
    """128 bits of the SHA-256 digest of a text as it is; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256), 1, 32))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row and text; id and row name a row up to repeats of both id and text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), _digest(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))


def _nodes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(named, reps): every row with its node, each node with the row that stands for it.

    Rows with the same words are one node, named by their least id.  Where that id has
    other texts too, those nodes get numbers above all ids instead.
    """
    rows = signed.select("id", "row", "s1", "s2", "n")
    named = materialise(
        with_representative(rows, ["s1", "s2", "n"], F.struct("id", "row"), "id").select(
            "id", "row", F.col("rep.id").alias("rep"), F.col("rep.row").alias("rep_row")
        ),
        "named",
    )
    reps = named.where((F.col("id") == F.col("rep")) & (F.col("row") == F.col("rep_row"))).select("rep", "rep_row")
    shared = reps.groupBy("rep").agg(F.count("*").alias("texts"), F.min("rep_row").alias("first")).where("texts > 1")
    if shared.isEmpty():
        return named.withColumn("node", F.col("rep")), reps.withColumn("node", F.col("rep"))
    top = signed.agg(F.max("id")).first()[0]
    further = materialise(
        reps.join(shared.withColumnRenamed("rep", "of"), F.col("rep") == F.col("of"))
        .where("rep_row <> first")
        .select(F.struct("rep", "rep_row").alias("whose"), (F.lit(top) + 1 + F.monotonically_increasing_id()).alias("node")),
        "nodes",
    )

    def numbered(df: DataFrame, by: str) -> DataFrame:
        found = salted_lookup(df.withColumn("whose", F.struct("rep", "rep_row")), "whose", by, further)
        return found.withColumn("node", F.coalesce("node", "rep")).drop("whose")

    return materialise(numbered(named, "id"), "named"), materialise(numbered(reps, "rep"), "reps")


def _classified(rows: DataFrame, threshold: float) -> tuple[DataFrame, bool]:
    """(rows, repeated): each row (id, row) once, with rep, rep_row, node and head.

    ``head`` is the node that names the class; it is repeated if the table has rows with both id and text alike.
    """
    signed = materialise(rows.where("id is not null").mapInArrow(_sign, SIGNED), "signed")
    repeated = not signed.groupBy("id", "row").agg(F.sum("times").alias("times")).where("times > 1").isEmpty()
    if repeated:
        signed = materialise(signed.dropDuplicates(["id", "row"]), "signed")
    named, reps = _nodes(signed)
    return _headed(named, _found(rows, signed, reps, threshold)), repeated


def _found(rows: DataFrame, signed: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the nodes that have links."""
    spark = rows.sparkSession
    bands = signed.select(F.col("id").alias("b_id"), F.col("row").alias("b_row"), "bands")
    slots = materialise(
        reps.join(bands, (F.col("rep") == F.col("b_id")) & (F.col("rep_row") == F.col("b_row")))
        .select(F.col("node").alias("rep"), F.posexplode("bands").alias("band", "code"))
        .select("rep", F.xxhash64("band", "code").alias("bucket"))
        .distinct(),
        "slots",
    )

    # buckets with members of more than one text; of buckets with equal members one is enough
    salted = slots.withColumn("salt", salt("rep", salts(spark)))
    parts = salted.groupBy("bucket", "salt").agg(
        F.count("*").alias("members"), F.min("rep").alias("low"), F.bit_xor(F.xxhash64("rep")).alias("sig")
    )
    whole = parts.groupBy("bucket").agg(
        F.sum("members").alias("members"), F.min("low").alias("low"), F.bit_xor("sig").alias("sig")
    ).where("members > 1")
    once = whole.groupBy("members", "low", "sig").agg(F.min("bucket").alias("bucket"))
    open_parts = parts.select("bucket", "salt").join(once, "bucket")
    inside = materialise(
        salted.join(open_parts, ["bucket", "salt"]).select("bucket", "rep", "low", "members"), "inside"
    )
    if inside.isEmpty():
        return spark.createDataFrame([], "node long, component long")

    # texts are brought together by id at every size of the table
    wanted = (
        reps.join(inside.select(F.col("rep").alias("w")).distinct(), F.col("node") == F.col("w"))
        .select(F.col("rep").alias("w_id"), F.col("rep_row").alias("w_row"), F.col("node").alias("w_node"))
    )
    features = materialise(
        rows.join(wanted, (F.col("id") == F.col("w_id")) & (F.col("row") == F.col("w_row")))
        .select("w_node", "text")
        .mapInArrow(_features, FEATURES)
        .dropDuplicates(["node"]),
        "features",
    )
    feat = lambda c: features.withColumnRenamed("node", c)

    # every member against one of its bucket; what is left open, against another one
    edges = spark.createDataFrame([], "a long, b long")
    open_ = inside.select("bucket", "rep", "members", F.col("rep").alias("label"), F.col("low").alias("pivot"), F.col("low").alias("pivot_label"))
    for turn in range(PIVOTS):
        pairs = materialise(
            open_.where("label <> pivot_label")
            .groupBy("pivot", "rep")
            .agg(F.max("label").alias("label"), F.max("pivot_label").alias("pivot_label"), F.ceil(F.max("members") / ABREAST).alias("parts"))
            .select("pivot", "rep", "label", "pivot_label", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("g2")),
            "pairs",
        )
        first = pairs.groupBy("pivot", "g2").agg(F.max("pivot_label").alias("label")).join(feat("pivot"), "pivot").select(
            F.col("pivot").alias("g1"), "g2", F.lit(False).alias("streamed"), F.col("pivot").alias("id"), "label", "features"
        )
        rest = pairs.join(feat("rep"), "rep").select(
            F.col("pivot").alias("g1"), "g2", F.lit(True).alias("streamed"), F.col("rep").alias("id"), "label", "features"
        )
        edges = edges.unionByName(_verify(first.unionByName(rest), threshold, "edges"))
        found = components(edges)
        open_ = _still_open(inside, found, turn)
        if open_.isEmpty():
            return found

    # buckets that still hold several components: outsiders against all members
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    outsiders = F.col("members") - F.col("k")
    laid = open_.withColumns({"blocks": F.ceil(outsiders / HELD), "streams": F.ceil(F.col("members") / STREAMED)})
    held = laid.where("label <> pivot_label").select(
        "bucket", "rep", "label", "streams", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), spread(F.col("streams")).alias("stream"), F.lit(False).alias("streamed")
    )
    streamed = laid.select(
        "bucket", "rep", "label", "streams", spread(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("rep"), "streams").alias("stream"), F.lit(True).alias("streamed")
    )
    again = held.unionByName(streamed).join(feat("rep"), "rep").select(
        F.col("bucket").alias("g1"), (F.col("block") * F.col("streams") + F.col("stream")).alias("g2"), "streamed", F.col("rep").alias("id"), "label", "features"
    )
    edges = edges.unionByName(_verify(again, threshold, "edges"))
    return components(edges)


def _still_open(inside: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """Members of buckets with several components: bucket, rep, members, label, pivot, pivot_label, k.

    The pivot is a member of the bucket's largest component, another one each turn;
    k is the size of that component in the bucket.
    """
    labelled = materialise(
        inside.join(found, F.col("rep") == F.col("node"), "left").select(
            "bucket", "rep", "members", F.coalesce("component", "rep").alias("label")
        ),
        "labelled",
    )
    sizes = labelled.groupBy("bucket", "label").agg(
        F.count("*").alias("k"), F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep")).alias("pick")
    )
    tops = (
        sizes.groupBy("bucket")
        .agg(F.max(F.struct("k", "label", F.col("pick.rep").alias("rep"))).alias("top"), F.count("*").alias("labels"))
        .where("labels > 1")
        .drop("labels")
    )
    return materialise(
        salted_lookup(labelled, "bucket", "rep", tops, "inner").select(
            "bucket", "rep", "members", "label", F.col("top.rep").alias("pivot"), F.col("top.label").alias("pivot_label"), F.col("top.k").alias("k")
        ),
        "open",
    )


def _headed(named: DataFrame, found: DataFrame) -> DataFrame:
    """named with ``head``; a node that many rows share is split by Spark, as one side has a row for each node."""
    heads = found.select(F.col("node").alias("h_node"), F.col("component").alias("head"))
    met = named.join(heads, F.col("node") == F.col("h_node"), "left").drop("h_node")
    return met.withColumn("head", F.coalesce("head", "node"))


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, class_id, copy_of.

    Texts whose multisets of five-word runs reach the threshold in weighted
    Jaccard similarity are linked; a class is a connected component, named by
    its least id.  ``copy_of`` is the least id with the same words in the same
    order.  A text of fewer than five words is one run; texts without words
    (null, empty, punctuation) are copies of each other.  A row with a null id
    takes no part and has nulls.  Repeated rows repeat their answer.  Rows that share an id but not a text
    are texts of their own: the first by its digest goes by the id, and the classes of which others are the least
    are named by numbers above all ids, which hold within one result.  An empty table gives an empty result;
    other columns are ignored, texts may be of any length.
    """
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    named, repeated = _classified(rows, threshold)
    named = named.withColumn("class_id", F.col("head"))
    if repeated:  # each row of the table hears of the one that it repeats
        named = named.select(F.col("id").alias("n_id"), F.col("row").alias("n_row"), "class_id", "rep")
        named = rows.where("id is not null").select("id", "row").join(named, (F.col("id") == F.col("n_id")) & (F.col("row") == F.col("n_row")), "left")
    nothing = F.lit(None).cast("long")
    nulls = rows.where("id is null").select("id", nothing.alias("class_id"), nothing.alias("copy_of"))
    return named.select("id", "class_id", F.col("rep").alias("copy_of")).unionByName(nulls).withColumnRenamed("id", id_col)


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that name their class, with all columns; see ``classes`` for links and odd texts.

    Of rows that repeat id and text one stays.  Rows that share an id but not a text are
    texts of their own.  Rows with a null id stay.  An empty table gives an empty
    result.  Other columns may have any name that does not begin with ``_g_``.
    """
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    found, repeated = _classified(rows, threshold)
    stays = (F.col("node") == F.col("head")) & (F.col("id") == F.col("rep")) & (F.col("row") == F.col("rep_row"))
    gone = found.where(~stays).select(F.col("id").alias("_g_id"), F.col("row").alias("_g_row"))
    own = docs.withColumns({"_g_of": F.col(id_col).cast("long"), "_g_text": _digest(text_col)})
    kept = own.join(gone, (F.col("_g_of") == F.col("_g_id")) & (F.col("_g_text") == F.col("_g_row")), "left_anti")
    if repeated:
        named = kept.where("_g_of is not null").dropDuplicates(["_g_of", "_g_text"])
        kept = named.unionByName(kept.where("_g_of is null"))
    return kept.select(docs.columns)
