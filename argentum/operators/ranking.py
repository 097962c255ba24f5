"""Hybrid search: filters, words and vectors fused into one ordered list, and its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.operators import fulltext, predicates, vectors
from argentum.plans.query_parser import QueryPlan

BONUS = 0.15
PAGE, MAX_PAGE = 60, 200


def candidates(images: DataFrame, plan: QueryPlan, queries: list[list[float]] = ()) -> DataFrame:
    """Images that pass the filters, with lexical, sim (null: no vector) and excluded.

    ``lexical`` is the larger of the number of full-text hits and the share of terms
    found as substrings.  Filters, words and vectors are looked at in one pass: nothing is joined.
    """
    terms = [*plan.should, *plan.must]
    texts = {"filename": F.col("filename"), "ocr_text": F.col("ocr_text"), "people": F.array_join("people", " ")}
    # each text is lowered once; what is used more than once stays a column of its own
    low = images.where(predicates.plan_filter(plan)).select(
        "id", "filename", vectors.best_similarity(F.col("embedding"), list(queries)).alias("sim"), *[F.lower(F.coalesce(t, F.lit(""))).alias(f"_{c}") for c, t in texts.items()]
    )
    read = low.withColumn("_hay", F.concat_ws(" ", *[f"_{c}" for c in texts]))
    own = [F.col(f"_{c}") for c in texts]
    judged = F.struct(
        F.greatest(fulltext.score_of(own, terms).cast("double"), predicates.matched_share(F.col("_hay"), terms)).alias("lexical"),
        predicates.has_any_term(F.col("_hay"), plan.must_not).alias("excluded"),
    )
    # a row of its own, so that filters on it don't have it computed again
    rows = read.select("id", "filename", "sim", F.explode(F.array(judged)).alias("text"))
    return rows.select("id", "filename", "text.lexical", "sim", "text.excluded")


def similar(images: DataFrame, plan: QueryPlan, queries: list[list[float]]) -> DataFrame:
    """(sim) of all images that pass the filters: what the threshold is taken from, without reading a text."""
    return images.where(predicates.plan_filter(plan)).select(vectors.best_similarity(F.col("embedding"), list(queries)).alias("sim"))


def search(images: DataFrame, plan: QueryPlan, queries: list[list[float]] = ()) -> DataFrame:
    """(id, filename, score) of what a search keeps, in no order."""
    return ranked(candidates(images, plan, queries), plan, similar(images, plan, queries))


def ranked(found: DataFrame, plan: QueryPlan, sims: DataFrame | None = None) -> DataFrame:
    """(id, filename, score) of the candidates that a search keeps; sims: where their similarities can be read alone."""
    keep = ~F.col("excluded")
    if plan.should or plan.must:
        # the best of all candidates, excluded ones too: one value
        least = (found if sims is None else sims).agg(vectors.threshold(F.max("sim")).alias("least")).scalar()
        keep &= (F.col("lexical") > 0) | F.coalesce(F.col("sim") >= least, F.lit(False))
    sim = F.coalesce("sim", F.lit(0.0))
    score = F.when(
        (F.col("lexical") > 0) & ~F.col("excluded"), 1 + F.col("lexical") + BONUS * F.greatest(sim, F.lit(0.0))
    ).otherwise(sim)
    return found.where(keep).select("id", "filename", score.alias("score"))


def ordered(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Best score first, then by file name and id; a limit beyond an int cuts nothing.

    Hits, small rows, are dealt once before: a sort looks at its input twice, and would read all texts twice.
    """
    out = hits.repartition("id").orderBy(F.desc("score"), "filename", "id")
    return out.limit(limit) if limit and limit < 2**31 else out


def page(
    hits: DataFrame, offset: int = 0, size: int = PAGE, limit: int | None = None, after: tuple[float, str, object] | None = None
) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of the ordered hits, at most MAX_PAGE; ``limit`` cuts before.

    ``after`` is (score, filename, id) of a row: the page then begins behind it, counts its offset
    from there, and costs the same however deep it lies.
    """
    size = min(max(size, 1), MAX_PAGE)
    if limit is not None:
        size = max(0, min(size, limit - offset))
    if after is not None:
        score, name, id_ = (F.lit(x) for x in after)
        behind = (F.col("filename") > name) | ((F.col("filename") == name) & (F.col("id") > id_))
        hits = hits.where((F.col("score") < score) | ((F.col("score") == score) & behind))
    return hits.orderBy(F.desc("score"), "filename", "id").offset(offset).limit(size)


def page_metadata(hits: DataFrame, offset: int = 0, size: int = PAGE, limit: int | None = None) -> DataFrame:
    """One row: total, first and last row of the page, has_more."""
    size = min(max(size, 1), MAX_PAGE)
    total = F.least(F.count("*"), F.lit(min(limit, 2**63 - 1))) if limit is not None else F.count("*")
    return hits.agg(total.cast("long").alias("total")).select(
        "total",
        F.least(F.lit(offset), "total").alias("start"),
        F.least(F.lit(offset + size), "total").alias("end"),
        (F.least(F.lit(offset + size), F.col("total")) < F.col("total")).alias("has_more"),
    )


def hydrate(rows: DataFrame, thumbnails: DataFrame, key: str = "id") -> DataFrame:
    """A page with its thumbnails, empty where there is none; pages of more than MAX_PAGE rows are an error.

    The page comes to the driver, as pages do, and its keys are a filter that reaches the scan of
    the thumbnails: only what it lets through meets the page.
    """
    few = rows.limit(MAX_PAGE + 1).collect()
    if len(few) > MAX_PAGE:
        raise ValueError(f"a page has at most {MAX_PAGE} rows")
    shown = rows.sparkSession.createDataFrame(few, rows.schema)
    found = thumbnails.where(F.col(key).isin([r[key] for r in few])).select(key, "thumbnail").dropDuplicates([key])
    return shown.join(F.broadcast(found), key, "left").withColumn("thumbnail", F.coalesce("thumbnail", F.lit("")))


def _bounds(rows: DataFrame, key: Column, buckets: int) -> list:
    """buckets - 1 keys that cut rows into about equal ranges, from a sample that a hash of the key draws."""
    draws = 32 * buckets
    total = rows.count()
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    drawn = sorted(k for r in rows.where(share < draws / max(1, total)).select(key).collect() if None not in (k := tuple(r[0])))
    return [drawn[len(drawn) * k // buckets] for k in range(1, buckets)] if drawn else []


def _range_of(key: Column, bounds: list, kind: str) -> Column:
    """How many bounds are at most key: a binary search."""
    if not bounds:
        return F.lit(0)
    at = F.array(*[F.struct(*[F.lit(x) for x in b]).cast(kind) for b in bounds])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    fits = lambda p, s: (p + s <= len(bounds)) & (F.get(at, p + s - F.lit(1)) <= key)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda p, s: F.when(fits(p, s), p + s).otherwise(p))


def positions(images: DataFrame, walk: str = "id", buckets: int | None = None) -> DataFrame:
    """images with ``position``: its place by lower-case file name, then by the order of the listing."""
    kind = f"struct<name:string,walk:{images.schema[walk].dataType.simpleString()}>"
    return numbered(images, F.struct(F.lower("filename").alias("name"), F.col(walk).alias("walk")).cast(kind), kind, buckets)


def placed(hits: DataFrame, buckets: int | None = None) -> DataFrame:
    """hits with ``position``: best score first, then by file name and id."""
    kind = f"struct<low:double,name:string,id:{hits.schema['id'].dataType.simpleString()}>"
    return numbered(hits, F.struct((-F.col("score")).alias("low"), F.col("filename").alias("name"), F.col("id").alias("id")).cast(kind), kind, buckets)


def numbered(rows: DataFrame, key: Column, kind: str, buckets: int | None = None) -> DataFrame:
    """rows with ``position`` from 0 by key, a struct of type ``kind``; rows lie in ranges of positions, each sorted.

    Rows are dealt to ranges of the key, one for each shuffle partition, so that what begins alike may have any
    number of rows.  Each range is numbered by itself, and the ranges' sizes (a row for each) say where it begins.
    """
    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_p_part", _range_of(key, _bounds(rows, key, buckets), kind))
    told = ranged.withColumn("_p_nth", F.row_number().over(Window.partitionBy("_p_part").orderBy(key)))
    sizes = ranged.groupBy("_p_part").agg(F.count("*").alias("_p_n"))
    before = Window.orderBy("_p_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_p_part", F.coalesce(F.sum("_p_n").over(before), F.lit(0)).alias("_p_first"))
    met = told.join(F.broadcast(firsts), "_p_part")  # at most ``buckets`` rows
    return met.withColumn("position", F.col("_p_first") + F.col("_p_nth") - 1).select(*rows.columns, "position")


def session_key(root: str, query: str, version: int) -> tuple[str, str, int]:
    """What ranked hits may be reused for: the same root, the very same query, the same state of the catalogue."""
    return root, query, version
