"""The registered queries of the photo catalogue, each with its SQL.

All run over their whole tables; a limit stands only where it is the operator itself.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from argentum.functions import faces, media
from argentum.operators import fulltext, maintenance, people, predicates, ranking, records, textindex, vectors
from argentum.plans import views
from argentum.plans.query_parser import EXTENSIONS, QueryPlan, parse
from argentum.sources import files, pictures

PLAN = QueryPlan(should=["license", "the"], must_not=["idiot"], date_from="2000-01-01 00:00:00", date_to="2999-12-31 23:59:59")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(name, sql=None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def _images(name, sql, *columns):
    """A query over the view of images, or over some of its columns."""

    def add(function):
        return _register(name, f"with {views.IMAGES}\n{sql}")(lambda spark, d: function(views.images(spark, d, columns or None)))

    return add


def _six(x):
    return F.floor(x * 1e6 + 0.5) / 1e6


def six(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


# --- filters ---------------------------------------------------------------

HAY = "lower(concat_ws(' ', filename, coalesce(ocr_text, ''), array_to_string(people, ' ')))"
KEY = "coalesce(captured_at, strftime(make_timestamp(try_cast(modified_at as bigint) * 1000000), '%Y-%m-%d %H:%M:%S'))"
EXT = r"lower(regexp_extract(filename, '[^/]\.([^./]+)$', 1))"


@_images("filter_supported_ext", f"select id, filename from images where {EXT} in ('jpg', 'jpeg', 'png', 'webp', 'gif', 'bmp')", "id", "filename")
def _(images):
    return images.where(predicates.has_extension(F.col("filename"), EXTENSIONS)).select("id", "filename")


@_images("filter_extension", f"select id, filename from images where {EXT} in ('jpeg')", "id", "filename")
def _(images):
    return images.where(predicates.has_extension(F.col("filename"), ["jpeg"])).select("id", "filename")


@_images("filter_face_required", "select id from images where len(face_group_ids) > 0", "id", "face_group_ids")
def _(images):
    return images.where(predicates.has_faces(F.col("face_group_ids"))).select("id")


@_images("filter_face_forbidden", "select id from images where len(face_group_ids) = 0", "id", "face_group_ids")
def _(images):
    return images.where(~predicates.has_faces(F.col("face_group_ids"))).select("id")


@_images("filter_people_include", "select id from images where list_contains(list_transform(people, lambda p: lower(p)), 'nation_1')", "id", "people")
def _(images):
    return images.where(predicates.has_all_people(F.col("people"), ["Nation_1"])).select("id")


@_images("filter_people_exclude", "select id from images where not list_contains(list_transform(people, lambda p: lower(p)), 'nation_1')", "id", "people")
def _(images):
    return images.where(predicates.has_no_people(F.col("people"), ["Nation_1"])).select("id")


@_images("filter_people_only", "select id from images where len(people) > 0", "id", "people")
def _(images):
    return images.where(F.size("people") > 0).select("id")


@_images("date_key", f"select id, {KEY} as date_key from images", "id", "captured_at", "modified_at")
def _(images):
    return images.select("id", predicates.date_key(F.col("captured_at"), F.col("modified_at")).alias("date_key"))


@_images("filter_date_range", f"select id from images where {KEY} between '2024-01-01 06:00:00' and '2024-01-02 11:59:59'", "id", "captured_at", "modified_at")
def _(images):
    key = predicates.date_key(F.col("captured_at"), F.col("modified_at"))
    return images.where(predicates.in_dates(key, "2024-01-01 06:00:00", "2024-01-02 11:59:59")).select("id")


@_images(
    "filter_plan_conjunction",
    f"select id from images where {EXT} in ('jpg', 'png') and len(face_group_ids) > 0 and {KEY} between '2000-01-01 00:00:00' and '2999-12-31 23:59:59'", "id", "filename", "captured_at", "modified_at", "face_group_ids")
def _(images):
    plan = QueryPlan(extensions=["jpg", "png"], face="required", date_from=PLAN.date_from, date_to=PLAN.date_to)
    return images.where(predicates.plan_filter(plan)).select("id")


@_images("haystack_project", f"select id, md5({HAY}) as hay from images", "id", "filename", "ocr_text", "people")
def _(images):
    return images.select("id", F.md5(predicates.haystack()).alias("hay"))


@_images("term_contains", f"select id from images where contains({HAY}, 'of the') or contains(regexp_replace({HAY}, '[\\s\\p{{Z}}]+', '', 'g'), 'ofthe')", "id", "filename", "ocr_text", "people")
def _(images):
    return images.where(predicates.has_term(predicates.haystack(), "of the")).select("id")


@_images("must_not_exclude", f"select id from images where not (contains({HAY}, 'license') or contains(regexp_replace({HAY}, '[\\s\\p{{Z}}]+', '', 'g'), 'license'))", "id", "filename", "ocr_text", "people")
def _(images):
    return images.where(~predicates.has_any_term(predicates.haystack(), ["license"])).select("id")


# --- full text -------------------------------------------------------------

TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(ocr_text, '')), '[^\p{L}\p{N}\p{Co}]+'), lambda t: t <> '')"


def _phrase(c):
    return rf"(' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: t <> ''), ' ') || ' ')"


def _hit(term):
    return "(" + " or ".join(f"contains({_phrase(c)}, ' {term} ')" for c in ("filename", "ocr_text", "array_to_string(people, ' ')")) + ")"


def _texts():
    return [F.col("filename"), F.col("ocr_text"), F.array_join("people", " ")]


@_images("fts_tokenize", f"select id, len({TOKENS}) as n, md5(array_to_string({TOKENS}, ' ')) as digest from images", "id", "ocr_text")
def _(images):
    words = fulltext.tokens(F.col("ocr_text"))
    return images.select("id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, " ")).alias("digest"))


@_images("fts_term_match", f"select id from images where {_hit('license')}", "id", "filename", "ocr_text", "people")
def _(images):
    return images.where(fulltext.matches(_texts(), "license")).select("id")


@_images("fts_phrase_match", f"select id from images where {_hit('of the')}", "id", "filename", "ocr_text", "people")
def _(images):
    return images.where(fulltext.matches(_texts(), "of-the")).select("id")


@_images(
    "fts_score",
    f"select id, score from (select id, (case when {_hit('license')} then 1 else 0 end) + 2 * (case when {_hit('the')} then 1 else 0 end) as score from images) where score > 0", "id", "filename", "ocr_text", "people")
def _(images):
    low = fulltext.lowered(_texts())
    scores = F.transform(F.array(low), lambda x: fulltext.score_in(x, 3, ["license", "the", "the"]))
    return images.select("id", F.explode(scores).alias("score")).where("score > 0")  # scored once, then filtered


@_images("fts_must_not", f"select id from images where {_hit('the')} and not {_hit('license')}", "id", "filename", "ocr_text", "people")
def _(images):
    return images.where(fulltext.matches(_texts(), "the") & ~fulltext.matches(_texts(), "license")).select("id")


# --- stored index ----------------------------------------------------------

INDEXED = ["id", "filename", "ocr_text", "people"]


def _postings_sql(images, name="postings"):
    field = lambda k, c: f"""select id, {k} as field, unnest(w) as term, generate_subscripts(w, 1) - 1 as place
      from (select id, list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: t <> '') as w from {images})"""  # noqa: E731
    each = " union all ".join(field(k, c) for k, c in enumerate(("filename", "ocr_text", "array_to_string(people, ' ')")))
    return f"""{name} as (select id, field, term, count(*) as n, string_agg(place, ',' order by place) as places from ({each}) group by id, field, term)"""


#: What is held of each image, as one row: bounded by its own text.
HELD_SQL = "select id, field, count(*) as terms, sum(n)::bigint as words, md5(string_agg(term || ':' || places, ' ' order by term)) as digest from"


def _held(postings):
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "places"))), lambda x: F.concat_ws(":", x["term"], F.array_join(x["places"], ","))), " ")
    return postings.groupBy("id", F.col("field").cast("int").alias("field")).agg(
        F.count("*").alias("terms"), F.sum(F.size("places")).alias("words"), F.md5(told).alias("digest")
    )


@_images("index_build", f", {_postings_sql('images')} {HELD_SQL} postings group by id, field", *INDEXED)
def _(images):
    return _held(textindex.postings(images))


#: Every third image has another text, and every tenth is gone.
CHANGED = "changed as (select * replace (case when id % 3 = 0 then 'New text, new: ' || filename else ocr_text end as ocr_text) from images where id % 10 <> 0)"


@_images("index_update", f", {CHANGED}, {_postings_sql('changed')} {HELD_SQL} postings group by id, field", *INDEXED)
def _(images):
    fresh = images.where("id % 3 = 0 and id % 10 <> 0").withColumn("ocr_text", F.concat(F.lit("New text, new: "), "filename"))
    return _held(textindex.changed(textindex.postings(images), fresh, images.where("id % 10 = 0"), segment=1))


@_images(
    "index_search",
    f", scored as (select id, {_hit('license')}::int + 2 * {_hit('of the')}::int as score from images where not {_hit('idiot')}) select id, score from scored where score > 0",
    *INDEXED,
)
def _(images):
    return textindex.scores(textindex.postings(images), ["license", "of-the", "of-the"], must_not=["idiot"])


# --- vectors ---------------------------------------------------------------

COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
SIMS = """
sims as (
  select i.id, max(list_cosine_similarity(i.embedding::double[], q.embedding::double[])) as sim
  from images i, embeddings q where q.vec_id in (0, 1) and i.embedding is not null group by i.id
)"""


@_register("cosine_pairs", f"select a.vec_id as a, b.vec_id as b, {six(COS)} as sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(spark, d):
    a = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = a.select((F.col("a") - 1).alias("k"), F.col("a").alias("b"), F.col("x").alias("y"))
    return a.join(b, F.col("a") == F.col("k")).select("a", "b", _six(vectors.cosine(F.col("x"), F.col("y"))).alias("sim"))


@_register(
    "normalize_vectors",
    "select vec_id, "
    + six("list_sum(list_transform(embedding, lambda x: x::double * x::double))")
    + " as square, "
    + six("embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))")
    + " as first from embeddings",
)
def _(spark, d):
    v = F.col("embedding")
    return views.table(spark, d, "embeddings").select(
        "vec_id", _six(vectors.dot(v, v)).alias("square"), _six(F.get(vectors.normalize(v), F.lit(0))).alias("first")
    )


def _sims(spark, d):
    return vectors.similarities(views.images(spark, d, ["id", "embedding"]), views.queries(spark, d), "id")


@_register("knn_exhaustive", f"with {views.IMAGES},{SIMS} select id, {six('sim')} as sim from sims")
def _(spark, d):
    return _sims(spark, d).select("id", _six(F.col("sim")).alias("sim"))


@_register("knn_topk", f"with {views.IMAGES},{SIMS} select id, {six('sim')} as sim from sims order by sims.sim desc, id limit 10")
def _(spark, d):
    return vectors.nearest(_sims(spark, d), 10, "id").select("id", _six(F.col("sim")).alias("sim"))


@_register("semantic_threshold", f"with {views.IMAGES},{SIMS} select {six('greatest(coalesce(max(sim) - 0.07, 0.2), 0.2)')} as least from sims where id > 1")
def _(spark, d):
    return _sims(spark, d).where("id > 1").agg(_six(vectors.threshold(F.max("sim"))).alias("least"))


@_register("knn_max_over_queries", f"with {views.IMAGES},{SIMS} select id, {six('sim')} as sim from sims where id % 2 = 0")
def _(spark, d):
    some = views.images(spark, d, ["id", "embedding"]).where("id % 2 = 0")
    return some.select("id", vectors.best_similarity(F.col("embedding"), views.queries(spark, d)).alias("sim")).where("sim is not null").select("id", _six(F.col("sim")).alias("sim"))


@_register(
    "nearest_group",
    f"""with g as (select vec_id, 'face-' || label || '-' || vec_id as group_id, embedding from embeddings where vec_id % 20 = 0),
    s as (select a.vec_id, b.group_id, {COS} as sim from embeddings a, g b)
    select vec_id, group_id, {six('sim')} as sim from (
      select *, row_number() over (partition by vec_id order by sim desc, group_id desc) as n from s where sim >= 0.2) where n = 1""",
)
def _(spark, d):
    all_ = views.table(spark, d, "embeddings")
    groups = all_.where("vec_id % 20 = 0").select(F.concat(F.lit("face-"), "label", F.lit("-"), "vec_id").alias("group_id"), F.col("embedding").alias("centroid"))
    return vectors.nearest_group(all_, groups, "vec_id", "embedding", "centroid", 0.2).select("vec_id", "group_id", _six(F.col("sim")).alias("sim"))


@_register(
    "knn_each",
    f"""with s as (select a.vec_id as query, b.vec_id, {COS} as sim from embeddings a, embeddings b where a.vec_id % 20 = 0)
    select query, vec_id, {six('sim')} as sim, n as place from (
      select *, row_number() over (partition by query order by round(sim, 12) desc, vec_id) as n from s) where n <= 10""",
)
def _(spark, d):
    all_ = views.table(spark, d, "embeddings")
    return vectors.nearest_each(all_, all_.where("vec_id % 20 = 0"), 10, "vec_id", "embedding").select("query", "vec_id", _six(F.col("sim")).alias("sim"), "place")


@_register(
    "match_known_people",
    f"""with k as (select vec_id as place, 'face-' || vec_id as id, 'person ' || label as name, embedding from embeddings where vec_id % 25 = 3),
    s as (select a.vec_id, b.id, b.name, b.place, {COS} as sim from embeddings a, k b)
    select vec_id, id, name, {six('sim')} as sim from (
      select *, row_number() over (partition by vec_id order by sim desc, place desc) as n from s where sim >= 0.45) where n = 1""",
)
def _(spark, d):
    all_ = views.table(spark, d, "embeddings")
    known = all_.where("vec_id % 25 = 3").select(
        F.col("vec_id").alias("place"), F.concat(F.lit("face-"), "vec_id").alias("id"), F.concat(F.lit("person "), "label").alias("name"), "embedding"
    )
    return people.match_known(all_, known, "vec_id", "embedding").select("vec_id", "id", "name", _six(F.col("sim")).alias("sim"))


# --- ranking ---------------------------------------------------------------


def _share(term):
    return f"case when contains({HAY}, '{term}') or contains(regexp_replace({HAY}, '[\\s\\p{{Z}}]+', '', 'g'), '{term}') then 1.0 else 0.0 end"


CANDIDATES = f"""
candidates as (
  select i.id, filename,
         greatest(((case when {_hit('license')} then 1 else 0 end) + (case when {_hit('the')} then 1 else 0 end))::double,
                  (({_share('license')}) + ({_share('the')}))::double / 2) as lexical,
         sim, ({_share('idiot')}) > 0 as excluded
  from images i left join sims s on s.id = i.id
  where {KEY} between '2000-01-01 00:00:00' and '2999-12-31 23:59:59'
),
hits as (
  select id, filename,
         case when lexical > 0 then 1 + lexical + 0.15 * greatest(coalesce(sim, 0), 0) else coalesce(sim, 0) end as score
  from candidates, (select greatest(coalesce(max(sim) - 0.07, 0.2), 0.2) as least from candidates)
  where not excluded and (lexical > 0 or coalesce(sim >= least, false))
)"""
HYBRID = f"with {views.IMAGES},{SIMS},{CANDIDATES}"


SEARCHED = ["id", "filename", "ocr_text", "people", "face_group_ids", "captured_at", "modified_at", "embedding"]


def _candidates(spark, d):
    return ranking.candidates(views.images(spark, d, SEARCHED), PLAN, views.queries(spark, d))


def _hits(spark, d, plan=PLAN):
    return ranking.search(views.images(spark, d, SEARCHED), plan, views.queries(spark, d))


@_register("hybrid_candidates", f"{HYBRID} select id, lexical, {six('sim')} as sim, excluded from candidates")
def _(spark, d):
    return _candidates(spark, d).select("id", "lexical", _six(F.col("sim")).alias("sim"), "excluded")


@_register("lexical_score", f"{HYBRID} select id, case when excluded then 0.0 else lexical end as lexical from candidates")
def _(spark, d):
    return _candidates(spark, d).select("id", F.when(F.col("excluded"), 0.0).otherwise(F.col("lexical")).alias("lexical"))


@_register("hybrid_filter", f"{HYBRID} select id from hits")
def _(spark, d):
    return _hits(spark, d).select("id")


@_register("hybrid_score", f"{HYBRID} select id, {six('score')} as score from hits")
def _(spark, d):
    return _hits(spark, d).select("id", _six(F.col("score")).alias("score"))


#: A query as a user types it; its terms, filters and limit come out of the words.
TYPED = "license the 不要idiot 最多 40 張"


@_register("search_text", f"{HYBRID} select id, filename from (select * from hits order by score desc, filename, id limit 40) order by score desc, filename, id limit 30 offset 15")
def _(spark, d):
    names = [r["name"] for r in people.known_people(views.images(spark, d, ["people"])).collect()]  # a row for each person
    plan = parse(TYPED, names)
    return ranking.page(_hits(spark, d, plan), 15, 30, plan.limit).select("id", "filename")


@_register("page_after", f"{HYBRID} select id, filename from hits order by score desc, filename, id limit 60 offset 60")
def _(spark, d):
    hits = _hits(spark, d)
    last = ranking.page(hits).collect()[-1]
    return ranking.page(hits, after=(last["score"], last["filename"], last["id"])).select("id", "filename")


@_images("index_position", "select id, row_number() over (order by lower(filename), id) - 1 as position from images", "id", "filename")
def _(images):
    return ranking.positions(images).select("id", "position")


@_register("hybrid_search", f"{HYBRID} select id, filename, {six('score')} as score from hits")
def hybrid_search(spark, d):
    return ranking.ordered(_hits(spark, d)).select("id", "filename", _six(F.col("score")).alias("score"))


@_register("hybrid_limit", f"{HYBRID} select id, filename from hits order by score desc, filename, id limit 20")
def _(spark, d):
    return ranking.ordered(_hits(spark, d), 20).select("id", "filename")


@_register("page_offset_limit", f"{HYBRID} select id, filename from hits order by score desc, filename, id limit 60 offset 60")
def _(spark, d):
    return ranking.page(_hits(spark, d), 60).select("id", "filename")


@_register("page_metadata", f'{HYBRID} select count(*) as total, least(60, count(*)) as start, least(120, count(*)) as "end", least(120, count(*)) < count(*) as has_more from hits')
def _(spark, d):
    return ranking.page_metadata(_hits(spark, d), 60).select("total", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "has_more")


@_register(
    "page_hydrate",
    f"{HYBRID},{views.THUMBS} select h.id, coalesce(thumbnail, '') as thumbnail from (select * from hits order by score desc, filename, id limit 60) h left join thumbs t on t.id = h.id",
)
def _(spark, d):
    thumbs = views.thumbnails(views.images(spark, d, ["id", "root", "path"])).select("id", "thumbnail")
    return ranking.hydrate(ranking.page(_hits(spark, d)).select("id"), thumbs).select("id", "thumbnail")


@_images("browse_page", "select id, filename from images order by lower(filename), id limit 60 offset 60", "id", "filename")
def _(images):
    return images.orderBy(F.lower("filename"), "id").offset(60).limit(60).select("id", "filename")


# --- maintenance -----------------------------------------------------------


LISTED = ["id", "root", "path", "filename", "bytes", "modified_at", "face_group_ids"]


def _snapshots(spark, d):
    now = views.images(spark, d, LISTED)
    return now, views.old_snapshot(now), views.thumbnails(now)


STATUS = f"""with {views.IMAGES},{views.OLD},{views.THUMBS},
status as (
  select i.*, case when o.path is null then 'new' when not coalesce(i.bytes = o.bytes and i.modified_at = o.modified_at, false) then 'changed'
                   when t.path is null then 'reuse_needs_thumb' else 'reuse' end as status
  from images i left join old o on o.root = i.root and o.path = i.path left join thumbs t on t.root = i.root and t.path = i.path
)"""


@_register("change_detection", f"{STATUS} select id, status from status")
def _(spark, d):
    return maintenance.changes(*_snapshots(spark, d)).select("id", "status")


@_register(
    "scan_summary",
    f"""{STATUS} select count(*) as total, count(*) filter (status <> 'reuse') as to_process, count(*) filter (status like 'reuse%' or id % 17 <> 0) as indexed,
    count(*) filter (status like 'reuse%') as reused, count(*) filter (status not like 'reuse%' and id % 17 = 0) as skipped,
    coalesce(sum(len(face_group_ids)) filter (status like 'reuse%' or id % 17 <> 0), 0)::bigint as faces_detected, 10::bigint as face_groups from status""",
)
def _(spark, d):
    now, old, thumbs = _snapshots(spark, d)
    return maintenance.counters(maintenance.changes(now, old, thumbs), now.where("id % 17 <> 0"), 10)


@_register("upsert_images", f"with {views.IMAGES},{views.OLD} select id, path, bytes from old where path not in (select path from images where id % 3 = 0) union all select id, path, bytes from images where id % 3 = 0")
def _(spark, d):
    now, old, _ = _snapshots(spark, d)
    new = now.where("id % 3 = 0")
    earlier = new.withColumn("bytes", F.lit(-1).cast("long"))
    unread = now.where("id % 3 = 1").withColumn("bytes", F.lit(None).cast("long"))
    return maintenance.upsert(old, new.unionByName(earlier).unionByName(unread), order=["bytes"], fingerprint=["bytes"]).select("id", "path", "bytes")


@_register("stale_anti_join", f"with {views.IMAGES},{views.OLD} select id, path from old where path not in (select path from images)")
def _(spark, d):
    now, old, _ = _snapshots(spark, d)
    return maintenance.stale(old, now).select("id", "path")


@_register("present_semi_join", f"with {views.IMAGES},{views.OLD} select id, path from old where path in (select path from images)")
def _(spark, d):
    now, old, _ = _snapshots(spark, d)
    return maintenance.present(old, now).select("id", "path")


@_register(
    "upsert_vectors",
    "select vec_id, label from embeddings where vec_id % 2 = 1 union all select vec_id, 100 + label from embeddings where vec_id % 2 = 0 and vec_id % 4 = 0",
)
def _(spark, d):
    old = views.table(spark, d, "embeddings")
    new = old.where("vec_id % 2 = 0").select(
        "vec_id", F.when(F.col("vec_id") % 4 == 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 3)).alias("embedding"), (F.col("label") + 100).alias("label")
    )
    return maintenance.upsert_vectors(old, new, ["vec_id"], 64).select("vec_id", "label")


VECTORS = """stored as (
  select 'clip' as kind, root, path, '' as group_id, embedding from images where embedding is not null
  union all select 'clip', root, path || '.gone', '', embedding from images where embedding is not null and id % 4 = 0
  union all select 'face', root, '', 'old-' || id, embedding from images where embedding is not null and id % 8 = 0
)"""


def _stored(images):
    own = images.where("embedding is not null")
    row = lambda df, kind, path, group: df.select(F.lit(kind).alias("kind"), "root", path.alias("path"), group.alias("group_id"), "embedding")
    clip = row(own, "clip", F.col("path"), F.lit(""))
    gone = row(own.where("id % 4 = 0"), "clip", F.concat("path", F.lit(".gone")), F.lit(""))
    return clip.unionByName(gone).unionByName(row(own.where("id % 8 = 0"), "face", F.lit(""), F.concat(F.lit("old-"), "id")))


@_images("exists_vectors", f", {VECTORS} select bool_or(kind = 'clip' and root = '/corpus') as clip, coalesce(bool_or(kind = 'clip' and root = '/other'), false) as other from stored", "id", "root", "path", "embedding")
def _(images):
    return _stored(images).agg(records.has_vectors("clip", "/corpus").alias("clip"), records.has_vectors("clip", "/other").alias("other"))


@_images("count_vectors", f", {VECTORS} select kind, root, count(*) as n from stored group by kind, root", "id", "root", "path", "embedding")
def _(images):
    return records.vector_counts(_stored(images))


@_images(
    "knn_scoped",
    f""", {VECTORS}, scoped as (select group_id, embedding from stored where kind = 'face' and root = '/corpus')
    select group_id, {six('max(list_cosine_similarity(s.embedding::double[], q.embedding::double[]))')} as sim
    from scoped s, embeddings q where q.vec_id = 3 group by group_id order by max(list_cosine_similarity(s.embedding::double[], q.embedding::double[])) desc, group_id limit 5""",
    "id", "root", "path", "embedding",
)
def _(images):
    query = images.where("id = 3").select("embedding").first()[0]
    scores = vectors.similarities(records.scoped(_stored(images), "face", "/corpus"), [query], "group_id")
    return vectors.nearest(scores, 5, "group_id").select("group_id", _six(F.col("sim")).alias("sim"))


@_images("stale_vectors", f", {VECTORS} select kind, path, group_id from stored where kind <> 'clip' or path in (select path from images)", "id", "root", "path", "embedding")
def _(images):
    return maintenance.without_stale(_stored(images), images).select("kind", "path", "group_id")


@_images("stale_thumbnails", f", {views.THUMBS}, all_thumbs as (select path from thumbs union all select path || '.gone' from thumbs) select path from all_thumbs where path in (select path from images)", "id", "root", "path")
def _(images):
    thumbs = views.thumbnails(images).select("root", "path")
    stored = thumbs.unionByName(thumbs.withColumn("path", F.concat("path", F.lit(".gone"))))
    return maintenance.present(stored, images).select("path")


@_images(
    "face_vectors_replace",
    f", {VECTORS} select kind, path, group_id from stored where kind <> 'face' union all select 'face', '', 'face-' || id from images where embedding is not null and id % 10 = 0",
    "id", "root", "path", "embedding",
)
def _(images):
    centroid = F.when(F.col("id") % 20 < 15, F.col("embedding")).otherwise(F.slice("embedding", 1, 3))
    groups = images.where("embedding is not null and id % 5 = 0").select(F.concat(F.lit("face-"), "id").alias("group_id"), centroid.alias("centroid"), "id")
    return maintenance.replace_faces(_stored(images), groups.where("id % 10 = 0 or size(centroid) < 64"), "/corpus", 64).select("kind", "path", "group_id")


@_images(
    "legacy_json_vectors",
    f"select path, {six('list_sum(list_transform(embedding, lambda x: x::double))')} as total from images where embedding is not null and id % 3 <> 0",
    "id", "root", "path", "embedding",
)
def _(images):
    broken = F.when(F.col("id") % 6 == 0, F.lit("{no json")).when(F.col("id") % 6 == 3, F.to_json(F.struct(F.slice("embedding", 1, 5).alias("embedding"))))
    old = images.select("root", "path", broken.otherwise(F.to_json(F.struct("path", "embedding"))).alias("record_json"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return records.legacy_vectors(old, 64).select("path", _six(total).alias("total"))


@_register(
    "face_groups_load",
    "select 'r' || n_regionkey as root, 'face-' || n_nationkey as id, case when n_nationkey < 5 then n_name end as name, n_nationkey::bigint as face_count from nation where n_regionkey <> 1",
)
def _(spark, d):
    groups = views.table(spark, d, "nation").select(
        F.concat(F.lit("r"), "n_regionkey").alias("root"), F.concat(F.lit("face-"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") < 5, F.col("n_name")).alias("name"),
        F.array(F.lit(0.5)).cast("array<float>").alias("centroid"), F.col("n_nationkey").cast("long").alias("face_count"), F.array().cast("array<string>").alias("image_ids"), F.lit("").alias("preview"),
    )
    state = records.groups_as_json(groups).withColumn("face_groups_json", F.when(F.col("root") == "r1", F.lit("{broken")).otherwise(F.col("face_groups_json")))
    return records.groups_from_json(state).select("root", "id", "name", "face_count")


@_images("record_project", "select path as id, path, filename, modified_at, captured_at, width, height, md5(ocr_text) as ocr, array_to_string(people, ',') as people, '' as thumbnail, 1.0::double as score from images")
def _(images):
    back = records.restored(records.kept(images))
    return back.select("id", "path", "filename", "modified_at", "captured_at", "width", "height", F.md5("ocr_text").alias("ocr"), F.array_join("people", ",").alias("people"), "thumbnail", "score")


@_images("scan_supported_limit", f"select path from images where {EXT} in ('jpg', 'jpeg', 'png', 'webp', 'gif', 'bmp') order by path limit 300", "path", "filename")
def _(images):
    return files.supported(images, 300).select("path")


@_register("fingerprint_project", "select event_id, epoch_us(ts + to_microseconds(event_id * 997 % 1000000)) * 1000 as modified_ns from events")
def _(spark, d):
    fine = F.timestamp_micros(views.utc_seconds("ts") * 1000000 + F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000000)) + F.col("event_id") * 997 % 1000000)
    return views.table(spark, d, "events").select("event_id", files.modified_ns(fine).alias("modified_ns"))


# --- people ----------------------------------------------------------------

GROUPS = "groups as (select 'face-' || n_nationkey as group_id, case when n_nationkey < 5 then n_name end as name from nation)"
HELD = f"with {views.IMAGES}, {GROUPS}, held as (select group_id, any_value(name) as name, count(*) as face_count from (select id, unnest(face_group_ids) as group_id from images) join groups using (group_id) group by group_id)"


def _groups(spark, d):
    return views.table(spark, d, "nation").select(F.concat(F.lit("face-"), "n_nationkey").alias("group_id"), F.when(F.col("n_nationkey") < 5, F.col("n_name")).alias("name"))


@_images("known_people_distinct", "select distinct unnest(people) as name from images", "people")
def _(images):
    return people.known_people(images)


@_register("cluster_refresh", f"{HELD} select group_id, face_count, face_count as image_count from held")
def _(spark, d):
    return people.refresh_groups(_groups(spark, d), views.images(spark, d, ["id", "face_group_ids"])).select("group_id", "face_count", "image_count")


@_register(
    "face_group_summary",
    f"{HELD} select group_id, name, face_count, face_count as image_count, '' as preview, row_number() over (order by name is null, face_count desc, group_id) - 1 as place from held",
)
def _(spark, d):
    return people.summary(people.refresh_groups(_groups(spark, d), views.images(spark, d, ["id", "face_group_ids"])))


@_register("label_group", f"with {views.IMAGES} select id, case when list_contains(face_group_ids, 'face-7') then 'Ann' else coalesce(people[1], '') end as people from images")
def _(spark, d):
    labelled = people.label(_groups(spark, d), "face-7", " Ann ")
    return people.people_of(views.images(spark, d, ["id", "face_group_ids"]), labelled).select("id", F.array_join("people", "、").alias("people"))


@_register(
    "replace_known_person",
    "select 'face-' || vec_id as id, 'person ' || label as name from embeddings where vec_id % 25 = 3 and vec_id <> 28 union all select 'face-28', 'Ann'",
)
def _(spark, d):
    known = views.table(spark, d, "embeddings").where("vec_id % 25 = 3").select(F.concat(F.lit("face-"), "vec_id").alias("id"), F.concat(F.lit("person "), "label").alias("name"), "embedding")
    groups = known.select(F.col("id").alias("group_id"), F.col("embedding").alias("centroid"))
    return people.replace_known(known, groups, "face-28", " Ann ").select("id", "name")


@_register("face_group_id")
def _(spark, d):
    return views.table(spark, d, "embeddings").select("vec_id", people.group_id(F.col("embedding")).alias("group_id"))


# --- media -----------------------------------------------------------------


@_register(
    "exif_normalize",
    """select event_id, case when event_id % 3 = 0 then null else strftime(ts, '%Y-%m-%d %H:%M:%S') end as captured from events""",
)
def _(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy:'13':dd HH:mm:ss")).otherwise(F.concat(F.lit(' "'), F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lit('"')))
    return views.table(spark, d, "events").select("event_id", media.exif_datetime(raw).alias("captured"))


WH = "(p_size * 100)::bigint as w, (p_partkey % 4000 + 1)::bigint as h"


@_register(
    "thumbnail_dims",
    f"""select p_partkey, case when w >= h then 480 else greatest(1, (w * 480 + h // 2) // h) end::bigint as width,
    case when w >= h then greatest(1, (h * 480 + w // 2) // w) else 480 end::bigint as height,
    (case when greatest(w, h) < 1800 then least(greatest(w, h) * 2, 2600) else least(greatest(w, h), 3200) end)::bigint as side
    from (select p_partkey, {WH} from part)""",
)
def _(spark, d):
    w, h = (F.col("p_size") * 100).cast("long"), (F.col("p_partkey") % 4000 + 1).cast("long")
    return views.table(spark, d, "part").select(
        "p_partkey", media.thumbnail_width(w, h).alias("width"), media.thumbnail_height(w, h).alias("height"), media.ocr_side(w, h).alias("side")
    )


@_register(
    "exif_coalesce",
    """select event_id, case when event_id % 3 < 2 then strftime(case when event_id % 3 = 0 then ts + interval 1 day else ts end, '%Y-%m-%d %H:%M:%S') end as captured from events""",
)
def _(spark, d):
    k, text = F.col("event_id") % 3, lambda ts: F.date_format(ts, "yyyy:MM:dd HH:mm:ss")
    tags = [F.when(k == 0, text(F.col("ts") + F.expr("interval 1 day"))).otherwise("0000:00:00 00:00:00"), F.when(k == 2, "unknown"), F.when(k < 2, text(F.col("ts")))]
    return views.table(spark, d, "events").select("event_id", media.first_datetime(tags).alias("captured"))


#: A JPEG file up to its frame header, in hexadecimal: a directory that leads to another one with the date of the shot, then the sides.
BEFORE_DATE = "ffd8ffe10048457869660000" "4d4d002a00000008" "0001876900040000" "00010000001a00000000" "0001900300020000" "00140000002c00000000"


@_register(
    "picture_facts",
    """select event_id, 'jpeg' as format, (user_id % 6000 + 1)::integer as width, (event_id % 4000 + 1)::integer as height,
    case when event_id % 5 > 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') end as captured from events where event_id % 7 > 0
    union all select event_id, 'jpeg', null, null, null from events where event_id % 7 = 0""",
)
def _(spark, d):
    side = lambda x: F.lpad(F.hex(x + 1), 4, "0")
    date = F.when(F.col("event_id") % 5 > 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).otherwise("0000:00:00 00:00:00")
    whole = F.concat(F.lit(BEFORE_DATE), F.hex(F.encode(date, "UTF-8")), F.lit("00ffc0001108"), side(F.col("event_id") % 4000), side(F.col("user_id") % 6000), F.lit("03012200"))
    cut = F.when(F.col("event_id") % 7 == 0, F.substring(whole, 1, 60)).otherwise(whole)  # files that break off
    read = pictures.with_facts(views.table(spark, d, "events").select("event_id", F.unhex(cut).alias("content")))
    return read.select("event_id", "format", "width", "height", media.first_datetime([F.col(c) for c in ("original", "digitised", "changed")]).alias("captured"))


LANDMARKS = ["l_quantity", "l_partkey % 97", "l_quantity + 30", "l_suppkey % 13", "l_partkey % 50", "l_quantity + 20", "l_suppkey % 31", "70.0", "l_quantity + 25", "l_partkey % 80"]


def _cut(x: str) -> str:
    """Rounded to 6 digits at a place that sums of short decimals don't meet."""
    return f"floor(({x}) * 1e6 + 0.37) / 1e6"


def _transform_sql():
    s, d_ = [f"({x})::double" for x in LANDMARKS], faces.ALIGNED
    mean = lambda p, k: "(" + " + ".join(str(x) for x in p[k::2]) + ") / 5"
    du, dv = [f"({x} - sx)" for x in s[::2]], [f"({x} - sy)" for x in s[1::2]]
    dp, dq = [f"({x} - dx)" for x in d_[::2]], [f"({x} - dy)" for x in d_[1::2]]
    total = lambda f: " + ".join(f(i) for i in range(5))
    return f"""with m as (select *, {mean(s, 0)} as sx, {mean(s, 1)} as sy, {mean(d_, 0)} as dx, {mean(d_, 1)} as dy from lineitem),
    c as (select l_orderkey, l_linenumber, sx, sy, dx, dy, {total(lambda i: f"{du[i]} * {du[i]} + {dv[i]} * {dv[i]}")} as spread, {total(lambda i: f"{dp[i]} * {du[i]} + {dq[i]} * {dv[i]}")} as trace,
      {total(lambda i: f"{dq[i]} * {du[i]} - {dp[i]} * {dv[i]}")} as turn from m),
    -- angle and scale, instead of the ratios that the query takes
    t as (select *, atan2(turn, trace) as angle, sqrt(turn * turn + trace * trace) / spread as scale from c)
    select l_orderkey, l_linenumber, {_cut('scale * cos(angle)')} as a, {_cut('scale * sin(angle)')} as b,
      {_cut('dx - scale * (cos(angle) * sx - sin(angle) * sy)')} as x, {_cut('dy - scale * (sin(angle) * sx + cos(angle) * sy)')} as y from t"""


@_register("face_alignment", _transform_sql())
def _(spark, d):
    source, target = [F.expr(x).cast("double") for x in LANDMARKS], [F.lit(x) for x in faces.ALIGNED]
    found = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", faces.similarity(source, target).alias("t"))
    return found.select("l_orderkey", "l_linenumber", *[(F.floor(F.col(f"t.{c}") * 1e6 + 0.37) / 1e6).alias(c) for c in ("a", "b", "x", "y")])


@_register("ocr_target_side", f"select p_partkey, (case when greatest(w, h) < 1800 then least(greatest(w, h) * 2, 2600) else least(greatest(w, h), 3200) end)::bigint as side from (select p_partkey, {WH} from part)")
def _(spark, d):
    w, h = (F.col("p_size") * 100).cast("long"), (F.col("p_partkey") % 4000 + 1).cast("long")
    return views.table(spark, d, "part").select("p_partkey", media.ocr_side(w, h).alias("side"))


@_register(
    "data_url_codec",
    """select doc_id, md5('data:image/jpeg;base64,' || base64(encode(text))) as url, case when doc_id % 7 > 2 then md5(text) end as back from documents""",
)
def _(spark, d):
    url = media.to_data_url(F.encode("text", "UTF-8"))
    k = F.col("doc_id") % 7
    damaged = F.when(k == 0, F.concat(url, F.lit("="))).when(k == 1, F.concat(url, F.lit("*AAA"))).when(k == 2, F.concat(F.lit("x"), url)).otherwise(url)
    return views.table(spark, d, "documents").select("doc_id", F.md5(url).alias("url"), F.md5(media.from_data_url(damaged)).alias("back"))


@_register(
    "box_iou",
    f"""select l_orderkey, l_linenumber, case when u > 0 then {six('s / u')} else 0.0 end as iou from (
      select *, (l_quantity * 10) * 50 + 100 * 50 - s as u from (
        select l_orderkey, l_linenumber, l_quantity, greatest(least(l_quantity * 10, x + 100) - greatest(0, x), 0) * 50 as s
        from (select *, (l_partkey % 640)::double as x from lineitem)))""",
)
def _(spark, d):
    x, zero = (F.col("l_partkey") % 640).cast("double"), F.lit(0.0)
    iou = media.box_iou([zero, zero, F.col("l_quantity") * 10, F.lit(50.0)], [x, zero, x + 100, F.lit(50.0)])
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _six(iou).alias("iou"))


@_register(
    "eta_seconds",
    "select event_id, case when event_id % 100 = 0 or value < 0.5 then null else ceil((100 - event_id % 100) * value / (event_id % 100))::bigint end as eta from events",
)
def _(spark, d):
    done = F.col("event_id") % 100
    return views.table(spark, d, "events").select("event_id", media.eta_seconds(done, F.lit(100), F.col("value")).alias("eta"))


@_images(
    "result_card_project",
    """select id, concat_ws(' | ', case when height is not null then width || ' × ' || height else '圖片' end, '拍攝：' || captured_at,
    case when len(people) > 0 then array_to_string(people, '、') end, case when ocr_text <> '' then 'OCR：' || substring(ocr_text, 1, 100) end) as card from images""",
)
def _(images):
    return images.select("id", media.card(F.col("ocr_text"), F.col("people"), F.col("width"), F.col("height"), F.col("captured_at")).alias("card"))


@_images("filename_project", "select id, case when id % 10 = 0 then '圖片' else filename end as name from images", "id", "path")
def _(images):
    return images.select("id", media.filename(F.when(F.col("id") % 10 == 0, F.concat("path", F.lit("/"))).otherwise(F.col("path"))).alias("name"))


@_register(
    "eta_format",
    """select o_orderkey, case when s is null then '正在估算完成時間…' when s <= 0 then '即將完成' else '預估剩餘 ' ||
    case when s >= 3600 then (s // 3600) || ' 小時 ' || (s % 3600 // 60) || ' 分鐘' when s >= 60 then (s % 3600 // 60) || ' 分鐘 ' || (s % 60) || ' 秒' else (s % 60) || ' 秒' end
    || '（約 ' || case when hour(o_orderdate + to_seconds(s)) < 12 then '上午' else '下午' end || strftime(o_orderdate + to_seconds(s), '%I:%M') || ' 完成）' end as eta
    from (select o_orderkey, case when o_orderkey % 11 > 0 then o_orderkey % 9000 - 5 end as s, o_orderdate from orders)""",
)
def _(spark, d):
    s = F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderkey") % 9000 - 5)
    second = F.hour("o_orderdate") * 3600 + F.minute("o_orderdate") * 60 + F.second("o_orderdate")
    return views.table(spark, d, "orders").select("o_orderkey", media.eta_text(s, media.clock_text((second + s) % 86400)).alias("eta"))


#: A recogniser's output for each part: two words, a line that is too short, and a blank word; the same in both dialects.
TSV = (
    "'header' || chr(10) || repeat('1' || chr(9), 10) || p_size || chr(9) || ' ' || p_brand || chr(9) || 'x ' || chr(10) || repeat('1' || chr(9), 10) || '-1' || chr(9) || p_type"
    " || chr(10) || 'short' || chr(10) || repeat('1' || chr(9), 10) || 'x' || chr(9) || ' ' || chr(10)"
)


@_register(
    "ocr_tsv_parse",
    f"""with o as (select p_partkey, {TSV} as tsv from part),
    l as (select p_partkey, unnest(str_split(tsv, chr(10))[2:]) as line, generate_subscripts(str_split(tsv, chr(10))[2:], 1) as place from o),
    f as (select p_partkey, place, str_split(line, chr(9)) as f from l),
    w as (select p_partkey, place, trim(array_to_string(f[12:], chr(9))) as word, case when try_cast(f[11] as float) >= 0 then try_cast(f[11] as float) end as conf from f where len(f) >= 12)
    select p_partkey, place - 1 as place, word, conf::double as confidence from w where word <> ''""",
)
def _(spark, d):
    words = views.table(spark, d, "part").select("p_partkey", F.explode(media.tsv_words(F.expr(TSV))).alias("w"))
    return words.select("p_partkey", F.col("w.place").cast("long").alias("place"), "w.word", F.col("w.confidence").cast("double").alias("confidence"))


@_register(
    "ocr_confidence",
    "select p_partkey, p_brand || chr(9) || 'x ' || p_type as text, p_size::double as confidence from part where p_size >= 20",
)
def _(spark, d):
    read = views.table(spark, d, "part").select("p_partkey", media.tsv_text(F.expr(TSV)).alias("r")).where("r is not null")
    return read.select("p_partkey", "r.text", "r.confidence")


@_register(
    "ocr_text_agg",
    f"""select l_orderkey, text, {six('confidence')} as confidence from (
      select l_orderkey, string_agg(l_linestatus || l_partkey, ' ' order by l_linenumber, l_linestatus || l_partkey) as text, avg(case when l_quantity - 5 >= 0 then l_quantity - 5 end) as confidence
      from lineitem group by l_orderkey) where confidence is null or confidence >= 20""",
)
def _(spark, d):
    words = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_linestatus", "l_partkey").alias("word"), (F.col("l_quantity") - 5).alias("conf"))
    return media.words_of_page(words, "l_orderkey", "l_linenumber", "word", "conf").withColumn("confidence", _six(F.col("confidence")))


@_register(
    "ocr_best_candidate",
    """select l_orderkey, arg_max(l_returnflag || l_partkey, struct_pack(rank := l_quantity + 0.08 * least(length(l_returnflag || l_partkey), 200), place := l_linenumber, word := l_returnflag || l_partkey)) as text
    from lineitem group by l_orderkey""",
)
def _(spark, d):
    readings = views.table(spark, d, "lineitem").withColumn("reading", F.concat("l_returnflag", "l_partkey"))
    return media.best_candidate(readings, "l_orderkey", "l_linenumber", "reading", "l_quantity")


@_register("face_min_size", "select l_orderkey, l_linenumber from lineitem where l_quantity >= 24 and l_partkey % 50 >= 24")
def _(spark, d):
    box = [F.col("l_suppkey"), F.lit(5), F.col("l_suppkey") + F.col("l_quantity"), F.col("l_partkey") % 50 + 5]
    return views.table(spark, d, "lineitem").where(faces.large_enough(box)).select("l_orderkey", "l_linenumber")


def _boxes(spark, d):
    x, y, side = (F.col("l_partkey") % 90).cast("double"), (F.col("l_suppkey") % 40).cast("double"), F.col("l_quantity") + 20
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return views.table(spark, d, "lineitem").select(
        "l_orderkey", place.cast("long").alias("n"), F.floor(F.col("l_extendedprice") / 10000).cast("double").alias("score"),
        x.alias("x1"), y.alias("y1"), (x + side).alias("x2"), (y + 40).alias("y2"),
    )


BOXES = """boxes as (
  select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n, floor(l_extendedprice / 10000)::double as score,
         (l_partkey % 90)::double as x1, (l_suppkey % 40)::double as y1, (l_partkey % 90)::double + l_quantity + 20 as x2, (l_suppkey % 40)::double + 40 as y2 from lineitem
), ordered as (select *, row_number() over (partition by l_orderkey order by score desc, n) as r from boxes)"""


@_register(
    "nms",
    f"""with recursive {BOXES},
    kept as (
      select l_orderkey, 1 as r, [struct_pack(n := n, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] as k from ordered where r = 1
      union all
      select o.l_orderkey, o.r, case when len(list_filter(k, lambda b:
          greatest(least(b.x2, o.x2) - greatest(b.x1, o.x1), 0) * greatest(least(b.y2, o.y2) - greatest(b.y1, o.y1), 0)
          > 0.4 * ((b.x2 - b.x1) * (b.y2 - b.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(least(b.x2, o.x2) - greatest(b.x1, o.x1), 0) * greatest(least(b.y2, o.y2) - greatest(b.y1, o.y1), 0)))) > 0
        then k else list_append(k, struct_pack(n := o.n, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2)) end
      from kept join ordered o on o.l_orderkey = kept.l_orderkey and o.r = kept.r + 1
    )
    select l_orderkey, f.n as n from (select l_orderkey, unnest(k) as f from (select l_orderkey, arg_max(k, r) as k from kept group by l_orderkey))""",
)
def _(spark, d):
    return faces.suppress(_boxes(spark, d), "l_orderkey", ["n"]).select("l_orderkey", "n")


@_register(
    "face_crop_geometry",
    f"""with {BOXES}
    select l_orderkey, n, floor(a)::int as x, floor(b)::int as y, floor(least(greatest(x2 + mx, floor(a) + 1), 100))::int - floor(a)::int as width,
    floor(least(greatest(y2 + my, floor(b) + 1), 70))::int - floor(b)::int as height
    from (select *, least(greatest(x1 - mx, 0), 99) as a, least(greatest(y1 - my, 0), 69) as b from (
      select *, greatest(x2 - x1, 1) * 0.22::double as mx, greatest(y2 - y1, 1) * 0.28::double as my from boxes))""",
)
def _(spark, d):
    box = [F.col(c) for c in faces.BOX]
    return _boxes(spark, d).select("l_orderkey", "n", faces.crop(box, F.lit(100), F.lit(70)).alias("c")).select("l_orderkey", "n", "c.*")


@_register(
    "detector_decode",
    f"""with s as (select vec_id, embedding as e, unnest(embedding) as score, unnest(range(64)) as anchor from embeddings)
    select vec_id, anchor::bigint as anchor, {six('((anchor // 2) % 20 - e[anchor % 15 * 4 + 1]::double) * 32 / 0.5')} as x1, {six('(floor(anchor / 40) + e[anchor % 15 * 4 + 4]::double) * 32 / 0.5')} as y2,
    {six('(e[anchor % 6 * 10 + 2]::double + floor(anchor / 40)) * 32 / 0.5')} as first_y from s where score > 0.1::float""",
)
def _(spark, d):
    v = F.col("embedding").cast("array<double>")
    part = lambda width, of: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.slice("e", i % of * width + 1, F.lit(width))))
    levels = views.table(spark, d, "embeddings").select("vec_id", v.alias("e"), F.col("embedding").alias("scores"), F.lit(32).alias("stride"), F.lit(0.5).alias("scale"))
    levels = levels.withColumns({"boxes": part(4, 15), "landmarks": part(10, 6)}).withColumn("scores", F.col("scores").cast("array<float>"))
    found = faces.decode(levels, "vec_id", F.lit(0.1).cast("float"))
    return found.select("vec_id", F.col("anchor").cast("long").alias("anchor"), _six(F.col("x1")).alias("x1"), _six(F.col("y2")).alias("y2"), _six(F.get("landmarks", F.lit(1))).alias("first_y"))


@_register("incremental_merge", f"{STATUS} select o.id, o.bytes from old o join status s on s.root = o.root and s.path = o.path where s.status like 'reuse%' union all select id, bytes * 2 as bytes from status where status not like 'reuse%' and id % 17 <> 0")
def _(spark, d):
    now, old, thumbs = _snapshots(spark, d)
    fresh = now.where("id % 17 <> 0").withColumn("bytes", F.col("bytes") * 2)
    return maintenance.merge(maintenance.changes(now, old, thumbs), old, fresh).select("id", "bytes")


@_register("cache_lookup_join", f"with {views.IMAGES},{views.OLD},{views.THUMBS} select i.id, o.bytes as cached_bytes, t.path is not null as has_thumbnail from images i left join old o on o.root = i.root and o.path = i.path left join thumbs t on t.root = i.root and t.path = i.path")
def _(spark, d):
    now, old, thumbs = _snapshots(spark, d)
    return maintenance.lookup(now, old, thumbs, ["bytes"]).select("id", "cached_bytes", "has_thumbnail")


@_register("semantic_filter", f"with {views.IMAGES},{SIMS} select id, {six('sim')} as sim from sims where sim >= (select greatest(coalesce(max(sim) - 0.07, 0.2), 0.2) from sims where id > 1)")
def _(spark, d):
    sims = _sims(spark, d)
    least = sims.where("id > 1").agg(vectors.threshold(F.max("sim")).alias("least")).scalar()
    return sims.where(F.col("sim") >= least).select("id", _six(F.col("sim")).alias("sim"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
