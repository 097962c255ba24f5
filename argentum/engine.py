"""The application's commands over a catalogue that is kept as Parquet tables in one folder (see ``store``).

Images, thumbnails and vectors are cut by root and by a hash of the path, and a scan or a label writes only
the parts that it changes.  A scan takes its files in steps; what a step has derived is kept until the scan
ends, so one that breaks off goes on where it was.  Listings, joins and searches are Spark jobs; only
pages, people's names, group summaries and counters come to the driver.

What needs a model is handed in: ``derive`` makes a scan's rows out of listed files, ``encode`` makes
vectors out of a query's text.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from argentum.functions import media
from argentum.operators import maintenance, people, ranking, records, textindex
from argentum.plans.query_parser import QueryPlan, parse
from argentum.settings import Settings, load_people, load_settings, read_json, save_settings, write_json
from argentum.sources import files, listing
from argentum.sources.pictures import with_facts
from argentum.store import Store, bucket, buckets_for
from argentum.streaming.ingest import Gate, in_steps, remaining

#: Numbers in a vector of a picture or a face (fixed value).
DIMENSION = 512

IMAGES = (
    "id string, root string, path string, filename string, bytes long, modified_at string, modified_ns long, captured_at string, width int, height int,"
    " ocr_text string, people array<string>, face_group_ids array<string>"
)
PLACES = "root string, id string, filename string, position long"
THUMBNAILS = "root string, path string, thumbnail string"
VECTORS = "kind string, root string, path string, group_id string, embedding array<float>"
GROUPS = "root string, group_id string, name string, centroid array<float>, face_count long, image_count long, preview string"
SCHEMAS = {
    "images": IMAGES, "places": PLACES, "thumbnails": THUMBNAILS, "vectors": VECTORS, "groups": GROUPS, "postings": textindex.POSTINGS, "owners": textindex.OWNERS,
}
#: Segments of the text index that are written before they are merged into one; parts of a segment, by word.
SEGMENTS, TERM_PARTS = 8, 16
#: Old records whose JSON still holds a vector, where a catalogue has such a table.
LEGACY = "root string, path string, record_json string"
def _observed() -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.greatest(F.size("face_group_ids"), F.lit(0))), F.lit(0)).alias("faces")]


@dataclass
class ScanResult:
    root: str
    total: int
    to_process: int
    indexed: int
    reused: int
    skipped: int
    faces_detected: int
    face_groups: int
    semantic_available: bool


@dataclass
class SearchPage:
    images: list[dict]
    total: int
    has_more: bool


@dataclass
class Derived:
    """What a scan makes of listed files: rows like IMAGES (id and people may be missing), and thumbnails,
    vectors and face groups with the columns of their tables, if any.  Of unchanged files that lack a
    thumbnail only that is taken.
    """

    images: DataFrame
    thumbnails: DataFrame | None = None
    vectors: DataFrame | None = None
    groups: DataFrame | None = None


def bare(listing: DataFrame) -> Derived:
    """Rows of files of which nothing but the listing is known."""
    return Derived(listing.select("root", "path", "filename", "bytes", "modified_at", "modified_ns"))


def pictures(listed: DataFrame) -> Derived:
    """Rows with the sizes and capture times that the files' own bytes tell; files that are no pictures are left out."""
    read = with_facts(files.contents(listed))
    taken = media.first_datetime([F.col(c) for c in ("original", "digitised", "changed")])
    return Derived(read.where("width is not null").withColumn("captured_at", taken).drop("format", "original", "digitised", "changed"))


def _filled(rows: DataFrame, schema: str) -> DataFrame:
    """rows with exactly the columns of a schema; missing ones are null, missing lists empty."""
    fields_ = StructType.fromDDL(schema).fields
    empty = lambda f: F.array() if f.name in ("people", "face_group_ids") else F.lit(None)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else empty(f)).cast(f.dataType).alias(f.name) for f in fields_])


@dataclass
class Catalogue:
    spark: SparkSession
    store: str
    derive: Callable[[DataFrame], Derived] = bare
    encode: Callable[[str], list[list[float]]] | None = None
    dimension: int = DIMENSION
    gate: Gate = field(default_factory=Gate)
    #: Hits of the last search: (root, query, version), the table with their places, its folder and their number.
    session: tuple | None = None

    # --- files and state

    def __post_init__(self):
        self._store = Store(self.spark, self.store, SCHEMAS)

    @property
    def settings_file(self) -> str:
        return f"{self.store}/settings.json"

    @property
    def people_file(self) -> str:
        """The known people of the current state."""
        return f"{self.store}/{self._store.state()['people'] or 'known_people.json'}"

    @property
    def current(self) -> tuple[int, str | None]:
        """The version and root that searches look at; (0, None) before the first scan."""
        state = self._store.state()
        return state["version"], state["root"]

    @property
    def root(self) -> str | None:
        return self.current[1]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a state: images, places, thumbnails, vectors or groups."""
        return self._store.read(name, self._store.state(version))

    def _forget(self) -> None:
        if self.session:
            self._store.remove(self.session[2])
        self.session = None

    # --- settings

    def settings(self) -> Settings:
        return load_settings(self.settings_file)

    def update_settings(self, settings: Settings) -> Settings:
        """Check and keep settings; a change of the text encoder's device ends the session."""
        before = self.settings()
        save_settings(self.settings_file, settings.checked())
        if before.clip_gpu != settings.clip_gpu:
            self._forget()
        return settings

    def pause(self) -> None:
        self.gate.pause()

    def resume(self) -> None:
        self.gate.resume()

    # --- scans

    def scan(self, root: str, report: Callable[[dict], None] | None = None) -> ScanResult:
        """Bring the catalogue of a folder up to date; unchanged files keep what was derived of them.

        Files are taken in steps of ``index_batch_size`` for each core.  Before each step a paused gate holds, and after it
        ``report`` gets processed, total, eta, indexed, reused, skipped and faces, counted by the writing itself.
        """
        self.gate.resume()
        found = files.scan(self.spark, root, limit=self.settings().max_indexed_images)
        return _Scan(self, root, found, report or (lambda told: None)).run()

    def follow(self, root: str, checkpoint: str, report: Callable[[dict], None] | None = None, once: bool = True):
        """Take new and changed files of a folder into the catalogue as a stream; returns the query.

        The state records the last micro-batch taken of each stream, so one that is repeated changes nothing.
        Stopping the query pauses it, and the next call with the same checkpoint goes on.  Lost files leave with the next scan.
        Without ``once`` it goes on until it is stopped.
        """
        listing.check_root(root)
        listing.register(self.spark)

        def take(batch: DataFrame, number: int) -> None:
            name = (read_json(f"{checkpoint}/metadata", {}) or {}).get("id", checkpoint)
            if self._store.state()["taken"].get(name, -1) < number:
                _Scan(self, root, batch, report or (lambda told: None), taken=(name, number)).run()

        found = files.supported(files.listed(self.spark.readStream.format("folder").load(root), root))
        writer = found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    # --- searches

    def search(self, query: str) -> SearchPage:
        return self.search_page(query)

    def search_page(self, query: str, offset: int = 0, size: int = ranking.PAGE) -> SearchPage:
        """Rows ``offset`` to ``offset + size`` of a query's hits; a blank query lists the catalogue in its order.

        The hits of a query are kept, in order and with their places, until another query, scan or label: a page is a range of places.
        """
        state = self._store.state()
        root = state["root"]
        images = self._store.read("images", state, root)
        size = min(max(size, 1), ranking.MAX_PAGE)
        if not query.strip():
            hits, total = self._store.read("places", state, root).withColumn("score", F.lit(1.0)), None
        else:
            hits, total = self._hits(ranking.session_key(root, query, state["version"]), images, state)
        total = hits.count() if total is None else total
        shown = hits.where(F.col("position").between(offset, min(offset + size, total) - 1)).select("id", "score", "position").collect()
        order = {r["id"]: (r["position"], r["score"]) for r in shown}
        full = images.where(F.col("id").isin(list(order)))
        thumbs = self._store.read("thumbnails", state, root).select(F.col("path").alias("id"), "thumbnail")
        rows = ranking.hydrate(full, thumbs).collect()
        found = sorted(({**r.asDict(), "score": order[r["id"]][1]} for r in rows), key=lambda r: order[r["id"]][0])
        return SearchPage(found, total, min(offset + size, total) < total)

    def _hits(self, key: tuple, images: DataFrame, state: dict) -> tuple[DataFrame, int]:
        """(id, score, position) of a query's hits and their number; written once, in ranges of places."""
        if self.session and self.session[0] == key:
            return self.session[1], self.session[3]
        self._forget()
        names = [r["name"] for r in people.known_people(images).collect()]  # a row for each person
        plan = parse(key[1], names)
        wanted = bool(plan.semantic_query and self.encode) and any(p.startswith("clip-") for p in self._store.parts("vectors", state, key[0]))
        stored = records.scoped(self._store.read("vectors", state, key[0]), "clip", key[0])
        searched = images.join(stored.select("path", "embedding"), "path", "left") if wanted else images
        queries = self.encode(plan.semantic_query) if wanted else []
        folder = self._store.fresh("session")
        path, told = f"{self.store}/{folder}", Observation()
        ranking.search(searched, plan, queries).write.parquet(f"{path}/hits")
        hits = ranking.placed(self.spark.read.parquet(f"{path}/hits"))
        hits.observe(told, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/placed")
        total = told.get["rows"] if plan.limit is None else min(told.get["rows"], plan.limit)
        self.session = (key, self.spark.read.schema(hits.schema).parquet(f"{path}/placed"), folder, total)
        return self.session[1], total

    def text_scores(self, should: list[str], must: list[str] = (), must_not: list[str] = ()) -> DataFrame:
        """(id, score) of the images in which words or phrases stand, from the stored index: no text is read.

        Only the parts of the index that hold the terms' words are looked at.
        """
        state = self._store.state()
        root = state["root"]
        words = textindex.words_in([*should, *must, *must_not])
        buckets = {r[0] for r in self.spark.createDataFrame([(w,) for w in words], "term string").select(bucket("term", TERM_PARTS)).collect()} if words else set()
        parts = {p for p in self._store.parts("postings", state, root) if p.rpartition("-")[2] in buckets}
        held = self._store.read("postings", state, root, parts)
        found = textindex.live(held.where(F.col("term").isin(words)), self._store.read("owners", state, root))
        return textindex.scores(found, should, must, must_not)

    def _index(self, state: dict, root: str, images: DataFrame, gone: DataFrame | None = None) -> None:
        """Let a state name postings of new and changed images (a segment of their own), and who owns them.

        ``gone``: images (id) that left.  Where there are SEGMENTS of them already, all live postings are merged into one.
        """
        store = self._store
        held = store.parts("postings", state, root)
        numbers = {int(p.partition("-")[0]) for p in held}
        new = max(numbers, default=0) + 1
        owners = store.read("owners", state, root)
        out = images.select("id") if gone is None else images.select("id").unionByName(gone.select("id"))
        kept = owners.join(out, "id", "left_anti")
        part = F.concat_ws("-", F.col("segment"), bucket("term", TERM_PARTS))
        fresh = textindex.postings(images, new)
        if len(numbers) >= SEGMENTS:
            old = textindex.live(store.read("postings", state, root), kept).withColumn("segment", F.lit(new).cast("long"))
            owned = kept.select("id", F.lit(new).cast("long").alias("segment"))
            store.replace(state, "postings", root, store.write("postings", old.select(fresh.columns).unionByName(fresh), part, ["term"]))
        else:
            owned = kept
            store.replace(state, "postings", root, store.write("postings", fresh, part, ["term"]), set())
        own = owned.unionByName(images.select("id", F.lit(new).cast("long").alias("segment")))
        store.replace(state, "owners", root, store.write("owners", own))

    # --- people

    def face_groups(self) -> list[dict]:
        """Summaries of the current root's groups, named ones first."""
        state = self._store.state()
        groups = self._store.read("groups", state, state["root"])
        return [r.asDict() for r in people.summary(groups).drop("place").collect()]

    def label(self, group_id: str, name: str) -> list[dict]:
        """Name a group, or clear its name with a blank one; images and known people follow.  An unknown group is an error.

        Written are the groups, and the parts that hold the group's images; groups, images and known people switch together.
        """
        state = self._store.state()
        root, store = state["root"], self._store
        groups, images = (store.read(n, state, root) for n in ("groups", "images"))
        labelled = people.label(groups, group_id, name)
        known = [p for p in load_people(self.people_file) if p["id"] != group_id]
        if name and name.strip():
            centroid = groups.where(F.col("group_id") == group_id).first()["centroid"]
            known.append({"id": group_id, "name": name.strip(), "embedding": centroid})
        part = bucket("path", state["buckets"].get(root, 1))
        parts = {r["part"] for r in images.where(F.array_contains("face_group_ids", group_id)).select(part.alias("part")).distinct().collect()}
        after = store.next(state)
        if parts:
            renamed = with_people(store.read("images", state, root, parts), labelled)
            store.replace(after, "images", root, store.write("images", renamed, part), parts)
            self._index(after, root, store.read("images", after, root, parts).where(F.array_contains("face_group_ids", group_id)))
        store.replace(after, "groups", root, store.write("groups", labelled))
        after["people"] = store.write_people(known)
        store.commit(after)
        self._forget()
        return self.face_groups()

    def known_people(self) -> DataFrame:
        """Known people (place, id, name, embedding) for ``people.match_known``."""
        rows = [(k, p["id"], p["name"], p["embedding"]) for k, p in enumerate(load_people(self.people_file))]
        return self.spark.createDataFrame(rows, "place long, id string, name string, embedding array<float>")


def with_people(images: DataFrame, groups: DataFrame) -> DataFrame:
    """images with the names of their groups as people."""
    named = people.people_of(images.select("id", "face_group_ids"), groups)
    return images.drop("people").join(named, "id").select(images.columns)


class _Scan:
    """One scan, or one micro-batch of a stream (``taken``), in which files that are not listed stay."""

    def __init__(self, app: Catalogue, root: str, found: DataFrame, report: Callable[[dict], None], taken: tuple[str, int] | None = None):
        self.app, self.root, self.report, self.taken = app, root, report, taken
        self.store, self.spark = app._store, app.spark
        self.began = time.monotonic()
        self.pending = f"pending/{hashlib.sha256(root.encode()).hexdigest()[:16]}"
        self.work = f"{self.store.path}/{self.store.fresh(self.pending)}"
        self.migrated = self._migrate()
        self.state = self.store.state()
        self.listed = self._listed(found)

    def _read(self, table: str, parts: set[str] | None = None) -> DataFrame:
        return self.store.read(table, self.state, self.root, parts)

    def _migrate(self) -> bool:
        """Take vectors out of the JSON of old records, once for each root; whether that was now."""
        state, store, app = self.store.state(), self.store, self.app
        if self.root in state["migrated"] or "legacy" not in store.names(""):
            return False
        rows = files.read_snapshot(self.spark, f"{store.path}/legacy", LEGACY, self.root)
        found = maintenance.last_of(records.legacy_vectors(rows, app.dimension), ["kind", "root", "path"], ["embedding"])
        after, old = store.next(state), store.read("vectors", state, self.root)
        n = after["buckets"].setdefault(self.root, 1)
        merged = maintenance.upsert_vectors(old, found, ["kind", "root", "path", "group_id"], app.dimension)
        store.replace(after, "vectors", self.root, store.write("vectors", merged, vector_part(n)))
        after["migrated"] = [*state["migrated"], self.root]
        store.commit(after)
        return True

    def _listed(self, found: DataFrame) -> DataFrame:
        """The listing with status, kept for the whole scan; its counts come from the writing."""
        images, told = self._read("images"), Observation()
        status = maintenance.changes(found, images, self._read("thumbnails"), "modified_ns")
        met = status.join(images.select(*maintenance.KEY, "face_group_ids"), maintenance.KEY, "left")
        reuse = F.col("status").startswith("reuse")
        faces = F.sum(F.when(reuse, F.greatest(F.size("face_group_ids"), F.lit(0))))
        counted = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "reuse").alias("todo"), F.count_if(reuse).alias("reused"), F.coalesce(faces, F.lit(0)).alias("faces")]
        met.observe(told, *counted).write.parquet(f"{self.work}/listed")
        self.counts = told.get
        return self.spark.read.schema(met.schema).parquet(f"{self.work}/listed").drop("face_group_ids")

    def _left(self) -> list[str]:
        """Folders of steps that earlier scans of this root have finished."""
        runs = [f"{self.pending}/{run}" for run in self.store.names(self.pending)]
        return [f"{self.store.path}/{run}/{n.removesuffix('.json')}" for run in runs for n in self.store.names(run) if n.endswith(".json")]

    def _of_steps(self, folders: list[str], table: str) -> DataFrame:
        empty = self.spark.createDataFrame([], SCHEMAS[table])
        paths = [f"{f}/{table}" for f in folders]
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def _print(self) -> list[str]:
        return [*maintenance.KEY, "bytes", "modified_ns"]

    def _derive(self) -> None:
        """Derive what has to be, step by step; steps of a scan that broke off count where files are still the same."""
        app, left = self.app, self._left()
        fresh = self.listed.where("status in ('new', 'changed')")
        todo, self.rows, self.faces = self.listed.where("status <> 'reuse'"), 0, 0
        if left:
            before = self._of_steps(left, "images").join(fresh.select(self._print()), self._print(), "left_semi").dropDuplicates(maintenance.KEY)
            done = before.agg(*_observed()).first()
            self.rows, self.faces = done["rows"], done["faces"]
            todo = todo.join(before.select(maintenance.KEY), maintenance.KEY, "left_anti")
        size = app.settings().index_batch_size * self.spark.sparkContext.defaultParallelism
        staged, steps = in_steps(todo, size, f"{self.work}/todo")
        waiting = staged.count() if steps else 0
        handled, self.folders = self.counts["todo"] - waiting, list(left)
        self._tell(handled)
        for step in range(steps):
            app.gate.wait()
            part = staged.where(F.col("step") == step).drop("step")
            made, told, folder = app.derive(part.drop("status")), Observation(), f"{self.work}/step-{step}"
            keys = part.where("status in ('new', 'changed')").select(*maintenance.KEY)
            own = lambda rows, keys=keys: rows.join(keys, maintenance.KEY, "left_semi")
            images = own(_filled(made.images, IMAGES)).withColumn("id", F.coalesce("id", "path"))
            images.observe(told, *_observed()).write.mode("overwrite").parquet(f"{folder}/images")
            for table, rows in (("thumbnails", made.thumbnails), ("vectors", made.vectors), ("groups", made.groups)):
                if rows is not None:
                    filled = _filled(rows, SCHEMAS[table])
                    rows = own(filled) if table == "vectors" else filled
                (self.spark.createDataFrame([], SCHEMAS[table]) if rows is None else rows).write.mode("overwrite").parquet(f"{folder}/{table}")
            write_json(f"{folder}.json", told.get)  # from now on the step counts
            self.folders.append(folder)
            self.rows, self.faces = self.rows + told.get["rows"], self.faces + told.get["faces"]
            handled += min(size, waiting - step * size)
            self._tell(handled)

    def _tell(self, handled: int) -> None:
        c = self.counts
        plain = c["total"] - c["todo"]
        reused = c["reused"] if handled == c["todo"] else plain
        self.report(
            {
                "processed": plain + handled, "total": c["total"], "eta": remaining(handled, c["todo"], time.monotonic() - self.began),
                "indexed": reused + self.rows, "reused": reused, "skipped": max(0, handled - self.rows - (reused - plain)), "faces": self.faces + c["faces"],
            }
        )

    def run(self) -> ScanResult:
        store, root, app = self.store, self.root, self.app
        self._derive()
        app.gate.wait()
        after = store.next(self.state)
        key, old = maintenance.KEY, self._read("images")
        fresh_keys = self.listed.where("status in ('new', 'changed')").select(*key)
        rows = self._of_steps(self.folders, "images").join(self.listed.where("status in ('new', 'changed')").select(self._print()), self._print(), "left_semi")
        rows = rows.dropDuplicates(key)
        lost = self.spark.createDataFrame([], "root string, path string") if self.taken else old.select(*key).join(self.listed.select(*key), key, "left_anti")
        gone = fresh_keys.unionByName(lost)

        # groups and the people of images, from small columns
        stay = old.select(*key, "id", "filename", "face_group_ids", "people").join(gone, key, "left_anti")
        small = stay.unionByName(rows.select(stay.columns))
        found = self._groups(self._read("groups"), self._of_steps(self.folders, "groups"))
        made = store.write("groups", people.refresh_groups(found, small).withColumn("root", F.lit(root)))
        store.replace(after, "groups", root, made)
        named = store.read("groups", after, root)

        # parts that change: of new, changed and lost files, and of images whose people change
        n, wanted = self.state["buckets"].get(root), buckets_for(self.counts["total"])
        if n is None or not self.taken and not n / 4 <= wanted <= n * 4:  # a stream's batch doesn't tell how many there are
            n = wanted
        moved = n != self.state["buckets"].get(root, n)
        after["buckets"][root] = n
        part = bucket("path", n)
        touched = {r["part"] for r in gone.select(part.alias("part")).distinct().collect()}
        renamed = stay.select("id", "path", F.col("people").alias("was"), "face_group_ids").join(people.people_of(stay.select("id", "face_group_ids"), named), "id")
        renamed = renamed.where(~F.col("was").eqNullSafe(F.col("people")))
        parts = None if moved else touched | {r["part"] for r in renamed.select(part.alias("part")).distinct().collect()}
        if parts is None or parts:
            kept = self._read("images", parts).join(gone, key, "left_anti").unionByName(rows)
            store.replace(after, "images", root, store.write("images", with_people(kept, named), part), parts)
        if parts is None or parts:
            keys = gone.select(*key).unionByName(renamed.select(F.lit(root).alias("root"), "path")).distinct()
            left = old.select(*key, "id").join(gone, key, "left_semi").select("id")
            app._index(after, root, store.read("images", after, root, parts).join(keys, key, "left_semi"), left)
        if touched or root not in self.state["tables"].get("places", {}):
            placed = ranking.positions(small.select("root", "id", "path", "filename"), "path")
            store.replace(after, "places", root, store.write("places", placed))
        self._write_thumbnails(after, part, None if moved else touched)
        self._write_vectors(after, gone, n, None if moved or self.migrated else touched, named)
        if self.taken:
            after["taken"][self.taken[0]] = self.taken[1]
        after["root"] = root
        store.commit(after)
        app._forget()
        store.remove(self.pending)
        number = store.read("groups", after, root).count()
        c, indexed = self.counts, self.counts["reused"] + self.rows
        semantic = any(p.startswith("clip-") for p in store.parts("vectors", after, root))
        return ScanResult(root, c["total"], c["todo"], indexed, c["reused"], c["total"] - indexed, c["faces"] + self.faces, number, semantic)

    def _groups(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Groups with the new ones upserted; a name stays unless a new one is told."""
        last = maintenance.last_of(new.drop("root"), ["group_id"], ["face_count", "preview"]).select([F.col(c).alias(f"n_{c}") for c in new.columns if c != "root"])
        met = old.drop("root").join(last, F.col("group_id") == F.col("n_group_id"), "full")
        return met.select([F.coalesce(f"n_{c}", c).alias(c) for c in old.columns if c != "root"])

    def _write_thumbnails(self, after: dict, part: Column, touched: set[str] | None) -> None:
        """Thumbnails of new and changed files, and of unchanged ones that lacked one."""
        new = self._of_steps(self.folders, "thumbnails").where("thumbnail <> ''").dropDuplicates(maintenance.KEY)
        new = new.join(self.listed.select(*maintenance.KEY), maintenance.KEY, "left_semi")
        parts = None if touched is None else touched | {r["part"] for r in new.select(part.alias("part")).distinct().collect()}
        if parts is None or parts:
            merged = maintenance.upsert(self._read("thumbnails", parts), new)
            present = self.store.read("images", after, self.root, parts)
            self.store.replace(after, "thumbnails", self.root, self.store.write("thumbnails", maintenance.present(merged, present), part), parts)

    def _write_vectors(self, after: dict, gone: DataFrame, n: int, touched: set[str] | None, named: DataFrame) -> None:
        """Vectors of changed and lost files leave, whether there are new ones or not; faces are the groups' centroids."""
        store, root, dim = self.store, self.root, self.app.dimension
        known = {p for p in store.parts("vectors", self.state, root) if not p.startswith("face-")}
        parts = known if touched is None else {p for p in known if p.rpartition("-")[2] in touched}
        new = self._of_steps(self.folders, "vectors").where((F.col("kind") != "face") & (F.size("embedding") == dim))
        new = new.join(self.listed.where("status in ('new', 'changed')").select(*maintenance.KEY), maintenance.KEY, "left_semi").dropDuplicates(["kind", "path", "group_id"])
        old = self._read("vectors", parts).join(gone, maintenance.KEY, "left_anti").unionByName(new)
        held = maintenance.without_stale(old, store.read("images", after, root, touched))
        faces = maintenance.replace_faces(self.spark.createDataFrame([], VECTORS), named, root, dim)
        made = store.write("vectors", held.unionByName(faces), vector_part(n))
        store.replace(after, "vectors", root, made, parts | {"face-0"})


def vector_part(n: int) -> Column:
    """Faces lie in one part, other vectors in those of their files."""
    return F.when(F.col("kind") == "face", F.lit("face-0")).otherwise(F.concat_ws("-", "kind", bucket("path", n)))
