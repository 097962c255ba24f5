"""States of a catalogue: what a scan, a label and a stream write, what goes on after a break, and what stays."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from argentum import settings, store
from argentum.engine import Catalogue, Derived


@pytest.fixture
def photos(tmp_path):
    root = tmp_path / "photos"
    root.mkdir()
    for k in range(6):
        (root / f"p{k}.jpg").write_bytes(b"x" * (k + 1))
    return root


class Model:
    """Derives texts, vectors and groups; ``thumbs`` and ``vectors`` can be switched off, and a call can break."""

    def __init__(self):
        self.thumbs, self.vectors, self.seen, self.breaks = True, True, [], None

    def __call__(self, listing):
        names = sorted(r["filename"] for r in listing.collect())
        if self.breaks is not None and len(self.seen) >= self.breaks:
            raise RuntimeError("the model broke")
        self.seen.append(names)
        face = F.array(F.concat(F.lit("face-"), F.coalesce(F.substring("filename", 2, 1).try_cast("int"), F.lit(0)) % 2))
        images = listing.withColumn("ocr_text", F.concat(F.lit("text of "), "filename")).withColumn("face_group_ids", face)
        thumbs = listing.select("root", "path", F.concat(F.lit("thumb "), "bytes").alias("thumbnail")) if self.thumbs else None
        vector = F.array(F.col("bytes").cast("float"), F.lit(1.0).cast("float"))
        vectors = listing.select(F.lit("clip").alias("kind"), "root", "path", F.lit("").alias("group_id"), vector.alias("embedding")) if self.vectors else None
        groups = listing.sparkSession.createDataFrame([("face-0", None, [1.0, 0.0]), ("face-1", None, [0.0, 1.0])], "group_id string, name string, centroid array<float>")
        return Derived(images, thumbs, vectors, groups)


def names(df):
    return sorted(r["path"].rpartition("/")[2] for r in df.collect())


def parquet_files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, found in os.walk(path) for f in found if f.endswith(".parquet")}


def test_reused_rows_get_their_thumbnails_and_changed_ones_lose_their_vectors(spark, photos, tmp_path):
    model, told = Model(), []
    app = Catalogue(spark, str(tmp_path / "store"), model, dimension=2)
    model.thumbs = False
    first = app.scan(str(photos), told.append)
    assert (first.to_process, first.indexed, first.face_groups, first.semantic_available) == (6, 6, 2, True)
    assert told[0]["processed"] == 0 and (told[-1]["processed"], told[-1]["total"], told[-1]["eta"], told[-1]["indexed"], told[-1]["faces"]) == (6, 6, 0, 6, 6)
    assert app.table("thumbnails").isEmpty()
    model.thumbs = True
    second = app.scan(str(photos), told.append)
    assert (second.to_process, second.reused, second.indexed, second.skipped) == (6, 6, 6, 0)
    assert (told[-1]["reused"], told[-1]["skipped"], told[-1]["processed"]) == (6, 0, 6)
    assert names(app.table("thumbnails")) == [f"p{k}.jpg" for k in range(6)]
    assert app.scan(str(photos)).to_process == 0 and len(model.seen) == 2
    # a changed file without a new vector must not keep the old picture's
    model.vectors = False
    (photos / "p2.jpg").write_bytes(b"another one")
    (photos / "p5.jpg").unlink()
    third = app.scan(str(photos))
    assert (third.total, third.to_process, third.indexed) == (5, 1, 5)
    assert names(app.table("vectors").where("kind = 'clip'")) == ["p0.jpg", "p1.jpg", "p3.jpg", "p4.jpg"]
    assert names(app.table("thumbnails")) == ["p0.jpg", "p1.jpg", "p2.jpg", "p3.jpg", "p4.jpg"]
    assert {r["thumbnail"] for r in app.table("thumbnails").where("path like '%p2.jpg'").collect()} == {"thumb 11"}
    assert [r["filename"] for r in app.search_page("", 3, 2).images] == ["p3.jpg", "p4.jpg"] and app.search_page("", 9, 2).images == []


def test_what_is_derived_before_a_break_is_kept(spark, photos, tmp_path):
    model, told = Model(), []
    app = Catalogue(spark, str(tmp_path / "store"), model, dimension=2)
    app.update_settings(settings.Settings(index_batch_size=1))
    model.breaks = 0
    with pytest.raises(RuntimeError):
        app.scan(str(photos))
    assert app.current == (0, None)
    for k in range(6, 20):
        (photos / f"q{k}.jpg").write_bytes(b"y" * k)
    model.breaks = 2
    cores = spark.sparkContext.defaultParallelism
    with pytest.raises(RuntimeError):
        app.scan(str(photos), told.append)
    assert [len(s) for s in model.seen] == [cores, cores] and told[-1]["processed"] == 2 * cores and app.current == (0, None)
    changed = model.seen[0][0]
    (photos / changed).write_bytes(b"changed meanwhile")
    model.breaks = None
    done = app.scan(str(photos))
    assert (done.total, done.indexed, done.skipped) == (20, 20, 0)
    left = 20 - 2 * cores + 1
    assert sum(map(len, model.seen[2:])) == left and changed in sum(model.seen[2:], [])
    assert app.table("images").count() == app.table("vectors").where("kind = 'clip'").count() == 20
    assert not any(app._store.names(n) for n in app._store.names("") if n == "pending")


def test_a_label_writes_what_it_changes(spark, photos, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROWS_PER_PART", 2)
    app = Catalogue(spark, str(tmp_path / "store"), Model(), dimension=2)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "p9.jpg").write_bytes(b"9")
    app.scan(str(tmp_path / "other"))
    app.scan(str(photos))
    state = app._store.state()
    assert len(state["tables"]["images"][str(photos)]) > 1
    files = parquet_files(tmp_path / "store")
    app.label("face-1", "Ann")
    after, now = app._store.state(), parquet_files(tmp_path / "store")
    for table in ("thumbnails", "vectors", "places"):
        assert after["tables"][table] == state["tables"][table]
    for table in ("images", "groups"):
        assert after["tables"][table][str(tmp_path / "other")] == state["tables"][table][str(tmp_path / "other")]
    new = {f for f in now if f not in files}
    assert new and all(f"{tmp_path}/store/{t}/" in f for f in new for t in [f.removeprefix(f"{tmp_path}/store/").split("/")[0]])
    assert {f.removeprefix(f"{tmp_path}/store/").split("/")[0] for f in new} == {"images", "groups", "postings", "owners"}
    assert {(r["filename"], *r["people"]) for r in app.table("images").where(F.col("root") == str(photos)).collect()} == {
        (f"p{k}.jpg", "Ann") if k % 2 else (f"p{k}.jpg",) for k in range(6)
    }
    # one changed file: one part of images, thumbnails and vectors; states before the last two go
    (photos / "p3.jpg").write_bytes(b"other bytes")
    app.scan(str(photos))
    third = app._store.state()
    for table in ("images", "thumbnails"):
        before, then = after["tables"][table][str(photos)], third["tables"][table][str(photos)]
        assert sum(before[p] != then[p] for p in before) == 1
    assert [g["name"] for g in app.face_groups()] == ["Ann", None]
    assert len(list((tmp_path / "store" / "states").iterdir())) == 2 * store.KEPT  # each with its checksum
    held = {f for s in (after, third) for f in store._folders(s)}
    assert all(any(f"/{h}/" in f for h in held) for f in parquet_files(tmp_path / "store"))
    with pytest.raises(store.Conflict):
        app._store.commit(after)
    assert app._store.state() == third


def test_old_vectors_are_taken_once(spark, photos, tmp_path):
    model = Model()
    model.vectors = False
    app = Catalogue(spark, str(tmp_path / "store"), model, dimension=2)
    rows = [(str(photos), f"file:{photos}/p{k}.jpg", json.dumps({"embedding": [float(k)] * (1 if k == 4 else 2)})) for k in (1, 4)]
    rows += [(str(photos), f"file:{photos}/gone.jpg", '{"embedding": [1, 2]}'), (str(photos), "x", "{no json"), ("elsewhere", "y", '{"embedding": [1, 2]}')]
    app.scan(str(photos))
    spark.createDataFrame(rows, "root string, path string, record_json string").write.parquet(str(tmp_path / "store" / "legacy"))
    assert app.scan(str(photos)).semantic_available
    assert names(app.table("vectors").where("kind = 'clip'")) == ["p1.jpg"]
    assert app._store.state()["migrated"] == [str(photos)]
    (photos / "p1.jpg").write_bytes(b"changed, and no vector of it")
    assert not app.scan(str(photos)).semantic_available


def test_a_stream_takes_each_batch_once(spark, photos, tmp_path):
    model = Model()
    app, checkpoint = Catalogue(spark, str(tmp_path / "store"), model, dimension=2), str(tmp_path / "ck")
    assert app.follow(str(photos), checkpoint).awaitTermination(120)
    assert app.table("images").count() == 6 and app.root == str(photos)
    taken = app._store.state()["taken"]
    assert list(taken.values()) == [0]
    # the batch's commit is lost: it is run again and changes nothing
    os.remove(tmp_path / "ck" / "commits" / "0")
    for hidden in (tmp_path / "ck" / "commits").glob(".0.crc"):
        hidden.unlink()
    version = app.current[0]
    assert app.follow(str(photos), checkpoint).awaitTermination(120)
    assert app.current[0] == version and len(model.seen) == 1
    time.sleep(0.1)
    (photos / "_new.png").write_bytes(b"n")
    (photos / "p0.jpg").write_bytes(b"changed")
    (photos / "p1.jpg").unlink()  # a stream doesn't hear of lost files
    query = app.follow(str(photos), checkpoint, once=False)
    query.processAllAvailable()
    query.stop()
    assert names(app.table("images")) == ["_new.png", "p0.jpg", "p1.jpg", "p2.jpg", "p3.jpg", "p4.jpg", "p5.jpg"]
    assert model.seen[1] == ["_new.png", "p0.jpg"]
    assert app.scan(str(photos)).total == 6 and names(app.table("images"))[-1] == "p5.jpg" and len(model.seen) == 2


def test_pages_are_ranges_of_places(spark, photos, tmp_path):
    app = Catalogue(spark, str(tmp_path / "store"), Model(), dimension=2)
    app.scan(str(photos))
    assert [r["filename"] for r in app.search_page("text", 2, 3).images] == ["p2.jpg", "p3.jpg", "p4.jpg"]
    assert app.search_page("text", 4, 3).has_more is False and app.search_page("text 最多 3 張", 1, 5).total == 3
    assert [r["filename"] for r in app.search_page("text 最多 3 張", 1, 5).images] == ["p1.jpg", "p2.jpg"]
    plan = app.session[1].where("position between 2 and 4")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "PushedFilters: [IsNotNull(position), GreaterThanOrEqual(position,2), LessThanOrEqual(position,4)]" in plan


def found(app, *terms, **more):
    return {r["id"].rpartition("/")[2]: r["score"] for r in app.text_scores(list(terms), **more).collect()}


def test_words_are_found_without_reading_texts(spark, photos, tmp_path):
    app = Catalogue(spark, str(tmp_path / "store"), Model(), dimension=2)
    app.scan(str(photos))
    every = {f"p{k}.jpg" for k in range(6)}
    assert found(app, "text") == dict.fromkeys(every, 1) and found(app, "text of", "P3.JPG", "p3") == {n: 3 if n == "p3.jpg" else 1 for n in every}
    assert found(app, "of text") == {} == found(app, "—", "") and found(app, "text", must_not=["p3 jpg"]) == dict.fromkeys(every - {"p3.jpg"}, 1)
    plan = app.text_scores(["text of"])._jdf.queryExecution().executedPlan().toString()
    assert "ocr_text" not in plan and "term:string" in plan
    app.label("face-1", "Ann Lee")
    assert found(app, "ann lee") == {"p1.jpg": 1, "p3.jpg": 1, "p5.jpg": 1} and found(app, "text") == dict.fromkeys(every, 1)
    (photos / "p3.jpg").unlink()
    (photos / "p5.jpg").rename(photos / "new name.png")
    app.scan(str(photos))
    assert found(app, "p3") == {} == found(app, "p5 jpg") and found(app, "text of new name") == {"new name.png": 1}


def test_segments_are_merged(spark, photos, tmp_path, monkeypatch):
    monkeypatch.setattr("argentum.engine.SEGMENTS", 2)
    app = Catalogue(spark, str(tmp_path / "store"), Model(), dimension=2)
    counts = []
    for k in range(4):
        (photos / f"q{k}.jpg").write_bytes(b"q")
        app.scan(str(photos))
        counts.append(len({p.partition("-")[0] for p in app._store.parts("postings", app._store.state(), str(photos))}))
        assert len(found(app, "text")) == 7 + k and found(app, f"q{k}") == {f"q{k}.jpg": 1}
    assert counts == [1, 2, 1, 2]
