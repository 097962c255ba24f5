import threading

import pytest
from pyspark.sql import functions as F

from argentum import settings
from argentum.engine import Catalogue, Derived
from argentum.streaming import ingest


@pytest.fixture
def photos(tmp_path):
    root = tmp_path / "photos" / "in"
    root.mkdir(parents=True)
    for name, text in (("b.jpg", "the river"), ("A.PNG", "a dog by the river"), ("c.gif", "receipt total"), ("n.txt", "no picture"), ("bad.jpg", "?")):
        (root / name).write_bytes(text.encode())
    return root


def derive(listing):
    """The file's content is its text; who is in a picture is told by its name; ``bad`` ones can't be read."""
    spark = listing.sparkSession
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    read = listing.where("filename not like 'bad%'")
    paths = [r["path"] for r in read.select("path").collect()]
    if not paths:
        return Derived(read)
    text = content.load(paths).select("path", F.decode("content", "UTF-8").alias("ocr_text"))
    face = F.when(F.col("filename").isin("b.jpg", "A.PNG"), F.array(F.lit("face-1"))).when(F.col("filename") == "c.gif", F.array(F.lit("face-2"))).otherwise(F.array())
    images = read.join(text, "path").withColumn("face_group_ids", face.cast("array<string>"))
    vector = F.when(F.col("filename") == "c.gif", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    vectors = images.select(F.lit("clip").alias("kind"), "root", "path", F.lit("").alias("group_id"), vector.alias("embedding"))
    groups = spark.createDataFrame([("face-1", None, [1.0, 0.0]), ("face-2", None, [0.0, 1.0]), ("face-3", None, [1.0, 1.0])], "group_id string, name string, centroid array<float>")
    return Derived(images, images.select("root", "path", F.concat(F.lit("thumb of "), "filename").alias("thumbnail")), vectors, groups)


def test_scan_search_and_label(spark, photos, tmp_path):
    app = Catalogue(spark, str(tmp_path / "store"), derive, lambda q: [[1.0, 0.0]], dimension=2)
    assert app.current == (0, None) and app.face_groups() == []
    root = str(photos.parent)
    first = app.scan(root)
    assert (first.total, first.to_process, first.indexed, first.reused, first.skipped) == (4, 4, 3, 0, 1)
    assert (first.faces_detected, first.face_groups, first.semantic_available) == (3, 2, True)
    page = app.search("")
    assert [r["filename"] for r in page.images] == ["A.PNG", "b.jpg", "c.gif"] and page.total == 3 and not page.has_more
    assert page.images[0]["thumbnail"] == "thumb of A.PNG" and page.images[0]["score"] == 1.0
    assert [r["filename"] for r in app.search_page("", 1, 1).images] == ["b.jpg"] and app.search_page("", 1, 1).has_more
    # words, then the vector that is like the query's
    assert [r["filename"] for r in app.search("river").images] == ["A.PNG", "b.jpg", "c.gif"]
    kept = app.session[1]
    assert [r["filename"] for r in app.search_page("river", 1, 1).images] == ["b.jpg"] and app.session[1] is kept
    assert [r["filename"] for r in app.search("river 不要dog").images] == ["b.jpg", "c.gif"]
    assert app.search("river 最多1張").total == 1
    # labels
    assert [(g["group_id"], g["name"], g["face_count"]) for g in app.face_groups()] == [("face-1", None, 2), ("face-2", None, 1)]
    assert [(g["group_id"], g["name"]) for g in app.label("face-2", " Tony ")] == [("face-2", "Tony"), ("face-1", None)]
    assert app.session is None
    assert [(r["filename"], r["people"]) for r in app.search("TONY 照片").images] == [("c.gif", ["Tony"])]
    assert [(p["id"], p["name"], p["embedding"]) for p in settings.load_people(app.people_file)] == [("face-2", "Tony", [0.0, 1.0])]
    assert app.known_people().count() == 1
    with pytest.raises(KeyError):
        app.label("face-9", "x")
    # an unchanged, a changed, a new and a lost file
    (photos / "b.jpg").write_bytes(b"the mountain, now")
    (photos / "d.webp").write_bytes(b"a cat")
    (photos / "A.PNG").unlink()
    (photos / "bad.jpg").unlink()
    again = app.scan(root)
    assert (again.total, again.to_process, again.indexed, again.reused, again.skipped) == (3, 2, 3, 1, 0)
    assert [r["filename"] for r in app.search("").images] == ["b.jpg", "c.gif", "d.webp"]
    assert sorted(r["path"].rpartition("/")[2] for r in app.table("thumbnails").collect()) == ["b.jpg", "c.gif", "d.webp"]
    assert app.label("face-2", "  ")[0]["name"] is None and settings.load_people(app.people_file) == []


def test_settings_and_missing_folders(spark, tmp_path):
    app = Catalogue(spark, str(tmp_path / "store"))
    assert app.settings() == settings.Settings()
    app.update_settings(settings.Settings(max_indexed_images=1, clip_gpu=True))
    assert app.settings().clip_gpu and app.settings().index_batch_size == 50
    assert settings.Settings.of({"clip_gpu": True, "other": 1}) == settings.Settings(clip_gpu=True)
    for wrong in (settings.Settings(max_indexed_images=0), settings.Settings(index_batch_size=0)):
        with pytest.raises(ValueError):
            app.update_settings(wrong)
    settings.write_json(app.settings_file, [1])
    assert app.settings() == settings.Settings() and settings.load_people(app.settings_file) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        app.scan(str(tmp_path / "nowhere"))
    (tmp_path / "file.jpg").write_bytes(b"x")
    with pytest.raises(NotADirectoryError):
        app.scan(str(tmp_path / "file.jpg"))


def test_limited_scan_takes_the_first_by_path(spark, photos, tmp_path):
    app = Catalogue(spark, str(tmp_path / "store"))
    app.update_settings(settings.Settings(max_indexed_images=2))
    assert app.scan(str(photos.parent)).indexed == 2
    assert [r["filename"] for r in app.search("").images] == ["A.PNG", "b.jpg"]


def test_paused_stream_waits_and_reports(spark, photos, tmp_path):
    gate, told = ingest.Gate(), []
    gate.pause()
    query = ingest.follow(spark, str(photos.parent), str(tmp_path / "changes"), str(tmp_path / "ck"), 1, gate, told.append, total=4)
    assert gate.paused and not query.awaitTermination(3) and not told
    threading.Timer(0.1, gate.resume).start()
    assert query.awaitTermination(120)
    assert [t["done"] for t in told] == [1, 2, 3, 4] and told[-1]["eta"] == 0
    assert ingest.remaining(0, 4, 9) is None and ingest.remaining(1, 4, 0.4) is None and ingest.remaining(1, 4, 2) == 6
    assert ingest.latest(spark.read.parquet(str(tmp_path / "changes"))).count() == 4
