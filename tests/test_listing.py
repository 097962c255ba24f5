"""The folder source: every name, times in nanoseconds, slices, links, and its stream."""

import os
import time

import pytest
from pyspark.sql import functions as F

from argentum.operators import maintenance
from argentum.sources import files, listing
from argentum.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "photos"
    (root / "_sub").mkdir(parents=True)
    (root / ".hidden" / "deep er").mkdir(parents=True)
    for name in ("a.jpg", "_DSC0001.JPG", "_sub/e.jpg", ".hidden/deep er/f[1]{x}.png", "empty.gif", "n.txt", ".jpg", "ж 中.webp", "none"):
        (root / name).write_bytes(b"" if "empty" in name else name.encode())
    return root


NAMES = [".hidden/deep er/f[1]{x}.png", "_DSC0001.JPG", "_sub/e.jpg", "a.jpg", "empty.gif", "ж 中.webp"]


def told(df, root):
    return sorted(r["path"].removeprefix(f"file:{root}/") for r in df.collect())


def test_every_name_is_listed(spark, folder):
    found = files.scan(spark, str(folder))
    assert told(found, folder) == NAMES
    rows = {r["filename"]: r for r in found.collect()}
    for name in NAMES:
        stat, row = os.stat(folder / name), rows[name.rpartition("/")[2]]
        assert (row["bytes"], row["modified_ns"], row["modified_at"]) == (stat.st_size, stat.st_mtime_ns, str(stat.st_mtime_ns // 10**9))
    content = {r["filename"]: r["content"] for r in files.scan(spark, str(folder), with_content=True).collect()}
    assert content["f[1]{x}.png"] == b".hidden/deep er/f[1]{x}.png" and content["empty.gif"] == b""
    assert told(files.scan(spark, f"file://{folder}", limit=2), folder) == NAMES[:2]


def test_links_old_times_and_unreadable_ones(spark, folder, tmp_path):
    (tmp_path / "else").mkdir()
    (tmp_path / "else" / "far.jpg").write_bytes(b"1234")
    (folder / "link.jpg").symlink_to(tmp_path / "else" / "far.jpg")
    (folder / "lost.jpg").symlink_to(tmp_path / "nothing.jpg")
    (folder / "linked").symlink_to(tmp_path / "else")
    os.utime(folder / "a.jpg", ns=(0, -5_000_000_000))
    rows = {r["filename"]: r for r in files.scan(spark, str(folder)).collect()}
    assert rows["link.jpg"]["bytes"] == 4 and "lost.jpg" not in rows and "far.jpg" not in rows
    assert rows["a.jpg"]["modified_ns"] is None and rows["a.jpg"]["modified_at"] is None
    gone = files.scan(spark, str(folder))
    (folder / "_sub" / "e.jpg").unlink()
    assert "_sub/e.jpg" not in told(gone, folder)
    read = files.contents(spark.createDataFrame([(str(folder / "_sub" / "e.jpg"),), (None,), (str(folder / "n.txt"),)], "path string"))
    assert [r["content"] for r in read.collect()] == [None, None, b"n.txt"]


def test_missing_roots_are_errors(spark, folder):
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(folder / "nowhere"))
    with pytest.raises(NotADirectoryError):
        files.scan(spark, str(folder / "a.jpg"))


def test_a_change_within_a_millisecond_is_a_change(spark, folder):
    os.utime(folder / "a.jpg", ns=(10**18, 10**18 + 123_456_789))
    before = spark.createDataFrame(files.scan(spark, str(folder)).collect())
    os.utime(folder / "a.jpg", ns=(10**18, 10**18 + 123_456_790))
    status = maintenance.changes(files.scan(spark, str(folder)), before, before.select("root", "path"), "modified_ns")
    assert {r["filename"]: r["status"] for r in status.where("status <> 'reuse'").collect()} == {"a.jpg": "changed"}


@pytest.mark.parametrize("at_least,files_", [(1, 10**6), (3, 2), (64, 1)])
def test_slices_cover_each_file_once(folder, at_least, files_):
    pieces = listing.slices(str(folder), at_least, files_)
    found = sorted(p for piece in pieces for batch in listing.rows_of(str(folder), piece) for p in batch.column(0).to_pylist())
    assert found == sorted(f"file:{folder}/{n}" for n in [*NAMES, "n.txt", ".jpg", "none"])
    assert len(pieces) >= min(at_least, 4)


def follow(spark, folder, tmp_path, **more):
    query = ingest.follow(spark, str(folder), str(tmp_path / "changes"), str(tmp_path / "ck"), **more)
    assert query.awaitTermination(120)
    return spark.read.option("basePath", str(tmp_path / "changes")).parquet(str(tmp_path / "changes"))


def test_stream_tells_each_change_once(spark, folder, tmp_path):
    first = follow(spark, folder, tmp_path, files_per_batch=2)
    assert told(first, folder) == NAMES
    assert max(r["n"] for r in first.groupBy("batch", "step").agg(F.count("*").alias("n")).collect()) == 2
    assert told(follow(spark, folder, tmp_path), folder) == NAMES  # nothing new
    time.sleep(0.1)
    (folder / "_sub" / "_new.bmp").write_bytes(b"new")
    (folder / "a.jpg").write_bytes(b"another text")
    moved = tmp_path / "made elsewhere"
    moved.mkdir()
    (moved / "old.png").write_bytes(b"old")
    time.sleep(0.1)
    moved.rename(folder / "moved")  # its file keeps its own times
    again = follow(spark, folder, tmp_path)
    assert told(again, folder) == sorted([*NAMES, "_sub/_new.bmp", "a.jpg", "moved/old.png"])
    assert {r["filename"]: r["bytes"] for r in ingest.latest(again).collect()}["a.jpg"] == 12
