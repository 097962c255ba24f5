import numpy as np
import pytest
from pyspark.sql import functions as F

from argentum.functions import faces, media
from argentum.operators import fulltext, maintenance, predicates, ranking, vectors
from argentum.sources import files
from argentum.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_exif_datetime(spark):
    given = ["2025:07:01 12:34:56", "not-a-date", "2025:13:01 12:34:56", None, "2025:02:31 1:2:3"]
    want = ["2025-07-01 12:34:56", None, None, None, "2025-02-31 01:02:03"]
    assert [one(spark, media.exif_datetime(F.lit(x).cast("string"))) for x in given] == want


def test_thumbnail_sides(spark):
    for w, h, want in ((4000, 3000, (480, 360)), (3000, 4000, (360, 480)), (1, 1, (480, 480))):
        a, b = F.lit(w), F.lit(h)
        assert (one(spark, media.thumbnail_width(a, b)), one(spark, media.thumbnail_height(a, b))) == want


def test_cosine_and_threshold(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    for a, b, want in (((1, 0), (1, 0), 1), ((1, 0), (-1, 0), -1), ((1, 0), (0, 1), 0), ((0, 0), (1, 0), 0), ((1,), (1, 0), 0)):
        assert abs(one(spark, vectors.cosine(v(*a), v(*b))) - want) < 1e-6
    for best, want in ((0.33, 0.26), (0.24, 0.20), (0.18, 0.20), (None, 0.20)):
        assert abs(one(spark, vectors.threshold(F.lit(best).cast("double"))) - want) < 1e-9


def test_full_text(spark):
    rows = {
        "p1": ("IMG_2024-receipt.jpg", "Total invoice 海邊的狗", "Tony Wang"),
        "p2": ("海邊 dog.png", "foo-bar baz Straße", "小明"),
        "p3": ("x.jpg", "café café a b", "A"),
    }
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "id string, f string, o string, p string")
    texts = [F.col(c) for c in "fop"]
    hits = {
        "p1": ["receipt", "RECEIPT", "img", "2024", "tony", "海邊的狗", "2024 receipt", "invoice 海邊的狗"],
        "p2": ["海邊", "foo bar", "foo-bar", "bar baz", "小明", "straße"],
        "p3": ["café", 'a"b'],
        None: ["invo", "的狗", "jpg total", "—", "", "cafe", "p1", "r", "wang tony", "img receipt"],
    }
    for want, terms in hits.items():
        for term in terms:
            got = [r["id"] for r in df.where(fulltext.matches(texts, term)).collect()]
            assert got == ([want] if want else []), term


def test_terms_between_blanks(spark):
    df = spark.createDataFrame([("a b\u3000c d. e\\f(g",)], "hay string")
    for term, want in (("bcd", True), ("b c", True), ("B C", True), ("c d.", True), ("c.d", False), (". e\\f(", True), ("x", False), ("da", False)):
        assert df.select(predicates.has_term(F.col("hay"), term).alias("x")).first()["x"] is want, term


def test_data_urls_that_are_none(spark):
    good = media.DATA_URL + "AAECAw=="
    for url, want in ((good, b"\0\1\2\3"), (media.DATA_URL, b""), (good + "=", None), (good[1:], None), (media.DATA_URL + "AB*=", None), (media.DATA_URL + "AAF=", None), (None, None)):
        got = one(spark, media.from_data_url(F.lit(url).cast("string")))
        assert (None if got is None else bytes(got)) == want, url


def test_date_keys_are_utc_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Asia/Taipei"):
            spark.conf.set("spark.sql.session.timeZone", name)
            for seconds, want in (("0", "1970-01-01 00:00:00"), ("-1", "1969-12-31 23:59:59"), ("1784246400", "2026-07-17 00:00:00"), ("2026-08-19", None), (None, None)):
                assert one(spark, predicates.date_key(F.lit(None).cast("string"), F.lit(seconds).cast("string"))) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_cards_and_names(spark):
    text = "\U0001f600" * 60
    assert one(spark, media.utf16_prefix(F.lit(text), 100)) == text[:50]
    assert one(spark, media.utf16_prefix(F.lit("a" + text), 100)) == "a" + text[:49]
    assert one(spark, media.utf16_prefix(F.lit("é" * 120), 100)) == "é" * 100
    none = F.lit(None).cast("string")
    assert one(spark, media.card(F.lit(""), F.array(F.lit("Ann"), F.lit("Bo")), F.lit(4), F.lit(3), none)) == "4 × 3 | Ann、Bo"
    assert one(spark, media.card(F.lit("x"), F.array().cast("array<string>"), F.lit(None).cast("int"), F.lit(3), F.lit("2024"))) == "圖片 | 拍攝：2024 | OCR：x"
    for path, want in (("/a/b.jpg", "b.jpg"), ("/a/", "圖片"), (None, "圖片")):
        assert one(spark, media.filename(F.lit(path).cast("string"))) == want
    for seconds, want in ((None, "正在估算完成時間…"), (0, "即將完成"), (59, "預估剩餘 59 秒"), (61, "預估剩餘 1 分鐘 1 秒"), (3660, "預估剩餘 1 小時 1 分鐘")):
        assert one(spark, media.eta_text(F.lit(seconds).cast("long"))) == want


def test_recogniser_output(spark):
    line = lambda conf, word: "\t".join(["1"] * 10 + [conf, word])
    read = lambda *lines: one(spark, media.tsv_text(F.lit("\n".join(["header", *lines]))))
    assert read(line("90", " a\tb "), line("-1", "c"), "short", line("x", "\u3000")) == ("a\tb c", 90.0)
    assert read(line("10", "a"), line("20", "b")) is None and read() is None and read(line("50", " ")) is None
    assert read(line("NaN", "a")) == ("a", 0.0) and read(line("30", "a") + "\r", line("20", "b")) == ("a b", 25.0)


def test_overlapping_and_small_faces(spark):
    rows = [(1, 0, 0.9, 0, 0, 10, 10), (1, 1, 0.8, 1, 0, 11, 10), (1, 2, 0.7, 8, 0, 18, 10), (1, 3, 0.9, 1, 0, 11, 10), (2, 0, 0.1, 0, 0, 1, 1)]
    found = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], "image int, n int, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r["image"], r["n"]) for r in faces.suppress(found, "image", ["n"]).collect()) == [(1, 0), (1, 2), (2, 0)]
    assert faces.suppress(found.where("false"), "image", ["n"]).count() == 0
    box = lambda *x: [F.lit(float(v)) for v in x]
    assert one(spark, faces.large_enough(box(0, 0, 24, 24))) and not one(spark, faces.large_enough(box(0, 0, 24, 23.9)))
    assert one(spark, faces.crop(box(10, 10, 60, 60), F.lit(100), F.lit(100))) == (0, 0, 71, 74)
    assert one(spark, faces.crop(box(500, 500, 501, 501), F.lit(100), F.lit(50))) == (99, 49, 1, 1)
    assert one(spark, faces.fitted(F.lit(360), F.lit(90))) == (180, 45) and one(spark, faces.fitted(F.lit(1), F.lit(1000))) == (1, 180)
    grid = spark.createDataFrame([(1, 320, 2.0, [0.1, 0.9, 0.7, 0.66, 0.9, 0.9, 0.9, 0.9, 0.9], [0.5] * 32, [0.25] * 80)], "image int, stride int, scale double, scores array<double>, boxes array<double>, landmarks array<double>")
    got = {r["anchor"]: (r["x1"], r["y1"], r["x2"], r["y2"], r["landmarks"][:2]) for r in faces.decode(grid, "image").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    assert got[1] == (-80.0, -80.0, 80.0, 80.0, [40.0, 40.0]) and got[6] == (80.0, 80.0, 240.0, 240.0, [200.0, 200.0])


def test_nearest_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(40)] + [(40, None), (41, []), (42, [0.0] * 4), (43, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    groups = spark.createDataFrame([(f"g{i:02d}", v) for i, v in rows[:20]] + [("twin", rows[3][1]), ("short", [1.0, 1.0])], "group_id string, c array<double>")
    one_block = sorted(map(tuple, vectors.nearest_group(table, groups, "id", "v", "c", 0.3).collect()))
    assert one_block == sorted(map(tuple, vectors.nearest_group(table, groups, "id", "v", "c", 0.3, rows=3).collect()))
    got = {r[0]: r[1] for r in one_block}
    assert got[3] == "twin" and got[43] == "short" and not {40, 41, 42} & set(got)
    unit = np.array([v for _, v in rows[:40]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = {(q, int(i)) for q in (0, 20) for i in np.argsort(-(unit @ unit[q]))[:5]}
    near = vectors.nearest_each(table, table.where("id % 20 = 0"), 5, "id", "v", rows=1)
    assert {(r["query"], r["id"]) for r in near.where("query < 40").collect()} == want
    assert "Join" not in vectors.nearest_group(table, groups, "id", "v", "c", 0.3)._jdf.queryExecution().toString()


def test_pages_seek_and_hydrate(spark):
    hits = spark.createDataFrame([(f"f{i % 7}", i, float(i % 3)) for i in range(50)], "filename string, id long, score double")
    whole = ranking.ordered(hits).collect()
    assert ranking.ordered(hits, 2**40).count() == 50
    last = whole[19]
    seek = ranking.page(hits, size=10, after=(last["score"], last["filename"], last["id"])).collect()
    assert seek == whole[20:30] == ranking.page(hits, 20, 10).collect()
    thumbs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, thumbnail string")
    shown = ranking.hydrate(hits.where("id < 3"), thumbs)
    assert sorted((r["id"], r["thumbnail"]) for r in shown.collect()) == [(0, ""), (1, "a"), (2, "b")]
    assert "SortMergeJoin" not in shown._jdf.queryExecution().toString()
    many = spark.range(201).withColumn("score", F.lit(1.0))
    try:
        ranking.hydrate(many, thumbs)
        raise AssertionError
    except ValueError:
        pass
    images = spark.createDataFrame([(i, n) for i, n in enumerate(["b", "A", "a", "B", "c"])], "id long, filename string")
    assert sorted((r["position"], r["id"]) for r in ranking.positions(images).collect()) == [(0, 1), (1, 2), (2, 0), (3, 3), (4, 4)]
    same = spark.range(500).select((F.col("id") * 7 % 500).alias("id"), F.lit("image.jpg").alias("filename"))
    assert all(r["position"] == r["id"] for r in ranking.positions(same, buckets=5).collect())
    assert ranking.positions(same.where("false")).count() == 0


def test_query_vectors_without_a_cap(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "id long, v array<double>")
    got = {r["id"]: r["sim"] for r in vectors.similarities(df, [[0.0, 1.0], [-1.0, 0.0], [1.0, 0.0]], "id", "v").collect()}
    assert got == {1: 1.0} and vectors.similarities(df, [], "id", "v").count() == 0


def test_scan_follow_and_upsert(spark, tmp_path):
    root = tmp_path / "photos" / "a"
    root.mkdir(parents=True)
    for name in ("x.JPG", "y.png", "z.txt"):
        (root / name).write_bytes(name.encode())
    found = files.scan(spark, str(tmp_path / "photos"))
    assert sorted(r["filename"] for r in found.collect()) == ["x.JPG", "y.png"]
    ingest.follow(spark, str(tmp_path / "photos"), str(tmp_path / "changes"), str(tmp_path / "ck")).awaitTermination(120)
    (root / "w.gif").write_bytes(b"w")
    ingest.follow(spark, str(tmp_path / "photos"), str(tmp_path / "changes"), str(tmp_path / "ck")).awaitTermination(120)
    rows = ingest.latest(spark.read.parquet(str(tmp_path / "changes")))
    assert sorted(r["filename"] for r in rows.collect()) == ["w.gif", "x.JPG", "y.png"]
    changed = rows.where("filename = 'x.JPG'").withColumn("bytes", F.lit(99).cast("long"))
    merged = {r["filename"]: r["bytes"] for r in maintenance.upsert(rows, changed).collect()}
    assert merged == {"w.gif": 1, "x.JPG": 99, "y.png": 5}


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.05 * rng.standard_normal((n, dim))
    x[::7] = x[0]  # many copies, and so ties
    return [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [1.0, 2.0]), (n + 4, [2.0, 1.0])]


def plain_similarities(rows, queries):
    """{query: [(sim, key)]} of vectors of one length, rounded as told."""
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    some = [(i, unit(v)) for i, v in rows if v and any(v)]
    return {q: [(round(float(np.clip(unit(w) @ x, -1, 1)), 12), i) for i, x in some if len(x) == len(w)] for q, w in queries if w and any(w)}


@pytest.mark.parametrize("rows,abreast", [(4096, 16384), (60, 50), (7, 1000)])
def test_block_join_is_exact_and_skips_blocks(spark, rows, abreast):
    given = clustered(600, 16, 2)
    table = spark.createDataFrame(given, "id long, v array<double>")
    found = vectors.nearest_each(table, table.where("id % 20 = 0"), 5, "id", "v", rows, abreast)
    want = {q: sorted(sims, key=lambda s: (-s[0], s[1]))[:5] for q, sims in plain_similarities(given, [g for g in given if g[0] % 20 == 0]).items()}
    got = {}
    for r in found.orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append((r["sim"], r["id"]))
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(abs(a[0] - b[0]) < 1e-9 for q in got for a, b in zip(got[q], want[q]))
    plan = found._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Scan ExistingRDD") == 2 and "CartesianProduct" not in plan
    held = vectors.cells(table, "id", "v", rows)
    if rows < 600:
        x = np.array([v for _, v in given[:600]])
        x /= np.linalg.norm(x, axis=1)[:, None]
        assert held[16].count.sum() == 600 and held[2].count.tolist() == [2]
        assert held[16].routes(x, 5, None).mean() < 0.5  # most cells are skipped
        assert held[16].routes(x, 5, 0.9).mean() <= held[16].routes(x, 5, None).mean()
    groups = spark.createDataFrame([(f"g{i:04}", v) for i, v in given if i % 3 == 0], "group_id string, c array<double>")
    best = {r["id"]: (r["group_id"], r["sim"]) for r in vectors.nearest_group(table, groups, "id", "v", "c", 0.8, rows=rows, abreast=abreast).collect()}
    names = plain_similarities([(f"g{i:04}", v) for i, v in given if i % 3 == 0], given)
    want = {q: max(sims)[1] for q, sims in names.items() if sims and max(sims)[0] >= 0.8}
    assert {q: b[0] for q, b in best.items()} == want
    nothing = table.where("false")
    assert vectors.nearest_each(nothing, table, 3, "id", "v").isEmpty() and vectors.nearest_each(table, nothing, 3, "id", "v").isEmpty()


def test_limits_past_a_long_cut_nothing(spark):
    hits = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(5)], "id long, filename string, score double")
    for limit in (2**63, 2**64 - 1):
        assert ranking.page_metadata(hits, 0, 3, limit).first()["total"] == 5 and ranking.page(hits, 0, 3, limit).count() == 3
