"""Each operator against a brute-force version, its SQL, an exact round trip or held-out accuracy."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from argentum.llm import (
    common,
    components,
    decontaminate,
    entry,
    exact_dedup,
    langid,
    license_scan,
    minhash,
    packing,
    sharding,
    textops,
    tokens,
    toxicity,
    url_filter,
    warc,
)

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt string, sha string, body string, id long, score double, label int"
BASE = "the quick brown fox jumps over a lazy dog while seven old friends watch the river flow past the mill"


def odd_rows():
    long = " ".join(f"w{i % 5000}" for i in range(60000))
    texts = [None, "", " \n\t", "...!?", "a", BASE, BASE, BASE + " ", BASE.replace("seven", "eight"), "éß 中文", long, long + " end", "x" * 200000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, BASE), (None, BASE), (None, None), (None, "only here")]
    return [(i, t, "en", "s", 1, "x", "x", "x", 7, 0.5, 1) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df, rel = entry.queries()[name](spark, DATA), db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    tidy = lambda rows, cols: sorted(str([round(r[cols.index(c)], 9) if isinstance(r[cols.index(c)], float) else r[cols.index(c)] for c in sorted(cols)]) for r in rows)
    assert tidy(df.collect(), df.columns) == tidy(rel.fetchall(), list(rel.columns))


# --- exact copies


def test_exact_copies_of_odd_rows(odd, none):
    got = exact_dedup.copies(odd).collect()
    want = defaultdict(list)
    for r in odd_rows():
        body = "".join(c for c in (r[1] or "") if c not in " \t\n\x0b\x0c\r")
        want[body].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    assert len(got) == len(odd_rows())
    sizes = Counter(r["text_sha256"] for r in got)
    for body, group in want.items():
        sha = hashlib.sha256(body.encode()).hexdigest()
        top = min(group)
        assert sizes[sha] == len(group)
        for r in got:
            if r["text_sha256"] == sha:
                assert (r["group_size"], r["keep_id"]) == (len(group), None if top[1] else top[2])
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(want)
    assert exact_dedup.copies(none).count() == exact_dedup.drop_copies(none).count() == 0


# --- near copies


def words_of(text):
    hasher = textops.Hasher()
    (_, data, cuts), = textops.chunks(pa.array([text]))
    return hasher.words(data, cuts)


def shingles(text):
    hashes, firsts, _, _ = words_of(text)
    return textops.occurrences(textops.windows(hashes, firsts, minhash.WIDTH)[2])


def test_near_copies_against_all_pairs(spark, docs, texts):
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            short, long = sorted((len(sets[a]), len(sets[b])))
            if short >= 0.8 * long and minhash.overlap(sets[a], sets[b]) >= 0.8:
                links += find(a) != find(b)
                low, high = sorted((find(a), find(b)))
                root[high] = low
    wrong = [i for i in ids if got[i] != find(i)]
    assert links > 20
    assert len(wrong) <= max(1, 0.02 * links)  # pairs just over the threshold may share no band
    for i in wrong:
        assert got[i] >= find(i)  # never a link that isn't there


def test_near_copies_of_odd_rows(odd, none):
    got = {(r["doc_id"], r["class_id"]) for r in minhash.classes(odd).collect()}
    of = {i: c for i, c in got if i is not None}
    assert of[0] == of[1] == of[2] == of[3] == 0
    assert of[5] == of[6] == of[7] == 5 and of[10] == of[11] == 10
    assert (None, None) in got
    kept = minhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sum(r["doc_id"] is None for r in kept.collect()) == 3
    assert minhash.classes(none).count() == minhash.drop_near_copies(none).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    code = np.sort(rng.integers(1, 1 << 60, 400).astype(np.uint64))
    a, b = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    text = np.repeat([0, 1], 400)
    agree = []
    for k in range(40):
        shifted = textops.mix(code + np.uint64(k))
        order = np.argsort(shifted)
        s = minhash.signatures(text, np.tile(shifted[order], 2), np.concatenate([a[order], b[order]]), 2)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(30)] + [(7, 7), (500, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + k] for k in range(30)} == {100} and got[500] == 500


# --- decontamination


def smith_waterman(item, passage):
    best, above = 0.0, [0.0] * (len(passage) + 1)
    for w in item:
        row = [0.0]
        for j, p in enumerate(passage):
            row.append(max(0.0, above[j] + (1 if p == w else -0.5), above[j + 1] - 0.5, row[-1] - 0.5))
        best, above = max(best, *row), row
    return best


def test_alignment_against_plain_version():
    rng = np.random.default_rng(1)
    for _ in range(60):
        item, passage = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 40))
        assert abs(decontaminate.align(item, passage)[0] - smith_waterman(list(item), list(passage))) < 1e-9
        assert decontaminate.reachable(item, passage) >= smith_waterman(list(item), list(passage)) / len(item) - 1e-9


def test_leaks_against_all_pairs(spark, docs, texts):
    items = pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    bags = {i: (w, set(w.tolist())) for i, w in ((i, words_of(t)[0]) for i, t in texts.items())}
    for item in items:
        words = words_of(item["text"])[0]
        for i, (own, bag) in bags.items():
            if sum(w in bag for w in words.tolist()) < 0.5 * len(words):
                continue
            score = decontaminate.align(words, own)[0] / len(words)
            if score >= 0.7:
                assert abs(got[i, item["item_id"]] - score) < 1e-9
            elif score < 0.5:
                assert (i, item["item_id"]) not in got
    assert got


def test_edited_leaks_and_odd_rows(spark, odd, none):
    item = " ".join(f"item{k} word{k}" for k in range(20))
    edited = item.replace("item3 ", "").replace("word9", "other").replace("item15", "more item15")
    rows = [(1, f"before {item} after"), (2, f"a b c {edited} d"), (3, "nothing of it"), (4, None), (2, f"a b c {edited} d")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(9, item), (None, None), (8, ""), (7, "yes it is")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["start_word"]) for r in decontaminate.find(table, tests).collect()]
    assert sorted(got) == [(1, 9, 1), (2, 9, 3), (2, 9, 3)]
    assert [r["doc_id"] for r in decontaminate.drop_leaks(table, tests).collect()] == [3, 4]
    assert decontaminate.find(odd, tests).count() == 0
    assert decontaminate.drop_leaks(odd, tests.where("false")).count() == len(odd_rows())
    assert decontaminate.find(none, tests).count() == 0


def test_leaks_where_only_edited_copies_stand(spark):
    """No seed of the items need be whole anywhere: every passage that reaches the threshold is found."""
    rng = np.random.default_rng(5)
    items = [[f"i{k}w{rng.integers(0, 60)}" if rng.random() < 0.7 else f"c{rng.integers(0, 8)}" for _ in range(n)] for k, n in enumerate(rng.integers(8, 60, 60))]
    rows = []
    for k, words in enumerate(items):
        share = rng.uniform(0.05, 0.35)
        own = [w if rng.random() > share else f"x{rng.integers(0, 10**9)}" for w in words]
        thirds = [w if i % 3 < 2 else "other" for i, w in enumerate(words)]  # no three words in a row are left
        put = [x for i, w in enumerate(words) for x in ([w, "more"] if i % 2 else [w])]
        apart = [x for w in words for x in (w, "and")]
        rows += [["c1", "c2"] * int(rng.integers(0, 30)) + x + ["c3"] * 9 for x in (own, thirds, put, apart)]
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find(table, tests).collect()}
    want = {}
    for k, words in enumerate(items):
        for i in range(4 * k, 4 * k + 4):
            names = {w: j for j, w in enumerate(dict.fromkeys(words + rows[i]))}
            score = decontaminate.align(np.array([names[w] for w in words]), np.array([names[w] for w in rows[i]]))[0] / len(words)
            if score >= 0.5:
                want[i, k] = score
    assert len(want) > 150 and {g: s for g, s in got.items() if g[0] // 4 == g[1]} == pytest.approx(want)
    assert not set(decontaminate.drop_leaks(table, tests).toPandas()["doc_id"]) & {i for i, _ in want}


def test_short_items_stand_word_for_word_in_long_texts(spark):
    items = [(1, "What is the capital of France?"), (2, "Paris"), (3, "Who wrote Hamlet"), (4, "yes it is, it is")]
    filler = " and so it went on" * 20
    rows = [(1, f"{filler} what is the capital of FRANCE {filler}"), (2, f"{filler} what is the big capital of France {filler} Parisian"), (3, f"in Paris {filler}")]
    rows += [(4, f"who wrote Hamlet, they asked {filler} yes it is it is"), (5, "who wrote hamlet"), (6, f"who else wrote Hamlet {filler}")]
    table, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.find(table, tests).collect()]
    assert sorted(got) == [(1, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0), (4, 4, 1.0), (5, 3, 1.0)]
    assert [r["doc_id"] for r in decontaminate.drop_leaks(table, tests).collect()] == [2, 6]


# --- packing


def check_packing(rows, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return by_seq


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary(packing.TOKENIZER))
    rows = packing.pack(docs).collect()
    by_seq = check_packing(rows, 4096)
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    seen = Counter()
    for r in rows:
        ids = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) for i, x in whole.items()}
    used = sum(n for own in by_seq.values() for _, n in own)
    assert used / (4096 * len(by_seq)) > 0.99


def test_sequences_and_odd_rows(spark, odd, none):
    for r in packing.sequences(odd, pad_id=0).collect():
        assert len(r["ids"]) == 4096 or r["used"] & (r["used"] - 1) == 0 and len(r["ids"]) == r["used"]
    rows = packing.pack(odd).collect()
    check_packing(rows, 4096)
    assert sum(r["start"] == 0 for r in rows) == len(odd_rows())
    assert packing.pack(none).count() == packing.sequences(none).count() == 0


def test_fullest_sum_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(80):
        left = {int(x): int(n) for x, n in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5))}
        room = int(rng.integers(1, 100))
        sums = {0}
        for x, n in left.items():
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
        used = packing.fullest(left, room)
        assert sum(x * n for x, n in used.items()) == max(sums) and all(n <= left[x] for x, n in used.items())


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(3)
    counts = {int(x): int(n) for x, n in zip(rng.integers(1, 4097, 300), rng.integers(1, 50, 300))} | {1: 100000, 700: 30000}
    got = Counter()
    for pattern, times in packing.plan(counts):
        assert sum(x * n for x, n in pattern.items()) <= 4096
        for x, n in pattern.items():
            got[x] += n * times
    assert got == counts and packing.plan({}) == []


def test_ids_of_parts_equal_those_of_whole_texts():
    import random

    r = random.Random(4)
    alphabet = ["a", "B9", "é", "'s", "'", "'t", " ", "\n", ".", "_", "<|endoftext|>", "<", "|", ">", "̸", "́", "…", "中", " ", "ß", "#", "-", "\x00", "\U0001f600"]
    given = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    by = tokens.encoder(packing.vocabulary(packing.TOKENIZER))
    want = [x.ids for x in by.tokenizer.encode_batch(given, add_special_tokens=False)]
    assert [ids.tolist() for _, ids in tokens.encoded(pa.array(given), by)] == want


# --- sharding


def test_shards_hold_the_law(docs, texts, odd, none):
    for table, expected in ((docs, len(texts)), (odd, len(odd_rows()))):
        rows = sharding.shards(table, 40).collect()
        assert len(rows) == expected
        total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
        bytes_of, slots = Counter(), defaultdict(list)
        for r in rows:
            assert 0 <= r["shard"] < 40 and r["law"] == "bytes" and r["grown_shard"] is None
            bytes_of[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(abs(bytes_of[s] - total / 40) <= most for s in range(40))
    for r in sharding.shards(docs, 40).collect()[:200]:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 16, zlib.crc32(body))
    assert sharding.shards(none, 40).count() == 0


def test_written_shards(spark, odd, none, tmp_path):
    docs = odd.withColumn("shard", F.lit("own"))
    assert sharding.write_shards(docs, str(tmp_path / "a"), 5) == "_shard"
    got = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(map(str, got.drop("_shard").select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    want = Counter((r["doc_id"], r["size"], r["shard"]) for r in sharding.shards(odd, 5).collect() if r["doc_id"] not in (5, None))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    assert Counter((r[0], r[1], r[2]) for r in got.where("doc_id <> 5").select("doc_id", size, "_shard").collect()) == want
    assert sharding.write_shards(none, str(tmp_path / "b"), 5) == "shard"


# --- WARC


def test_warc_of_odd_pages(spark):
    big = "<p>" + "é" * 600
    huge = "".join(chr(33 + k * k % 90) for k in range(1 << 20)) * 20  # more than a task holds at once
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "x\ny", ""), (5, "http://a/5", "\r\n\r\nWARC/1.1\r\n"), (6, "http://a/6", "<p>" * 300), (7, "u", "<p>" * 300), (8, "h", huge)]
    columns = "page_id long, url string, html string, payload string, digest string, sha int, salt int, archive string"
    pages = spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], columns)
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 8
    again = pages.where("page_id in (2, 3)").unionByName(pages.where("page_id in (1, 2, 3)")).unionByName(pages.where("page_id = 1").withColumn("page_id", F.lit(None).cast("long")))
    repeats = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(again).collect())
    assert repeats == {(2, "response", None): 2, (3, "response", None): 2, (1, "revisit", 2): 1, (None, "revisit", 2): 1}
    for i, _, html in rows:
        body = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert got[i]["payload"] is None if i == 1 else bytes(got[i]["payload"]) == body
    assert (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 2)
    assert got[2]["record_type"] == got[6]["record_type"] == "response"
    assert warc.round_trip(pages.where("false")).count() == 0


# --- language


def test_held_out_languages(docs):
    net = langid.fit(docs.where(~langid.held_out("doc_id")), sample=1600)
    rows = langid.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out("doc_id")).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_every_language_is_learned(spark):
    rows = [(i, f"wort{i % 230} satz{i % 230}", f"l{i % 230:03d}") for i in range(230 * 3)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=300)
    assert net.languages == [f"l{k:03d}" for k in range(230)]


def test_languages_of_odd_rows(odd, none):
    net = langid.fit(odd, sample=50)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, net).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("und", 0.0) and got[5][0] == "en" and 0 <= got[5][1] <= 1
    assert langid.identify(odd, langid.fit(none)).where("lang_pred = 'und' and score = 0").count() == len(odd_rows())
    assert langid.identify(none, net).count() == 0


def test_gradients_against_differences():
    rng = np.random.default_rng(6)
    windows, labels = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])
    net = langid.learn(windows, labels, ["a", "b"], steps=2)
    loss = lambda: -net.forward(windows)[np.arange(4), labels].mean()
    for p, g in zip(net.parameters(), net.gradients(windows, labels)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-2
        up = loss()
        p[at] -= 2e-2
        down = loss()
        p[at] += 1e-2
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_scores_of_whole_texts_against_plain_version(spark):
    rng = np.random.default_rng(9)
    net = langid.learn(rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8), np.arange(40) % 3, ["a", "b", "c"], steps=20)
    texts = ["Das ist ein Satz über Äpfel. " * 12, "short", "x" * langid.WINDOW, "1 2 3", "Ünï " * 400]
    rows = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()
    for r in rows:
        body = texts[r["doc_id"]].lower().encode()
        if r["doc_id"] == 3:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total, n = np.zeros(3), 0
        for at in range(0, len(body), langid.WINDOW):
            window = body[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            features = []
            for kernel, bias, width in zip(net.kernels, net.biases, langid.WIDTHS):
                answers = [np.concatenate([net.embed[b] for b in window[i : i + width]]) @ kernel for i in range(langid.WINDOW - width + 1)]
                features += [max(0.0, max(a[f] for a in answers) + bias[f]) for f in range(langid.FILTERS)]
            logits = np.array(features) @ net.dense + net.dense_bias
            total += logits - np.log(np.exp(logits).sum())
            n += 1
        p = np.exp(total / n) / np.exp(total / n).sum()
        assert r["lang_pred"] == net.languages[p.argmax()] and abs(r["score"] - p.max()) < 1e-4


# --- URL filter


def canonical(to):
    return f'<link rel="canonical" href="{to}">'


def refresh(to):
    return f'<meta http-equiv="refresh" content="0; url={to}">'


def test_url_rules_and_aliases(spark):
    rows = [
        (1, "http://a.com/en/x", None),
        (2, "http://b.org/p", canonical("http://a.com/en/x")),
        (3, "http://c.io/q?z", refresh("http://b.org/p")),
        (4, "HTTP://Example.COM/en/77#f", ""),
        (5, "http://notexample.com/en/7", None),
        (6, None, None),
        (7, "no scheme", None),
        (8, "http://d.io/r", canonical("http://example.com/en/77")),
        (9, "http://e.com/en/y", canonical("http://example.com/en/77")),
        (9, "http://e.com/en/y", canonical("http://example.com/en/77")),
        (10, "http://f.io/a", canonical("http://net.net/de/never-crawled")),
        (None, "http://f.io/b", canonical("http://f.io/a")),
    ]
    got = defaultdict(list)
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, node string, host string, blocked int")
    for r in url_filter.judge(pages).collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[1] == [("a.com", "/en/x", "com/en/", "block")]
    assert got[2] == [("b.org", "/p", None, "block")] and got[3] == [("c.io", "/q", None, "block")]
    assert got[4] == [("example.com", "/en/77", "example.com/en/7", "allow")]
    assert got[5][0][2:] == ("com/en/", "block")
    assert got[6] == [("", "", None, "allow")] == got[7]
    assert got[8] == [("d.io", "/r", None, "allow")]  # an allow goes before a block among aliases
    assert got[9] == [("e.com", "/en/y", "com/en/", "block")] * 2
    assert got[10] == [("f.io", "/a", None, "block")] and got[None] == [("f.io", "/b", None, "block")]
    assert url_filter.judge(pages.where("false")).count() == 0


def test_relative_and_further_links(spark):
    rows = [
        (1, "http://a.com/en/x", None),
        (2, "http://a.com/new/login.html", refresh("../en/x")),
        (3, "http://a.com/en/y", None),
        (4, "https://a.com/p/q?z", canonical("./r/../../../en/./y#top")),
        (5, "http://b.org/1", canonical("/self") + canonical("http://a.com/en/x")),
        (6, "http://b.org/2", '<meta http-equiv="refresh" content="9;url=?a">' + refresh("http://a.com/en/x")),
        (7, "http://a.com", refresh("en/x")),
        (8, "http://c.io/d/", refresh("e?next=http://a.com/en/x")),
        (9, "http://c.io/d/e", canonical("mailto:x@a.com")),
        (10, "http://d.io/a/../b", canonical("http://a.com/en/x")),
        (11, "http://d.io/c", canonical("http://d.io/a/../b")),
        (12, "http://e.io/1", canonical("/go?to=http://net/de/x")),
        (13, "http://e.io/v?id=1&b=2", canonical("http://a.com/en/x")),
        (14, "http://e.io/v?id=2", None),
        (15, "http://e.io/w", canonical("v?id=1&amp;b=2")),
        (16, "http://www.e.io/w", None),
        (17, "http://a.com/en", None),
        (18, "http://e.io/x", "<!-- " + canonical("http://a.com/en/x") + " -->"),
        (19, "http://e.io/y", '<base href="http://a.com/en/"><link href=x rel=canonical>'),
        (20, "http://e.io/z", '<link rel="alternate" href="http://a.com/en/x"><link data-rel="canonical" href="http://a.com/en/x">'),
        (21, "http://e.io/long", "<p>" * 300000 + canonical("http://a.com/en/x")),
    ]
    got = {r["page_id"]: (r["verdict"], r["component"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i for i, (verdict, _) in got.items() if verdict == "block"} == {1, 2, 3, 4, 5, 6, 7, 10, 11, 13, 15, 19, 21}
    assert got[2][1] == got[1][1] and got[4][1] == got[3][1] and got[8] == ("allow", "c.io/d/") and got[9] == ("allow", "c.io/d/e")


def linked_pages(seed, n=400):
    import random

    r = random.Random(seed)
    hosts = ["a.com", "example.com", "www.example.com", "b.net", "example.net", "c.org", "d.io", "E.io", "f.io", "g.io"]
    place = lambda: "/".join(r.choice(["en", "de", "es", "7", "8", "x", "y", ".", ".."]) for _ in range(r.randint(1, 4)))
    urls = [f"http://{r.choice(hosts)}/{place()}{r.choice(['', '', '/', '?q=1', '?q=2', '#f'])}" for _ in range(n)]
    link = lambda: r.choice([r.choice(urls), r.choice(urls), place(), "/" + place(), "?q=1", "#top", "//d.io/" + place(), "mailto:a@b.c", "http://x.io/?u=http://a.com/en/"])
    html = lambda: "".join(r.choice([canonical, refresh])(link().replace("&", "&amp;")) for _ in range(r.choice([0, 0, 1, 1, 2])))
    return [(i, r.choice([None, "plain"]) if r.random() < 0.03 else u, r.choice([None, ""]) if r.random() < 0.2 else html()) for i, u in enumerate(urls)]


def union_find_verdicts(pages, rules):
    """Verdicts by a plain union-find over addresses that the standard library resolves."""
    import re
    from urllib.parse import urljoin, urlsplit

    def rule(host, path):
        fits = [(len(name), name, v == "allow", v) for v, name in rules for h, _, p in [name.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return max(fits) if fits else None

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    def clean(url):
        u = urlsplit(url)
        path = urlsplit(urljoin("http://h/", u.path)).path if "/." in u.path else u.path
        return u.netloc.lower() + (path or "/") + ("?" + u.query if u.query else "")

    for _, url, html in pages:
        if url and "://" in url and html:
            base = "http://" + clean(url)
            for to in re.findall(r"""(?:href|url)="?([^"]+)""", html):
                to = to.replace("&amp;", "&")
                if not re.match("[a-z]+:(?!//)", to) and clean(urljoin(base, to)) != clean(url):
                    root[find(clean(urljoin(base, to)))] = find(clean(url))
    said = defaultdict(set)
    for node in list(root):
        host, slash, rest = node.partition("/")
        if hit := rule(host, slash + rest.partition("?")[0]):
            said[find(node)].add(hit[3])
    out = {}
    for i, url, _ in pages:
        if not url or "://" not in url:
            out[i] = ("", "", None, "allow")
            continue
        u = urlsplit(url)
        hit = rule(u.netloc.lower(), u.path)
        of = said[find(clean(url))] if clean(url) in root else set()
        out[i] = (u.netloc.lower(), u.path, hit[1] if hit else None, hit[3] if hit else "block" if of == {"block"} else "allow")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_against_union_find_and_sql(spark, seed):
    pages = linked_pages(seed)
    given = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(given).collect()}
    assert got == union_find_verdicts(pages, url_filter.RULES)
    assert 5 < sum(r is None and v == "block" for _, _, r, v in got.values())
    con = duckdb.connect()
    con.register("pages", given.toPandas())
    assert sorted(con.sql(url_filter.judge_sql()).fetchall()) == sorted((i, *v) for i, v in got.items())


def test_query_judges_by_the_rules_of_its_contract(spark, tmp_path):
    rows = [
        (1, "http://net/de/1", None, "net/de/", "allow"),
        (2, "http://www.Example.NET/de/7?q", "", "net/de/", "allow"),
        (3, "http://example.net/de/81#f", None, "example.net/de/8", "block"),
        (4, "http://m.example.net/de/8", None, "example.net/de/8", "block"),
        (5, "http://notexample.net/de/8", None, "net/de/", "allow"),
        (6, "http://net/de", None, None, "allow"),
        (7, "http://c.io/a", canonical("http://a.net/de/1") + refresh("http://a.com/en/x"), None, "allow"),
        (8, "http://c.io/b", canonical("http://example.net/de/8"), None, "block"),
        (9, "http://a.com/en/y", canonical("http://b.net/de/1"), "com/en/", "block"),
        (10, "http://example.com/en/70", None, "example.com/en/7", "allow"),
        (11, "http://a.org/es/", None, "org/es/", "block"),
        (12, None, None, None, "allow"),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in entry.op9_url_filter(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[3:] for r in rows}


def test_long_rule_lists_decide_as_short_ones(spark):
    import random

    r = random.Random(3)
    part = lambda: "/".join(r.choice(["en", "de", "es", "7", "8"]) for _ in range(r.randint(0, 3)))
    rules = [(r.choice(["block", "allow"]), f"{r.choice(['com', 'example.com', 'net', 'org', 'www.example.com', 'io'])}/{part()}") for _ in range(60)]
    pages = spark.createDataFrame(linked_pages(4), "page_id long, url string, html string")
    short = sorted(map(str, url_filter.judge(pages, rules).collect()))
    long = sorted(map(str, url_filter.judge(pages, rules + [("block", f"h{k}.xyz/") for k in range(2000)]).collect()))
    assert short == long


# --- licences


def test_licences_of_odd_rows(spark, odd, none):
    rows = [(1, "Intro\nReleased  under the MIT licence or MIT License."), (2, "RELEASED UNDER THE: mit license"), (3, None), (4, "")]
    got = {(r["doc_id"], r["license"]): r["dice"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2, "MIT"] == 1.0 and all(i in (1, 2) for i, _ in got)
    assert license_scan.scan(odd).count() == license_scan.scan(none).count() == 0


def test_licences_inside_longer_lines_and_paragraphs(spark):
    bsd = dict(license_scan.TEXTS)["BSD-3-Clause"]
    rows = [
        (1, "Released under the MIT License. Copyright 2024 The Authors."),
        (2, "This project is released under the MIT License, see the file LICENSE."),
        (3, "All of this text is ours and was\nlicensed under the Apache\nLicense, Version 2.0. Have a good time with all of the rest."),
        (4, f"Copyright 2024 The Authors. All rights reserved. {bsd} THIS SOFTWARE IS PROVIDED AS IS, and so on, for the rest of the text."),
        (5, "This work is licensed under the GNU General Public License, version 3. It is of the world, and to the world it goes."),
        (6, "The license of the work is not known, and the work is under the table."),
        (7, "Well, it is released under the MIT License and then some of it is licensed under CC BY-NC 4.0. That is all."),
    ]
    got = {(r["doc_id"], r["license"]): (r["dice"], r["units"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = [(1, "MIT"), (2, "MIT"), (3, "Apache-2.0"), (4, "BSD-3-Clause"), (5, "GPL-3.0"), (7, "CC-BY-NC-4.0"), (7, "MIT")]
    assert got == {k: (1.0, 1) for k in want}


def test_licence_tags_heads_and_deeds(spark):
    rows = [(i, f"// SPDX-License-Identifier: {name}\nint main() {{}}") for i, name in enumerate(license_scan.TAGGED)]
    rows += [
        (100, "# SPDX-License-Identifier: GPL-2.0-or-later"),
        (101, "SPDX-License-Identifier: Foo-7.1"),
        (102, "A header has an SPDX-License-Identifier: MIT tag, in the midst of a line that goes on for a long while."),
        (103, "Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND"
         " DISTRIBUTION\n\n1. Definitions."),
        (104, "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nEveryone is permitted to copy"),
        (105, "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"),
        (106, "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\nand more"),
        (107, "GNU GENERAL PUBLIC LICENSE\nVersion 1, February 1989"),
    ]
    want = set(enumerate(license_scan.TAGGED)) | {
        (100, "GPL-2.0"), (101, "SPDX-other"), (102, "MIT"), (103, "Apache-2.0"), (104, "LGPL-3.0"), (105, "GPL-2.0"), (106, "CC0-1.0"),
    }
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == want and len(got) == len(want)


def test_licences_of_rows_that_share_an_id_or_have_none(spark):
    mit, isc = "Released under the MIT License.", "Released under the ISC License."
    rows = [(None, mit), (None, isc), (None, mit), (5, mit), (5, isc), (5, isc), (6, None)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["license"], r["units"]) for r in got) == [(0, "ISC", 1), (0, "MIT", 1), (5, "ISC", 1), (5, "MIT", 1)]


def plain_runs(text, templates, threshold):
    """The runs that count in a text, from the definition: all runs of all templates, then the best of each place."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    found = []
    for t, (_, notice) in enumerate(templates):
        own = set(license_scan.bigrams_of(notice))
        longest = license_scan.bounds(len(re.findall("[a-z0-9]+", notice.lower())) - 1, threshold)[1]
        for i in range(len(grams)):
            runs = []
            for j in range(i, min(len(grams), i + longest)):
                if grams[i] in own and grams[j] in own:
                    inside = [g for g in grams[i : j + 1] if g in own]
                    others = j + 1 - i - len(inside)
                    shared = len(set(inside))
                    runs.append((2.0 * shared / (shared + others + len(own)), shared, j, tuple(inside)))
            if runs and max(runs)[0] >= threshold:
                dice, shared, j, inside = max(runs, key=lambda r: r[:3])
                found.append((-dice, -shared, t, i, j, inside))
    kept = []
    for r in sorted(found):
        if all(k[4] + 1 < r[3] or r[4] + 1 < k[3] for k in kept):
            kept.append(r)
    return sorted((templates[r[2]][0], -r[0]) for r in kept)


def test_runs_of_words_against_all_runs(spark):
    rng = random.Random(5)
    templates = [("A", "a b c d e f"), ("B", "b c d x y"), ("C", "a b a b c"), ("D", "x y z"), ("E", "c d")]
    texts = [" ".join(rng.choice("abcdefxyz") for _ in range(rng.randrange(60))) for _ in range(150)]
    for k in range(150):  # templates with words left out and put in
        parts = [[w for w in rng.choice(templates)[1].split() if rng.random() < 0.9] + ["z"] * rng.randrange(3) for _ in range(4)]
        texts.append(" ".join(sum(parts, [])))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for threshold in (0.6, 0.8):
        got = {}
        for r in license_scan.runs(rows, templates, threshold).collect():
            got.setdefault(r["id"], []).append((r["license"], r["dice"]))
        want = {i: found for i, text in enumerate(texts) if (found := plain_runs(text, templates, threshold))}
        assert got.keys() == want.keys()
        for i in want:
            assert [(n, pytest.approx(d)) for n, d in want[i]] == sorted(got[i]), texts[i]


def test_key_words_lose_no_unit():
    rng = np.random.default_rng(8)
    keys = license_scan.key_words(license_scan.TEMPLATES, 0.8)
    for _, notice in license_scan.TEMPLATES:
        words = notice.split()
        for _ in range(20):
            kept = [w for w in words if rng.random() < 0.8]
            a, b = set(license_scan.bigrams_of(" ".join(kept))), set(license_scan.bigrams_of(notice))
            if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                assert any(k in " ".join(kept).lower() for k in keys)


# --- toxicity


def kernel(x, y):
    """The subsequence kernel, spelled out."""

    def features(s):
        s = "^" + s + "$"
        out = Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + 3 + toxicity.GAPS)):
                    out["".join("^" if c in "^$" else c for c in (s[i], s[j], s[k]))] += toxicity.DECAY ** (k - i - 2)
        return out

    a, b = features(x), features(y)
    return sum(v * b[u] for u, v in a.items()) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5


def test_kernel_against_plain_version():
    marks = ["idiot", "moron", "the"]
    given = ["idiot", "idxiot", "idit", "of", "thenidiots"]
    got = toxicity._kernel([g.encode() for g in given], toxicity._table([m.encode() for m in marks]))
    assert np.allclose(got, [[kernel(g, m) for m in marks] for g in given], atol=1e-5)


def test_margins_of_whole_texts_against_plain_version():
    """A text's margin is that of its worst unit: the machine's weights times the unit's subsequences, spelled out."""

    def features(s):
        s, out = "^" + s + "$", Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + 3 + toxicity.GAPS)):
                    out[tuple(0 if c in "^$" else ord(c) - 96 for c in (s[i], s[j], s[k]))] += toxicity.DECAY ** (k - i - 2)
        return out

    clean = [[w.encode() for w in t.split()] for t in ("the river flows past an old mill", "seven friends watch a lazy dog", "it is what it was")] * 5
    model = toxicity.fit_units(clean + [[*c, b"idiot"] for c in clean[:4]], [0] * len(clean) + [1] * 4, 0.3)

    def margin(unit):
        found = features(unit)
        norm = sum(v * v for v in found.values()) ** 0.5
        return sum(v * model.weights[(a * 32 + b) * 32 + c] for (a, b, c), v in found.items()) / norm + model.bias

    for text in ("what an idiot he is", "the old mill", "idixot", "a dog", "moron at the river"):
        want = model.probability(np.array([max(margin(u) for u in text.split())]))[0]
        assert abs(toxicity.Scorer(model).scores(pa.array([text]))[0] - want) < 1e-4, text


def test_held_out_toxicity(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id")))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9


def test_gapped_insults():
    clean = [[w.encode() for w in s.split()] for s in ("the river flows past an old mill", "seven friends watch a lazy dog", "it is what it was", "or not to be on top")] * 5
    toxic = [[*c, b"idiot"] for c in clean[:4]] + [[*c, b"moron"] for c in clean[:4]]
    model = toxicity.fit_units(clean + toxic, [0] * len(clean) + [1] * len(toxic), 0.3)
    judge = lambda s: toxicity.Scorer(model).scores(pa.array([s]))[0]
    plain = judge("what a lovely old mill")
    for insult in ("you idiot", "you idi-ot", "you i d i o t", "you idixot", "you 1d1ot", "you m.o.r.o.n"):
        assert judge(insult) > max(0.3, plain), insult
    assert plain < 0.3


def test_fit_learns_from_all_of_a_long_unit():
    """The insult stands behind the first window of a long unit, once or more, and one clean text is wrongly marked."""
    r = np.random.default_rng(3)
    filler = lambda n: "".join(r.choice(list("bcfghjklvwxz"), n))
    clean = [[filler(k).encode() for k in (3, 5, 8, 60)] for _ in range(60)] + [[b"idiot", b"the"]]
    toxic = [[filler(5).encode(), f"{filler(33)}idiot{filler(30)}".encode()] for _ in range(30)] + [[b"you", b"idiot"]] * 20
    texts, labels = clean + toxic, [0] * len(clean) + [1] * len(toxic)
    models = [toxicity.fit_units(texts, labels, 0.3, seed=seed) for seed in range(3)]
    for model in models:
        judge = lambda s: toxicity.Scorer(model).scores(pa.array([s]))[0]
        assert judge("you idiot") >= 0.3 and judge(filler(44) + "idiot") >= 0.3
        assert sum(judge(filler(5) + " " + filler(70)) >= 0.3 for _ in range(20)) <= 1


def test_blame_goes_to_what_many_bags_share():
    """Ten bags share a window; five of them are copies with forty words of their own."""
    bags = [np.array([0, *range(1, 41)])] * 5 + [np.array([0, 50 + i]) for i in range(5)]
    blame = toxicity._blame(bags, 60)
    plain = Counter(int(w) for b in bags for w in b)
    want = [sum(plain[w] / sum(plain[int(v)] for v in b) for b in bags if w in b) for w in range(60)]
    assert np.allclose(blame, want) and blame.argmax() == 0 and abs(blame.sum() - 10) < 1e-9


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 0), (8, 1), (None, 1), (9, None), (3, 7)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    flat = toxicity.fit(odd, labels.where("false"))
    assert len({r["score"] for r in toxicity.score(odd, flat).collect()}) == 1
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns
    assert toxicity.score(none, model).count() == 0


# --- pipeline


def planted_documents(seed=12):
    """Documents with their tests and labels: (rows, items, labels)."""
    import random

    r = random.Random(seed)
    names = [a + b + c for a in ("ba", "ke", "li", "mo", "nu", "ra", "se", "to") for b in ("dar", "fen", "gil", "lom", "pur", "vex") for c in ("a", "in", "o")]
    prose = lambda n: " ".join(r.choice(names) for _ in range(n))
    items = [prose(r.randint(10, 30)) for _ in range(8)]
    texts = [prose(r.choice([3, 40, 80, 200])) for _ in range(150)]
    for k in range(12):
        base = texts[k].split()
        near = list(base)
        near[r.randrange(len(near))] = "changed"
        texts += [texts[k], "  " + texts[k].replace(" ", "\n"), " ".join(near), " ".join(base[: len(base) // 2] + near[len(base) // 2 :] + ["end"])]
    for k, item in enumerate(items):
        words = item.split()
        texts += [f"{prose(20)} {item} {prose(20)}", f"{prose(5)} {' '.join(w if i % 4 else 'swapped' for i, w in enumerate(words))} {prose(9)}"]
    marked = len(texts)
    texts += [f"{prose(20)} you {r.choice(['idiot', 'moron', 'i-d-i-o-t'])} {prose(10)}" for _ in range(60)] + [None, "", " ", "?!"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(i >= marked)) for i in range(len(texts) - 4)]
    r.shuffle(rows)
    return rows, items, labels


def test_pipeline_against_plain_version(spark, tmp_path):
    rows, items, labels = planted_documents()
    save = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    save("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    save("benchmark", list(enumerate(items)), "item_id long, text string")
    save("labels", labels, "doc_id long, quality int, toxic int")
    # toxic ones by the same model, text by text
    docs, marks = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit(docs, marks.where(~toxicity.held_out("doc_id")))
    left = {i: t for i, t, *_ in rows if toxicity.Scorer(model).scores(pa.array([t], pa.string()))[0] < 0.3}
    assert len(rows) - len(left) >= 55
    # exact copies
    best = {}
    for i, t in left.items():
        body = "".join((t or "").split())
        best[body] = min(best.get(body, (1, 0)), (-len(t or ""), i))
    left = {i: left[i] for _, i in best.values()}
    assert len(left) < len(rows) - 70
    # near copies
    sets = {i: shingles(t) for i, t in left.items() if words_of(t)[0].size} if left else {}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    wordless = [i for i in left if i not in sets]
    linked = [(a, b) for a in sets for b in sets if a < b and minhash.overlap(sets[a], sets[b]) >= 0.8]
    for a, b in linked + list(zip(wordless, wordless[1:])):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert linked
    left = {i: t for i, t in left.items() if find(i) == i}
    # test items
    tests = [words_of(t)[0] for t in items]
    leaks = lambda t: any(len(w) and decontaminate.align(x, w)[0] / len(x) >= 0.5 for w in [words_of(t)[0]] for x in tests)
    clean = {i: t for i, t in left.items() if not leaks(t)}
    assert len(left) - len(clean) >= 14
    before = common.written()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = tokens.Encoder(packing.vocabulary(packing.TOKENIZER))
    want = {i: len(by.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == want
    check_packing(out, 4096)
    assert len(common.written()) <= len(before) + 2  # the last stage's documents and pieces
    # stages give the columns of documents, and take empty tables
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), str(tmp_path)).schema == docs.schema


# --- hashes decide nothing alone


def thue_morse(x, y, turns=11):
    """Two different words that every polynomial modulo 2**64 takes for one."""
    for _ in range(turns):
        x, y = x + y, y + x
    return x, y


def test_words_that_polynomials_confuse(spark):
    one, other = thue_morse("a", "b")
    by = tokens.Encoder(packing.vocabulary(packing.TOKENIZER))
    got = [ids.tolist() for _, ids in tokens.encoded(pa.array([one, other]), by)]
    assert got == [x.ids for x in by.tokenizer.encode_batch([one, other], add_special_tokens=False)]
    rows = [(1, one), (2, other), (3, one + "!"), (4, f"{one} {other} {one} {one} {one} {other}"), (5, f"{one} {one} {other} {one} {other} {one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["copy_of"]) for r in minhash.classes(docs).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (1, 1), 4: (4, 4), 5: (5, 5)}
    assert {r["doc_id"] for r in minhash.drop_near_copies(docs).collect()} == {1, 2, 4, 5}


def test_parts_that_share_a_hash_keep_their_ids(texts):
    class Poor(textops.Hasher):
        def spans(self, data, a, b):
            return (b - a).astype(np.uint64) % np.uint64(3)

    by = tokens.Encoder(packing.vocabulary(packing.TOKENIZER))
    by.hasher = Poor()
    given = list(texts.values())[:40] + ["", None, "aa bb cc dd"]
    want = [x.ids for x in by.tokenizer.encode_batch([t or "" for t in given], add_special_tokens=False)]
    assert [ids.tolist() for _, ids in tokens.encoded(pa.array(given), by)] == want


def test_rows_that_share_an_id_but_not_a_text(spark):
    far = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, BASE), (3, far), (5, BASE + " today"), (3, far), (9, far + " !"), (4, "x " + BASE), (None, far), (7, None), (7, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _salt long")
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == sorted([(3, BASE), (3, far), (0, far), (7, "")])
    found = sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in minhash.classes(docs).collect())
    of = {i: c for i, c in found if i in (4, 5, 7, 9)}
    # two classes begin with id 3: one has its name, the other a number above all ids
    assert of[4] == of[5] and of[4] != of[9] and min(of[4], of[9]) == 3 and max(of[4], of[9]) > 9 and of[7] == 7
    assert found == sorted([(3, of[4]), (3, of[9]), (3, of[9]), (5, of[5]), (9, of[9]), (4, of[4]), (0, 0), (7, 7), (7, 7)])


def test_hashes_do_not_depend_on_windows(monkeypatch):
    rng = np.random.default_rng(7)
    data = rng.choice(np.frombuffer(b"ab \xc3\xa9,", np.uint8), 5000)
    data[1000:2300] = ord("w")  # a word longer than a window and its overlap
    cuts = np.array([0, 17, 17, 900, 1500, 4999, 5000])
    whole = textops.Hasher().words(data, cuts)
    spans = rng.integers(0, 2500, (2, 300))
    a, b = spans.min(0), spans.max(0) + 1  # in no order, and overlapping
    apart = textops.Hasher().spans(data, a, b)
    for chunk, overlap in ((64, 8), (100, 1), (1024, 512)):
        monkeypatch.setattr(textops, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(textops, "OVERLAP", overlap)
        for x, y in zip(whole, textops.Hasher().words(data, cuts)):
            assert (x == y).all()
        assert (textops.Hasher().spans(data, a, b) == apart).all()


def test_long_texts_take_little_memory():
    import tracemalloc

    n = 24_000_000
    text = (b"some words of a long text, " * (n // 27 + 1))[:n]
    for body in (text, b"w" * n):
        data, cuts = np.frombuffer(body, np.uint8), np.array([0, n])
        tracemalloc.start()
        hashes, firsts, a, b = textops.Hasher().words(data, cuts)
        textops.word_digests(data, cuts, a, b, firsts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak - 120_000_000 < 16 * n  # windows and tables are a fixed part
