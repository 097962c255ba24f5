"""Centroids, vector codes and SimHash classes against plain versions in Python's integers."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from argentum.llm import centroids, exact, simhash, vector_codes

VECTORS = "vec_id long, embedding array<double>, label string, id string, vector int, sums string, code string"
LONGEST = (1 << 63) - 1


def table(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(i, v, l, "x", 1, "x", "x") for i, v, l in rows], schema)


def odd_vectors(dim, n=40, big=1e3):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(dim) * big).round(3).tolist(), None if i % 5 == 0 else f"l{i % 3}") for i in range(n)]
    same = rows[0][1]
    rows += [(n + i, same, "l0") for i in range(30)]  # copies and ties
    rows += [(7, rows[8][1], "l1"), (7, rows[9][1], "l1"), (7, rows[8][1], "l1"), (None, same, None), (None, rows[3][1], "l2")]
    rows += [(900, None, "a"), (901, [], "a"), (902, same[:-1], "a"), (903, [nan, *same[1:]], "a"), (904, [inf, *same[1:]], "a"), (905, [None, *same[1:]], "a")]
    return rows


def kept(rows, dim, scale):
    good = [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and x == x and abs(x) != inf and abs(x * scale) != inf for x in r[1])]
    return [(i, [floor(Fraction(x) * scale) for x in v], label, v) for i, v, label in good]


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(x, books):
    return min(range(len(books)), key=lambda k: (gap(x, books[k]), k))


def moved(xs, of, books):
    out = []
    for k, old in enumerate(books):
        own = [x for x, a in zip(xs, of) if a == k]
        out.append([sum(c) // len(own) for c in zip(*own)] if own else old)
    return out


def plain_clusters(rows, k, rounds, scale, dim):
    rows = kept(rows, dim, scale)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[3]))
    cents, xs = [r[1] for r in order[:k]], [r[1] for r in rows]
    for _ in range(rounds):
        cents = moved(xs, [nearest(x, cents) for x in xs], cents)
    of = [nearest(x, cents) for x in xs]
    far = [gap(x, cents[a]) for x, a in zip(xs, of)]
    inertia = [sum(d for d, a in zip(far, of) if a == c) for c in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    least = lambda v: min(v, LONGEST)
    return sorted(((r[0], a, least(d), least(inertia[a]), least(sum(far)), sha[a]) for r, a, d in zip(rows, of, far)), key=repr)


def plain_codes(rows, parts, entries, rounds, scale, dim):
    rows, width = kept(rows, dim, scale), dim // parts
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[3]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    codes, errors, every = [""] * len(rows), [0] * len(rows), []
    for p in range(parts):
        book, xs = [cut(r[1], p) for r in first], [cut(r[1], p) for r in rows]
        for _ in range(rounds):
            book = moved(xs, [nearest(x, book) for x in xs], book)
        of = [nearest(x, book) for x in xs]
        codes = [c + f"{a:02x}" for c, a in zip(codes, of)]
        errors = [e + gap(x, book[a]) for e, x, a in zip(errors, xs, of)]
        every += [v for entry in book for v in entry]
    by_label = defaultdict(int)
    for r, e in zip(rows, errors):
        by_label[r[2]] += min(e, LONGEST)
    sha = hashlib.sha256(",".join(map(str, every)).encode()).hexdigest()
    return sorted(((r[0], c, min(e, LONGEST), min(by_label[r[2]], LONGEST), sha) for r, c, e in zip(rows, codes, errors)), key=repr)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


CLUSTERED = "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
CODED = "vec_id", "code", "error", "label_error", "codebooks_sha256"


@pytest.mark.parametrize("big", [1.0, 1e6, 1e12, 1e30])
def test_clusters_are_exact_at_every_magnitude(spark, big):
    rows = odd_vectors(8, big=big) + [(50_000 + i, [big * 1e5 * (i + 1)] * 8, "far") for i in range(3)]
    found = centroids.cluster(table(spark, rows), k=6, dim=8)
    assert got(found, *CLUSTERED) == plain_clusters(rows, 6, 5, 256, 8)


def test_clusters_of_few_or_no_rows(spark):
    rows = [(1, [0.5, -0.5], "a"), (2, [0.5, -0.5], "a"), (3, [9.0, 9.0], None), (4, [1e308, 1.0], None)]
    assert got(centroids.cluster(table(spark, rows), dim=2), *CLUSTERED) == plain_clusters(rows, 40, 5, 256, 2)
    for none in ([], [(1, None, "a")], [(None, [1.0, 2.0], "a")]):
        found = centroids.cluster(table(spark, none), dim=2)
        assert found.columns == list(CLUSTERED) and found.isEmpty()


def test_whole_numbers_near_the_bound_are_exact():
    rng = random.Random(5)
    for size in (1 << 20, 1 << 24, 1 << 27, 1 << 40):
        x = [[rng.randrange(-size, size) for _ in range(6)] for _ in range(9)]
        c = [[rng.randrange(-size, size) for _ in range(6)] for _ in range(4)] + [[rng.randrange(-9, 9) for _ in range(6)]]
        found = exact.distances(np.array(x, np.float64), np.array(c, object))
        assert [[int(v) for v in row] for row in found] == [[gap(a, b) for b in c] for a in x]


@pytest.mark.parametrize("big", [1.0, 1e6, 1e20])
def test_codes_are_exact_at_every_magnitude(spark, big):
    rows = odd_vectors(8, n=120, big=big) + [(50_000 + i, [big * 1e5 * (i + 1)] * 8, "far") for i in range(3)]
    found = vector_codes.encode(table(spark, rows), entries=20, dim=8)
    assert got(found, *CODED) == plain_codes(rows, 4, 20, 4, 1024, 8)


def test_codes_where_ties_are_common(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(3)) / 1024 for _ in range(8)], str(i % 2)) for i in range(400)]
    found = vector_codes.encode(table(spark, rows), entries=30, dim=8, rounds=6)
    assert got(found, *CODED) == plain_codes(rows, 4, 30, 6, 1024, 8)


def test_codes_of_few_or_no_rows(spark):
    rows = [(1, [0.5, -0.5, 1.0, 2.0], None), (None, [0.5, -0.5, 1.0, 2.0], "a"), (3, [9.0, 9.0, 9.0, 9.0], None)]
    assert got(vector_codes.encode(table(spark, rows), dim=4), *CODED) == plain_codes(rows, 4, 256, 4, 1024, 4)
    for none in ([], [(1, None, "a")], [(None, [1.0] * 4, "a")]):
        found = vector_codes.encode(table(spark, none), dim=4)
        assert found.columns == list(CODED) and found.isEmpty()
    with pytest.raises(ValueError):
        vector_codes.encode(table(spark, rows), dim=6)


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((32, 16)) * 10
    rows = [(i, (centres[i % 32] + rng.standard_normal(16)).tolist(), "a") for i in range(3000)]
    _, books, asked = vector_codes.train(table(spark, rows), entries=32, dim=16, groups=8, rounds=6)
    every = 3000 * 4 * 32
    assert asked[0] == every and len(books) == 4
    assert sum(asked[1:]) < 0.5 * every * 6


# --- fingerprints


def plain_mark(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    names = sorted(root)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {m: find(m) for m in names}


def plain_classes(rows):
    marks = [plain_mark(t) for _, t in rows]
    joined, low = plain_components(marks), {}
    for (i, _), m in zip(rows, marks):
        if i is not None:
            low[joined[m]] = min(i, low.get(joined[m], i))
    return sorted(((i, f"{m:016x}", low.get(joined[m])) for (i, _), m in zip(rows, marks)), key=repr)


def test_classes_of_odd_texts(spark):
    base = "Ärger the quick\x0bbrown\tfox JUMPS over a lazy dog"
    long = " ".join(f"w{i % 700}" for i in range(40_000))
    texts = [None, "", " \t\r\n", "one", "one two", "ONE two", "one two three", base, base.upper(), base.lower(), base.replace(" ", "\n"), "\x1c \x85 　", "a\x00b c", long, long + " x", "y" * 3_000_000]
    rows = list(enumerate(texts)) + [(7, base), (3, "one"), (None, base), (None, "only here"), (0, "only here too, twice"), (0, None)]
    docs = spark.createDataFrame([(i, t, "m", 1, "k") for i, t in rows], "doc_id long, text string, mark string, id int, key string")
    found = simhash.classes(docs)
    assert got(found, "doc_id", "fingerprint", "component_id") == plain_classes(rows)
    none = simhash.classes(docs.limit(0))
    assert none.columns == ["doc_id", "fingerprint", "component_id"] and none.isEmpty()


def test_classes_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(simhash.classes(docs), "doc_id", "fingerprint", "component_id") == plain_classes(rows)


def test_texts_are_read_in_pieces(monkeypatch):
    text = ("Ab cd\tefg  hi\n" * 50 + " tail").encode()
    whole = simhash.fingerprints([text, b"", b"a b"])
    for piece, counted in ((1, 1), (7, 3), (64, 10)):
        monkeypatch.setattr(simhash, "PIECE", piece)
        monkeypatch.setattr(simhash, "COUNTED", counted)
        assert (simhash.fingerprints([text, b"", b"a b"]) == whole).all()
    assert whole.tolist() == [plain_mark(text.decode()), 0, plain_mark("a b")]


def test_each_remainder_has_one_error():
    assert sorted(bin(x).count("1") for x in simhash.LEADERS.tolist()) == sorted([0] + [1] * 23 + [2] * 253 + [3] * 1771)
    rng = random.Random(2)
    words = np.array([rng.getrandbits(23) for _ in range(2000)])
    counts = {len(set(row)) for row in simhash.codewords(words).tolist()}
    assert counts == {1, 6}


def test_near_fingerprints_share_a_key():
    rng = random.Random(4)
    marks = [rng.getrandbits(64) for _ in range(600)]
    near = [m ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3))) for m in marks]
    row, key = simhash.keys(np.array(marks + near, np.uint64))
    held = defaultdict(set)
    for r, k in zip(row.tolist(), key.tolist()):
        held[r].add(k)
    assert all(held[i] & held[i + 600] for i in range(600))
    assert max(map(len, held.values())) <= 18


@pytest.mark.parametrize("held", [0, 3, 64])
def test_links_keep_components(spark, held):
    rng = random.Random(6)
    marks = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(8):  # dense groups, chains and loose ones
        m = rng.getrandbits(64)
        marks |= {m ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
        for _ in range(20):
            m ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
            marks.add(m)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    edges = simhash.links(spark.createDataFrame([(m,) for m in signed], "mark long"), held).collect()
    assert all(((e["a"] ^ e["b"]) & (1 << 64) - 1).bit_count() <= 2 for e in edges)
    pairs = {(e["a"], e["b"]) for e in edges}
    root = {m: m for m in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups, plain = defaultdict(set), defaultdict(set)
    for m in signed:
        groups[find(m)].add(m & (1 << 64) - 1)
    for m, r in plain_components(list(marks)).items():
        plain[r].add(m)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))
