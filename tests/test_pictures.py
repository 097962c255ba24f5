"""Sizes and dates out of files that are made here, whole, cut off and broken; transforms of landmarks."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from argentum.engine import Catalogue, pictures
from argentum.functions import faces
from argentum.sources.pictures import date_tags, facts

DATES = ("2024:05:06 07:08:09", "2023:01:02 03:04:05", "2022:12:31 23:59:59")


def tiff(order, original=DATES[0], digitised=DATES[1], changed=DATES[2], pointer="I"):
    """A directory with the date of change and a pointer, its sub-directory with the other two, then the texts."""
    mark = b"II*\x00" if order == "<" else b"MM\x00*"
    at = 8 + 2 + 24 + 4
    text = at + 2 + 24 + 4
    entry = lambda tag, value, k: struct.pack(order + "HHII", tag, 2, len(value) + 1, text + 20 * k)
    lead = struct.pack(order + "HHI", 0x8769, 4 if pointer == "I" else 3, 1) + struct.pack(order + pointer, at).ljust(4, b"\x00")
    out = mark + struct.pack(order + "IH", 8, 2) + entry(0x0132, changed, 0) + lead + struct.pack(order + "I", 0)
    out += struct.pack(order + "H", 2) + entry(0x9003, original, 1) + entry(0x9004, digitised, 2) + struct.pack(order + "I", 0)
    return out + b"".join(x.encode().ljust(20, b"\x00") for x in (changed, original, digitised))


def jpeg(w, h, exif=b"", frame=0xC0):
    app = b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\x00\x00" + exif if exif else b""
    tables = b"\xff\xc4" + struct.pack(">H", 6) + b"\x00\x63\x00\x63"  # looks like a frame, but is a table
    return b"\xff\xd8\xff\xe0\x00\x04ab" + app + tables + b"\xff\xff\xff" + bytes([frame]) + struct.pack(">HBHH", 11, 8, h, w) + b"\x01\x01\x11\x00\xff\xda\x00\x02data\xff\xd9"


def png(w, h, exif=b""):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")


def webp(body):
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def riff(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


FILES = {
    "jpeg": jpeg(4000, 3000, tiff(">")),
    "jpeg, progressive": jpeg(4000, 3000, tiff("<"), 0xC2),
    "png": png(4000, 3000, tiff("<", pointer="H")),
    "gif": b"GIF89a" + struct.pack("<HH", 4000, 3000) + b"\x00\x00\x00;",
    "bmp": b"BM" + b"\x00" * 12 + struct.pack("<IiiHH", 40, 4000, -3000, 1, 24),
    "bmp, old": b"BM" + b"\x00" * 12 + struct.pack("<IHHHH", 12, 4000, 3000, 1, 24),
    "webp, lossy": webp(riff(b"VP8 ", b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 4000 | 1 << 14, 3000))),
    "webp, lossless": webp(riff(b"VP8L", b"\x2f" + struct.pack("<I", 3999 | 2999 << 14) + b"\x00")),
    "webp, extended": webp(riff(b"VP8X", b"\x08\x00\x00\x00" + (3999).to_bytes(3, "little") + (2999).to_bytes(3, "little")) + riff(b"ICCP", b"abc") + riff(b"EXIF", EXIF := b"Exif\x00\x00" + tiff(">"))),
}


@pytest.mark.parametrize("name", FILES)
def test_sizes_and_dates(name):
    found = facts(FILES[name])
    assert found[:3] == (name.partition(",")[0], 4000, 3000)
    assert found[3:] == (DATES if name in ("jpeg", "jpeg, progressive", "png", "webp, extended") else (None,) * 3)


def test_broken_files_end_and_tell_nothing_wrong():
    rng = random.Random(3)
    for data in FILES.values():
        for n in range(len(data)):
            kind, w, h, *tags = facts(data[:n])
            assert (w, h) in ((4000, 3000), (None, None)) and all(t in (None, *DATES) for t in tags)
        for _ in range(300):
            bad = bytearray(data)
            for _ in range(rng.randrange(1, 4)):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            facts(bytes(bad))
    assert facts(None) == facts(b"") == facts(b"no picture") == (None,) * 6
    assert facts(png(0, 5))[:3] == ("png", None, None)


def test_directories_that_lead_nowhere():
    loop = b"MM\x00*" + struct.pack(">IH", 8, 1) + struct.pack(">HHII", 0x8769, 4, 1, 8) + b"\x00\x00\x00\x00"
    assert date_tags(loop) == (None,) * 3
    far = b"II*\x00" + struct.pack("<I", 2**32 - 1)
    assert date_tags(far) == date_tags(b"XX") == date_tags(b"") == (None,) * 3
    many = b"II*\x00" + struct.pack("<IH", 8, 65535)
    assert date_tags(many) == (None,) * 3
    number = b"MM\x00*" + struct.pack(">IH", 8, 1) + struct.pack(">HHII", 0x0132, 4, 1, 8) + b"\x00\x00\x00\x00"
    assert date_tags(number) == (None,) * 3
    short = b"II*\x00" + struct.pack("<IH", 8, 1) + struct.pack("<HHI", 0x0132, 2, 3) + b"ab\x00\x00" + b"\x00" * 4
    assert date_tags(short) == (None, None, "ab")


def test_a_scan_reads_sizes_and_dates(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    for name, data in (("a.jpg", FILES["jpeg"]), ("_b.png", FILES["png"][:40]), ("c.gif", FILES["gif"]), ("d.webp", FILES["webp, lossy"][:20]), ("e.bmp", b"")):
        (root / name).write_bytes(data)
    app = Catalogue(spark, str(tmp_path / "store"), pictures)
    done = app.scan(str(root))
    assert (done.total, done.indexed, done.skipped) == (5, 3, 2)
    rows = {r["filename"]: (r["width"], r["height"], r["captured_at"]) for r in app.table("images").collect()}
    assert rows == {"a.jpg": (4000, 3000, "2024-05-06 07:08:09"), "_b.png": (4000, 3000, None), "c.gif": (4000, 3000, None)}
    assert [r["filename"] for r in app.search("2024年5月").images] == ["a.jpg"]


def by_decomposition(source, target):
    """The same by a singular value decomposition."""
    s, d = np.array(source).reshape(5, 2), np.array(target).reshape(5, 2)
    ds, dd = s - s.mean(0), d - d.mean(0)
    cov, spread = dd.T @ ds / 5, (ds**2).sum() / 5
    u, values, v = np.linalg.svd(cov)
    sign = np.array([1.0, -1.0 if np.linalg.det(cov) < 0 or np.linalg.det(cov) == 0 and np.linalg.det(u) * np.linalg.det(v) < 0 else 1.0])
    turn = u @ np.diag(sign) @ v
    scale = 1.0 if spread == 0 else (values * sign).sum() / spread
    if spread == 0:
        turn = np.eye(2)
    return scale * turn, d.mean(0) - scale * turn @ s.mean(0)


def test_transforms_against_a_decomposition(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        s = rng.normal(50, 20, (5, 2))
        angle, scale = rng.uniform(-math.pi, math.pi), rng.uniform(0.2, 3)
        turn = scale * np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
        d = s @ turn.T + rng.normal(0, 30, 2) + (rng.normal(0, 1, (5, 2)) if k % 2 else 0)
        if k % 5 == 4:
            d[:, 0] = -d[:, 0]  # mirrored: the best turn doesn't mirror
        rows.append((k, s.ravel().tolist(), d.ravel().tolist()))
    line = np.stack([np.arange(5.0), np.zeros(5)], 1)
    rows += [(100, [3.0, 4.0] * 5, rows[0][2]), (101, rows[0][1], [7.0, 8.0] * 5), (102, line.ravel().tolist(), (2 * line[:, ::-1]).ravel().tolist())]
    table = spark.createDataFrame(rows, "k int, s array<double>, d array<double>")
    points = lambda c: [F.get(c, F.lit(i)) for i in range(10)]
    for r in table.select("k", "s", "d", faces.similarity(points("s"), points("d")).alias("t")).collect():
        matrix, shift = by_decomposition(r["s"], r["d"])
        t = r["t"]
        assert np.allclose([[t["a"], -t["b"]], [t["b"], t["a"]]], matrix, atol=1e-8) and np.allclose([t["x"], t["y"]], shift, atol=1e-6), r["k"]
