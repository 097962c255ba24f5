"""What a picture's bytes tell without decoding it: format, width, height and date tags.

Headers are read field by field; a file that ends too early, or says that a side is 0, has no size.  All
offsets are checked against the bytes that are there, and a directory is read once, so broken or circular files end.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
JPEG, PNG, GIF, BMP, RIFF, WEBP = b"\xff\xd8", b"\x89PNG\r\n\x1a\n", (b"GIF87a", b"GIF89a"), b"BM", b"RIFF", b"WEBP"
FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
ALONE = {0x01, *range(0xD0, 0xD8)}
EXIF = b"Exif\x00\x00"
ORIGINAL, DIGITISED, CHANGED, SUB_DIRECTORY = 0x9003, 0x9004, 0x0132, 0x8769
TEXT, SHORT, LONG = 2, 3, 4

FACTS = "format string, width int, height int, original string, digitised string, changed string"


def _unpack(kind: str, data: bytes, at: int):
    """The values at an offset, or none where the data end before."""
    if at < 0 or at + struct.calcsize(kind) > len(data):
        return None
    return struct.unpack_from(kind, data, at)


def _directory(tiff: bytes, order: str, at: int) -> dict[int, tuple[int, int, int]]:
    """{tag: (type, count, where its value field lies)} of a directory; of equal tags the first counts."""
    count = _unpack(order + "H", tiff, at)
    found: dict[int, tuple[int, int, int]] = {}
    for k in range(count[0] if count else 0):
        entry = _unpack(order + "HHI", tiff, at + 2 + 12 * k)
        if entry is None or at + 14 + 12 * k > len(tiff):
            break
        found.setdefault(entry[0], (entry[1], entry[2], at + 10 + 12 * k))
    return found


def _text(tiff: bytes, order: str, entry: tuple[int, int, int] | None) -> str | None:
    """A text value up to its first NUL, or none where it isn't text or lies outside."""
    if entry is None or entry[0] != TEXT:
        return None
    _, count, at = entry
    if count > 4:
        at = _unpack(order + "I", tiff, at)[0]
    if at + count > len(tiff):
        return None
    return tiff[at : at + count].partition(b"\x00")[0].decode("ascii", "replace")


def date_tags(tiff: bytes) -> tuple[str | None, str | None, str | None]:
    """(original, digitised, changed) out of a TIFF block in either byte order, from its first directory and that one's sub-directory."""
    order = {b"II*\x00": "<", b"MM\x00*": ">"}.get(tiff[:4])
    first = _unpack(order + "I", tiff, 4) if order else None
    if not first:
        return None, None, None
    top = _directory(tiff, order, first[0])
    kind, _, at = top.get(SUB_DIRECTORY, (None, 0, 0))
    to = _unpack(order + ("I" if kind == LONG else "H"), tiff, at) if kind in (LONG, SHORT) else None
    inner = _directory(tiff, order, to[0]) if to else {}
    return _text(tiff, order, inner.get(ORIGINAL)), _text(tiff, order, inner.get(DIGITISED)), _text(tiff, order, top.get(CHANGED))


def _jpeg(data: bytes):
    size, tiff, at = None, b"", 2
    while at + 1 < len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:  # fill
            at += 1
            continue
        if mark in ALONE:
            at += 2
            continue
        length = _unpack(">H", data, at + 2)
        if mark in (0xD9, 0xDA) or length is None or length[0] < 2:
            break
        if mark in FRAMES and size is None:
            size = _unpack(">HH", data, at + 5)
        if mark == 0xE1 and not tiff and data[at + 4 : at + 10] == EXIF:
            tiff = data[at + 10 : at + 2 + length[0]]
        at += 2 + length[0]
    return (size[1], size[0]) if size else None, tiff


def _chunks(data: bytes, at: int, kind: str, padded: bool, closing: int) -> Iterator[tuple[bytes, bytes]]:
    """(name, content) of the chunks of PNG (length first, a checksum behind) or RIFF (name first, padded)."""
    while at + 8 <= len(data):
        head = data[at : at + 8]
        name, length = (head[:4], head[4:]) if padded else (head[4:], head[:4])
        n = struct.unpack(kind, length)[0]
        yield name, data[at + 8 : at + 8 + n]
        at += 8 + n + closing + (n % 2 if padded else 0)


def _png(data: bytes):
    size, tiff = None, b""
    for name, body in _chunks(data, 8, ">I", False, 4):
        if name == b"IHDR" and size is None:
            size = _unpack(">II", body, 0)
        elif name == b"eXIf" and not tiff:
            tiff = body
        elif name == b"IEND":
            break
    return size, tiff


def _bmp(data: bytes):
    head = _unpack("<I", data, 14)
    if head is None:
        return None, b""
    size = _unpack("<HH", data, 18) if head[0] == 12 else _unpack("<ii", data, 18) if head[0] >= 40 else None
    return (size and (size[0], abs(size[1]))), b""


def _webp(data: bytes):
    size, tiff = None, b""
    for name, body in _chunks(data, 12, "<I", True, 0):
        if name == b"VP8X" and size is None and len(body) >= 10:
            size = 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
        elif name == b"VP8 " and size is None and body[3:6] == b"\x9d\x01\x2a" and (sides := _unpack("<HH", body, 6)):
            size = sides[0] & 0x3FFF, sides[1] & 0x3FFF
        elif name == b"VP8L" and size is None and body[:1] == b"\x2f" and (bits := _unpack("<I", body, 1)):
            size = 1 + (bits[0] & 0x3FFF), 1 + (bits[0] >> 14 & 0x3FFF)
        elif name == b"EXIF" and not tiff:
            tiff = body.removeprefix(EXIF)
    return size, tiff


def facts(data: bytes | None) -> tuple:
    """(format, width, height, original, digitised, changed) of a file's bytes; nulls for what they don't tell."""
    data = data or b""
    if data.startswith(JPEG):
        kind, (size, tiff) = "jpeg", _jpeg(data)
    elif data.startswith(PNG):
        kind, (size, tiff) = "png", _png(data)
    elif data.startswith(GIF):
        kind, size, tiff = "gif", _unpack("<HH", data, 6), b""
    elif data.startswith(RIFF) and data[8:12] == WEBP:
        kind, (size, tiff) = "webp", _webp(data)
    elif data.startswith(BMP):
        kind, (size, tiff) = "bmp", _bmp(data)
    else:
        return (None,) * 6
    whole = size is not None and all(0 < s < 1 << 31 for s in size)
    return kind, *(size if whole else (None, None)), *date_tags(tiff)


def with_facts(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with the columns of ``facts`` in place of the bytes, which don't come back from the tasks."""
    kept = [c for c in rows.columns if c != content]
    names = [f.split()[0] for f in FACTS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    schema = rows.select(*kept, *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in FACTS.split(", ")]).schema

    def read(batches):
        for batch in batches:
            told = [facts(x.as_py()) for x in batch.column(len(kept))]
            columns = [pa.array([t[k] for t in told], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*kept, *names])

    return rows.select(*kept, content).mapInArrow(read, schema)
