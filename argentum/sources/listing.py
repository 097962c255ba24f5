"""Folders as a data source of Spark's: a row for each file, with sizes and times in nanoseconds.

``spark.read.format("folder")`` lists every file, whatever its name: empty ones and names that begin
with ``_`` or ``.`` too.  ``spark.readStream.format("folder")`` tells when something under the folder
has changed, and lists what may have.

Names are read where the rows are made: the driver looks into folders until there are enough of them to
deal out, and each task walks its own.  A folder of very many files is dealt to several tasks by
a hash of the names.
"""

from __future__ import annotations

import os
import stat
import time
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, bytes long, modified_ns long, stamp long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
#: Folders or parts of folders that are dealt out at least, where there are so many; files of one folder in a part.
SLICES, FILES_PER_SLICE = 64, 20_000
#: Rows handed to Spark at a time.
ROWS = 4096
#: A change is told when it is this old, so that none with the same time can follow (seconds).
SETTLED = 0.05


@dataclass
class Entry:
    name: str
    path: str
    folder: bool
    file: bool
    bytes: int | None = None
    modified_ns: int | None = None
    #: When the entry itself was last made, moved or written, by the file system's clock.
    stamp: int = 0


def is_local(path: str) -> bool:
    return "://" not in path.removeprefix("file://")


def local_path(path: str) -> str:
    path = path.removeprefix("file:")
    return os.path.abspath("/" + path.lstrip("/") if path.startswith("//") else path)


def _since_1970(ns: int) -> int | None:
    return ns if ns >= 0 else None


def entries(folder: str, fs: pafs.FileSystem | None, wanted=lambda name: True) -> Iterator[Entry]:
    """What a folder holds; a folder that can't be read holds nothing, and entries that can't be read are left out.

    Links to files count as the files they lead to; links to folders are not followed.
    """
    if fs is not None:
        try:
            found = fs.get_file_info(pafs.FileSelector(folder, recursive=False, allow_not_found=True))
        except OSError:
            return
        for x in found:
            if x.type in (pafs.FileType.File, pafs.FileType.Directory) and wanted(x.base_name):
                ns = x.mtime_ns
                yield Entry(x.base_name, x.path, x.type == pafs.FileType.Directory, x.type == pafs.FileType.File, x.size, ns if ns is None else _since_1970(ns), ns or 0)
        return
    try:
        with os.scandir(folder) as found:
            for x in found:
                try:
                    if x.is_dir(follow_symlinks=False):
                        yield Entry(x.name, x.path, True, False, stamp=x.stat(follow_symlinks=False).st_ctime_ns)
                    elif wanted(x.name):
                        s = x.stat()
                        if stat.S_ISREG(s.st_mode):
                            yield Entry(x.name, x.path, False, True, s.st_size, _since_1970(s.st_mtime_ns), s.st_ctime_ns)
                except OSError:
                    continue
    except OSError:
        return


def file_system(root: str) -> tuple[pafs.FileSystem | None, str]:
    """(None, path) of a local folder, else pyarrow's file system and the path in it."""
    if is_local(root):
        return None, local_path(root)
    return pafs.FileSystem.from_uri(root)


def check_root(root: str) -> None:
    fs, path = file_system(root)
    kind = fs.get_file_info(path).type if fs else None
    if not (os.path.exists(path) if fs is None else kind != pafs.FileType.NotFound):
        raise FileNotFoundError(f"{root} does not exist")
    if not (os.path.isdir(path) if fs is None else kind == pafs.FileType.Directory):
        raise NotADirectoryError(root)


class Slice(InputPartition):
    """A folder, whether its sub-folders belong to it too, and which part of its files: names with hash % of == part."""

    def __init__(self, folder: str, deep: bool, part: int = 0, of: int = 1, stamp: int = 0, since: int = -1):
        self.folder, self.deep, self.part, self.of, self.stamp, self.since = folder, deep, part, of, stamp, since


def _looked_into(folder: str, fs: pafs.FileSystem | None) -> tuple[list[tuple[str, int]], int]:
    """(sub-folders with their stamps, number of other entries), without asking for the files' sizes."""
    if fs is not None:
        found = list(entries(folder, fs))
        return [(e.path, e.stamp) for e in found if e.folder], sum(e.file for e in found)
    inner, n = [], 0
    try:
        with os.scandir(folder) as found:
            for x in found:
                try:
                    if x.is_dir(follow_symlinks=False):
                        inner.append((x.path, x.stat(follow_symlinks=False).st_ctime_ns))
                    else:
                        n += 1
                except OSError:
                    continue
    except OSError:
        pass
    return inner, n


def slices(root: str, at_least: int = SLICES, files: int = FILES_PER_SLICE, since: int = -1) -> list[Slice]:
    """The work of a listing, dealt out; only the upper folders are looked into here."""
    fs, top = file_system(root)
    todo, out = deque([(top, 0)]), []
    while todo and len(todo) + len(out) < at_least:
        folder, above = todo.popleft()
        inner, n = _looked_into(folder, fs)
        todo.extend((path, max(above, stamp)) for path, stamp in inner)
        parts = max(1, -(-n // files))
        out += [Slice(folder, False, k, parts, above, since) for k in range(parts)]
    return out + [Slice(folder, True, stamp=above, since=since) for folder, above in todo]


def walk(piece: Slice, fs: pafs.FileSystem | None) -> Iterator[tuple[Entry, int]]:
    """(file, stamp) of a slice; a stamp is the latest of the file's and of the folders' between it and the root.

    A folder that is moved here is stamped itself, but its files are not.
    """
    todo = deque([(piece.folder, piece.stamp)])
    mine = (lambda name: zlib.crc32(os.fsencode(name)) % piece.of == piece.part) if piece.of > 1 else (lambda name: True)
    while todo:
        folder, above = todo.popleft()
        for e in entries(folder, fs, mine):
            if e.file:
                yield e, max(above, e.stamp)
            elif piece.deep:
                todo.append((e.path, max(above, e.stamp)))


def text_of(path: str) -> str:
    """A path as Unicode; bytes that are none become the replacement character."""
    return os.fsencode(path).decode("utf-8", "replace")


def prefix_of(root: str) -> str:
    """What stands before the file system's own paths, so that paths look as Spark's other sources tell them."""
    fs, top = file_system(root)
    return "file:" if fs is None else root.rstrip("/").removesuffix(top.rstrip("/"))


def rows_of(root: str, piece: Slice) -> Iterator[pa.RecordBatch]:
    fs, _ = file_system(root)
    prefix = prefix_of(root)
    columns: list[list] = [[] for _ in NAMES]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=NAMES)

    for e, stamp in walk(piece, fs):
        if stamp > piece.since:
            for column, value in zip(columns, (prefix + text_of(e.path), e.bytes, e.modified_ns, stamp)):
                column.append(value)
        if len(columns[0]) == ROWS:
            yield batch()
            columns = [[] for _ in NAMES]
    yield batch()


class FolderReader(DataSourceReader):
    def __init__(self, root: str, at_least: int):
        self.root, self.at_least = root, at_least

    def partitions(self):
        return slices(self.root, self.at_least)

    def read(self, partition):
        return rows_of(self.root, partition)


class FolderStream(DataSourceStreamReader):
    """An offset is the stamp of the last change that has been told; the driver looks for later ones."""

    def __init__(self, root: str, at_least: int):
        self.root, self.at_least = root, at_least

    def initialOffset(self):
        return {"stamp": -1}

    def _last(self) -> int:
        fs, top = file_system(self.root)
        last, todo = -1, deque([top])
        while todo:
            for e in entries(todo.popleft(), fs):
                last = max(last, e.stamp)
                if e.folder:
                    todo.append(e.path)
        return last

    def latestOffset(self):
        last = self._last()
        while (young := SETTLED - (time.time() - last / 1e9)) > 0:
            time.sleep(min(young, SETTLED))
            last = self._last()
        return {"stamp": last}

    def partitions(self, start, end):
        if start == end:
            return []
        return slices(self.root, self.at_least, since=start["stamp"])

    def read(self, partition):
        return rows_of(self.root, partition)


class Folder(DataSource):
    """Options: path, and ``slices``, into how many parts a listing is dealt at least."""

    @classmethod
    def name(cls):
        return "folder"

    def schema(self):
        return SCHEMA

    def _of(self):
        return self.options["path"], int(self.options.get("slices", SLICES))

    def reader(self, schema):
        return FolderReader(*self._of())

    def streamReader(self, schema):
        return FolderStream(*self._of())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Folder)


def read_whole(path: str) -> bytes | None:
    """A file's content; none where it can't be read."""
    try:
        if is_local(path):
            with open(local_path(path), "rb") as f:
                return f.read()
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(name) as f:
            return f.read()
    except (OSError, pa.ArrowInvalid):
        return None


def with_content(batches):
    """Rows (path, …) with the content of their files, one file at a time, so that a batch holds one file."""
    for batch in batches:
        at = batch.schema.get_field_index("path")
        for k, path in enumerate(batch.column(at).to_pylist()):
            row = batch.slice(k, 1)
            content = pa.array([None if path is None else read_whole(path)], pa.binary())
            yield pa.RecordBatch.from_arrays([*row.columns, content], names=[*batch.schema.names, "content"])
