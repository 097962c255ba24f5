"""Tables of a catalogue as Parquet folders, and the states that name them.

A table is cut by root, and within a root into parts.  A state is a small file that names the folder of every
part; writing a part makes a new folder, and a state is switched by creating the next file, which
fails if somebody else has created it.  So a change writes the parts that it touches and no others, a
reader sees one state as a whole, and what breaks off before the switch changes nothing.  Folders that only
dropped states name are removed.
"""

from __future__ import annotations

import copy
import datetime
import json
import math
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.settings import open_fs, read_json, write_json

#: Rows of a part that is cut by path, about; states that are kept, so that readers of the one before can end.
ROWS_PER_PART, KEPT = 100_000, 2


def bucket(path: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("string")


def buckets_for(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_PER_PART))


class Conflict(RuntimeError):
    """Another state was written meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    # --- folders

    def names(self, folder: str) -> list[str]:
        fs, name = open_fs(f"{self.path}/{folder}")
        found = fs.get_file_info(pafs.FileSelector(name, allow_not_found=True))
        return sorted(f.base_name for f in found)

    def remove(self, folder: str) -> None:
        fs, name = open_fs(f"{self.path}/{folder}")
        if fs.get_file_info(name).type == pafs.FileType.Directory:
            fs.delete_dir(name)

    def fresh(self, kind: str) -> str:
        return f"{kind}/{uuid.uuid4().hex}"

    # --- states

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names("states") if n.removesuffix(".json").isdigit())

    def state(self, version: int | None = None) -> dict:
        """A state, or the last one that is whole; an empty one before the first."""
        for v in reversed(self._versions()) if version is None else [version]:
            if found := read_json(f"{self.path}/states/{v:012d}.json", None):
                return found
        return {"version": 0, "root": None, "tables": {}, "buckets": {}, "migrated": [], "taken": {}, "people": None}

    def commit(self, state: dict) -> dict:
        """Switch to a state made from the last one; older ones than the kept ones go."""
        last = self._versions()
        if last and self.state()["version"] != state["version"]:
            raise Conflict(f"the catalogue has moved on from state {state['version']}")
        made = {**state, "version": max([state["version"], *last]) + 1, "at": datetime.datetime.now(datetime.UTC).isoformat()}
        self._create(f"states/{made['version']:012d}.json", json.dumps(made, ensure_ascii=False))
        self._drop_old()
        return made

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _create(self, name: str, text: str) -> None:
        """A file that must not be there yet, by the Hadoop file system that Spark writes with."""
        path, fs = self._hadoop(name)
        try:
            out = fs.create(path, False)
        except Exception as error:
            raise Conflict(name) from error
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _drop_old(self) -> None:
        versions = self._versions()
        held = [self.state(v) for v in versions[-KEPT:]]
        kept = {f for s in held for f in _folders(s)}
        for v in versions[:-KEPT]:
            for folder in _folders(self.state(v)) - kept:
                self.remove(folder)
            path, fs = self._hadoop(f"states/{v:012d}.json")
            fs.delete(path, False)  # with its checksum

    # --- tables

    def read(self, table: str, state: dict, root: str | None = None, parts: set[str] | None = None) -> DataFrame:
        """The rows of a state's table, of one root or of some of its parts: only their folders are read."""
        roots = state["tables"].get(table, {})
        chosen = roots.values() if root is None else [roots.get(root, {})]
        folders = [f"{self.path}/{f}" for found in chosen for part, f in sorted(found.items()) if parts is None or part in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*folders)

    def parts(self, table: str, state: dict, root: str) -> set[str]:
        return set(state["tables"].get(table, {}).get(root, {}))

    def write(self, table: str, rows: DataFrame, part: Column | None = None, order: list[str] | None = None) -> dict[str, str]:
        """Write rows of a root into new folders, one for each part, or one in all; returns part -> folder.

        A part has ROWS_PER_PART rows or so, and one task writes it.  With an ``order`` parts may be of any size: each is
        dealt to ranges of that order and sorted, so that readers can pass over files and row groups.
        """
        folder = self.fresh(table)
        columns = rows.sparkSession.createDataFrame([], self.schemas[table]).columns
        if part is None:
            rows.select(columns).write.parquet(f"{self.path}/{folder}")
            return {"0": folder}
        told = rows.select(*columns, part.alias("part"))
        laid = told.repartitionByRange("part", *order).sortWithinPartitions("part", *order) if order else told.repartition("part")
        laid.write.partitionBy("part").parquet(f"{self.path}/{folder}")
        return {n.removeprefix("part="): f"{folder}/{n}" for n in self.names(folder) if n.startswith("part=")}

    def replace(self, state: dict, table: str, root: str, made: dict[str, str], parts: set[str] | None = None) -> None:
        """Let a state name new folders in place of some parts of a root (or of all)."""
        old = state["tables"].setdefault(table, {}).get(root, {})
        state["tables"][table][root] = {p: f for p, f in old.items() if parts is not None and p not in parts} | made

    def next(self, state: dict) -> dict:
        return copy.deepcopy(state)

    def write_people(self, people: list[dict]) -> str:
        name = f"{self.fresh('people')}.json"
        write_json(f"{self.path}/{name}", people)
        return name


def _folders(state: dict) -> set[str]:
    return {f for roots in state.get("tables", {}).values() for parts in roots.values() for f in parts.values()}
