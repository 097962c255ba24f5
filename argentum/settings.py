"""Settings and known people as small JSON files, read and written by the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

import pyarrow.fs as pafs


@dataclass
class Settings:
    """What a scan and a search may use.  Fixed values: 3000 images at most by default, 50 in a batch."""

    max_indexed_images: int | None = 3000
    index_batch_size: int = 50
    thumbnail_gpu: bool = False
    ocr_gpu: bool = False
    clip_gpu: bool = False
    face_gpu: bool = False

    def checked(self) -> Settings:
        """These settings, or an error: a limit and a batch hold one image at least."""
        if self.max_indexed_images is not None and self.max_indexed_images < 1:
            raise ValueError("the limit of images must be at least 1, or none")
        if self.index_batch_size < 1:
            raise ValueError("a batch must hold at least one image")
        return self

    @classmethod
    def of(cls, values: dict) -> Settings:
        """Missing fields have their defaults; unknown ones are ignored."""
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})


def open_fs(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def read_json(path: str, default):
    """The value of a JSON file; the default where it can't be read."""
    try:
        fs, name = open_fs(path)
        with fs.open_input_stream(name) as source:
            return json.loads(source.read())
    except (OSError, ValueError):
        return default


def write_json(path: str, value) -> None:
    fs, name = open_fs(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name) as target:
        target.write(json.dumps(value, ensure_ascii=False, indent=2).encode())


def load_settings(path: str) -> Settings:
    values = read_json(path, {})
    return Settings.of(values) if isinstance(values, dict) else Settings()


def save_settings(path: str, settings: Settings) -> None:
    write_json(path, asdict(settings))


def load_people(path: str) -> list[dict]:
    """Known people (id, name, embedding), in their order; none where the file can't be read."""
    values = read_json(path, [])
    return [v for v in values if isinstance(v, dict) and {"id", "name", "embedding"} <= set(v)] if isinstance(values, list) else []


def save_people(path: str, people: list[dict]) -> None:
    write_json(path, people)
