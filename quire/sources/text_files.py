"""One UTF-8 file for each document and part, written and read by tasks themselves.

Files lie in ``FOLDERS`` folders by a checksum of the key, so no folder grows without bound and none is made for a single
document. A task writes a file under another name and then gives it its own, so a file is whole or absent, and a task that
runs again writes the same files. What each task wrote comes back as its commit message; their sum is the ``_SUCCESS`` file
that only a complete write has. Readers list one folder each: the driver never holds the names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quire.sources.places import opened

FOLDERS = 256
#: Bytes of text in one batch of a reader.
BATCH_BYTES = 8 << 20


def _folder(key: str) -> str:
    return f"{zlib.crc32(key.encode()) % FOLDERS:02x}"


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        system, root = opened(self.path)
        made, files, size = set(), 0, 0
        for key, part, text in rows:
            folder = f"{root}/{_folder(key or '')}"
            if folder not in made:
                system.make(folder)
                made.add(folder)
            raw = (text or "").encode()
            waiting = f"{folder}/.{uuid.uuid4().hex}"
            system.write(waiting, raw)
            name = "none" if key is None else f"k{quote(key, safe='')}"
            system.move(waiting, f"{folder}/{name}.{part:06d}.txt")
            files, size = files + 1, size + len(raw)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        system.make(root)
        done = [m for m in messages if m is not None]
        system.write(f"{root}/_SUCCESS", json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing is taken back: without ``_SUCCESS`` the folder is not whole."""


@dataclass
class _Folder(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Folder]:
        return [_Folder(f"{k:02x}") for k in range(FOLDERS)]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            keys, parts, texts = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(parts, pa.int64()), pa.array(texts, pa.string())], ["key", "part", "text"])

        for e in system.entries(f"{root}/{partition.name}"):
            if e.name.startswith(".") or not e.name.endswith(".txt"):
                continue  # left by a task that was lost
            name, part, _ = e.name.rsplit(".", 2)
            key = unquote(name[1:]) if name.startswith("k") else None
            held.append((key, int(part), system.read(e.path).decode("utf-8", "replace")))
            size += e.size
            if size > BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class TextFiles(DataSource):
    """``spark.read`` and ``df.write`` format ``text_files``: (key, part, text)."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "key string, part bigint, text string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])
