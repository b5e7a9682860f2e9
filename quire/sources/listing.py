"""A listing of every file below a folder, empty and hidden ones too, made by tasks.

The driver opens folders level by level only until there are enough of them to share out; a task lists one folder, or all
below it, so neither names nor sizes pass through the driver.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.sources.places import named, opened

#: Folders that are worth a task each.
SHARES = 64
ROWS = 1 << 14


@dataclass
class _Share(InputPartition):
    folder: str
    deep: bool


class _Lister(DataSourceReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[_Share]:
        system, root = opened(self.path)
        level, shallow = [root], []
        while level and len(level) < SHARES:
            shallow += level
            level = [e.path for folder in level for e in system.entries(folder) if e.is_folder]
        return [_Share(f, False) for f in shallow] + [_Share(f, True) for f in level]

    def read(self, share: _Share) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        folders = [share.folder]
        paths, sizes = [], []
        while folders:  # one folder's names at a time
            for e in system.entries(folders.pop()):
                if e.is_folder:
                    if share.deep:
                        folders.append(e.path)
                elif fnmatch.fnmatchcase(e.name, self.pattern):
                    paths.append(named(self.path, e.path))
                    sizes.append(e.size)
            if len(paths) >= ROWS or not folders:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "length"])
                paths, sizes = [], []


class FileListing(DataSource):
    """``spark.read`` format ``file_listing``: (path, length)."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, length bigint"

    def reader(self, schema) -> _Lister:
        return _Lister(self.options["path"], self.options.get("pattern", "*"))
