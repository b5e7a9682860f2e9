"""Folders and files by address: the machine's own file tree, or any that Arrow reaches."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit


class Entry(NamedTuple):
    path: str
    name: str
    is_folder: bool
    size: int


class Local:
    """Shared folders that are mounted."""

    def entries(self, folder: str) -> Iterator[Entry]:
        if not os.path.isdir(folder):
            return
        with os.scandir(folder) as found:
            for e in found:
                is_folder = e.is_dir()
                yield Entry(f"{folder.rstrip('/')}/{e.name}", e.name, is_folder, 0 if is_folder else e.stat().st_size)

    def make(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)

    def write(self, path: str, raw: bytes) -> None:
        with open(path, "wb") as out:
            out.write(raw)

    def move(self, old: str, new: str) -> None:
        os.replace(old, new)

    def read(self, path: str) -> bytes:
        with open(path, "rb") as file:
            return file.read()


class Remote:
    """File systems of Arrow."""

    def __init__(self, uri: str):
        from pyarrow import fs  # it starts threads, so only where it is needed

        self.fs = fs
        self.system, self.root = fs.FileSystem.from_uri(uri)

    def entries(self, folder: str) -> Iterator[Entry]:
        for info in self.system.get_file_info(self.fs.FileSelector(folder, allow_not_found=True)):
            is_folder = info.type == self.fs.FileType.Directory
            yield Entry(info.path, info.base_name, is_folder, 0 if is_folder else info.size)

    def make(self, folder: str) -> None:
        self.system.create_dir(folder, recursive=True)

    def write(self, path: str, raw: bytes) -> None:
        with self.system.open_output_stream(path) as out:
            out.write(raw)

    def move(self, old: str, new: str) -> None:
        self.system.move(old, new)

    def read(self, path: str) -> bytes:
        with self.system.open_input_file(path) as file:
            return file.read()


def opened(address: str) -> tuple[Local | Remote, str]:
    """(file system, path) of a path or URI."""
    parts = urlsplit(address)
    if "://" not in address and not address.startswith("file:"):
        return Local(), address.rstrip("/") or "/"
    if parts.scheme == "file":
        return Local(), "/" + address[len("file:"):].strip("/")
    system = Remote(address)
    return system, system.root


def named(address: str, path: str) -> str:
    """A path as Spark names it: one slash after "file:", scheme and host before others."""
    parts = urlsplit(address)
    if parts.scheme in ("", "file"):
        return f"file:{path}"
    inside = path if path.startswith("/") else f"/{path}"
    return f"{parts.scheme}://{parts.netloc}{inside.removeprefix(f'/{parts.netloc}') if parts.netloc else inside}"
