"""Where values and records lie: in memory, or in files below a folder that all workers reach."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import Protocol
from urllib.parse import urlsplit

from pyarrow import fs


class Store(Protocol):
    url: str | None

    def get(self, table: str, key: str) -> bytes | None: ...
    def put(self, table: str, key: str, data: bytes) -> None: ...
    def add(self, table: str, key: str, data: bytes) -> bool: ...
    def drop(self, table: str, key: str) -> None: ...
    def keys(self, table: str, prefix: str = "") -> Iterator[str]: ...


class MemoryStore:
    """For one process. Large values lie in blocks, so that none has to be one string."""

    url = None

    def __init__(self, block: int = 30 * 1024 * 1024):
        self.block = block
        self.tables: dict[str, dict[str, list[bytes]]] = {}

    def get(self, table: str, key: str) -> bytes | None:
        blocks = self.tables.get(table, {}).get(key)
        return None if blocks is None else b"".join(blocks)

    def put(self, table: str, key: str, data: bytes) -> None:
        self.tables.setdefault(table, {})[key] = [data[i : i + self.block] for i in range(0, len(data), self.block)] or [b""]

    def add(self, table: str, key: str, data: bytes) -> bool:
        """put() where nothing is yet; False where something is."""
        if key in self.tables.get(table, {}):
            return False
        self.put(table, key, data)
        return True

    def drop(self, table: str, key: str) -> None:
        self.tables.get(table, {}).pop(key, None)

    def keys(self, table: str, prefix: str = "") -> Iterator[str]:
        return iter(sorted(k for k in self.tables.get(table, {}) if k.startswith(prefix)))


class FileStore:
    """<root>/<table>/<first two characters of the key>/<the rest>; writes appear by one rename.

    Where a file system copies instead of renaming, as object stores do, a reader sees the old file or
    the new one as well, since those make a file visible when it is whole.
    """

    def __init__(self, url: str):
        self.url = url
        self.fs, self.root = fs.FileSystem.from_uri(url)

    def _place(self, table: str, key: str) -> str:
        return f"{self.root}/{table}/{key[:2]}/{key[2:]}"

    def get(self, table: str, key: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(self._place(table, key)) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, table: str, key: str, data: bytes) -> None:
        place = self._place(table, key)
        self.fs.create_dir(place.rsplit("/", 1)[0])
        draft = f"{place}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(draft) as f:
            f.write(data)
        self.fs.move(draft, place)

    def add(self, table: str, key: str, data: bytes) -> bool:
        """put() where nothing is yet; False where something is.

        Exact on folders of the operating system, shared ones included. Elsewhere two writers in one
        moment may both succeed.
        """
        place = self._place(table, key)
        if not isinstance(self.fs, fs.LocalFileSystem):
            if self.get(table, key) is not None:
                return False
            self.put(table, key, data)
            return self.get(table, key) == data
        os.makedirs(place.rsplit("/", 1)[0], exist_ok=True)
        try:
            with open(place, "xb") as f:
                f.write(data)
        except FileExistsError:
            return False
        return True

    def drop(self, table: str, key: str) -> None:
        try:
            self.fs.delete_file(self._place(table, key))
        except FileNotFoundError:
            pass

    def keys(self, table: str, prefix: str = "") -> Iterator[str]:
        folder = f"{self.root}/{table}" + (f"/{prefix[:2]}" if len(prefix) >= 2 else "")
        found = self.fs.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
        names = ("".join(x.path.rsplit("/", 2)[1:]) for x in found if x.type == fs.FileType.File and not x.path.endswith(".tmp"))
        return iter(sorted(n for n in names if n.startswith(prefix)))


def open_store(url: str | None = None) -> Store:
    """memory: or a URL that pyarrow's file systems know; WEFTLINE_STORE where none is given."""
    url = url or os.environ.get("WEFTLINE_STORE") or "memory:"
    scheme = urlsplit(url).scheme
    if scheme == "memory":
        return MemoryStore()
    if scheme in ("", "file", "hdfs", "s3", "gs", "abfs"):
        return FileStore(os.path.abspath(url) if not scheme else url)
    raise NotImplementedError(f"no store for {scheme}: URLs")
