"""A data source of file trees that never opens what it leaves out.

Folders are listed one by one, those with an excluded name not at all; files are dealt to partitions by their bytes before any of them
is read. Empty files are rows too, and of files beyond a size only their names and sizes are read.

    spark.dataSource.register(FileTree)
    spark.read.format("filetree").option("project", "proj").load("/data/sources")
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .corpus import EXCLUDED_DIRS

#: Files of fewer bytes are read: what may be valid is smaller.
MAX_BYTES = 1_000_000
#: A partition's files have about so many bytes, and are so many, at most.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 20_000
#: Bytes of content to a record batch, and folders that are listed at a time.
BATCH_BYTES, LISTERS = 8 << 20, 32

#: Name, whether it is a folder, and size of what a folder holds.
Lister = Callable[[str], list[tuple[str, bool, int]]]


@dataclass(frozen=True)
class Place:
    """Where a tree lies: a local path, or one of a store that Arrow reaches by its address."""

    root: str

    @property
    def local(self) -> bool:
        return "://" not in self.root or self.root.startswith("file://")

    @property
    def base(self) -> str:
        return (self.root.removeprefix("file://") if self.local else self._arrow()[1]).rstrip("/") or "/"

    def _arrow(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def lister(self) -> Lister:
        """Links to folders aren't followed, so that no cycle is."""
        if self.local:
            return local_entries
        from pyarrow import fs

        store = self._arrow()[0]

        def entries(folder: str) -> list[tuple[str, bool, int]]:
            found = store.get_file_info(fs.FileSelector(folder))
            return [(i.base_name, i.type == fs.FileType.Directory, i.size or 0) for i in found if i.type in (fs.FileType.File, fs.FileType.Directory)]

        return entries

    def reader(self) -> Callable[[str], bytes]:
        if self.local:
            return local_bytes
        store = self._arrow()[0]

        def content(path: str) -> bytes:
            with store.open_input_stream(path) as f:
                return f.read()

        return content


def local_entries(folder: str) -> list[tuple[str, bool, int]]:
    out = []
    with os.scandir(folder) as entries:
        for e in entries:
            try:
                if e.is_dir():
                    if not e.is_symlink():
                        out.append((e.name, True, 0))
                elif e.is_file():
                    out.append((e.name, False, e.stat().st_size))
            except OSError:  # it went away, or is a link to nowhere
                continue
    return out


def local_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def walked(base: str, entries: Lister, excluded: frozenset[str]) -> Iterator[tuple[str, int]]:
    """Paths below the base and sizes of its files, by folders; folders with an excluded name aren't listed."""
    with ThreadPoolExecutor(LISTERS) as pool:
        level = [""]
        while level:
            below: list[str] = []
            for folder, found in zip(level, pool.map(lambda f: entries(f"{base}/{f}" if f else base), level), strict=True):
                for name, is_dir, size in sorted(found):
                    path = f"{folder}/{name}" if folder else name
                    if not is_dir:
                        yield path, size
                    elif name not in excluded:
                        below.append(path)
            level = below


def dealt(files: Iterator[tuple[str, int]], max_bytes: int, partition_bytes: int = PARTITION_BYTES) -> Iterator[list[tuple[str, int]]]:
    """Files in groups by the bytes that are to be read of them."""
    group, total = [], 0
    for path, size in files:
        cost = size if size < max_bytes else 0
        if group and (total + cost > partition_bytes or len(group) >= PARTITION_FILES):
            yield group
            group, total = [], 0
        group.append((path, size))
        total += cost
    if group:
        yield group


@dataclass
class Files(InputPartition):
    """Files of a partition: paths below the base, and sizes."""

    files: list[tuple[str, int]]


class FileTree(DataSource):
    """Options: `path`, `project` (before every path), `maxBytes`, `partitionBytes`, `content` (false: names and sizes only), `excluded` (names, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, relative_path string, size bigint, content string, strict boolean"

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(self.options)


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.place, self.project = Place(options["path"]), options.get("project", "")
        self.max_bytes = int(options.get("maxBytes", MAX_BYTES)) if options.get("content", "true").lower() != "false" else 0
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.excluded = frozenset(n for n in options["excluded"].split(",") if n) if "excluded" in options else frozenset(EXCLUDED_DIRS)

    def partitions(self) -> list[Files]:
        found = walked(self.place.base, self.place.lister(), self.excluded)
        return [Files(group) for group in dealt(found, self.max_bytes, self.partition_bytes)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        base, content = self.place.base, self.place.reader()
        rows, held = [], 0
        for below, size in partition.files:
            text, strict = None, None
            if size < self.max_bytes:
                try:
                    data = content(f"{base}/{below}")
                except FileNotFoundError:  # it was there when the folder was listed
                    continue
                text, strict = decoded_bytes(data)
                held += len(data)
            rows.append((f"{base}/{below}", f"{self.project}/{below}" if self.project else below, size, text, strict))
            if held >= BATCH_BYTES or len(rows) >= 4096:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def decoded_bytes(data: bytes) -> tuple[str, bool]:
    """UTF-8 with universal newlines, invalid bytes dropped, and whether there were none."""
    try:
        text, strict = data.decode("utf-8"), True
    except UnicodeDecodeError:
        text, strict = data.decode("utf-8", errors="ignore"), False
    return text.replace("\r\n", "\n").replace("\r", "\n"), strict


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as columns; names that aren't valid UTF-8 get a replacement mark for what isn't."""
    clean = lambda name: name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    rows = [(clean(path), clean(below), *rest) for path, below, *rest in rows]
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "relative_path", "size", "content", "strict"])


def walk(spark: SparkSession, root: str, project: str, content: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All files below a root but those in excluded folders, empty ones too: `path`, `relative_path`, `size`, `content`, `strict`.

    Content is null for files of `max_bytes` or more, or if it isn't wanted. Texts are decoded with invalid bytes dropped; `strict` says
    whether there were none. A path has the project before it and slashes only. A root that isn't there is an error.
    """
    spark.dataSource.register(FileTree)
    options = {"path": root, "project": project, "content": str(content).lower(), "maxBytes": str(max_bytes)}
    return spark.read.format("filetree").options(**options).load()
