"""Files that a task can seek in: of the local file system, or of a store that Arrow reaches."""

from __future__ import annotations

from typing import BinaryIO

from pyspark.sql import SparkSession


def opened(path: str) -> tuple[BinaryIO, int]:
    """A file and its size, by the path or address under which Spark lists it."""
    if path.startswith("file:") or "://" not in path:
        f = open("/" + path.removeprefix("file:").lstrip("/"), "rb")  # noqa: SIM115 - the caller closes it
        return f, f.seek(0, 2)
    from pyarrow import fs

    store, below = fs.FileSystem.from_uri(path)
    f = store.open_input_file(below)
    return f, f.size()


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files at a path (a file, folder or pattern of any store), as Spark lists them, in order."""
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
