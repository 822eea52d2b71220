"""Large JSON arrays read by several tasks: a pass notes where elements begin and end, and partitions seek to theirs.

The pass looks at strings, brackets and commas alone and keeps only where a partition begins and ends. Elements become lines
of JSON, which Spark's own reader takes from there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..staging import staged_folder
from .seek import listed, opened

#: Elements of a partition have about so many bytes, and so many are read at a time.
PARTITION_BYTES, READ_BYTES = 16 << 20, 4 << 20
BATCH_BYTES = 4 << 20
#: A string, ended or not; a bracket or comma; a colon.
_TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[\[\]{},:]', re.S)
_BLANK = b" \t\r\n"


def _tokens(f: BinaryIO, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offsets and tokens of a stretch of a file, read a piece at a time."""
    f.seek(begin)
    held, at, left = b"", begin, end - begin
    while True:
        piece = f.read(min(READ_BYTES, left)) if left else b""
        left -= len(piece)
        held, last, cut = held + piece, 0, False
        for m in _TOKEN.finditer(held):
            token = m[0]
            if token[0] == 34 and (len(token) == 1 or m.end() == len(held)) and (len(token) == 1 or token[-1] != 34 or _open(token)):
                cut, last = True, m.start()
                break
            yield at + m.start(), token
            last = m.end()
        if not piece:
            if cut:
                raise ValueError("the document ends inside a string")
            return
        keep = held[last:] if cut else b""
        at += len(held) - len(keep)
        held = keep


def _open(token: bytes) -> bool:
    """Whether a string's last quote is one that a backslash stands before."""
    slashes = len(token) - 1 - len(token[:-1].rstrip(b"\\"))
    return slashes % 2 == 1


def element_spans(f: BinaryIO, size: int, name: str | None = None, begin: int = 0) -> Iterator[tuple[int, int]]:
    """Begin and end of each element of a document's array: the document itself, or the array that its object has under a name.

    A document without such an array is an error. With `begin`, the stretch is a list of elements without brackets.
    """
    inside = begin > 0
    depth, first, key, seen = 0, begin, None, inside
    level = 0 if inside else 1 if name is None else 2
    wanted = inside  # whether what is open is the array
    for at, token in _tokens(f, begin, size):
        c = token[:1]
        if c == b'"':
            if depth == 1 and name is not None and not wanted:
                key = json.loads(token)
            continue
        if c in b"[{":
            if c == b"[" and depth == level - 1 and not inside and (name is None or key == name) and not seen:
                wanted = seen = True
                first = at + 1
            depth += 1
        elif c in b"]}":
            depth -= 1
            if depth == level - 1 and wanted and not inside:
                yield first, at
                wanted = False
        elif c == b"," and depth == level and wanted:
            yield first, at
            first = at + 1
        if c == b"," and depth == 1:
            key = None
    if inside:
        yield first, size
    if wanted and not inside:
        raise ValueError("the array has no end")
    if not seen:
        raise ValueError("the document is no array" if name is None else f"the document has no array {name}")


def dealt_spans(spans: Iterator[tuple[int, int]], partition_bytes: int) -> Iterator[tuple[int, int]]:
    """Stretches of elements that follow one another, of about so many bytes."""
    begin = end = None
    for a, b in spans:
        if begin is not None and b - begin > partition_bytes:
            yield begin, end
            begin = None
        begin, end = a if begin is None else begin, b
    if begin is not None:
        yield begin, end


@dataclass
class Stretch(InputPartition):
    path: str
    begin: int
    end: int


class JsonArray(DataSource):
    """Options: `paths` (a JSON list of files), `array` (the name of an array in the document's object), `partitionBytes`. A row is an element, as one line."""

    @classmethod
    def name(cls) -> str:
        return "jsonarray"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> JsonArrayReader:
        return JsonArrayReader(json.loads(self.options["paths"]), self.options.get("array") or None, int(self.options.get("partitionBytes", PARTITION_BYTES)))


class JsonArrayReader(DataSourceReader):
    def __init__(self, paths: list[str], array: str | None, partition_bytes: int):
        self.paths, self.array, self.partition_bytes = paths, array, partition_bytes

    def partitions(self) -> list[Stretch]:
        out = []
        for path in self.paths:
            f, size = opened(path)
            with f:
                out += [Stretch(path, *s) for s in dealt_spans(element_spans(f, size, self.array), self.partition_bytes)]
        return out or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        if partition.path:
            f, _ = opened(partition.path)
            with f:
                for begin, end in list(element_spans(f, partition.end, begin=partition.begin)):
                    f.seek(begin)
                    # line ends stand between tokens only
                    text = f.read(end - begin).strip(_BLANK).replace(b"\r", b" ").replace(b"\n", b" ")
                    if text:
                        held.append(text.decode("utf-8"))
                        total += len(text)
                    if total >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict({"value": held})
                        held, total = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": held})


def read_array(spark: SparkSession, path: str, schema: str | None = None, array: str | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The objects of a JSON array (a document, or an array of its object) as rows, with a schema or what Spark infers.

    `path` is a file, folder or pattern; each file is a document. The elements are written to the shared folder as lines of JSON, so a
    document is cut up once.
    """
    spark.dataSource.register(JsonArray)
    options = {"paths": json.dumps(listed(spark, path)), "array": array or "", "partitionBytes": str(partition_bytes)}
    lines = staged_folder(spark, "json")
    spark.read.format("jsonarray").options(**options).load().write.text(lines)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(lines)
