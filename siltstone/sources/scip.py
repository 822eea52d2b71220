"""Reader of SCIP code indexes: the protobuf wire format, as far as documents, occurrences and symbols go.

An index is one message; where its documents begin is found by reading their lengths and skipping what they hold. So documents are dealt
to partitions, each of which seeks to its own, and an index of any size is parsed by many tasks, once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..staging import staged
from .seek import listed, opened

# Field numbers of the published schema.
INDEX_DOCUMENT = 2
DOCUMENT_PATH, DOCUMENT_OCCURRENCE, DOCUMENT_SYMBOL = 1, 2, 3
OCCURRENCE_RANGE, OCCURRENCE_SYMBOL, OCCURRENCE_ROLES, OCCURRENCE_ENCLOSING = 1, 2, 3, 7
SYMBOL_NAME, SYMBOL_RELATION = 1, 4
RELATION_SYMBOL, RELATION_IMPLEMENTS = 1, 3

OCCURRENCES = "doc long, ord int, relative_path string, symbol string, roles int, range array<int>, enclosing array<int>"
RELATIONS = "doc long, ord int, relative_path string, source string, target string, is_implementation boolean"
#: Both as one table: `symbol` is a relation's source.
ROWS = f"{OCCURRENCES}, target string, is_implementation boolean"
#: Documents of a partition have about so many bytes.
PARTITION_BYTES = 4 << 20
BATCH_ROWS = 20_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message: integers, or the bytes of what has a length."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("the index is cut short")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} isn't known")
        yield tag >> 3, value


def _ints(value: int | bytes) -> list[int]:
    """One number, or the numbers of a packed list."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n)
    return out


def _numbers(data: bytes, n: int) -> list[int]:
    """The first n fields of a message of integers; those that are left out are 0."""
    found = {number: value for number, value in fields(data) if isinstance(value, int)}
    return [found.get(i, 0) for i in range(1, n + 1)]


#: Numbers of the typed forms of `range` and `enclosing_range`: (one line, several lines).
TYPED_RANGE, TYPED_ENCLOSING = (8, 9), (10, 11)


def parse_document(document: bytes) -> tuple[str, list[tuple], list[tuple]]:
    """A document's path, occurrences (symbol, roles, range, enclosing) and relations (source, target, is_implementation), in its order."""
    occurrences, relations = [], []
    parts = list(fields(document))
    path = next((v.decode() for n, v in parts if n == DOCUMENT_PATH), "")
    for n, value in parts:
        if n == DOCUMENT_OCCURRENCE:
            at: list[int] = []
            around: list[int] = []
            symbol, roles = "", 0
            for m, v in fields(value):
                if m == OCCURRENCE_RANGE:
                    at += _ints(v)
                elif m == OCCURRENCE_SYMBOL:
                    symbol = v.decode()
                elif m == OCCURRENCE_ROLES:
                    roles = v
                elif m == OCCURRENCE_ENCLOSING:
                    around += _ints(v)
                elif m in TYPED_RANGE:
                    at = at or _numbers(v, 3 if m == TYPED_RANGE[0] else 4)
                elif m in TYPED_ENCLOSING:
                    around = around or _numbers(v, 3 if m == TYPED_ENCLOSING[0] else 4)
            occurrences.append((symbol, roles, at or None, around or None))
        elif n == DOCUMENT_SYMBOL:
            source, found = "", []
            for m, v in fields(value):
                if m == SYMBOL_NAME:
                    source = v.decode()
                elif m == SYMBOL_RELATION:
                    found.append(dict(fields(v)))
            for relation in found:
                target = relation.get(RELATION_SYMBOL, b"").decode()
                relations.append((source, target, bool(relation.get(RELATION_IMPLEMENTS, 0))))
    return path, occurrences, relations


def parse_index(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """Rows of occurrences and of relations of a whole index, numbered within their documents."""
    occurrences, relations = [], []
    for doc, document in enumerate(v for n, v in fields(data) if n == INDEX_DOCUMENT):
        path, found, related = parse_document(document)
        occurrences += [(doc, i, path, *o) for i, o in enumerate(found)]
        relations += [(doc, i, path, *r) for i, r in enumerate(related)]
    return occurrences, relations


def document_spans(f: BinaryIO, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each document of an index, by its fields' heads alone."""
    at = 0
    while at < size:
        f.seek(at)
        head = f.read(24)
        try:
            tag, n = _varint(head, 0)
            kind = tag & 7
            length = 0
            if kind == 2:
                length, n = _varint(head, n)
            elif kind == 0:
                _, n = _varint(head, n)
            elif kind in (1, 5):
                n += 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} isn't known")
        except IndexError:
            raise ValueError("the index is cut short") from None
        if at + n + length > size:
            raise ValueError("the index is cut short")
        if tag >> 3 == INDEX_DOCUMENT and kind == 2:
            yield at + n, length
        at += n + length


@dataclass
class Documents(InputPartition):
    """Documents of an index: its path, and number, offset and length of each."""

    path: str
    spans: list[tuple[int, int, int]]


class ScipIndex(DataSource):
    """Options: `paths` (a JSON list of files), `partitionBytes`."""

    @classmethod
    def name(cls) -> str:
        return "scip"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> ScipReader:
        return ScipReader(json.loads(self.options["paths"]), int(self.options.get("partitionBytes", PARTITION_BYTES)))


class ScipReader(DataSourceReader):
    def __init__(self, paths: list[str], partition_bytes: int):
        self.paths, self.partition_bytes = paths, partition_bytes

    def partitions(self) -> list[Documents]:
        """Only the heads of fields are read here."""
        out = []
        for i, path in enumerate(self.paths):
            f, size = opened(path)
            with f:
                group, total = [], 0
                for doc, (offset, length) in enumerate(document_spans(f, size)):
                    if group and total + length > self.partition_bytes:
                        out.append(Documents(path, group))
                        group, total = [], 0
                    group.append(((i << 32) + doc, offset, length))
                    total += length
                if group:
                    out.append(Documents(path, group))
        return out or [Documents("", [])]

    def read(self, partition: Documents) -> Iterator[pa.RecordBatch]:
        rows = []
        if partition.spans:
            f, _ = opened(partition.path)
            with f:
                for doc, offset, length in partition.spans:
                    f.seek(offset)
                    path, occurrences, relations = parse_document(f.read(length))
                    rows += [(doc, i, path, *o, None, None) for i, o in enumerate(occurrences)]
                    rows += [(doc, i, path, source, None, None, None, target, implements) for i, (source, target, implements) in enumerate(relations)]
                    while len(rows) >= BATCH_ROWS:
                        yield _batch(rows[:BATCH_ROWS])
                        rows = rows[BATCH_ROWS:]
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    number, text, numbers = pa.int32(), pa.string(), pa.list_(pa.int32())
    types = (pa.int64(), number, text, text, number, numbers, numbers, text, pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split(" ")[0] for c in ROWS.split(", ")])


def read_scip(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> tuple[DataFrame, DataFrame]:
    """Occurrences and relations of the indexes at a path (a file, folder or pattern), which are listed by Spark and sought in by tasks.

    Documents are numbered within their index, and indexes in the order of their paths. The rows are written to the shared folder, so an
    index is parsed once, whatever is made of it.
    """
    spark.dataSource.register(ScipIndex)
    paths = listed(spark, path)
    rows = staged(spark.read.format("scip").options(paths=json.dumps(paths), partitionBytes=str(partition_bytes)).load(), "scip")
    occurrences = rows.where(F.col("is_implementation").isNull()).drop("target", "is_implementation")
    relations = rows.where(F.col("is_implementation").isNotNull()).select("doc", "ord", "relative_path", F.col("symbol").alias("source"), "target", "is_implementation")
    return occurrences, relations
