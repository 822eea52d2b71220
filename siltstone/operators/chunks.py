"""Chunks of source code and prose: splitting, merging of short ones, and the documents that are embedded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.paths import PROVIDERS, LanguageProvider, classify, name_of, posix, registry, suffix_of
from ..functions.text import chunk_document, doc_summary, text_document
from .parser import split
from .textsplit import split_text

MAX_LINES, MIN_LINES = 50, 10
#: Chunks of files go on together up to so many, or so many characters of files.
BATCH_ROWS, BATCH_CHARS = 5_000, 4_000_000
_CHUNK = "chunk_type string, hierarchical_name string, source_text string, start_line int, end_line int, start_byte int, end_byte int, jsdoc_text string"


def merge_table(chunks: DataFrame, file: str = "file", min_lines: int = MIN_LINES, max_lines: int = MAX_LINES) -> DataFrame:
    """Fold the chunks of each file in the order of their first byte: long ones stay, short neighbours of one parent become blocks.

    A chunk of `min_lines` or more stands alone and ends the block before it. A short one joins the block if it has
    the parent of the block's last chunk and the block would span no more than `max_lines`. A block of one is a block.

    Rows are sorted by file and place and pass through one at a time: only the block that is open is held, which spans `max_lines` at most.
    """
    names = [c.split(" ")[0] for c in _CHUNK.split(", ")]
    first = ["start_byte", "end_byte", *[n for n in names if n not in ("start_byte", "end_byte")]]
    placed = chunks.select(file, *names).repartition(file).sortWithinPartitions(file, *first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = None if row[4] is None or row[5] is None else row[5] - row[4]
                lone = lines is not None and lines >= min_lines
                if block and (lone or not _joins(block, row, max_lines)):
                    done.append(_block(block))
                    block = []
                if lone:
                    done.append(row)
                else:
                    block.append(row)
            if done:
                yield made(done)
        if block:
            yield made([_block(block)])

    types = [to_arrow_type(chunks.schema[file].dataType), *[pa.int32() if c.endswith(" int") else pa.string() for c in _CHUNK.split(", ")]]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[file, *names])

    return placed.mapInArrow(run, f"`{file}` {chunks.schema[file].dataType.simpleString()}, {_CHUNK}")


def _parent(name: str | None) -> str | None:
    return None if name is None else name.rpartition(".")[0]


def _joins(block: list[tuple], row: tuple, max_lines: int) -> bool:
    """Whether a short chunk (file, type, name, text, first line, last line, ...) goes on with an open block."""
    first, last = block[0], block[-1]
    if row[0] != last[0] or None in (row[2], last[2], row[5], first[4]):
        return False
    return _parent(last[2]) == _parent(row[2]) and row[5] - first[4] <= max_lines


def _block(block: list[tuple]) -> tuple:
    first, last = block[0], block[-1]
    parent = _parent(first[2])
    name = None if None in (parent, first[4], last[5]) else f"{parent}.merged_L{first[4]}_L{last[5]}"
    return (first[0], "merged_block", name, "\n\n".join(c[3] for c in block if c[3] is not None), first[4], last[5], first[6], last[7], first[8])


def code_chunks(files: DataFrame, providers: tuple[LanguageProvider, ...] = PROVIDERS) -> DataFrame:
    """Atomic chunks of code files: `relative_path`, a chunk's fields, and `error` for files that couldn't be read."""
    known = registry(providers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for path, content in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                name = path.replace("\\", "/").rsplit("/", 1)[-1]
                provider = known["." + name.rsplit(".", 1)[-1].lower()]
                try:
                    held += [(path, c.chunk_type, c.hierarchical_name, c.source_text, c.start_line, c.end_line, c.start_byte, c.end_byte, c.jsdoc_text, None) for c in split(content, name, provider)]
                except (RecursionError, ValueError, IndexError, AttributeError, StopIteration) as e:
                    held.append((path, *[None] * 8, f"{type(e).__name__}: {e}"))
                size += len(content)
                if size > BATCH_CHARS or len(held) > BATCH_ROWS:
                    yield from made(held)
                    held, size = [], 0
            yield from made(held)

    def made(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = f"relative_path string, {_CHUNK}, error string"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = [pa.int32() if " int" in c else pa.string() for c in schema.split(", ")]
    code = files.where((classify(F.col("relative_path"), providers) == "CODE") & F.col("content").isNotNull())
    return code.select("relative_path", "content").mapInArrow(run, schema)


def text_chunks(files: DataFrame, text: str = "content", path: str = "relative_path", **limits: int) -> DataFrame:
    """Chunks of texts, numbered from 1: the path, `number`, `chunk`. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, c) for p, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True) if t for i, c in enumerate(split_text(t, **limits), 1)]
            if rows:
                p, i, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, batch.column(0).type), pa.array(i, pa.int32()), pa.array(c)], names=[path, "number", "chunk"])

    kind = files.schema[path].dataType.simpleString()
    return files.select(path, text).mapInArrow(run, f"{path} {kind}, number int, chunk string")


def chunk_documents(files: DataFrame, providers: tuple[LanguageProvider, ...] = PROVIDERS) -> tuple[DataFrame, DataFrame]:
    """Documents to embed, of code and text files, and the rejects: files whose code couldn't be split, with the error.

    Columns: page_content, source_file, hierarchical_name, chunk_type, start_line, end_line, jsdoc_summary. Files of
    other kinds give nothing. With a column `strict`, code and text files whose bytes weren't valid UTF-8 are rejects.
    """
    broken = files.limit(0).select("relative_path", F.lit("").alias("error"))
    if "strict" in files.columns:
        broken = files.where(~F.col("strict") & classify(F.col("relative_path"), providers).isin("CODE", "TEXT")).select("relative_path", F.lit("UnicodeDecodeError: the bytes aren't valid UTF-8").alias("error"))
        files = files.where("strict")
    atoms = code_chunks(files, providers)
    rejects = atoms.where("error IS NOT NULL").select("relative_path", "error").unionByName(broken)
    code = merge_table(atoms.where("error IS NULL").drop("error"), "relative_path")
    path = posix(F.col("relative_path"))
    coded = code.select(
        chunk_document(path, F.col("hierarchical_name"), F.col("source_text"), F.col("jsdoc_text")).alias("page_content"), path.alias("source_file"),
        "hierarchical_name", "chunk_type", "start_line", "end_line", doc_summary(F.col("jsdoc_text")).alias("jsdoc_summary"),
    )
    prose = text_chunks(files.where(classify(F.col("relative_path"), providers) == "TEXT"))
    zero = F.lit(0)
    written = prose.select(
        text_document(path, F.col("number"), F.col("chunk")).alias("page_content"), path.alias("source_file"),
        F.concat(name_of(F.col("relative_path")), F.lit("_chunk_"), F.col("number")).alias("hierarchical_name"),
        F.concat(suffix_of(F.col("relative_path")), F.lit("_file")).alias("chunk_type"), zero.alias("start_line"), zero.alias("end_line"), F.lit("N/A").alias("jsdoc_summary"),
    )
    return coded.unionByName(written), rejects
