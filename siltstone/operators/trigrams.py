"""Substring search over an index of trigrams: posting lists say which texts can hold what is looked for, and only those are read.

    index/postings/*.parquet    gram (packed), part (the column), n, keys; each file sorted by gram, so that a search reads the row groups of its grams
    index/counts/*.parquet      gram, texts that hold it
    index/texts/*.parquet       the rows, sorted by key, so that a few keys are found without reading the rest

A text that holds a string holds the string's trigrams in one column, so the candidates are an intersection of posting lists, from the
rarest gram on. Candidates are verified by the search's own condition, so the rows are those of a full scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UPPER, like_search

N = 3
#: Posting lists that are intersected: those of the rarest grams.
MOST_GRAMS = 8
#: So many postings make a block, and so many lists go on together.
BLOCK, ROWS = 2_000_000, 10_000
#: So many candidates may be named in the scan's filter; more are joined.
IN_PLACE = 1000


def packed(gram: str) -> int:
    """A trigram as one number of three code points."""
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


def grams_of(text: bytes | None) -> np.ndarray:
    """Distinct packed trigrams of a text with A-Z lower-cased; none for null and shorter ones."""
    chars = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64) if text else np.zeros(0, np.int64)
    chars[(chars >= 65) & (chars <= 90)] += 32
    return np.unique(chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]) if len(chars) >= N else chars[:0]


def grams_wanted(wanted: str) -> list[str] | None:
    """Trigrams that every match of a LIKE text holds: those of its runs between wildcards; None if it has none, or escapes."""
    if "\\" in wanted:
        return None
    runs = re.split("[%_]", wanted.translate(str.maketrans(UPPER, UPPER.lower())))
    return sorted({run[i : i + N] for run in runs for i in range(len(run) - N + 1)}) or None


def _lists(parts: int):
    """Rows of a key and texts to posting lists: of each block of texts, a row for each gram and column with the keys that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        grams: list[list[np.ndarray]] = [[] for _ in range(parts)]
        held = 0
        for batch in batches:
            begun = 0
            for i in range(batch.num_rows):
                for part in range(parts):
                    grams[part].append(grams_of(batch.column(1 + part)[i].as_py()))
                    held += len(grams[part][-1])
                if held >= BLOCK:
                    keys.append(batch.column(0).slice(begun, i + 1 - begun))
                    yield from made(keys, grams)
                    keys, grams, held, begun = [], [[] for _ in range(parts)], 0, i + 1
            keys.append(batch.column(0).slice(begun))
        yield from made(keys, grams)

    def made(keys: list[pa.Array], grams: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for part, found in enumerate(grams):
            if sum(map(len, found)):
                of = np.repeat(np.arange(len(found)), [len(g) for g in found])
                every = np.concatenate(found)
                order = np.argsort(every, kind="stable")
                distinct, begins = np.unique(every[order], return_index=True)
                ends = np.append(begins, len(every))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(keys).take(pa.array(of[order])))
                for i in range(0, len(distinct), ROWS):
                    rows = len(distinct[i : i + ROWS])
                    columns = [pa.array(distinct[i : i + ROWS]), pa.array(np.full(rows, part, np.int32)), pa.array(np.diff(ends[i : i + rows + 1]).astype(np.int32)), lists.slice(i, rows)]
                    yield pa.RecordBatch.from_arrays(columns, names=["gram", "part", "n", "keys"])

    return run


@dataclass(frozen=True)
class TrigramIndex:
    """An index at a path: of which key and columns."""

    spark: SparkSession
    path: str
    key: str
    columns: tuple[str, ...]

    def write(self, table: DataFrame) -> TrigramIndex:
        """Index a table whose key isn't null and doesn't repeat. Every task writes the posting lists of its own texts, so a gram that all hold is spread over files."""
        table.sort(self.key).write.mode("overwrite").parquet(f"{self.path}/texts")
        kind = table.schema[self.key].dataType
        texts = self.spark.read.schema(table.schema).parquet(f"{self.path}/texts").select(F.col(self.key).alias("key"), *[F.col(c).cast("binary").alias(f"t{i}") for i, c in enumerate(self.columns)])
        schema = f"gram long, part int, n int, keys array<{kind.simpleString()}>"
        postings = texts.mapInArrow(_lists(len(self.columns)), schema).sortWithinPartitions("gram", "part")
        postings.write.mode("overwrite").parquet(f"{self.path}/postings")
        counted = self.spark.read.parquet(f"{self.path}/postings").groupBy("gram").agg(F.sum("n").alias("texts"))
        counted.sort("gram").write.mode("overwrite").parquet(f"{self.path}/counts")
        return self

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def candidates(self, wanted: str) -> DataFrame | None:
        """Keys of the texts that hold all of a string's rarest trigrams in one column; None if it has none, so that all are candidates."""
        wanted_grams = grams_wanted(wanted)
        if wanted_grams is None:
            return None
        grams = [packed(g) for g in wanted_grams]
        counts = self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(grams)).orderBy("texts", "gram").limit(MOST_GRAMS).collect()
        postings = self.spark.read.parquet(f"{self.path}/postings")
        if self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(grams)).count() < len(grams):
            return postings.select(F.explode("keys").alias("key")).limit(0)  # a gram that no text holds
        rarest = [r["gram"] for r in counts]
        met = postings.where(F.col("gram").isin(rarest)).select("part", F.explode("keys").alias("key")).groupBy("key", "part").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest))
        return met.select("key").distinct()

    def search(self, wanted: str) -> DataFrame:
        """Rows any of whose columns holds the text, as `like_search` says."""
        condition = like_search([F.col(c) for c in self.columns], wanted)
        keys = self.candidates(wanted)
        if keys is None:
            return self.texts().where(condition)
        few = [r["key"] for r in keys.limit(IN_PLACE + 1).collect()]
        if len(few) <= IN_PLACE:
            return self.texts().where(F.col(self.key).isin(few)).where(condition)
        return self.texts().join(keys.withColumnRenamed("key", self.key), self.key, "left_semi").where(condition)
