"""Vector columns: similarity, and deterministic embeddings for work without a model server."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .calls import Caller, Limits, bounded_tokens

DIM = 256
BATCH = 8


def dot(a: Column, b: Column) -> Column:
    wide = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for a null vector and for one of no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / F.when(lengths > 0, lengths))


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x * x)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dimension(df: DataFrame, column: str = "embedding") -> int | None:
    row = df.where(F.col(column).isNotNull()).select(F.size(column)).first()
    return None if row is None else row[0]


def hashed_embedding(text: str, dim: int = DIM) -> np.ndarray:
    """A unit vector of signed, hashed words and character trigrams: the default provider, needs no model."""
    out = np.zeros(dim, np.float32)
    for word in text.lower().split():
        marked = f"^{word}$"
        for gram in (marked, *(marked[i : i + 3] for i in range(len(marked) - 2))):
            h = xxhash.xxh64_intdigest(gram)
            out[h % dim] += 1 if h >> 63 else -1
    length = float(np.linalg.norm(out))
    return out / length if length else out


Provider = Callable[[list[str]], list[list[float]]]


def hashed_provider(texts: list[str]) -> list[list[float]]:
    return [hashed_embedding(t).tolist() for t in texts]


def embed(df: DataFrame, text: str, provider: Provider = hashed_provider, batch: int = BATCH, into: str = "embedding", limits: Limits = Limits(retries=0)) -> DataFrame:  # noqa: B008
    """Add embeddings from a provider that takes small batches. A batch that it fails on, or hangs at, gets nulls and loses nothing else.

    A task asks for a few batches at a time, each within the deadline of the limits.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(provider, limits)
        for rows in batches:
            texts = [bounded_tokens(t or "", limits.max_tokens) for t in rows.column(rows.schema.get_field_index(text)).to_pylist()]
            parts = [texts[i : i + batch] for i in range(0, len(texts), batch)]
            vectors: list = []
            for part, outcome in zip(parts, caller.all([(p,) for p in parts]), strict=True):
                whole = outcome.error is None and outcome.value is not None and len(outcome.value) == len(part)
                vectors += outcome.value if whole else [None] * len(part)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], names=schema.names)

    return df.mapInArrow(run, schema)
