"""Exact vector search over a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, literal, squared_distance

METRICS = {"cosine": (cosine, True), "dot": (dot, True), "l2": (squared_distance, False)}


def nearest(table: DataFrame, query: list[float], k: int, key: str, vector: str = "embedding", metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k best rows with `similarity`, ties by key. A filter comes before; rows without a similarity drop out.

    Spark keeps k rows in every task and merges those: nothing is sorted or shuffled as a whole.
    """
    measure, largest = METRICS[metric]
    rows = table if where is None else table.where(where)
    scored = rows.withColumn("similarity", measure(F.col(vector), literal(query))).where(F.col("similarity").isNotNull())
    return scored.orderBy(F.desc("similarity") if largest else F.asc("similarity"), key).limit(k)


def in_files(paths: list[str] | None, column: str = "source_file") -> Column | None:
    return F.col(column).isin(paths) if paths else None
