"""The store of JSON files: validated, one row per path, searched by substring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import kib, like_search
from ..sources.corpus import strict_json

LIMIT = 3


def json_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("relative_path").endswith(".json"))


def store(files: DataFrame, order: str | None = None) -> DataFrame:
    """Valid JSON files as `relative_path`, `content`, `score`, `size_kb`; of a path that repeats, the first in order.

    Without an order of its own that is the manifest's: the best score first, then by content.
    """
    valid = strict_json(json_files(files), "content").where("valid")
    best = [F.desc("score")] if "score" in files.columns else []
    first = W.partitionBy("relative_path").orderBy(*([F.col(order)] if order else best), "content")
    rows = valid.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    score = F.col("score") if "score" in files.columns else F.lit(0)
    return rows.select("relative_path", "content", score.alias("score"), kib(F.col("size")).alias("size_kb"))


def search(table: DataFrame, wanted: str, limit: int = LIMIT) -> DataFrame:
    """Rows whose path or content holds the text, without regard to the case of A-Z, first by path."""
    return table.where(like_search([F.col("relative_path"), F.col("content")], wanted)).orderBy("relative_path").limit(limit)


def write_store(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)
