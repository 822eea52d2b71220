"""Incremental cards: new files of a folder become cards, one for each file, across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cards
from ..sources.corpus import decoded, excluded_dir

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, root: str, project: str) -> DataFrame:
    """Files below a root as a stream of `relative_path`, `content`, `size`."""
    rows = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://").lstrip("/")
    below = F.regexp_replace("path", f"^(file:)?/*{base}/", "")
    kept = rows.withColumn("_below", below).where(~F.coalesce(excluded_dir(F.col("_below")), F.lit(False)))
    return kept.select(F.concat_ws("/", F.lit(project), "_below").alias("relative_path"), decoded(F.col("content")).alias("content"), F.col("length").alias("size"))


def stream_cards(files: DataFrame, nodes: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Write a card for every file that has none of its content yet, take what there is, and stop.

    A batch is one version of the store, named by the query and the batch's number: if it is run again, or was killed on the way, it counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh, known = batch.dropDuplicates(["relative_path"]), cards.card_store(spark, store)
        if known.exists():
            fresh = cards.pending(fresh, known.read(), by_content=True)
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        cards.write_cards(cards.build_cards(fresh, nodes), store, resume=True, token=query and f"{query}:{number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
