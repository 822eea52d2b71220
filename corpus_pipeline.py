"""Corpus pipeline: quality rules, line dedup, near-dedup, source mixing and packing, one after another.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last
return the columns of `documents`, and any others that the table has, whatever their names. Stages meet in Parquet files in the folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import lines, minhash, mixing, packing, rules
from siltstone.llm.common import given_names, read_table, renamed, staged, unstage

#: Percent of Jaccard similarity at which the pipeline counts documents as near-duplicates.
NEAR_PERCENT = 80
#: Shorter texts are rejected by the rules.
MIN_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Their length matters little: short clean texts stay, and packing splits long ones.

    Null, empty and blank texts go, and so do others under MIN_WORDS words. Repeated rows and rows of one doc_id with
    different texts are judged by their own text each.
    """
    rows, names = renamed(docs)
    return given_names(rules.apply_rules(rows, text=names["text"], min_words=MIN_WORDS).where("kept"), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources share; `n_chars` follows the text.

    Null and empty texts stay as they are, and repeated rows are cut alike. A text that was boilerplate alone is empty after it.
    """
    rows, names = renamed(docs)
    cut = lines.remove_boilerplate(rows, key=names["doc_id"], text=names["text"], site=names["source"])
    chars = names["n_chars"]
    return given_names(cut.withColumn(chars, F.when(F.col("n_removed") > 0, F.length(names["text"]).cast("long")).otherwise(F.col(chars))), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group; rows that repeat stay once.

    Rows of one doc_id with different texts are decided by their own text each. Null and empty texts, and rows without a
    doc_id, are no group: they stay.
    """
    rows, names = renamed(docs)
    key, text = names["doc_id"], names["text"]
    stays = minhash.near_duplicates(rows, key=key, text=text, percent=NEAR_PERCENT).where("kept").select("row").distinct()
    own = rows.withColumn("own", F.xxhash64(F.col(key).cast("long"), F.col(text)))
    return given_names(own.join(stays, F.col("own") == F.col("row"), "left_semi").dropDuplicates([key, text]), names)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice; documents without a word go.

    Rows of one doc_id with different texts are taken each by its own number; rows that repeat as a whole by the largest of theirs.
    """
    rows, names = renamed(docs)
    key, text, source = (names[c] for c in ("doc_id", "text", "source"))
    keyed = rows.withColumn("own", F.xxhash64(key, text, source))
    taken = mixing.mix(keyed, key="own", text=text, source=source).where(F.col("copies") > 0).groupBy(F.col("own").alias("row")).agg(F.max("copies").alias("copies"))
    mixed = keyed.join(taken, F.col("own") == F.col("row"))
    return given_names(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), names)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins of 4096 words. Documents without a word have a row without a bin; equal texts share none."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Mixing and packing are sequential and iterative: SQL can't express them, so tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
