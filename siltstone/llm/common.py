"""Helpers that the corpus operators share: words, folds, staging and samples of labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_dir, staged, staged_folder, unstage  # noqa: F401

#: A word is a longest run of characters other than the six ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD_PATTERN)

#: The longest texts that a bounded sample of labelled documents takes in. Scoring takes whole texts of any length.
MAX_SAMPLE_CHARS = 50_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """A frame with its columns as c0, c1, ..., so that none clashes with names used on the way, and these names by the given ones."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def given_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that `renamed` got, under their own names."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def words_of(text: str | None) -> list[str]:
    """The words of a text; a null text has none."""
    return WORD_RE.findall(text) if text else []


def lower_words_of(text: str | None) -> list[str]:
    """The words with A-Z lower-cased and every other character left alone."""
    return WORD_RE.findall(text.translate(_ASCII_LOWER)) if text else []


def words_col(text: Column) -> Column:
    """The words of a text column as an array; null and blank texts have an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def fold_of(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n: the fold that hold-out contracts are stated in."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def fold_is(key: Column, n: int, rest: int) -> Column:
    """Whether a key is in the fold that is held out. Rows without a key aren't; they aren't learned from either."""
    return F.coalesce(fold_of(key, n) == rest, F.lit(False))


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a lambda variable, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sampled_labels(labels: DataFrame, key: str, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """At most about `per_class` keys of each label 0 and 1, picked by key hash, and the rates they were picked at.

    Columns `k` and `y`. A key that is labelled twice counts once, as 1 if any row says so; null labels and other
    values don't count. Only this bounded table is ever broadcast.
    """
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    rows = rows.dropna().groupBy("k").agg(F.max("y").alias("y"))
    rates = {r["y"]: min(1.0, per_class / r["n"]) for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    whole = 1 << 52
    part = F.pmod(F.xxhash64(F.col("k"), F.lit("sample")), F.lit(whole))
    bound = F.when(F.col("y") == 1, int(whole * rates.get(1, 0))).otherwise(int(whole * rates.get(0, 0)))
    return rows.where(part < bound), rates


def labelled_texts(docs: DataFrame, sample: DataFrame, key: str, text: str, max_chars: int = MAX_SAMPLE_CHARS) -> DataFrame:
    """Key, text and label (`k`, `t`, `y`) of a bounded sample's documents that have a text; the documents don't move.

    Texts of more than `max_chars` characters aren't trained on, so the sample is bounded in bytes as well.
    """
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") <= max_chars)
    return texts.join(F.broadcast(sample), "k")
