"""A corpus of files as a DataFrame: `relative_path`, `content`, `size`."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import posix
from .jsonarray import read_array

# Directories that hold no sources of their own.
EXCLUDED_DIRS = (
    "node_modules", "dist", "build", ".git", "coverage", ".next", ".nuxt", "out", "venv", "__pycache__", ".cache", "vendor",
    "tmp", "temp",
)

MANIFEST = (
    "path string, relative_path string, score int, reasons array<string>, lines int, size bigint, category string, language string, support_status string"
)


def excluded_dir(relative_path: Column) -> Column:
    """True if a directory below the root, at any depth, is an excluded one."""
    parts = F.split(posix(relative_path), "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))


def decoded(content: Column) -> Column:
    """UTF-8 with invalid bytes dropped and universal newlines. A replacement mark that the text has of its own stays."""
    mark, aside = F.lit("\ufffd"), F.lit("\ufdd0\ufdd1\ufdd0")
    valid = F.make_valid_utf8(F.replace(content.cast("string"), mark, aside))
    return F.regexp_replace(F.replace(F.replace(valid, mark, F.lit("")), aside, mark), "\r\n?", "\n")


def scan(spark: SparkSession, root: str, project: str) -> DataFrame:
    """All files below a root that aren't in excluded directories, by the binary file reader of the root's file system.

    Texts are decoded with invalid bytes dropped; `strict` says whether they were valid. A path has the project before
    it and slashes only. Files without a byte are left out: the binary reader doesn't list them. `sources.tree.walk` does, and doesn't open what it prunes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    below = F.regexp_replace(posix(F.col("path")), f"^(file:)?/*{base.lstrip('/')}/", "")
    rows = files.select(F.col("path"), below.alias("below"), F.col("length").alias("size"), F.col("content").alias("bytes"))
    kept = rows.where(~F.coalesce(excluded_dir(F.col("below")), F.lit(False)))
    return kept.select(
        "path", F.concat_ws("/", F.lit(project), "below").alias("relative_path"), "size",
        decoded(F.col("bytes")).alias("content"), F.is_valid_utf8(F.col("bytes").cast("string")).alias("strict"),
    )


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A manifest from one JSON array, which several tasks read, or with `lines` from the JSON lines that the audit writes."""
    return spark.read.schema(MANIFEST).json(path) if lines else read_array(spark, path, MANIFEST)


def with_content(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """A manifest's rows with their files' content, and whether its bytes were valid if that is known; files that are gone drop out."""
    return manifest.join(files.select("relative_path", "content", *[c for c in ("strict",) if c in files.columns]), "relative_path")


def from_documents(docs: DataFrame) -> DataFrame:
    """A file corpus out of a table of documents, for tests and benchmarks: kinds, folders and code marks by key."""
    extensions = (".ts .tsx .js .jsx .mjs .md .mdx .yml .yaml .json .py .go .rs .java .sh .cpp .css .svg - .TS .d.ts .min.js .test.ts .lock").split()
    folders = ("src", "lib", "core", "docs", "node_modules", "api", "build")
    heads = ("export class A {}\n", 'import x from "y";\nconst a = 1;\n', "/** doc */\nfunction f() {}\n", "# Title\n", "")
    pick = lambda values, n: F.element_at(F.array(*[F.lit("" if v == "-" else v) for v in values]), (F.pmod("doc_id", F.lit(n)) + 1).cast("int"))
    rest = F.pmod("doc_id", F.lit(50))
    name = F.when(rest == 49, "README.md").when(rest == 48, "package.json").otherwise(F.concat(F.lit("f"), F.col("doc_id"), pick(extensions, len(extensions))))
    path = F.concat_ws("/", F.lit("proj"), "source", pick(folders, len(folders)), F.concat(F.lit("d"), F.pmod("doc_id", F.lit(3))), name)
    content = F.concat(pick(heads, len(heads)), F.col("text"))
    out = docs.select("doc_id", path.alias("relative_path"), content.alias("content"))
    return out.withColumn("size", F.octet_length("content").cast("long"))


def strict_json(df: DataFrame, column: str) -> DataFrame:
    """Add `valid`: whether a text is JSON as Python's parser takes it (NaN and repeated keys pass, trailing text doesn't).

    With a column `strict`, texts whose bytes weren't valid UTF-8 aren't valid either.
    """

    @F.pandas_udf("boolean")
    def parses(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool:
            try:
                json.loads(t)
                return True
            except (TypeError, ValueError, RecursionError):
                return False

        return texts.map(one).astype(bool)

    strict = F.col("strict") if "strict" in df.columns else F.lit(True)
    return df.withColumn("valid", parses(F.col(column)) & strict)
