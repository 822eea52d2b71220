"""File cards: per file a summary and what it defines, embedded, stored incrementally."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calls import Caller, Limits, bounded_tokens
from ..functions.text import summary_prompt
from ..functions.vectors import Provider, embed, hashed_provider
from ..staging import staged
from .versions import Versions

FALLBACK = "No summary could be made for this file."
SECTIONS = (("Class", "Classes", "members"), ("Function", "Functions", "parameters"), ("Interface", "Interfaces", "properties"))
PREVIEW = 5


def children(nodes: DataFrame) -> DataFrame:
    """Nodes that aren't files, per file: `filePath`, `nodes` sorted by line and name. Fields that an index lacks are null."""
    fields = ["line", "name", "type", *[s[2] for s in SECTIONS]]
    rows = nodes.where(~F.col("type").isin("File", "Config")).select(
        "filePath", F.struct(*[F.col(f) if f in nodes.columns else F.lit(None).cast("int").alias(f) for f in fields]).alias("n")
    )
    return rows.groupBy("filePath").agg(F.sort_array(F.collect_list("n")).alias("nodes"))


def card_markdown(path: Column, summary: Column, nodes: Column) -> Column:
    """Title, summary, and a section for the classes, functions and interfaces there are."""
    def section(kind: str, title: str, measure: str) -> Column:
        own = F.filter(nodes, lambda n: n["type"] == kind)
        line = lambda n: F.concat(F.lit("- **"), n["name"], F.lit("**: "), F.coalesce(n[measure], F.lit(0)), F.lit(f" {measure}"))
        body = F.concat(F.lit(f"\n## {title} ("), F.size(own), F.lit(")\n"), F.array_join(F.transform(own, line), "\n"))
        return F.when(F.size(own) > 0, body)

    sections = [section(*s) for s in SECTIONS]
    return F.concat_ws("\n", F.concat(F.lit("# Card: "), path), F.lit("## Purpose"), F.trim(summary), *sections)


def names_of(nodes: Column, kind: str) -> Column:
    return F.transform(F.filter(nodes, lambda n: n["type"] == kind), lambda n: n["name"])


Summarise = Callable[[str, str], str]


def extractive(path: str, code: str) -> str:
    """The default summary, without a model: the first words of the first comment or prose line that has some."""
    for raw in code.splitlines()[:400]:
        line = raw.strip().lstrip("/*#- ").strip()
        if len(line) > 20:
            return line[:300]
    return f"{path.rsplit('/', 1)[-1]}: {len(code.splitlines())} lines."


def summaries(files: DataFrame, summarise: Summarise = extractive, limits: Limits = Limits()) -> DataFrame:  # noqa: B008 - a constant
    """Add `prompt`, `summary`, `error` and `tries`; a file whose summary fails gets a fallback and the error, the others go on.

    A task makes a few calls at a time. A call that hangs costs its deadline; after some that hang in a row, a task calls no more, so that a
    server that is down doesn't hold up the stage. Code is cut to the tokens that a call may have.
    """
    asked = files.withColumn("prompt", summary_prompt(F.col("relative_path"), F.col("content")))
    schema = T.StructType([*asked.schema.fields, T.StructField("summary", T.StringType()), T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(summarise, limits)
        for batch in batches:
            paths, codes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("relative_path", "content"))
            made = list(caller.all([(p or "", bounded_tokens(c or "", limits.max_tokens)) for p, c in zip(paths, codes, strict=True)]))
            texts = [FALLBACK if o.error is not None or o.value is None else str(o.value) for o in made]
            columns = [pa.array(texts, pa.string()), pa.array([o.error for o in made], pa.string()), pa.array([o.tries for o in made], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return asked.mapInArrow(run, schema)


def build_cards(
    files: DataFrame, nodes: DataFrame, summarise: Summarise = extractive, provider: Provider = hashed_provider, limits: Limits = Limits(), rejects: str | None = None,  # noqa: B008
) -> DataFrame:
    """Cards of files (`relative_path`, `content`). The id is a hash of the path: in a card store a file's card takes the place of the one before.

    With `rejects`, files whose summary failed are added to that table, with `error` and `tries`; summaries are then made once and staged.
    """
    own = children(nodes).withColumnRenamed("filePath", "relative_path")
    made = summaries(files.select("relative_path", "content"), summarise, limits)
    if rejects is not None:
        made = staged(made, "summaries")
        made.where("error IS NOT NULL").select("relative_path", "error", "tries").write.mode("append").parquet(rejects)
    rows = made.join(own, "relative_path", "left")
    found = F.coalesce("nodes", F.array().cast(own.schema["nodes"].dataType))
    cards = rows.select(
        F.sha2("relative_path", 256).alias("id"), "relative_path", "summary", card_markdown(F.col("relative_path"), F.col("summary"), found).alias("card_md"),
        names_of(found, "Class").alias("main_classes"), names_of(found, "Function").alias("main_functions"), F.sha2("content", 256).alias("content_hash"),
    )
    return embed(cards, "card_md", provider, limits=limits)


def pending(files: DataFrame, existing: DataFrame, by_content: bool = False) -> DataFrame:
    """Files that have no card yet; with `by_content` also those whose content has changed. A card without a vector is none."""
    keys = ["relative_path"]
    if "embedding" in existing.columns:
        existing = existing.where(F.col("embedding").isNotNull())
    if by_content:
        files = files.withColumn("content_hash", F.sha2("content", 256))
        keys.append("content_hash")
    return files.join(existing.select(*keys).distinct(), keys, "left_anti").drop("content_hash")


def preview(cards: DataFrame, n: int = PREVIEW) -> DataFrame:
    """Cards with the first numbers of their vectors, for a look."""
    return cards.withColumn("embedding", F.slice("embedding", F.lit(1), F.lit(n)))


def card_store(spark: SparkSession, path: str) -> Versions:
    """The store of cards at a path, one per id."""
    return Versions(spark, path, "id")


def gone(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids of cards whose files aren't there any more."""
    return existing.select("id", "relative_path").join(files.select("relative_path").distinct(), "relative_path", "left_anti").select("id")


def write_cards(cards: DataFrame, path: str, resume: bool = False, gone: DataFrame | None = None, token: str | None = None) -> int:
    """A fresh store; or with `resume` cards that take the place of those of their files, without the ids of `gone`. Returns the store's version.

    `pending` tells which are missing. Cards whose embedding failed aren't stored, so that a resumed run makes them again. A version counts
    once it is whole: a run that is killed leaves the store as it was, and of a token only the first run counts.
    """
    store, whole = card_store(cards.sparkSession, path), cards.where(F.col("embedding").isNotNull())
    if resume:
        return store.upsert(whole, gone, token)
    version = store.replace(whole, token)
    store.vacuum()
    return version
