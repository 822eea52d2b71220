"""Coverage of languages, and the gate that refuses a corpus before anything is written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import STATUS_ORDER, language_support

BLOCKING = ("UNSUPPORTED", "EXPERIMENTAL")
EXAMPLES = 5
YES = ("o", "oui", "y", "yes")


def coverage(files: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Files per status and language with their first paths, in the order of statuses, then largest first.

    Examples are the least paths of a group; each task keeps no more than are asked for before any are shuffled.
    """
    rows = files.withColumn("_s", language_support(F.col("relative_path"))).select("relative_path", "_s.status", "_s.language")
    counts = rows.groupBy("status", "language").agg(F.count("*").alias("count"))
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("status", "language").orderBy("relative_path"))).where(F.col("_n") <= examples)
    shown = first.groupBy(F.col("status").alias("_s"), F.col("language").alias("_l")).agg(F.sort_array(F.collect_list("relative_path")).alias("examples"))
    out = counts.join(shown, (F.col("status") == F.col("_s")) & F.col("language").eqNullSafe(F.col("_l"))).drop("_s", "_l")
    order = F.array(*[F.lit(s) for s in STATUS_ORDER])
    return out.orderBy(F.array_position(order, F.col("status")), F.desc("count"), F.coalesce("language", F.lit("")))


def blocking(cover: DataFrame) -> DataFrame:
    return cover.where(F.col("status").isin(*BLOCKING))


def indexed(cover: DataFrame) -> DataFrame:
    """Number of files, and the languages that are indexed, sorted."""
    languages = F.sort_array(F.collect_set(F.when(F.col("status") == "VALIDATED", F.col("language"))))
    return cover.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("files"), F.array_join(languages, ",").alias("languages"))


@dataclass(frozen=True)
class Decision:
    proceed: bool
    reason: str


def decide(cover: DataFrame, override: bool = False, ask: Callable[[str], str] | None = None) -> Decision:
    """Go if nothing blocks, on override, or on a yes; else stop. What comes to the driver is one row per language."""
    found = blocking(cover).select(F.coalesce("language", F.lit("?")).alias("language"), "count").collect()
    if not found:
        return Decision(True, "nothing blocks")
    what = ", ".join(f"{r['language']} ({r['count']})" for r in found)
    if override:
        return Decision(True, f"overridden: {what}")
    if ask is not None and ask(f"Not supported: {what}. Go on without them? ").strip().lower() in YES:
        return Decision(True, f"accepted: {what}")
    return Decision(False, f"not supported: {what}")


def rendered(cover: DataFrame) -> str:
    """The coverage matrix as text."""
    rows = cover.collect()
    lines = [f"{'status':<13}{'language':<13}{'files':>8}  examples"]
    lines += [f"{r['status']:<13}{r['language'] or '-':<13}{r['count']:>8}  {', '.join(r['examples'])}" for r in rows]
    return "\n".join(lines)
