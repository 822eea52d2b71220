"""Questions to the stores: four bounded lookups. `plans.loop` puts them together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import bounded, prefixed_query
from ..functions.vectors import Provider, hashed_provider
from ..operators import graph, jsonstore, search
from ..operators.cards import card_store
from .pipeline import Stores

CARD_RESULTS, CARD_CHARS = 3, 700
CHUNK_RESULTS, CHUNK_CHARS = 4, 800
GRAPH_CHARS, JSON_CHARS = 1500, 600
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
TOOLS = ("cards", "chunks", "relations", "json")


@dataclass
class Lookups:
    """Lookups on the stores of a project. Stores are opened when first asked."""

    spark: SparkSession
    stores: Stores
    provider: Provider = hashed_provider
    query_prefix: str = ""
    memory: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    def _vector(self, question: str) -> list[float]:
        return self.provider([prefixed_query(question, self.query_prefix)])[0]

    def cards(self, question: str, k: int = CARD_RESULTS) -> list[tuple[str, str]]:
        """The closest file cards: (path, text)."""
        table = card_store(self.spark, self.stores.cards).read()
        rows = search.nearest(table, self._vector(question), k, "relative_path")
        return [tuple(r) for r in rows.select("relative_path", bounded(F.col("card_md"), CARD_CHARS)).collect()]

    def chunks(self, question: str, files: list[str] | None = None, k: int = CHUNK_RESULTS, metric: str = "cosine") -> list[tuple[str, int, str]]:
        """The closest chunks, of the given files only if any are given: (path, first line, text)."""
        table = self.spark.read.parquet(self.stores.chunks).withColumn("_key", F.concat_ws("\x1f", "source_file", "hierarchical_name"))
        rows = search.nearest(table, self._vector(question), k, "_key", metric=metric, where=search.in_files(files))
        return [tuple(r) for r in rows.select("source_file", "start_line", bounded(F.col("page_content"), CHUNK_CHARS)).collect()]

    def names(self, question: str) -> list[str]:
        """Identifiers of a question that name a node of the graph."""
        asked = self.spark.createDataFrame([(question,)], "q string").select(F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(NAME), F.lit(0)))).alias("name"))
        nodes = graph.read(self.spark, self.stores.graph).nodes
        return sorted(r["name"] for r in asked.join(nodes, "name", "left_semi").collect())

    def relations(self, question: str) -> str:
        """What the entities named in a question are related to."""
        names = self.names(question)
        if not names:
            return "The question names no entity of the graph."
        rows = graph.neighbours(graph.read(self.spark, self.stores.graph), names).collect()
        text = "\n".join(f"{r['type']} {r['name']} | out: {', '.join(r['out'])} | in: {', '.join(r['into'])}" for r in rows)
        return text if len(text) <= GRAPH_CHARS else text[:GRAPH_CHARS] + " […]"

    def json(self, wanted: str) -> list[tuple[str, str]]:
        rows = jsonstore.search(self.spark.read.parquet(self.stores.json), wanted)
        return [tuple(r) for r in rows.select("relative_path", bounded(F.col("content"), JSON_CHARS)).collect()]

    def run(self, tool: str, argument: str, files: list[str] | None = None) -> tuple[str, list[str]]:
        """What a lookup says, as a text, and the files that it names."""
        if tool == "cards":
            found = self.cards(argument)
            return "\n\n".join(f"# {path}\n{text}" for path, text in found), [path for path, _ in found]
        if tool == "chunks":
            rows = self.chunks(argument, files)
            return "\n\n".join(f"--- {path} (line {line}) ---\n{text}" for path, line, text in rows), [path for path, *_ in rows]
        if tool == "relations":
            return self.relations(argument), []
        if tool == "json":
            rows = self.json(argument)
            return "\n\n".join(f"--- {path} ---\n{text}" for path, text in rows), [path for path, _ in rows]
        raise ValueError(f"{tool} isn't a lookup: {', '.join(TOOLS)}")

    def ask(self, question: str, thread: str = "default") -> str:
        """A question by the plan that needs no model; see `plans.loop`. Answers are kept by thread."""
        from .loop import Loop

        answer = Loop(self).ask(question, thread).answer
        self.memory.setdefault(thread, []).extend([("user", question), ("assistant", answer)])
        return answer
