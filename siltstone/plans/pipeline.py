"""The stages audit, graph, cards, chunks and json, from a source tree to the four stores."""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.calls import Caller, Limits
from ..functions.paths import language_support
from ..functions.vectors import Provider, embed, hashed_provider
from ..operators import audit, cards, chunks, fallback, gate, graph, jsonstore
from ..sources import corpus, scip, seek, tree
from ..sources.config import Settings, load_settings, missing_keys, missing_modules

STAGES = ("audit", "graph", "cards", "chunks", "json")
log = logging.getLogger(__name__)
BACKENDS = ("scip", "source")
#: A resumed run rewrites the parts of the card store that so many versions have touched.
COMPACT_VERSIONS = 8


class Refused(Exception):
    """The gate stopped the corpus; nothing was written."""


@dataclass(frozen=True)
class Stores:
    """Where the stores of a project lie."""

    root: str
    manifest = property(lambda self: f"{self.root}/manifest")
    manifest_json = property(lambda self: f"{self.root}/manifest_json")
    manifest_list = property(lambda self: f"{self.root}/manifest_list")
    coverage = property(lambda self: f"{self.root}/coverage")
    graph = property(lambda self: f"{self.root}/graph")
    graph_rejects = property(lambda self: f"{self.root}/graph_rejects")
    cards = property(lambda self: f"{self.root}/cards")
    chunks = property(lambda self: f"{self.root}/chunks")
    card_rejects = property(lambda self: f"{self.root}/card_rejects")
    rejects = property(lambda self: f"{self.root}/rejects")
    json = property(lambda self: f"{self.root}/json")


def wipe(spark: SparkSession, stores: Stores) -> None:
    """Remove all stores of a project: a fresh build then finds nothing stale."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stores.root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_audit(files: DataFrame, stores: Stores, settings: Settings, override: bool = False, ask: Callable[[str], str] | None = None) -> DataFrame:
    """Gate first; then the ranked manifest, as a table, as JSON and as a list of paths."""
    cover = gate.coverage(files)
    decision = gate.decide(cover, override, ask) if not files.limit(1).isEmpty() else gate.Decision(True, "no files")
    if not decision.proceed:
        raise Refused(decision.reason)
    rows = audit.kept(audit.audited(files), settings.min_score)
    rows.write.mode("overwrite").parquet(stores.manifest)
    manifest = files.sparkSession.read.parquet(stores.manifest)
    best = audit.ranked(manifest)
    best.write.mode("overwrite").json(stores.manifest_json)
    best.select("relative_path").write.mode("overwrite").text(stores.manifest_list)
    cover.write.mode("overwrite").parquet(stores.coverage)
    return manifest


def run_graph(spark: SparkSession, index_path: str, manifest: DataFrame, stores: Stores, settings: Settings) -> graph.Graph:
    """A failure is raised: a graph that couldn't be built isn't a success."""
    occurrences, relations = scip.read_scip(spark, index_path)
    built = graph.build(occurrences, relations, manifest, settings.project)
    graph.write(graph.Graph(built.nodes, graph.resolved(built)), stores.graph)
    return graph.read(spark, stores.graph)


def run_cards(
    files: DataFrame, manifest: DataFrame, nodes: DataFrame, stores: Stores, resume: bool = False, by_content: bool = False,
    summarise: cards.Summarise = cards.extractive, provider: Provider = hashed_provider, limits: Limits = Limits(),  # noqa: B008 - a constant
) -> DataFrame:
    """Cards of the manifest's files: a fresh store, or with `resume` those that are missing, with `by_content` also of changed files.

    A resumed run takes out the cards of files that are gone. Files whose bytes aren't valid UTF-8 get none; they and those
    whose summary failed are told in a store of their own.
    """
    spark, store = files.sparkSession, cards.card_store(files.sparkSession, stores.cards)
    wanted = corpus.with_content(manifest.select("relative_path"), files)
    broken = wanted.where(~F.col("strict")) if "strict" in wanted.columns else wanted.limit(0)
    broken.select("relative_path", F.lit("bytes aren't valid UTF-8").alias("error"), F.lit(0).alias("tries")).write.mode("overwrite").parquet(stores.card_rejects)
    wanted = wanted.where("strict") if "strict" in wanted.columns else wanted
    gone, resume = None, resume and store.exists()
    if resume:
        known = store.read()
        wanted, gone = cards.pending(wanted, known, by_content), cards.gone(wanted, known)
    cards.write_cards(cards.build_cards(wanted, nodes, summarise, provider, limits, stores.card_rejects), stores.cards, resume, gone)
    if resume:
        store.compact(COMPACT_VERSIONS)
        store.vacuum()
    return store.read()


def run_chunks(files: DataFrame, manifest: DataFrame, stores: Stores, provider: Provider = hashed_provider) -> DataFrame:
    documents, rejects = chunks.chunk_documents(corpus.with_content(manifest.select("relative_path"), files))
    embed(documents, "page_content", provider).write.mode("overwrite").parquet(stores.chunks)
    rejects.write.mode("overwrite").parquet(stores.rejects)
    return files.sparkSession.read.parquet(stores.chunks)


def run_json(files: DataFrame, manifest: DataFrame, stores: Stores) -> DataFrame:
    rows = manifest.select("relative_path", "score").join(files.select("relative_path", "content", "size", "strict"), "relative_path")
    jsonstore.write_store(jsonstore.store(rows), stores.json)
    return files.sparkSession.read.parquet(stores.json)


def run_source_graph(files: DataFrame, manifest: DataFrame, stores: Stores) -> graph.Graph:
    """A graph from the texts themselves; sources that can't be read are told in a store of their own."""
    made = fallback.build(corpus.with_content(manifest.select("relative_path"), files), stores.graph_rejects)
    graph.write(graph.Graph(made.nodes, graph.resolved(made)), stores.graph)
    return graph.read(files.sparkSession, stores.graph)


def _checked(settings: Settings, index_path: str | None) -> None:
    if settings.graph_backend not in BACKENDS:
        raise ValueError(f"graph_backend is one of {', '.join(BACKENDS)}")
    if settings.graph_backend == "scip" and not index_path:
        raise ValueError("the backend scip needs an index; the backend source does without")


def run_stage(
    spark: SparkSession, settings: Settings, stage: str, index_path: str | None = None, override: bool = False, resume: bool = False, by_content: bool = False
) -> DataFrame:
    """One stage by name, on the stores that the stages before it left. Returns what it wrote, of the graph its nodes.

    The cards can be resumed: then files that have a card, and with `by_content` the same content, keep it.
    """
    if stage not in STAGES:
        raise ValueError(f"{stage} isn't a stage: {', '.join(STAGES)}")
    stores = Stores(settings.store_root)
    files = tree.walk(spark, settings.source_root, settings.project)
    if stage == "audit":
        return run_audit(files, stores, settings, override)
    manifest = spark.read.parquet(stores.manifest)
    if stage == "graph":
        _checked(settings, index_path)
        built = run_graph(spark, index_path, manifest, stores, settings) if settings.graph_backend == "scip" else run_source_graph(files, manifest, stores)
        return built.nodes
    if stage == "cards":
        return run_cards(files, manifest, graph.read(spark, stores.graph).nodes, stores, resume or by_content, by_content)
    return run_chunks(files, manifest, stores) if stage == "chunks" else run_json(files, manifest, stores)


def build(spark: SparkSession, settings: Settings, index_path: str | None = None, override: bool = False, fresh: bool = False) -> Stores:
    """All stages over a source tree. The graph comes from an index, or with the backend `source` from the texts themselves.

    With `fresh` all stores go first, so that nothing stale is left if a stage fails.
    """
    _checked(settings, index_path)
    if fresh:
        wipe(spark, Stores(settings.store_root))
    for stage in STAGES:
        run_stage(spark, settings, stage, index_path, override)
    return Stores(settings.store_root)


def doctor(
    spark: SparkSession, stores: Stores, settings_path: str | None = None, settings: Settings | None = None, index_path: str | None = None, provider: Provider | None = None,
    limits: Limits = Limits(deadline=10.0, retries=0),  # noqa: B008 - a constant
) -> DataFrame:
    """A row per check: `pass` and a store's rows, `warn` for an empty store or settings and modules that are missing, or `fail`.

    With settings also the sources that there are, languages that the gate stops, the graph's backend and its index, and files that got no card; with
    an embedding provider whether it answers in time, and in the dimension of the stored vectors.
    """
    rows = []
    for name in ("manifest", "graph/nodes", "graph/edges", "cards", "chunks", "json"):
        try:
            table = cards.card_store(spark, stores.cards).read() if name == "cards" else spark.read.parquet(f"{stores.root}/{name}")
            n = table.count()
            rows.append((name, "pass" if n else "warn", n))
        except Exception:  # a missing or broken store is what this looks for
            rows.append((name, "fail", None))
    if settings_path is not None:
        for what, missing in (("settings", missing_keys(settings_path)), ("modules", missing_modules())):
            rows.append((f"{what}: {', '.join(missing) or 'all there'}", "warn" if missing else "pass", len(missing)))
    if settings is not None:
        rows += _settings_checks(spark, stores, settings, index_path)
    if provider is not None:
        outcome = Caller(provider, limits).one((["a probe"],))
        found = len(outcome.value[0]) if outcome.error is None else None
        stored = vectors.dimension(cards.card_store(spark, stores.cards).read()) if rows[3][1] == "pass" else None
        said = outcome.error or ("as stored" if stored in (None, found) else f"stored are {stored}")
        rows.append((f"embeddings: {said}", "fail" if outcome.error else "pass" if stored in (None, found) else "fail", found))
    return spark.createDataFrame(rows, "store string, status string, rows long")


def _settings_checks(spark: SparkSession, stores: Stores, settings: Settings, index_path: str | None) -> list[tuple]:
    rows = []

    def check(name: str, look: Callable[[], tuple[str, str, int | None]]) -> None:
        try:
            said, status, n = look()
            rows.append((f"{name}: {said}", status, n))
        except Exception as e:  # what can't be looked at fails
            rows.append((f"{name}: {str(e).splitlines()[0][:80]}", "fail", None))

    def sources() -> tuple[str, str, int]:
        files = tree.walk(spark, settings.source_root, settings.project, content=False)
        n, typed = files.count(), audit.typescript_files(files.withColumn("language", language_support(F.col("relative_path"))["language"]))
        return f"{typed} TypeScript", "pass" if n else "warn", n

    def languages() -> tuple[str, str, int]:
        stopped = [r["language"] for r in gate.blocking(spark.read.parquet(stores.coverage)).collect()]
        return ", ".join(sorted(x or "unknown" for x in stopped)) or "none is stopped", "warn" if stopped else "pass", len(stopped)

    def backend() -> tuple[str, str, None]:
        _checked(settings, index_path)
        return settings.graph_backend, "pass", None

    def index() -> tuple[str, str, int]:
        n = len(seek.listed(spark, index_path))
        return index_path, "pass" if n else "fail", n

    def rejected() -> tuple[str, str, int]:
        n = spark.read.parquet(stores.card_rejects).count()
        return "files without a card of their own", "warn" if n else "pass", n

    for name, look in (("sources", sources), ("languages", languages), ("backend", backend), ("rejects", rejected)):
        check(name, look)
    if settings.graph_backend == "scip" and index_path:
        check("index", index)
    return rows


def tallies(checks: DataFrame) -> DataFrame:
    """How many checks passed, warned and failed."""
    return checks.groupBy("status").agg(F.count("*").alias("n"))


def main(args: list[str]) -> int:
    """`settings.ini STAGE|all|doctor [index] [--resume] [--by-content] [--fresh]`: 0, or 1 if a stage fails or a check does."""
    from ..session import session

    try:
        given, options = [a for a in args if not a.startswith("--")], {a for a in args if a.startswith("--")}
        settings, what, index = load_settings(given[0]), given[1], given[2] if len(given) > 2 else None
        spark = session()
        if what == "doctor":
            found = doctor(spark, Stores(settings.store_root), given[0], settings, index, hashed_provider).collect()
            print("\n".join(f"{r['status']:<6}{r['store']} {'' if r['rows'] is None else r['rows']}" for r in found))
            return int(any(r["status"] == "fail" for r in found))
        if what == "all":
            build(spark, settings, index, fresh="--fresh" in options)
        else:
            run_stage(spark, settings, what, index, resume="--resume" in options, by_content="--by-content" in options)
        return 0
    except Exception:  # whatever a stage raises is told, and the caller stops on the code
        log.exception("failed: %s", " ".join(args))
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
