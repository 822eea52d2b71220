"""The relationship graph: nodes and edges out of symbol occurrences, statistics, neighbourhoods.

Occurrences are rows (doc, ord, relative_path, symbol, roles, range, enclosing); relations are rows (relative_path, ord, source,
target, is_implementation). `doc` and `ord` give the order in which an index lists them.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import canonical, name_of
from ..functions.symbols import full_range, is_definition, parsed_symbol, span
from ..sources.jsonarray import read_array
from ..staging import staged

NODE_TYPES = ("File", "Class", "Interface", "Function", "Method", "Config")
EDGE_TYPES = ("CALLS", "DEFINED_IN", "USES", "IMPLEMENTS", "INHERITS")


@dataclass(frozen=True)
class Graph:
    """`closed`: by the way it was made, every end of an edge is a node."""

    nodes: DataFrame
    edges: DataFrame
    closed: bool = False


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def innermost(references: DataFrame, containers: DataFrame, file: str = "file", exclude_self: bool = True) -> DataFrame:
    """Each reference with the smallest container of its file around it, the first listed on a tie; others drop out.

    `references`: file, ref, line, col, target. `containers`: file, ord, symbol, r (a full range). Both are sorted by file and
    position and swept once: a container is open from its first position to its last, and a reference takes the smallest open one that
    isn't its own target. Nothing is repeated, and what is held is what is open, however long a file is. Rows without a position,
    and references without a file, drop out. Targets are compared with symbols as texts. `ord` is a
    number or a struct of numbers. References that repeat as a whole are one.
    """
    position = lambda line, col: (F.col(line).alias("line"), F.col(col).alias("col"))
    kind, order = containers.schema["symbol"].dataType, containers.schema["ord"].dataType
    listed = F.array(*[(F.col(f"ord.{n}") if isinstance(order, T.StructType) else F.col("ord")).cast("long") for n in (order.names if isinstance(order, T.StructType) else ["ord"])])
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("el", "int"), ("ec", "int"), ("span", "long"), ("symbol", kind))]
    opened = containers.select(
        F.col(file).alias("file"), *position("r.sl", "r.sc"), F.col("r.el").alias("el"), F.col("r.ec").alias("ec"), span(F.col("r")).alias("span"), "symbol",
        listed.alias("ord"), F.lit(None).cast(T.StructType(references.schema.fields)).alias("ref"), F.lit(None).cast("string").alias("own"),
    )
    asked = references.select(
        F.col(file).alias("file"), *position("line", "col"), *blank, F.lit(None).cast("array<long>").alias("ord"), F.struct(*[F.col(c) for c in references.columns]).alias("ref"),
        F.col("target").cast("string").alias("own"),
    )
    rows = opened.unionByName(asked).where(F.col("file").isNotNull() & F.col("line").isNotNull() & F.col("col").isNotNull())
    # by a hash, not by the file itself: where both sides are dealt by file already, adaptive execution drops the repartition and
    # then coalesces the sides apart. A container that opens at a reference's position is around it, so it comes first
    swept = rows.repartition(F.xxhash64("file")).withColumn("mark", F.xxhash64("ref")).sortWithinPartitions("file", "line", "col", F.col("ref").isNotNull(), "mark")
    schema = T.StructType([*references.schema.fields, T.StructField("container", kind)])
    text = F.col("symbol").cast("string").alias("text")
    return swept.select("file", "line", "col", "el", "ec", "span", "symbol", text, "own", "ord", "mark", "ref").mapInArrow(_swept(schema, exclude_self), schema)


def _swept(schema: T.StructType, exclude_self: bool):
    """Rows sorted by file and position, containers before references, to references with the container around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ = None, []  # what is open, the smallest first and the first listed of equals: (span, ord, arrival, el, ec, symbol, text)
        arrived, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = [batch.column(i).to_pylist() for i in range(11)]
            is_ref = batch.column(11).is_valid().to_pylist()
            at, found = [], []
            for i, (of, line, col, el, ec, width, symbol, text, own, order, mark) in enumerate(zip(*place, strict=True)):
                if of != file:
                    file, open_, last = of, [], None
                if not is_ref[i]:
                    if el is not None and ec is not None and (el, ec) >= (line, col):
                        insort(open_, (width, order, arrived, el, ec, symbol, text))
                        arrived += 1
                    continue
                if (line, col, mark) == last:
                    continue
                last, chosen, ended = (line, col, mark), None, []
                for j, (_, _, _, last_line, last_col, name, known) in enumerate(open_):
                    if (last_line, last_col) < (line, col):
                        ended.append(j)
                    elif not exclude_self or known != own:
                        chosen = (name,)
                        break
                for j in reversed(ended):
                    del open_[j]
                if chosen is not None:
                    at.append(i)
                    found.append(chosen[0])
            if at:
                refs = batch.column(11).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*refs.flatten(), pa.array(found, batch.column(6).type)], names=schema.names)

    return run


def build(occurrences: DataFrame, relations: DataFrame, manifest: DataFrame, project: str, implied_inheritance: bool = False) -> Graph:
    """Nodes and edges of the files in a manifest (`relative_path`, with the project before it).

    In TypeScript indexes every target of an implementation is an Interface, unless `implied_inheritance` asks for
    those that are classes by their own definition to stay classes; in other languages none is.
    """
    scope = manifest.select("relative_path").distinct()
    occurrences = staged(occurrences, "occurrences")  # read for the scheme, definitions, containers and references
    placed = occurrences.withColumn("file", canonical(F.lit(project), F.col("relative_path"))).drop("relative_path")
    scheme = occurrences.where(F.col("symbol").isNotNull() & (F.col("symbol") != "") & ~F.col("symbol").startswith("local "))
    scheme = scheme.select(F.min_by(F.element_at(F.split("symbol", " "), 1), F.struct("doc", "ord")).alias("scheme"))
    inside = placed.join(scope, placed["file"] == scope["relative_path"], "left_semi").withColumn("r", full_range(F.col("range"))).withColumn("e", full_range(F.col("enclosing")))
    definitions = inside.where(is_definition(F.col("roles"))).withColumn("p", parsed_symbol(F.col("symbol"))).where(F.col("p.kind").isin("TYPE", "METHOD", "FUNCTION"))
    symbols = first_rows(definitions, ["symbol"], ["doc", "ord"]).select("symbol", "p.kind", "p.name", "p.owner", "file", (F.col("r.sl") + 1).alias("line"), "doc", "ord")
    symbols = staged(symbols, "symbols")
    related = relations.withColumn("file", canonical(F.lit(project), F.col("relative_path"))).where("is_implementation")
    related = related.join(scope.withColumnRenamed("relative_path", "file"), "file", "left_semi")
    targets = related.select(F.col("target").alias("symbol")).distinct().crossJoin(scheme).where(F.col("scheme") == "scip-typescript").select("symbol", F.lit(True).alias("target"))
    if implied_inheritance:
        heirs = related.select(F.col("source").alias("symbol")).distinct()
        targets = targets.join(heirs, "symbol", "left_anti")
    labelled = symbols.join(targets, "symbol", "left")
    label = F.when(F.col("kind") == "METHOD", "Method").when(F.col("kind") == "FUNCTION", "Function").when(F.col("target"), "Interface").otherwise("Class")
    labelled = labelled.withColumn("type", label)
    file_name = name_of(F.col("relative_path"))
    files = scope.select(
        F.concat_ws("::", F.lit("File"), file_name, "relative_path").alias("id"), file_name.alias("name"), F.col("relative_path").alias("filePath"),
        F.lit(0).alias("line"), F.lit("File").alias("type"),
    )
    nodes = files.unionByName(labelled.select(F.col("symbol").alias("id"), "name", F.col("file").alias("filePath"), "line", "type"))

    known = symbols.select("symbol")
    none = F.lit(None).cast("int")
    owned = symbols.select(F.col("symbol").alias("source"), F.col("owner").alias("target"), "doc", "ord").join(known.withColumnRenamed("symbol", "target"), "target", "left_semi")
    owned = owned.select("source", "target", F.lit("DEFINED_IN").alias("type"), none.alias("callLine"), none.alias("refLine"), F.lit(0).alias("rule"), "doc", "ord")
    kept = related.join(known.withColumnRenamed("symbol", "source"), "source", "left_semi").join(known.withColumnRenamed("symbol", "target"), "target", "left_semi")
    kept = kept.join(labelled.select(F.col("symbol").alias("target"), F.col("target").alias("is_interface")), "target", "left")
    implied = kept.select(
        "source", "target", F.when(F.coalesce("is_interface", F.lit(False)), "IMPLEMENTS").otherwise("INHERITS").alias("type"),
        none.alias("callLine"), none.alias("refLine"), F.lit(1).alias("rule"), "doc", "ord",
    )
    containers = inside.where(is_definition(F.col("roles")) & F.col("e").isNotNull()).join(known, "symbol", "left_semi").select("file", F.struct("doc", "ord").alias("ord"), "symbol", F.col("e").alias("r"))
    references = inside.where(~is_definition(F.col("roles"))).join(symbols.select("symbol", "kind"), "symbol").select(
        "file", F.struct("doc", "ord").alias("ref"), F.col("r.sl").alias("line"), F.col("r.sc").alias("col"), F.col("symbol").alias("target"), "kind"
    )
    used = innermost(references, containers)
    called = F.col("kind").isin("METHOD", "FUNCTION")
    used = used.select(
        F.col("container").alias("source"), "target", F.when(called, "CALLS").otherwise("USES").alias("type"), F.when(called, F.col("line") + 1).alias("callLine"),
        F.when(~called, F.col("line") + 1).alias("refLine"), F.lit(2).alias("rule"), F.col("ref.doc").alias("doc"), F.col("ref.ord").alias("ord"),
    )
    edges = owned.unionByName(implied).unionByName(used)
    identity = F.concat(F.lit("e_"), F.substring(F.sha2(F.concat_ws("\x1f", "rule", "doc", "ord", "source", "target"), 256), 1, 16))
    return Graph(nodes, edges.select(identity.alias("id"), "source", "target", "type", "callLine", "refLine"))


def resolved(graph: Graph) -> DataFrame:
    """Edges both of whose ends are nodes."""
    if graph.closed:
        return graph.edges
    ids = graph.nodes.select("id").distinct()
    edges = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def file_nodes(graph: Graph) -> DataFrame:
    """File nodes by path."""
    return graph.nodes.where(F.col("type") == "File").orderBy("filePath")


def statistics(graph: Graph, documents: int | None = None) -> DataFrame:
    """Counts of documents, nodes and edges in all and by type, as one row."""
    count = lambda kinds, what: [F.count_if(F.col("type") == k).alias(f"{what}_{k.lower()}") for k in kinds]
    nodes = graph.nodes.agg(F.count("*").alias("nodes_total"), *count(NODE_TYPES[:5], "nodes"))
    edges = graph.edges.agg(F.count("*").alias("edges_total"), *count(EDGE_TYPES, "edges"))
    files = F.col("nodes_file") if documents is None else F.lit(documents).cast("long")
    return nodes.crossJoin(edges).withColumn("documents", files)  # one row each


def neighbours(graph: Graph, names: DataFrame | list[str], collected: int = 6, shown: int = 5, limit: int = 15) -> DataFrame:
    """For nodes of the given names, by name and type: the first distinct outgoing and incoming relations.

    Either direction is aggregated on its own, so a node with many of both doesn't multiply them.
    """
    if isinstance(names, list):
        names = graph.nodes.sparkSession.createDataFrame([(n,) for n in names], "name string")
    picked = graph.nodes.join(names.select("name").distinct(), "name", "left_semi").select("id", "name", "type")
    ends = graph.nodes.select(F.col("id").alias("end"), F.col("name").alias("end_name"))

    def side(own: str, other: str, relation: Column, into: str) -> DataFrame:
        rows = graph.edges.select(F.col(own).alias("id"), F.col(other).alias("end"), F.col("type").alias("edge"))
        met = picked.join(rows, "id").join(ends, "end", "left").select("name", "type", relation.alias("relation")).distinct()
        first = met.withColumn("_n", F.row_number().over(W.partitionBy("name", "type").orderBy("relation"))).where(F.col("_n") <= collected)
        return first.groupBy("name", "type").agg(F.sort_array(F.collect_list("relation")).alias(into))

    end_name = F.coalesce("end_name", F.lit(""))
    out = side("source", "target", F.concat("edge", F.lit("->"), end_name), "out")
    into = side("target", "source", F.concat(end_name, F.lit("->"), "edge"), "into")
    empty = F.array().cast("array<string>")
    rows = picked.select("name", "type").distinct().join(out, ["name", "type"], "left").join(into, ["name", "type"], "left")
    rows = rows.orderBy("name", "type").limit(limit)
    named = lambda c, bad: F.slice(F.filter(F.coalesce(c, empty), bad), F.lit(1), F.lit(shown))
    return rows.select("name", "type", named(F.col("out"), lambda x: ~x.endswith("->")).alias("out"), named(F.col("into"), lambda x: ~x.startswith("->")).alias("into"))


def write(graph: Graph, path: str) -> None:
    """Overwrite the graph store: two tables, each partitioned by type. Node ids must be unique."""
    repeated = graph.nodes.groupBy("id").count().where("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"node ids repeat: {[r['id'] for r in repeated]}")
    graph.nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read(spark, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def export_json(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.write.mode("overwrite").json(f"{path}/edges")


def read_json(spark, path: str) -> Graph:
    """A graph from one JSON document with `nodes` and `edges` arrays, which several tasks read."""
    return Graph(read_array(spark, path, array="nodes"), read_array(spark, path, array="edges"))
