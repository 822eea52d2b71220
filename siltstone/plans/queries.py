"""The registered queries of the engine's own operators, and the DuckDB SQL that each is held against.

File operators run on a corpus derived from `documents`; graph operators on one derived from orders and customers;
containment on events. Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, symbols, text
from ..operators import audit, cards, chunks, fallback, gate, graph, jsonstore, search
from ..operators.trigrams import TrigramIndex
from ..operators.vectorindex import VectorIndex
from ..operators.versions import Versions
from ..sources import corpus
from ..staging import staged_folder

QUESTION = 0  # the vector that searches ask for


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.from_documents(_t(spark, sf_dir, "documents"))


FILES_CTE = """
files AS (
  SELECT doc_id, 'proj/' || source || '/' || (['src', 'lib', 'core', 'docs', 'node_modules', 'api', 'build'])[doc_id % 7 + 1] || '/d' || (doc_id % 3) || '/' ||
    CASE doc_id % 50 WHEN 49 THEN 'README.md' WHEN 48 THEN 'package.json' ELSE 'f' || doc_id ||
      (['.ts', '.tsx', '.js', '.jsx', '.mjs', '.md', '.mdx', '.yml', '.yaml', '.json', '.py', '.go', '.rs', '.java', '.sh', '.cpp', '.css', '.svg', '',
        '.TS', '.d.ts', '.min.js', '.test.ts', '.lock'])[doc_id % 24 + 1] END AS relative_path,
    (['export class A {}' || chr(10), 'import x from "y";' || chr(10) || 'const a = 1;' || chr(10), '/** doc */' || chr(10) || 'function f() {}' || chr(10),
      '# Title' || chr(10), ''])[doc_id % 5 + 1] || text AS content FROM documents),
sized AS (SELECT *, octet_length(encode(content))::BIGINT AS size FROM files),
named AS (SELECT *, split_part(relative_path, '/', -1) AS file_name, lower(regexp_extract(relative_path, '[^/](\\.[^./]*)$', 1)) AS ext,
  regexp_extract(relative_path, '[^/](\\.[^./]*)$', 1) AS suffix FROM sized),
kinds AS (SELECT *,
  CASE WHEN ext IN ('.ts', '.tsx') THEN 'typescript' WHEN ext IN ('.js', '.jsx', '.mjs') THEN 'javascript' WHEN ext = '.py' THEN 'python' WHEN ext = '.go' THEN 'go'
    WHEN ext = '.rs' THEN 'rust' WHEN ext = '.java' THEN 'java' WHEN ext = '.sh' THEN 'bash' WHEN ext = '.cpp' THEN 'cpp' END AS language,
  CASE WHEN ext IN ('.ts', '.tsx', '.js', '.jsx', '.mjs') THEN 'VALIDATED' WHEN ext IN ('.py', '.go', '.rs', '.java', '.sh', '.cpp') THEN 'UNSUPPORTED'
    WHEN ext IN ('.md', '.mdx', '.yml', '.yaml') THEN 'TEXT' WHEN ext = '.json' THEN 'CONFIG' ELSE 'IGNORED' END AS support_status,
  CASE WHEN ext IN ('.ts', '.tsx', '.js', '.jsx', '.mjs') THEN 'CODE' WHEN ext IN ('.md', '.mdx', '.yml', '.yaml') THEN 'TEXT' WHEN ext = '.json' THEN 'CONFIG'
    ELSE 'UNKNOWN' END AS category,
  file_name IN ('package.json', 'tsconfig.json', 'webpack.config.js', 'vite.config.ts', 'next.config.js', 'README.md') AS important FROM named),
valid AS (SELECT * FROM kinds WHERE CASE WHEN important THEN size < 1000000 ELSE
  suffix IN ('.ts', '.tsx', '.js', '.jsx', '.mjs', '.md', '.mdx', '.json', '.yaml', '.yml')
  AND NOT regexp_matches(file_name, '\\.(min|bundle|chunk)\\.js$|\\.min\\.css$|\\.(test|spec)\\.ts$|\\.lock$|^package-lock\\.json$|^yarn\\.lock$')
  AND size > 0 AND size <= 500000 END),
heads AS (SELECT *, left(content, 5000) AS head FROM valid),
marks AS (SELECT *, length(head) - length(replace(head, chr(10), '')) AS lines, contains(head, 'export ') AS exports,
  contains(head, '/**') OR contains(head, '@param') OR contains(head, '@returns') OR contains(head, '@example') OR contains(head, '# ') AS documented,
  least(5, len(list_filter(['class ', 'interface ', 'type ', 'enum ', 'function ', 'const ', 'let ', 'import ', 'require('], lambda k: contains(head, k)))) AS keywords,
  list_has_any(string_split(relative_path, '/')[:-2], ['src', 'lib', 'core', 'api', 'components', 'utils']) AS core FROM heads),
audit AS (SELECT *, (CASE WHEN exports THEN 3 ELSE 0 END + CASE WHEN documented THEN 2 ELSE 0 END + keywords + CASE WHEN lines > 10 AND lines < 1000 THEN 1 ELSE 0 END
  + CASE WHEN important THEN 5 ELSE 0 END + CASE WHEN core THEN 2 ELSE 0 END)::INT AS score,
  concat_ws(',', CASE WHEN exports THEN 'exports' END, CASE WHEN documented THEN 'documented' END, CASE WHEN important THEN 'critical_config' END,
    CASE WHEN core THEN 'core_directory' END) AS reasons FROM marks),
manifest AS (SELECT * FROM audit WHERE score >= 5 OR relative_path LIKE '%README.md')"""


def _sql(body: str, ctes: str = FILES_CTE) -> str:
    return f"WITH {ctes}\n{body}"


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("relative_path")
    out = _files(spark, sf_dir).withColumn("s", paths.language_support(path))
    return out.select(
        "doc_id", "relative_path", paths.ext_of(path).alias("ext"), paths.classify(path).alias("category"), "s.language", F.col("s.status").alias("support_status"),
        paths.provider_for_path(path).alias("provider"),
    )


def excluded_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy(corpus.excluded_dir(F.col("relative_path")).alias("excluded")).agg(F.count("*").alias("files"))


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.coverage(_files(spark, sf_dir)).withColumn("examples", F.array_join("examples", ","))


def gate_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.blocking(gate.coverage(_files(spark, sf_dir))).select("status", "language", "count")


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = gate.decide(gate.coverage(_files(spark, sf_dir)))
    return spark.createDataFrame([(decision.proceed,)], "proceed boolean")


def indexed_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.indexed(gate.coverage(_files(spark, sf_dir)))


def valid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return files.where(audit.valid_file(F.col("relative_path"), F.col("size"))).select("doc_id", "relative_path", "size")


def audit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.audited(_files(spark, sf_dir))
    return rows.select("doc_id", "relative_path", "score", F.array_join("reasons", ",").alias("reasons"), F.col("lines").cast("long").alias("lines"))


def ranked_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = audit.ranked(audit.kept(audit.audited(_files(spark, sf_dir))))
    return best.select("relative_path", "score", "category", "language", "support_status", "size")


def manifest_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ranked(audit.kept(audit.audited(_files(spark, sf_dir))), audit.REPORT_ROWS).select("relative_path", "score")


def manifest_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ranked(audit.kept(audit.audited(_files(spark, sf_dir))), audit.VIEW_ROWS).select("relative_path", "score")


def dir_top10_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_directory(audit.audited(_files(spark, sf_dir)))


def ext_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_extension(audit.audited(_files(spark, sf_dir)))


def dir_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_directory(audit.audited(_files(spark, sf_dir)), level=2)


def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.totals(audit.audited(_files(spark, sf_dir)))


def primary_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.primary_language(audit.audited(_files(spark, sf_dir)))


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_t(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUESTION).first()["embedding"])


def cards_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.nearest(_t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 3, "vec_id")
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


def chunks_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.nearest(_t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 4, "vec_id", metric="l2", where=F.col("label").isin(1, 3, 5))
    return out.select("vec_id", F.round("similarity", 4).alias("distance"))


def vector_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cards.preview(_t(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def _json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.pmod("event_id", F.lit(7)) == 0
    return _t(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("proj/Events/e"), F.pmod("event_id", F.lit(5000)), F.when(F.pmod("event_id", F.lit(3)) == 0, ".json").otherwise(".txt")).alias("relative_path"),
        F.when(bad, F.concat("props", F.lit(" x"))).otherwise(F.col("props")).alias("content"), F.octet_length("props").cast("long").alias("size"),
    )


JSON_CTE = """
jf AS (SELECT event_id, 'proj/Events/e' || (event_id % 5000) || CASE WHEN event_id % 3 = 0 THEN '.json' ELSE '.txt' END AS relative_path,
  CASE WHEN event_id % 7 = 0 THEN props || ' x' ELSE props END AS content, octet_length(encode(props))::BIGINT AS size FROM events),
js AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY event_id) AS n FROM jf
  WHERE relative_path LIKE '%.json' AND json_valid(content)) WHERE n = 1)"""


def json_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jsonstore.store(_json_files(spark, sf_dir), "event_id")
    return out.select("relative_path", "content", "score", F.round("size_kb", 6).alias("size_kb"))


def json_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonstore.search(jsonstore.store(_json_files(spark, sf_dir), "event_id"), "EVENTS/E12").select("relative_path")


def _graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """Customers as classes, orders as their methods, nations as files; an order uses the supplier's nation of none."""
    customers, orders = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    classes = customers.select(name("c", "c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("file"), F.col("c_mktsegment").alias("name"), F.lit("Class").alias("type"))
    methods = orders.select(name("o", "o_orderkey").alias("id"), F.lit(None).cast("string").alias("file"), F.col("o_orderpriority").alias("name"), F.lit("Method").alias("type"))
    files = _t(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("id"), name("n", "n_nationkey").alias("file"), F.col("n_name").alias("name"), F.lit("File").alias("type"))
    nodes = classes.unionByName(methods).unionByName(files).withColumnRenamed("file", "filePath")
    defined = orders.select(name("o", "o_orderkey").alias("source"), name("c", "o_custkey").alias("target"), F.lit("DEFINED_IN").alias("type"))
    uses = customers.select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"), F.lit("USES").alias("type"))
    calls = orders.select(name("o", "o_orderkey").alias("source"), F.concat(F.lit("o"), F.col("o_orderkey") + 40).alias("target"), F.lit("CALLS").alias("type"))
    return graph.Graph(nodes, defined.unionByName(uses).unionByName(calls))


GRAPH_CTE = """
nodes AS (
  SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS filePath, c_mktsegment AS name, 'Class' AS type FROM customer
  UNION ALL SELECT 'o' || o_orderkey, NULL, o_orderpriority, 'Method' FROM orders
  UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, n_name, 'File' FROM nation),
edges AS (
  SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target, 'DEFINED_IN' AS type FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'USES' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'o' || (o_orderkey + 40), 'CALLS' FROM orders)"""


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved(_graph(spark, sf_dir)).select("source", "target", "type")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).nodes.select("id", "name", "type")


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.statistics(_graph(spark, sf_dir))


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.neighbours(_graph(spark, sf_dir), ["BUILDING", "1-URGENT", "FRANCE", "NATION_6", "nobody"])
    return out.select("name", "type", F.array_join("out", ",").alias("out"), F.array_join("into", ",").alias("into"))


def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_nodes(_graph(spark, sf_dir)).select("filePath", "name")


def _index(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """The graph of an index made of the sales tables: a document and class per customer, a method or function per order, references per line.

    Some documents aren't in the manifest, some orders have no definition, places collide, and some symbols are local.
    """
    head = lambda key: F.concat(F.lit("scip-typescript npm shop 1.0 src/`c"), key, F.lit(".ts`/"))
    class_of = lambda key: F.concat(head(key), F.lit("C"), key, F.lit("#"))
    path_of = lambda key: F.concat(F.lit("src/c"), key, F.lit(".ts"))
    ints = lambda *v: F.array(*[(F.lit(x) if isinstance(x, int) else x).cast("int") for x in v])
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ck"))
    at = 10 * F.pmod("ok", F.lit(997)) + 1
    called = F.when(F.pmod("ok", F.lit(11)) == 0, F.concat(head(F.col("ck")), F.lit("f"), "ok", F.lit("()."))).otherwise(F.concat(class_of(F.col("ck")), F.lit("o"), "ok", F.lit("().")))
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck")).withColumns({"at": at, "called": called})
    row = lambda order, symbol, roles, where, around: [F.col("ck").cast("int").alias("doc"), order.cast("int").alias("ord"), path_of(F.col("ck")).alias("relative_path"), symbol.alias("symbol"), F.lit(roles).alias("roles"), where.alias("range"), around.alias("enclosing")]
    none = F.lit(None).cast("array<int>")
    classes = customers.select(*row(F.lit(0), class_of(F.col("ck")), 1, ints(0, 6, 10), ints(0, 0, 100_000, 1)))
    place = F.when(F.pmod("ok", F.lit(2)) == 0, ints(F.col("at"), 2, F.col("at"), 8)).otherwise(ints(F.col("at"), 2, 8))
    methods = orders.where(F.pmod("ok", F.lit(7)) != 0).select(*row(1 + F.col("ok"), F.col("called"), 1, place, ints(F.col("at"), 2, F.col("at") + 9, 3)))
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_suppkey").alias("sk"))
    met = items.join(orders, "ok").join(orders.select(F.col("ok").alias("other"), F.col("called").alias("there")), F.col("ok") - F.col("n") == F.col("other"), "left")
    target = F.when(F.col("n") == 5, F.lit("local 5")).when(F.col("n") > 5, class_of(F.col("sk"))).otherwise(F.col("there"))
    references = met.select(*row(1_000_000 + 10 * F.col("ok") + F.col("n"), target, 0, ints(F.col("at") + F.col("n"), 4, 6), none)).where("symbol IS NOT NULL")
    relations = customers.where(F.pmod("ck", F.lit(3)) < 2).select(
        F.col("ck").cast("int").alias("doc"), F.lit(0).alias("ord"), path_of(F.col("ck")).alias("relative_path"), class_of(F.col("ck")).alias("source"), class_of(F.col("ck") + 1).alias("target"),
        (F.pmod("ck", F.lit(3)) == 0).alias("is_implementation"),
    )
    manifest = customers.where(F.pmod("ck", F.lit(5)) != 0).select(F.concat(F.lit("shop/"), path_of(F.col("ck"))).alias("relative_path"))
    return graph.build(classes.unionByName(methods).unionByName(references), relations, manifest, "shop")


def index_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).nodes.select("id", "name", "filePath", F.col("line").cast("long").alias("line"), "type")


def index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _index(spark, sf_dir).edges
    return edges.select("source", "target", "type", F.col("callLine").cast("long").alias("callLine"), F.col("refLine").cast("long").alias("refLine"))


INDEX_CTE = """
cu AS (SELECT c_custkey AS ck, 'scip-typescript npm shop 1.0 src/`c' || c_custkey || '.ts`/' AS head FROM customer),
cl AS (SELECT ck, head || 'C' || ck || '#' AS symbol FROM cu),
od AS (SELECT o_orderkey AS ok, o_custkey AS ck, 10 * (o_orderkey % 997) + 1 AS sl, CASE WHEN o_orderkey % 11 = 0 THEN head || 'f' || o_orderkey || '().' ELSE head || 'C' || ck || '#o' || o_orderkey || '().' END AS symbol
  FROM orders JOIN cu ON ck = o_custkey),
df AS (
  SELECT ck, symbol, 'TYPE' AS kind, 'C' || ck AS name, 0 AS ord, 0 AS sl, 0 AS sc, 100000 AS el, 1 AS ec FROM cl WHERE ck % 5 <> 0
  UNION ALL SELECT ck, symbol, CASE WHEN ok % 11 = 0 THEN 'FUNCTION' ELSE 'METHOD' END, CASE WHEN ok % 11 = 0 THEN 'f' ELSE 'o' END || ok, 1 + ok, sl, 2, sl + 9, 3 FROM od WHERE ck % 5 <> 0 AND ok % 7 <> 0),
rf AS (
  SELECT o.ck, 1000000 + 10 * l_orderkey + l_linenumber AS ord, o.sl + l_linenumber AS line, CASE WHEN l_linenumber > 5 THEN c.symbol WHEN l_linenumber < 5 THEN t.symbol END AS target
  FROM lineitem JOIN od o ON o.ok = l_orderkey LEFT JOIN od t ON t.ok = l_orderkey - l_linenumber LEFT JOIN cl c ON c.ck = l_suppkey WHERE o.ck % 5 <> 0),
us AS (
  SELECT d.symbol AS source, rf.target, k.kind, rf.line, row_number() OVER (PARTITION BY rf.ck, rf.ord, rf.line, rf.target, k.kind ORDER BY (d.el - d.sl) * 100000 + d.ec - d.sc, d.ord) AS n
  FROM rf JOIN df k ON k.symbol = rf.target JOIN df d ON d.ck = rf.ck AND d.symbol <> rf.target AND (d.sl, d.sc) <= (rf.line, 4) AND (rf.line, 4) <= (d.el, d.ec))"""


def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).nodes.select("type").distinct()


def file_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _graph(spark, sf_dir)
    files = built.nodes.where("type = 'File'").select("filePath")
    own = cards.children(built.nodes.withColumn("line", F.lit(1)).where(F.col("filePath").isNotNull()))
    return files.join(own, "filePath", "left").select("filePath", F.coalesce(F.size("nodes"), F.lit(0)).cast("long").alias("children"))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("scip-typescript npm "), F.col("p_brand"), F.lit(" 1.0 src/`f"), F.col("p_partkey"), F.lit(".ts`/"))
    tail = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.pmod("p_partkey", F.lit(len(SUFFIXES))) + 1).cast("int"))
    known = F.when(F.pmod("p_partkey", F.lit(11)) == 0, F.concat(F.lit("local "), F.col("p_partkey"))).otherwise(F.concat(head, tail))
    return _t(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(known, "#(?=[0-9])", "_").alias("symbol"))


SUFFIXES = ("Alpha#", "Alpha#run().", "run().", "Alpha#Beta#go(+1).", "value.", "Alpha#value.", "run().(x)", "Alpha#`odd name`().", "Alpha#[T]", "Alpha#`a``b`().")
SYMBOL_CTE = """
sy AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'local ' || p_partkey ELSE regexp_replace('scip-typescript npm ' || p_brand, '#([0-9])', '_\\1', 'g')
  || ' 1.0 src/`f' || p_partkey || '.ts`/' || (['Alpha#', 'Alpha#run().', 'run().', 'Alpha#Beta#go(+1).', 'value.', 'Alpha#value.', 'run().(x)', 'Alpha#`odd name`().', 'Alpha#[T]', 'Alpha#`a``b`().'])
    [p_partkey % 10 + 1] END AS symbol, p_partkey % 10 AS k FROM part)"""


def symbol_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _symbols(spark, sf_dir).withColumn("p", symbols.parsed_symbol(F.col("symbol")))
    return out.select("p_partkey", "symbol", "p.valid", "p.kind", "p.name", "p.owner")


def innermost_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside the week that follows a signup of the same user: the shortest such week, first by id."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    minute = lambda c: F.floor(F.col(c) / 60).cast("int")
    opened = events.where("event_type = 'signup'").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("ord"), F.col("event_id").alias("symbol"),
        F.struct(minute("s").alias("sl"), F.lit(0).alias("sc"), (minute("s") + 1440 * (1 + F.pmod("event_id", F.lit(7)).cast("int"))).alias("el"), F.lit(60).alias("ec")).alias("r"),
    )
    asked = events.where("event_type <> 'signup'").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("ref"), minute("s").alias("line"), F.pmod(F.col("s"), F.lit(60)).cast("int").alias("col"), F.lit(-1).cast("long").alias("target")
    )
    return graph.innermost(asked, opened).select(F.col("ref").alias("event_id"), F.col("container").alias("signup_id"))


def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks, with spans that follow their length."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    name = F.concat(F.lit("d.p"), F.floor(F.col("at") / 7), F.lit(".l"), F.col("at"))
    first = (F.col("at") * 20).cast("int")
    rows = docs.select(
        F.col("doc_id").alias("file"), F.lit("line").alias("chunk_type"), name.alias("hierarchical_name"), F.col("line").alias("source_text"), first.alias("start_line"),
        (first + F.pmod(F.length("line"), F.lit(14))).cast("int").alias("end_line"), first.alias("start_byte"), (first + 1).cast("int").alias("end_byte"), F.lit(None).cast("string").alias("jsdoc_text"),
    )
    out = chunks.merge_table(rows)
    return out.select(F.col("file").alias("doc_id"), "chunk_type", "hierarchical_name", "start_line", "end_line", F.length("source_text").cast("long").alias("chars"))


MERGE_SQL = """
WITH RECURSIVE lines AS (
  SELECT doc_id, i - 1 AS pos, l, ((i - 1) * 20)::INT AS s, ((i - 1) * 20 + length(l) % 14)::INT AS e, ((i - 1) // 7) AS p
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (
  SELECT doc_id, pos, s, e, p, l, e - s >= 10 AS lone, s AS bs FROM lines WHERE pos = 0
  UNION ALL
  SELECT n.doc_id, n.pos, n.s, n.e, n.p, n.l, n.e - n.s >= 10, CASE WHEN n.e - n.s < 10 AND NOT f.lone AND n.p = f.p AND n.e - f.bs <= 50 THEN f.bs ELSE n.s END
  FROM f JOIN lines n ON n.doc_id = f.doc_id AND n.pos = f.pos + 1)
SELECT doc_id, CASE WHEN lone THEN 'line' ELSE 'merged_block' END AS chunk_type,
  CASE WHEN lone THEN 'd.p' || any_value(p) || '.l' || any_value(pos) ELSE 'd.p' || arg_min(p, pos) || '.merged_L' || min(s) || '_L' || max(e) END AS hierarchical_name,
  min(s) AS start_line, max(e) AS end_line, (sum(length(l)) + 2 * (count(*) - 1))::BIGINT AS chars
FROM f GROUP BY doc_id, lone, bs"""


#: Lines are joined as far as they fit; one that is too long is cut at blanks. A run of pieces is a text with the ends of its pieces in `c`;
#: a chunk goes from piece b to before piece e, and the next begins as early as the overlap allows.
SPLIT_SQL = """
WITH RECURSIVE lines AS (
  SELECT doc_id, i, contains(text, chr(10)) AS many, CASE WHEN i > 1 THEN chr(10) ELSE '' END || l AS p
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
long AS (SELECT *, NOT many OR length(p) >= 512 AS own FROM lines WHERE p <> ''),
dealt AS (SELECT *, 2 * sum(own::INT) OVER (PARTITION BY doc_id ORDER BY i) + (NOT own)::INT AS run FROM long),
pieces AS (
  SELECT doc_id, run, i, 0 AS j, p FROM dealt WHERE NOT own
  UNION ALL SELECT doc_id, run, i, j, CASE WHEN j > 1 THEN ' ' ELSE '' END || w
  FROM (SELECT doc_id, run, i, unnest(string_split(p, ' ')) AS w, generate_subscripts(string_split(p, ' '), 1) AS j FROM dealt WHERE own)),
ends AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id, run ORDER BY i, j)::INT AS c FROM pieces WHERE p <> ''),
runs AS (SELECT doc_id, run, string_agg(p, '' ORDER BY i, j) AS t, list_prepend(0, list(c ORDER BY i, j)) AS c FROM ends GROUP BY ALL),
steps AS (
  SELECT doc_id, run, c, 0 AS b, coalesce(list_min(list_filter(range(1, len(c) - 1), lambda i: c[i + 2] > 512)), len(c) - 1)::INT AS e FROM runs
  UNION ALL
  SELECT doc_id, run, c, b, coalesce(list_min(list_filter(range(b + 1, len(c) - 1), lambda i: c[i + 2] - c[b + 1] > 512)), len(c) - 1)::INT AS e
  FROM (SELECT doc_id, run, c, list_min(list_filter(range(b, e + 1), lambda k: c[e + 1] - c[k + 1] <= 50 AND c[e + 2] - c[k + 1] <= 512))::INT AS b FROM steps WHERE e < len(c) - 1)),
cut AS (SELECT doc_id, run, b, regexp_replace(substr(t, s.c[b + 1] + 1, s.c[e + 1] - s.c[b + 1]), '^\\s+|\\s+$', '', 'g') AS chunk FROM steps s JOIN runs USING (doc_id, run))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, b)::INT AS number, length(chunk)::INT AS chars, md5(chunk) AS digest FROM cut WHERE chunk <> ''"""


def text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of all documents; with their lengths and digests."""
    out = chunks.text_chunks(_t(spark, sf_dir, "documents"), "text", "doc_id")
    return out.select("doc_id", "number", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


def doc_comment_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    comment = F.concat(F.lit("/**\n * "), F.replace("text", F.lit("\n"), F.lit("\n * ")), F.lit("\n */"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.plain_doc(comment)).alias("digest"), text.doc_summary(comment).alias("summary"))


def chunk_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    comment = F.when(F.pmod("doc_id", F.lit(2)) == 0, "/** What it does. */")
    made = text.chunk_document(F.col("relative_path"), F.concat(F.lit("f.C"), F.col("doc_id")), F.col("content"), comment)
    return files.select("doc_id", F.md5(made).alias("digest"))


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.bounded(F.col("text"), 700)).alias("digest"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary prompts for texts that are longer than a prompt takes, some of them."""
    long = F.repeat(F.concat("text", F.lit("\n")), 40)
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.summary_prompt(F.concat(F.lit("p/"), "doc_id"), long)).alias("digest"))


def parent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.concat_ws(".", F.lit("a"), F.col("n_name"), F.col("n_nationkey").cast("string"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", text.parent_name(names).alias("parent"), text.root_name(names).alias("root"))


def file_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card per nation, with its customers as classes."""
    built = _graph(spark, sf_dir)
    own = cards.children(built.nodes.where(F.col("filePath").isNotNull()).withColumn("line", F.lit(1)))
    card = cards.card_markdown(F.col("filePath"), F.lit(" A nation. "), F.col("nodes"))
    return own.select("filePath", F.md5(card).alias("digest"), F.size(cards.names_of(F.col("nodes"), "Class")).cast("long").alias("classes"))


def cards_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("relative_path"), "source")
    done = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("relative_path"))
    return cards.pending(files, done).select(F.col("relative_path").alias("doc_id"), "source")


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated TypeScript: modules that declare, hand on as a whole, rename, go round in circles or export by default, and a user of each; chains of classes."""
    p = F.col("p_partkey")
    at = lambda text, n=0: F.concat(F.lit(text), p + n)
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("\n"))
    kind, mod = F.pmod(p, F.lit(6)), lambda n: at("./m", n)
    body = (
        F.when(kind == 0, line("export function ", at("f"), "() {\n}")).when(kind == 1, line("export * from '", mod(-1), "';"))
        .when(kind == 2, line("export { ", at("f", -2), " as ", at("g"), " } from '", mod(-1), "';")).when(kind == 3, line("export * from '", mod(1), "';\nexport * from \"", mod(-1), ".js\";"))
        .when(kind == 4, line("// export * from './none';\nexport * from '", mod(-1), "';")).otherwise(line("function ", at("h"), "() {\n}\nexport { ", at("h"), " as default };"))
    )
    name = F.when(kind == 0, at("f")).when(kind == 1, at("f", -1)).when(kind == 2, at("g")).when(kind == 3, at("g", -1)).otherwise(at("g", -2))
    clause = F.when(kind == 5, "call").otherwise(F.concat(F.lit("{ "), name, F.lit(" as call }")))
    use = line("import ", clause, " from '../lib/m", p.cast("string"), "';\nexport function ", at("run"), "() {\n  call();\n}")
    parts = _t(spark, sf_dir, "part")
    out = parts.select(F.concat(at("proj/lib/m"), F.lit(".ts")).alias("relative_path"), body.alias("content")).unionByName(
        parts.select(F.concat(at("proj/app/u"), F.lit(".ts")).alias("relative_path"), use.alias("content"))
    )
    s, root = F.col("s_suppkey"), F.col("s_suppkey") - F.pmod("s_suppkey", F.lit(4))
    base = F.when(F.pmod(s, F.lit(4)) != 0, F.concat(F.lit("import { C"), s - 1, F.lit(" } from './c"), s - 1, F.lit("';\n"))).otherwise("\n")
    over = F.when(F.pmod(s, F.lit(4)) != 0, F.concat(F.lit(" extends C"), s - 1)).otherwise("")
    text = F.concat(base, F.lit("export class C"), s, over, F.lit(" {\n  own"), s, F.lit("() {\n  }\n  go() {\n    this.own"), root, F.lit("();\n  }\n}\n"))
    classes = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("proj/cls/c"), s, F.lit(".ts")).alias("relative_path"), text.alias("content"))
    return out.unionByName(classes).repartition(2 * spark.sparkContext.defaultParallelism)


def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls and bases lead to over imports, re-exports and inheritance."""
    edges = fallback.build(_modules(spark, sf_dir)).edges
    return edges.where("type IN ('CALLS', 'INHERITS')").select("source", "target", "type", "callLine")


def module_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the generated modules declare, with lines, and what isn't found."""
    return fallback.build(_modules(spark, sf_dir)).nodes.select("id", "name", "type", "filePath", "line")


def first_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that many documents of an index define: the first in its order counts."""
    symbol = F.concat(F.lit("scip-typescript npm shop 1.0 src/`o.ts`/f"), "l_orderkey", F.lit("()."))
    path, at = F.concat(F.lit("src/s"), "l_suppkey", F.lit(".ts")), F.col("l_linenumber").cast("int")
    rows = _t(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("ord"), path.alias("relative_path"), symbol.alias("symbol"),
        F.lit(1).alias("roles"), F.array(at, F.lit(0), F.lit(3)).alias("range"), F.lit(None).cast("array<int>").alias("enclosing"),
    )
    none = spark.createDataFrame([], "doc long, ord int, relative_path string, source string, target string, is_implementation boolean")
    manifest = rows.select(F.concat(F.lit("shop/"), "relative_path").alias("relative_path")).distinct()
    nodes = graph.build(rows, none, manifest, "shop").nodes
    return nodes.where("type = 'Function'").select("id", "name", "filePath", F.col("line").cast("long").alias("line"))


MODULE_SQL = """
WITH RECURSIVE mods AS (SELECT p_partkey AS p, p_partkey % 6 AS kind FROM part),
declared AS (SELECT p, CASE kind WHEN 0 THEN 'f' ELSE 'h' END || p AS name FROM mods WHERE kind IN (0, 5)),
named AS (SELECT p, 'g' || p AS known, p - 1 AS over, 'f' || (p - 2) AS name FROM mods WHERE kind = 2 UNION ALL SELECT p, 'default', p, 'h' || p FROM mods WHERE kind = 5),
whole AS (SELECT p, p - 1 AS over FROM mods WHERE kind IN (1, 3, 4) UNION ALL SELECT p, p + 1 FROM mods WHERE kind = 3),
walk AS (
  SELECT p AS ask, p AS at, CASE kind WHEN 0 THEN 'f' || p WHEN 1 THEN 'f' || (p - 1) WHEN 2 THEN 'g' || p WHEN 3 THEN 'g' || (p - 1) WHEN 4 THEN 'g' || (p - 2) ELSE 'default' END AS name FROM mods
  UNION
  SELECT ask, over, CASE WHEN how THEN n ELSE w.name END FROM walk w JOIN (
    SELECT p, known, over, name AS n, true AS how FROM named UNION ALL SELECT p, NULL, over, NULL, false FROM whole) e ON e.p = w.at AND (e.known = w.name OR NOT how)),
led AS (SELECT ask, min('Function::' || d.name || '::proj/lib/m' || d.p || '.ts') AS id FROM walk w JOIN declared d ON d.p = w.at AND d.name = w.name GROUP BY ask),
cls AS (SELECT s_suppkey AS s, s_suppkey % 4 AS k FROM supplier),
above AS (
  SELECT s AS ask, s AS at FROM cls UNION SELECT ask, c.s FROM above a JOIN cls b ON b.s = a.at AND b.k <> 0 JOIN cls c ON c.s = a.at - 1)
SELECT 'Function::run' || p || '::proj/app/u' || p || '.ts' AS source, coalesce(id, 'Function::call::unresolved.file') AS target, 'CALLS' AS type, 3 AS "callLine" FROM mods LEFT JOIN led ON ask = p
UNION ALL
SELECT 'Class::C' || b.s || '::proj/cls/c' || b.s || '.ts', CASE WHEN c.s IS NULL THEN 'Class::C' || (b.s - 1) || '::unresolved.file' ELSE 'Class::C' || c.s || '::proj/cls/c' || c.s || '.ts' END, 'INHERITS', NULL
FROM cls b LEFT JOIN cls c ON c.s = b.s - 1 WHERE b.k <> 0
UNION ALL
SELECT 'Method::go::proj/cls/c' || s || '.ts', CASE WHEN a.at IS NULL THEN 'Function::own' || (s - k) || '::unresolved.file' ELSE 'Method::own' || a.at || '::proj/cls/c' || a.at || '.ts' END, 'CALLS', 6
FROM cls LEFT JOIN above a ON a.ask = s AND a.at = s - k"""


def json_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as `json_search`, by trigrams."""
    index = TrigramIndex(spark, staged_folder(spark, "trigrams"), "relative_path", ("relative_path", "content"))
    found = index.write(jsonstore.store(_json_files(spark, sf_dir), "event_id")).search("EVENTS/E12")
    return found.orderBy("relative_path").limit(jsonstore.LIMIT).select("relative_path")


def text_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as `text_search`, by trigrams."""
    index = TrigramIndex(spark, staged_folder(spark, "trigrams"), "doc_id", ("source", "text"))
    return index.write(_t(spark, sf_dir, "documents").select("doc_id", "source", "text")).search("THIS").select("doc_id")


def cards_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as `cards_topk`, by clusters."""
    index = VectorIndex(spark, staged_folder(spark, "clusters"), "vec_id").write(_t(spark, sf_dir, "embeddings"))
    return index.nearest(_vector(spark, sf_dir), 3).select("vec_id", F.round("similarity", 6).alias("similarity"))


def chunks_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as `chunks_topk_filtered`, by clusters."""
    index = VectorIndex(spark, staged_folder(spark, "clusters"), "vec_id", metric="l2").write(_t(spark, sf_dir, "embeddings"))
    return index.nearest(_vector(spark, sf_dir), 4, F.col("label").isin(1, 3, 5)).select("vec_id", F.round("similarity", 4).alias("distance"))


def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a store by key, labels as versions of it: good ones change rows, toxic ones take them out, some come back; compacted on the way."""
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    store = Versions(spark, staged_folder(spark, "versions"), "doc_id")
    store.upsert(docs.select("doc_id", "source", "n_chars"))
    changed = labels.where("quality = 1").select("doc_id", F.lit("good").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    store.upsert(changed, gone=labels.where("toxic = 1 AND quality = 0"))
    store.compact()
    back = labels.where("toxic = 1 AND doc_id % 3 = 0").select("doc_id", F.lit("back").alias("source"), F.col("doc_id").alias("n_chars"))
    store.upsert(back, gone=labels.where("quality = 1 AND doc_id % 5 = 0"))
    return store.read()


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.where(text.like_search([F.col("source"), F.col("text")], "THIS")).select("doc_id")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated TypeScript, a file per order: its lines become the methods of a class."""
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # small rows, and much to do for each
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("ls"))
    method = F.transform("ls", lambda x: F.concat(F.lit("  m"), x["l_linenumber"], F.lit("(a) {\n"), F.repeat(F.lit("    a += 1;\n"), x["l_quantity"].cast("int") % 16), F.lit("    return run(a);\n  }\n")))
    body = F.concat(F.lit('import { x } from "y";\n\nexport class C {\n'), F.array_join(method, "\n"), F.lit("}\n"))
    return lines.select(F.concat(F.lit("proj/o"), F.col("l_orderkey"), F.lit(".ts")).alias("relative_path"), body.alias("content"))


#: The generated sources' declarations with their lines, and the merge of short ones; a class of over 50 lines gives its methods.
CODE_SQL = """
WITH RECURSIVE methods AS (
  SELECT o, n, j, 3 + upto - k - 4 AS s, 1 + upto AS e FROM (
    SELECT *, sum(k + 4) OVER (PARTITION BY o ORDER BY j) AS upto FROM (
      SELECT l_orderkey AS o, l_linenumber AS n, trunc(l_quantity)::INT % 16 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS j FROM lineitem))),
classes AS (SELECT o, max(e) + 1 AS e, max(e) - 1 > 50 AS entered FROM methods GROUP BY o),
atoms AS (
  SELECT o, 0 AS pos, 'import_statement' AS t, 'o' || o || '.import_statement_L0' AS name, 'o' || o AS p, 0 AS s, 0 AS e FROM classes
  UNION ALL SELECT o, 1, 'class_declaration', 'o' || o || '.C', 'o' || o, 2, e FROM classes WHERE NOT entered
  UNION ALL SELECT o, j, 'method_definition', 'o' || o || '.C.m' || n, 'o' || o || '.C', s, m.e FROM methods m JOIN classes c USING (o) WHERE entered),
f AS (
  SELECT *, e - s >= 10 AS lone, s AS bs FROM atoms WHERE pos = 0
  UNION ALL
  SELECT n.*, n.e - n.s >= 10, CASE WHEN n.e - n.s < 10 AND NOT f.lone AND n.p = f.p AND n.e - f.bs <= 50 THEN f.bs ELSE n.s END
  FROM f JOIN atoms n ON n.o = f.o AND n.pos = f.pos + 1)
SELECT 'proj/o' || o || '.ts' AS relative_path, CASE WHEN lone THEN any_value(t) ELSE 'merged_block' END AS chunk_type,
  CASE WHEN lone THEN any_value(name) ELSE any_value(p) || '.merged_L' || min(s) || '_L' || max(e) END AS hierarchical_name, min(s)::INT AS start_line, max(e)::INT AS end_line
FROM f GROUP BY o, lone, bs"""


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.merge_table(chunks.code_chunks(_sources(spark, sf_dir)).where("error IS NULL").drop("error"), "relative_path")
    return out.select("relative_path", "chunk_type", "hierarchical_name", "start_line", "end_line")


def source_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the generated sources, counted by type."""
    built = fallback.build(_sources(spark, sf_dir))
    counted = lambda df, what: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return counted(built.nodes, "nodes").unionByName(counted(graph.resolved(built), "edges"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        file_kinds, excluded_dirs, coverage_matrix, gate_blocking, gate_decision, indexed_languages, valid_files, audit_score, ranked_manifest, ext_stats, dir_top10,
        audit_totals, primary_language, cards_topk, chunks_topk_filtered, vector_preview, json_store, json_search, graph_nodes, graph_edges, graph_stats,
        graph_neighbours, node_types, file_children, symbol_parse, innermost_container, chunk_merge, text_split, doc_comment_clean, chunk_format, truncated, prompts,
        parent_names, file_cards, cards_resume, text_search, code_chunks, source_graph, manifest_top20, manifest_top30, dir_top10_level1, file_nodes, index_nodes, index_edges,
        store_versions, json_search_indexed, text_search_indexed, cards_topk_indexed, chunks_topk_indexed, module_names, module_nodes,
        first_definitions,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    out = _plain_sql()
    indexed = {"json_search_indexed": "json_search", "text_search_indexed": "text_search", "cards_topk_indexed": "cards_topk", "chunks_topk_indexed": "chunks_topk_filtered"}
    return out | {name: out[plain] for name, plain in indexed.items()}


def _plain_sql() -> dict[str, str]:
    similarity = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
    return {
        "file_kinds": _sql(
            "SELECT doc_id, relative_path, ext, category, language, support_status, CASE WHEN language IN ('typescript', 'javascript') THEN language END AS provider FROM kinds"
        ),
        "excluded_dirs": _sql("SELECT list_has_any(string_split(relative_path, '/')[:-2], ['node_modules', 'build']) AS excluded, count(*) AS files FROM files GROUP BY 1"),
        "coverage_matrix": _sql(
            "SELECT support_status AS status, language, count(*) AS count, array_to_string(list_sort(list(relative_path))[1:5], ',') AS examples FROM kinds GROUP BY 1, 2"
        ),
        "gate_blocking": _sql("SELECT support_status AS status, language, count(*) AS count FROM kinds WHERE support_status IN ('UNSUPPORTED', 'EXPERIMENTAL') GROUP BY 1, 2"),
        "gate_decision": _sql("SELECT count(*) = 0 AS proceed FROM kinds WHERE support_status IN ('UNSUPPORTED', 'EXPERIMENTAL')"),
        "indexed_languages": _sql(
            "SELECT count(*) AS files, array_to_string(list_sort(list_distinct(list(language) FILTER (support_status = 'VALIDATED'))), ',') AS languages FROM kinds"
        ),
        "valid_files": _sql("SELECT doc_id, relative_path, size FROM valid"),
        "audit_score": _sql("SELECT doc_id, relative_path, score, reasons, lines FROM audit"),
        "ranked_manifest": _sql("SELECT relative_path, score, category, language, support_status, size FROM manifest ORDER BY score DESC, relative_path"),
        "ext_stats": _sql("SELECT ext, count(*) AS files FROM audit GROUP BY 1"),
        "dir_top10": _sql("SELECT split_part(relative_path, '/', 2) AS dir, count(*) AS files FROM audit GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "audit_totals": _sql("SELECT count(*) AS files, sum(lines)::BIGINT AS lines, round(sum(size) / 1048576.0, 6) AS mib FROM audit"),
        "primary_language": _sql("SELECT language, count(*) AS files FROM audit WHERE support_status = 'VALIDATED' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
        "cards_topk": f"""SELECT e.vec_id, round({similarity}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
            ORDER BY {similarity} DESC, e.vec_id LIMIT 3""",
        "chunks_topk_filtered": """SELECT vec_id, round(d, 4) AS distance FROM (
            SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS d
            FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 3, 5)) ORDER BY d, vec_id LIMIT 4""",
        "vector_preview": "SELECT vec_id, len(embedding[1:5]) AS n, round(list_sum(embedding[1:5]::DOUBLE[]), 5) AS total FROM embeddings",
        "json_store": f"WITH {JSON_CTE} SELECT relative_path, content, 0 AS score, round(size / 1024.0, 6) AS size_kb FROM js",
        "json_search": f"WITH {JSON_CTE} SELECT relative_path FROM js WHERE lower(relative_path) LIKE '%events/e12%' OR lower(content) LIKE '%events/e12%' ORDER BY 1 LIMIT 3",
        "graph_nodes": f"WITH {GRAPH_CTE} SELECT id, name, type FROM nodes",
        "graph_edges": f"WITH {GRAPH_CTE} SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)",
        "graph_stats": f"""WITH {GRAPH_CTE} SELECT n.*, e.*, n.nodes_file AS documents FROM (
            SELECT count(*) AS nodes_total, count(*) FILTER (type = 'File') AS nodes_file, count(*) FILTER (type = 'Class') AS nodes_class,
              count(*) FILTER (type = 'Interface') AS nodes_interface, count(*) FILTER (type = 'Function') AS nodes_function, count(*) FILTER (type = 'Method') AS nodes_method FROM nodes) n, (
            SELECT count(*) AS edges_total, count(*) FILTER (type = 'CALLS') AS edges_calls, count(*) FILTER (type = 'DEFINED_IN') AS edges_defined_in,
              count(*) FILTER (type = 'USES') AS edges_uses, count(*) FILTER (type = 'IMPLEMENTS') AS edges_implements, count(*) FILTER (type = 'INHERITS') AS edges_inherits FROM edges) e""",
        "graph_neighbours": f"""WITH {GRAPH_CTE}, picked AS (SELECT * FROM nodes WHERE name IN ('BUILDING', '1-URGENT', 'FRANCE', 'NATION_6', 'nobody')),
            o AS (SELECT p.name, p.type, list_sort(list(DISTINCT e.type || '->' || coalesce(t.name, '')))[1:6] AS x FROM picked p JOIN edges e ON e.source = p.id
              LEFT JOIN nodes t ON t.id = e.target GROUP BY 1, 2),
            i AS (SELECT p.name, p.type, list_sort(list(DISTINCT coalesce(s.name, '') || '->' || e.type))[1:6] AS x FROM picked p JOIN edges e ON e.target = p.id
              LEFT JOIN nodes s ON s.id = e.source GROUP BY 1, 2)
            SELECT p.name, p.type, coalesce(array_to_string(list_filter(o.x, lambda v: NOT suffix(v, '->'))[1:5], ','), '') AS "out",
              coalesce(array_to_string(list_filter(i.x, lambda v: NOT prefix(v, '->'))[1:5], ','), '') AS "into"
            FROM (SELECT DISTINCT name, type FROM picked) p LEFT JOIN o USING (name, type) LEFT JOIN i USING (name, type)""",
        "node_types": f"WITH {GRAPH_CTE} SELECT DISTINCT type FROM nodes",
        "file_children": f"""WITH {GRAPH_CTE} SELECT f.filePath, count(c.id) AS children FROM nodes f LEFT JOIN nodes c ON c.filePath = f.filePath AND c.type <> 'File'
            WHERE f.type = 'File' GROUP BY 1""",
        "symbol_parse": f"""WITH {SYMBOL_CTE} SELECT p_partkey, symbol, symbol NOT LIKE 'local %' AS valid,
            CASE WHEN symbol LIKE 'local %' THEN NULL ELSE (['TYPE', 'METHOD', 'FUNCTION', 'METHOD', 'term', 'term', 'param', 'METHOD', 'type_param', 'METHOD'])[k + 1] END AS kind,
            CASE WHEN symbol LIKE 'local %' THEN NULL ELSE (['Alpha', 'run', 'run', 'go', 'value', 'value', 'x', 'odd name', 'T', 'a`b'])[k + 1] END AS name,
            CASE WHEN symbol LIKE 'local %' OR k NOT IN (1, 3, 7, 9) THEN NULL WHEN k = 9 THEN replace(symbol, '`a``b`().', '') WHEN k = 1 THEN replace(symbol, 'run().', '') WHEN k = 3 THEN replace(symbol, 'go(+1).', '')
              ELSE replace(symbol, '`odd name`().', '') END AS owner FROM sy""",
        "innermost_container": """WITH ev AS (SELECT event_id, user_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS s FROM events),
            op AS (SELECT user_id, event_id AS id, s // 60 AS sl, s // 60 + 1440 * (1 + event_id % 7) AS el FROM ev WHERE event_type = 'signup'),
            m AS (SELECT a.event_id, op.id, row_number() OVER (PARTITION BY a.event_id ORDER BY el - sl, id) AS n FROM ev a JOIN op ON op.user_id = a.user_id
              WHERE event_type <> 'signup' AND a.s // 60 BETWEEN sl AND el)
            SELECT event_id, id AS signup_id FROM m WHERE n = 1""",
        "chunk_merge": MERGE_SQL,
        "text_split": SPLIT_SQL,
        "code_chunks": CODE_SQL,
        "source_graph": """WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), k AS (SELECT count(DISTINCT o) AS files, count(*) AS methods FROM l)
            SELECT 'nodes' AS what, 'File' AS type, files AS n FROM k UNION ALL SELECT 'nodes', 'Class', files FROM k UNION ALL SELECT 'nodes', 'Method', methods FROM k
            UNION ALL SELECT 'nodes', 'Function', 1 UNION ALL SELECT 'edges', 'DEFINED_IN', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'edges', 'CALLS', (SELECT count(*) FROM lineitem)""",
        "doc_comment_clean": r"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
            lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10))) AS digest, '/**' AS summary FROM documents""",
        "chunk_format": _sql(
            """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN '// Documentation:' || chr(10) || 'What it does.' || chr(10) || chr(10) ELSE '' END
            || '// Context: File: ' || relative_path || ' | Chunk: f > C' || doc_id || chr(10) || chr(10) || chr(10) || content) AS digest FROM files"""
        ),
        "truncated": "SELECT doc_id, md5(CASE WHEN length(text) > 700 THEN left(text, 700) || ' […]' ELSE text END) AS digest FROM documents",
        "prompts": """SELECT doc_id, md5('Describe what this file does and how it is built, for a reader who has not seen it.' || chr(10) || 'File: p/' || doc_id || chr(10) || chr(10) || '```' || chr(10)
            || array_to_string(string_split(repeat(text || chr(10), 40), chr(10))[1:400], chr(10)) || chr(10) || '```' || chr(10) || chr(10) || 'Summary:') AS digest FROM documents""",
        "manifest_top20": _sql("SELECT relative_path, score FROM manifest ORDER BY score DESC, relative_path LIMIT 20"),
        "manifest_top30": _sql("SELECT relative_path, score FROM manifest ORDER BY score DESC, relative_path LIMIT 30"),
        "dir_top10_level1": _sql("SELECT split_part(relative_path, '/', 1) AS dir, count(*) AS files FROM audit GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "file_nodes": f"WITH {GRAPH_CTE} SELECT filePath, name FROM nodes WHERE type = 'File'",
        "index_nodes": f"""WITH {INDEX_CTE}
            SELECT 'File::c' || ck || '.ts::shop/src/c' || ck || '.ts' AS id, 'c' || ck || '.ts' AS name, 'shop/src/c' || ck || '.ts' AS "filePath", 0::BIGINT AS line, 'File' AS type FROM cl WHERE ck % 5 <> 0
            UNION ALL SELECT symbol, name, 'shop/src/c' || ck || '.ts', sl + 1, CASE kind WHEN 'METHOD' THEN 'Method' WHEN 'FUNCTION' THEN 'Function'
              ELSE CASE WHEN ck > 1 AND (ck - 1) % 3 = 0 AND (ck - 1) % 5 <> 0 THEN 'Interface' ELSE 'Class' END END FROM df""",
        "index_edges": f"""WITH {INDEX_CTE}
            SELECT d.symbol AS source, c.symbol AS target, 'DEFINED_IN' AS type, NULL::BIGINT AS "callLine", NULL::BIGINT AS "refLine" FROM df d JOIN cl c USING (ck) WHERE d.kind = 'METHOD'
            UNION ALL SELECT a.symbol, b.symbol, 'IMPLEMENTS', NULL, NULL FROM df a JOIN df b ON b.ck = a.ck + 1 AND a.kind = 'TYPE' AND b.kind = 'TYPE' WHERE a.ck % 3 = 0
            UNION ALL SELECT source, target, CASE WHEN kind = 'TYPE' THEN 'USES' ELSE 'CALLS' END, CASE WHEN kind <> 'TYPE' THEN line + 1 END, CASE WHEN kind = 'TYPE' THEN line + 1 END FROM us WHERE n = 1""",
        "parent_names": "SELECT n_nationkey, 'a.' || n_name AS parent, 'a' AS root FROM nation",
        "file_cards": f"""WITH {GRAPH_CTE} SELECT filePath, md5('# Card: ' || filePath || chr(10) || '## Purpose' || chr(10) || 'A nation.' || chr(10) || chr(10) || '## Classes (' || count(*) || ')'
            || chr(10) || string_agg('- **' || name || '**: 0 members', chr(10) ORDER BY name)) AS digest, count(*) AS classes FROM nodes WHERE type = 'Class' GROUP BY filePath""",
        "cards_resume": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "module_names": MODULE_SQL,
        "module_nodes": f"""WITH made AS ({MODULE_SQL}), gone AS (SELECT DISTINCT target AS id FROM made WHERE suffix(target, 'unresolved.file')),
            own AS (
              SELECT 'f' || p_partkey AS name, 'Function' AS type, 'proj/lib/m' || p_partkey || '.ts' AS f, 1 AS line FROM part WHERE p_partkey % 6 = 0
              UNION ALL SELECT 'h' || p_partkey, 'Function', 'proj/lib/m' || p_partkey || '.ts', 1 FROM part WHERE p_partkey % 6 = 5
              UNION ALL SELECT 'run' || p_partkey, 'Function', 'proj/app/u' || p_partkey || '.ts', 2 FROM part
              UNION ALL SELECT 'C' || s_suppkey, 'Class', 'proj/cls/c' || s_suppkey || '.ts', 2 FROM supplier
              UNION ALL SELECT 'own' || s_suppkey, 'Method', 'proj/cls/c' || s_suppkey || '.ts', 3 FROM supplier
              UNION ALL SELECT 'go', 'Method', 'proj/cls/c' || s_suppkey || '.ts', 5 FROM supplier),
            files AS (SELECT 'm' || p_partkey || '.ts' AS name, 'proj/lib/m' || p_partkey || '.ts' AS f FROM part UNION ALL SELECT 'u' || p_partkey || '.ts', 'proj/app/u' || p_partkey || '.ts' FROM part
              UNION ALL SELECT 'c' || s_suppkey || '.ts', 'proj/cls/c' || s_suppkey || '.ts' FROM supplier)
            SELECT type || '::' || name || '::' || f AS id, name, type, f AS "filePath", line FROM own UNION ALL SELECT 'File::' || name || '::' || f, name, 'File', f, 0 FROM files
            UNION ALL SELECT id, split_part(id, '::', 2), split_part(id, '::', 1), 'unresolved.file', 0 FROM gone""",
        "first_definitions": """SELECT 'scip-typescript npm shop 1.0 src/`o.ts`/f' || l_orderkey || '().' AS id, 'f' || l_orderkey AS name, 'shop/src/s' || l_suppkey || '.ts' AS "filePath", l_linenumber::BIGINT + 1 AS line
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""",
        "store_versions": """WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1 AND quality = 0) AS out, bool_or(toxic = 1 AND doc_id % 3 = 0) AS back,
            bool_or(quality = 1 AND doc_id % 5 = 0) AS later FROM labels GROUP BY doc_id),
            k AS (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.source, d.n_chars, d.doc_id IS NOT NULL AS stored, coalesce(good, false) AS good, coalesce(out, false) AS out, coalesce(back, false) AS back,
              coalesce(later, false) AS later FROM documents d FULL JOIN l ON l.doc_id = d.doc_id)
            SELECT doc_id, CASE WHEN back THEN 'back' WHEN good THEN 'good' ELSE source END AS source, CASE WHEN back THEN doc_id WHEN good THEN 1 ELSE n_chars END AS n_chars
            FROM k WHERE back OR (good AND NOT later) OR (stored AND NOT out AND NOT good)""",
        "text_search": "SELECT doc_id FROM documents WHERE lower(source) LIKE '%this%' OR lower(text) LIKE '%this%'",
    }
