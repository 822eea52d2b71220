"""Symbols, indexes and the graph; then all stages over a small tree."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import symbols, vectors
from siltstone.operators import audit, cards, graph, search
from siltstone.plans import ask, pipeline
from siltstone.sources import config, corpus, scip
from siltstone.sources.config import Settings
from siltstone.streaming import ingest


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(n, value):
    if isinstance(value, int):
        return number(n << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(n << 3 | 2) + number(len(value)) + value


def occurrence(symbol, at, roles=0, around=None, typed=False):
    packed = b"".join(map(number, at))
    where = field(8 if len(at) == 3 else 9, b"".join(field(i + 1, v) for i, v in enumerate(at))) if typed else field(1, packed)
    return field(2, where + field(2, symbol) + (field(3, roles) if roles else b"") + (field(7, b"".join(map(number, around))) if around else b""))


P = "scip-typescript npm demo 1.0 src/`a.ts`/"
SHAPE, DRAW, BASE, RUN, OUT = P + "Shape#", P + "Shape#draw().", P + "Base#", P + "run().", P + "Gone#"


def index():
    inside = [
        occurrence(BASE, [0, 6, 10], 1, [0, 0, 2, 1]), occurrence(SHAPE, [4, 6, 11], 1, [4, 0, 20, 1]), occurrence(DRAW, [6, 2, 6], 1, [6, 2, 10, 3]),
        occurrence(RUN, [22, 9, 12], 1, [22, 0, 30, 1]), occurrence(DRAW, [25, 4, 25, 8]), occurrence(BASE, [26, 4, 8], typed=True), occurrence(DRAW, [8, 4, 8]),
        occurrence("local 3", [9, 1, 2]), occurrence(OUT, [9, 4, 5]), occurrence(DRAW, [40, 0, 2]),
    ]
    relation = field(3, field(1, SHAPE) + field(4, field(1, BASE) + field(3, 1)) + field(4, field(1, OUT) + field(2, 1)))
    document = field(1, "src/a.ts") + b"".join(inside) + relation
    other = field(1, "src/skip.ts") + occurrence(P + "Skip#", [0, 0, 1], 1)
    return field(1, b"") + field(2, document) + field(2, other)


def test_symbols(spark):
    cases = {
        SHAPE: (True, "TYPE", "Shape", None), DRAW: (True, "METHOD", "draw", SHAPE), RUN: (True, "FUNCTION", "run", None), P + "value.": (True, "term", "value", None),
        P + "Shape#`odd. name`().": (True, "METHOD", "odd. name", SHAPE), P + "run().(x)": (True, "param", "x", None), "local 4": (False, None, None, None),
        "a b c": (False, None, None, None), "": (False, None, None, None), "s m p v dir/": (True, "namespace", "dir", None),
        P + "Shape#[T]": (True, "type_param", "T", None), P + "Shape#`a``b`(+2).": (True, "METHOD", "a`b", SHAPE), P + "Shape#Inner#go().": (True, "METHOD", "go", P + "Shape#Inner#"),
        "two  words npm @a/b 1.0 x!": (True, "macro", "x", None), "s m p v": (False, None, None, None), "s m p v x": (False, None, None, None), "s m p v `x": (False, None, None, None),
        "s m p v `a#b`/run().": (True, "FUNCTION", "run", None), "s m p v größe:": (True, "meta", "größe", None), P + "Shape#f(a b).": (False, None, None, None),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "s string").select("s", symbols.parsed_symbol(F.col("s")).alias("p")).collect()
    assert {r["s"]: tuple(r["p"]) for r in rows} == cases


def built(spark, tmp_path):
    (tmp_path / "index.scip").write_bytes(index())
    occurrences, relations = scip.read_scip(spark, str(tmp_path / "index.scip"))
    manifest = spark.createDataFrame([("demo/src/a.ts",), ("demo/README.md",)], "relative_path string")
    return graph.build(occurrences, relations, manifest, "demo"), occurrences


def test_graph(spark, tmp_path):
    g, occurrences = built(spark, tmp_path)
    assert occurrences.where("symbol = 'local 3'").first()["range"] == [9, 1, 2]
    nodes = {(r["name"], r["type"], r["filePath"], r["line"]) for r in g.nodes.collect()}
    assert nodes == {
        ("a.ts", "File", "demo/src/a.ts", 0), ("README.md", "File", "demo/README.md", 0), ("Base", "Interface", "demo/src/a.ts", 1), ("Shape", "Class", "demo/src/a.ts", 5),
        ("draw", "Method", "demo/src/a.ts", 7), ("run", "Function", "demo/src/a.ts", 23),
    }
    edges = sorted((r["type"], r["source"][len(P) :], r["target"][len(P) :], r["callLine"], r["refLine"]) for r in g.edges.collect())
    assert edges == [
        ("CALLS", "Shape#", "Shape#draw().", 9, None), ("CALLS", "run().", "Shape#draw().", 26, None), ("DEFINED_IN", "Shape#draw().", "Shape#", None, None),
        ("IMPLEMENTS", "Shape#", "Base#", None, None), ("USES", "run().", "Base#", None, 27),
    ]
    assert graph.resolved(g).count() == 5 and graph.statistics(g, 2).first()["edges_calls"] == 2
    graph.write(g, str(tmp_path / "g"))
    again = graph.read(spark, str(tmp_path / "g"))
    row = graph.neighbours(again, ["Shape", "none"]).first()
    assert row["out"] == ["CALLS->draw", "IMPLEMENTS->Base"] and row["into"] == ["draw->DEFINED_IN"]
    with pytest.raises(ValueError):
        graph.write(graph.Graph(g.nodes.union(g.nodes), g.edges), str(tmp_path / "g2"))


def test_index_errors():
    with pytest.raises((ValueError, IndexError)):
        scip.parse_index(index()[:-3])
    assert scip.parse_index(b"") == ([], [])


def test_innermost_ties(spark):
    r = "r struct<sl:int,sc:int,el:int,ec:int>"
    containers = spark.createDataFrame([("f", 0, "a", (0, 0, 900, 0)), ("f", 1, "b", (10, 0, 20, 5)), ("f", 2, "c", (10, 0, 20, 5)), ("g", 3, "d", (0, 0, 9, 9))], f"file string, ord int, symbol string, {r}")
    refs = spark.createDataFrame([("f", 1, 20, 5, "z"), ("f", 2, 20, 6, "z"), ("f", 3, 600, 0, "z"), ("f", 4, 15, 0, "b"), ("f", 5, 901, 0, "z")], "file string, ref int, line int, col int, target string")
    assert {x["ref"]: x["container"] for x in graph.innermost(refs, containers).collect()} == {1: "b", 2: "a", 3: "a", 4: "c"}


def test_innermost_against_all_pairs(spark):
    """Ranges that cross each other, references at their ends, and a file of many lines."""
    import random

    rng = random.Random(12)
    at = lambda n: (rng.randrange(n), rng.randrange(6))
    ranges = [(f"f{rng.randrange(3)}", i, f"s{i % 9}", *sorted([at(30), at(30)])) for i in range(120)] + [("long", 200 + i, f"m{i}", (9 * i, 0), (9 * i + 5, 2)) for i in range(2000)] + [("long", 5000, "all", (0, 0), (100_000, 0))]
    refs = [(f"f{rng.randrange(3)}", i, *at(31), f"s{rng.randrange(9)}") for i in range(400)] + [("long", 1000 + i, 7 * i, 1, f"m{i}") for i in range(2500)] + [("none", 9, 1, 1, "x")]
    containers = spark.createDataFrame([(f, (0, i), s, (*b, *e)) for f, i, s, b, e in ranges], "file string, ord struct<doc:bigint,ord:int>, symbol string, r struct<sl:int,sc:int,el:int,ec:int>").repartition("file")
    references = spark.createDataFrame(refs, "file string, ref int, line int, col int, target string").repartition("file")
    for exclude in (True, False):
        want = {}
        for f, i, line, col, target in refs:
            around = [((e[0] - b[0]) * 100_000 + e[1] - b[1], o, s) for g, o, s, b, e in ranges if g == f and b <= (line, col) <= e and not (exclude and s == target)]
            if around:
                want[i] = min(around)[2]
        assert {r["ref"]: r["container"] for r in graph.innermost(references, containers, exclude_self=exclude).collect()} == want


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [2.0, 0.0])], "id int, embedding array<float>")
    assert [r["id"] for r in search.nearest(rows, [1.0, 0.0], 9, "id").collect()] == [1, 5, 2]
    assert [r["id"] for r in search.nearest(rows, [1.0, 0.0], 2, "id", metric="l2").collect()] == [1, 4]
    assert vectors.dimension(rows) == 2

    def broken(texts):
        raise OSError("no server")

    texts = spark.createDataFrame([("a b",), (None,)], "t string")
    assert vectors.embed(texts, "t", broken).where("embedding IS NULL").count() == 2
    assert vectors.dimension(vectors.embed(texts, "t")) == vectors.DIM


def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "src/a.ts": "/** Draws shapes on a canvas. */\nexport class Shape {\n  draw() {}\n}\nconst a = 1;\n", "README.md": "# Demo\nA project that draws shapes.\n",
        "package.json": json.dumps({"name": "demo", "dependencies": {"left-pad": "1"}}), "node_modules/x.js": "no",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_stages(spark, tmp_path):
    root = tree(tmp_path)
    (tmp_path / "index.scip").write_bytes(index())
    settings = Settings(project="demo", source_root=str(root), store_root=str(tmp_path / "stores"))
    stores = pipeline.build(spark, settings, str(tmp_path / "index.scip"))
    assert {r["status"] for r in pipeline.doctor(spark, stores).collect()} == {"pass"}
    lookups = ask.Lookups(spark, stores)
    assert lookups.cards("draws shapes", 1)[0][0] in ("demo/src/a.ts", "demo/README.md")
    assert lookups.chunks("Shape draw", ["demo/src/a.ts"])[0][0] == "demo/src/a.ts"
    assert "Class Shape" in lookups.relations("who uses Shape?") and lookups.names("nothing known") == []
    assert lookups.json("LEFT-PAD")[0][0] == "demo/package.json"
    assert "demo/package.json" in lookups.ask("what is in package.json", "t") and len(lookups.memory["t"]) == 2
    (root / "b.py").write_text("x = 1")
    with pytest.raises(pipeline.Refused):
        pipeline.build(spark, settings, str(tmp_path / "index.scip"))
    with pytest.raises(ValueError):
        pipeline.build(spark, settings)  # a backend that needs an index doesn't turn into another
    with pytest.raises(AttributeError):
        stores.manifset  # noqa: B018
    assert pipeline.doctor(spark, pipeline.Stores(str(tmp_path / "none"))).where("status = 'fail'").count() == 6


def test_stages_by_name(spark, tmp_path):
    root = tree(tmp_path)
    (root / "src/bad.ts").write_bytes(b"class B { \xff }\nexport const x = 1;\nimport a from 'a';\n/** d */\n" + b"\n" * 12)
    (root / "bad.json").write_bytes(b'{"a": "\xff", "type ": "class function const let import "}')
    path = tmp_path / "s.ini"
    path.write_text(f"[DEFAULT]\nproject = demo\nsource_root = {root}\nstore_root = {tmp_path / 'stores'}\ngraph_backend = source\nmin_score = 0\n")
    settings = pipeline.load_settings(str(path))
    with pytest.raises(ValueError):
        pipeline.run_stage(spark, settings, "nothing")
    assert pipeline.main([str(path), "json"]) == 1  # no manifest yet
    assert [pipeline.main([str(path), stage]) for stage in pipeline.STAGES] == [0] * 5
    assert pipeline.main([str(path), "doctor"]) == 0 and pipeline.main([str(tmp_path / "none.ini"), "all"]) == 1
    stores = pipeline.Stores(settings.store_root)
    assert [r["relative_path"] for r in spark.read.parquet(stores.rejects).collect()] == ["demo/src/bad.ts"]
    assert [r["relative_path"] for r in spark.read.parquet(stores.json).collect()] == ["demo/package.json"]
    checks = pipeline.doctor(spark, stores, str(path))
    assert {r["status"]: r["n"] for r in pipeline.tallies(checks).collect()} == {"pass": 7, "warn": 1}  # some settings are left at their defaults
    manifest = corpus.read_manifest(spark, stores.manifest_json, lines=True)
    assert manifest.where("relative_path = 'demo/src/a.ts'").first()["language"] == "typescript"
    (tmp_path / "m.json").write_text(json.dumps([{"relative_path": "a.ts", "score": 7, "reasons": ["x"]}, {"relative_path": "b.ts"}], indent=1))
    assert [(r["relative_path"], r["score"]) for r in corpus.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("a.ts", 7), ("b.ts", None)]
    assert audit.typescript_files(spark.read.parquet(stores.manifest)) == 2
    g = graph.read(spark, stores.graph)
    graph.export_json(g, str(tmp_path / "json"))
    for what, rows in (("nodes", g.nodes), ("edges", g.edges)):
        lines = [json.loads(line) for f in (tmp_path / "json" / what).glob("*.json") for line in f.read_text().splitlines()]
        assert sorted(x["id"] for x in lines) == sorted(r["id"] for r in rows.collect())
    whole = {what: [json.loads(line) for f in (tmp_path / "json" / what).glob("*.json") for line in f.read_text().splitlines()] for what in ("nodes", "edges")}
    (tmp_path / "graph.json").write_text(json.dumps(whole, indent=1))
    again = graph.read_json(spark, str(tmp_path / "graph.json"))
    assert again.nodes.count() == g.nodes.count() and sorted(r["source"] for r in again.edges.collect()) == sorted(r["source"] for r in g.edges.collect())
    pipeline.wipe(spark, stores)
    assert pipeline.doctor(spark, stores).where("status = 'fail'").count() == 6
    assert config.missing_modules(("json", "no_such_module")) == ["no_such_module"] and "query_prefix" in config.missing_keys(str(path))


def test_failed_embeddings_are_made_again(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}", f"text {i}") for i in range(20)], "relative_path string, content string")
    nodes = spark.createDataFrame([], "id string, name string, filePath string, line int, type string")

    def broken(texts):
        if any("f7" in t for t in texts):
            raise OSError("no server")
        return vectors.hashed_provider(texts)

    store = str(tmp_path / "cards")
    cards.write_cards(cards.build_cards(files.coalesce(1), nodes, provider=broken), store)
    done = spark.read.parquet(store)
    left = {r["relative_path"] for r in cards.pending(files, done).collect()}
    assert "f7" in left and len(left) == vectors.BATCH and done.where("embedding IS NULL").count() == 0
    cards.write_cards(cards.build_cards(cards.pending(files, done), nodes), store, resume=True)
    assert spark.read.parquet(store).count() == 20 and cards.pending(files, cards.build_cards(files, nodes, provider=broken)).count() == vectors.BATCH


def test_json_in_manifest_order(spark):
    from siltstone.operators import jsonstore

    rows = spark.createDataFrame([("a.json", "[2]", 1, 10), ("a.json", "[1]", 1, 10), ("a.json", "[9]", 3, 10), ("b.json", "{", 1, 10)], "relative_path string, content string, score int, size long")
    assert [(r["content"], r["score"]) for r in jsonstore.store(rows).collect()] == [("[9]", 3)]


def test_resume(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "relative_path string, content string")
    nodes = spark.createDataFrame([], "id string, name string, filePath string, line int, type string")
    done = cards.build_cards(files.where("relative_path = 'a'"), nodes)
    assert [r["relative_path"] for r in cards.pending(files, done).collect()] == ["b"]
    changed = spark.createDataFrame([("a", "9"), ("b", "2")], "relative_path string, content string")
    assert cards.pending(changed, done, by_content=True).count() == 2

    def broken(path, code):
        raise TimeoutError

    assert cards.build_cards(files, nodes, broken).select("summary").distinct().collect()[0][0] == cards.FALLBACK


def test_stream(spark, tmp_path):
    root = tree(tmp_path)
    nodes = spark.createDataFrame([], "id string, name string, filePath string, line int, type string")
    store, marks = str(tmp_path / "cards"), str(tmp_path / "marks")
    for expected in (3, 3, 4):
        if expected == 4:
            (root / "new.md").write_text("More to read about shapes.")
        ingest.stream_cards(ingest.stream_files(spark, str(root), "demo"), nodes, store, marks).awaitTermination()
        assert spark.read.parquet(store).count() == expected


def test_fallback(spark):
    from siltstone.operators import fallback

    a = (
        "import { P } from './b';\nexport abstract class Shape extends Base implements P, Q<string> {\n  x = 1;\n  constructor() { super(); setUp(1); }\n"
        "  static async draw(a: number, b = f(2, 3)): Promise<void> {\n    helper(a);\n    this.draw(a);\n  }\n}\nclass Base {}\nexport async function helper(a) {\n  return other(a);\n}\n"
    )
    b = "export interface P extends Q {\n  a: number;\n  b?: string;\n  c(): void;\n}\ninterface Q {}\n"
    files = spark.createDataFrame([("p/a.ts", a), ("p/b.ts", b), ("p/n.md", "x"), ("p/c.json", "{}"), ("p/bad.js", "`")], "relative_path string, content string")
    g = fallback.build(files)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert {i for i in nodes if not i.endswith("unresolved.file")} == {
        "File::a.ts::p/a.ts", "File::b.ts::p/b.ts", "Config::n.md::p/n.md", "File::bad.js::p/bad.js", "Class::Shape::p/a.ts", "Class::Base::p/a.ts", "Method::draw::p/a.ts",
        "Function::helper::p/a.ts", "Interface::P::p/b.ts", "Interface::Q::p/b.ts",
    }
    shape, draw, p = nodes["Class::Shape::p/a.ts"], nodes["Method::draw::p/a.ts"], nodes["Interface::P::p/b.ts"]
    assert (shape["isAbstract"], shape["isExported"], shape["members"], shape["line"]) == (True, True, 3, 2)
    assert (draw["isStatic"], draw["isAsync"], draw["parameters"]) == (True, True, 2) and p["properties"] == 2
    edges = {(r["type"], r["source"].split("::")[1], r["target"].split("::", 1)[1], r["callLine"]) for r in g.edges.collect()}
    assert edges == {
        ("INHERITS", "Shape", "Base::p/a.ts", None), ("IMPLEMENTS", "Shape", "P::p/b.ts", None), ("IMPLEMENTS", "Shape", "Q<string>::unresolved.file", None),
        ("DEFINED_IN", "draw", "Shape::p/a.ts", None), ("CALLS", "Shape", "super::unresolved.file", 4), ("CALLS", "Shape", "setUp::unresolved.file", 4),
        ("CALLS", "draw", "helper::p/a.ts", 6), ("CALLS", "draw", "draw::p/a.ts", 7), ("CALLS", "helper", "other::unresolved.file", 12), ("INHERITS", "P", "Q::p/b.ts", None),
    }
    assert graph.resolved(g).count() == len(edges)


def test_fallback_across_files(spark, tmp_path):
    """Calls of what other files export, under other names too; calls of packages are left out; namespaces and function values."""
    from siltstone.operators import fallback

    a = (
        "import { helper as h, type T } from './lib/util';\nimport * as tools from '../q/tools.js';\nimport lodash from 'lodash';\nimport { join } from 'path';\n"
        "export function run(x) {\n  h(x);\n  tools.sharpen(x);\n  lodash.map(x);\n  join(x);\n  arrow(x);\n  gone(x);\n  x.other();\n}\nconst arrow = async (y: number) => y;\nconst unused = (z) => z;\n"
        "export namespace Inner {\n  export function deep() {\n    run(1);\n  }\n}\n"
    )
    files = {"p/a.ts": a, "p/lib/util/index.ts": "export function helper(a) {}\n", "q/tools.ts": "export function sharpen(a, b) {}\n", "p/other.ts": "export function helper() {}\n"}
    frame = spark.createDataFrame(list(files.items()), "relative_path string, content string")
    g = fallback.build(frame, str(tmp_path / "rejects"))
    edges = {(r["source"], r["target"], r["callLine"]) for r in g.edges.where("type = 'CALLS'").collect()}
    run = "Function::run::p/a.ts"
    assert edges == {
        (run, "Function::helper::p/lib/util/index.ts", 6), (run, "Function::sharpen::q/tools.ts", 7), (run, "Function::arrow::p/a.ts", 10),
        (run, "Function::gone::unresolved.file", 11), (run, "Function::other::unresolved.file", 12), ("Function::deep::p/a.ts", run, 18),
    }
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert "Function::unused::p/a.ts" not in nodes and nodes["Function::arrow::p/a.ts"]["isAsync"] and nodes["Function::arrow::p/a.ts"]["line"] == 14
    assert nodes["Function::deep::p/a.ts"]["isExported"] and spark.read.parquet(str(tmp_path / "rejects")).count() == 0


def test_fallback_reads_sources_once(spark, tmp_path, monkeypatch):
    """One pass over the texts, whatever the graph is asked; files that can't be read are told."""
    from siltstone.operators import fallback

    frame = spark.createDataFrame([("p/a.ts", "function f() { g(); }\n")] * 1, "relative_path string, content string")
    g = fallback.build(frame)
    plan = graph.resolved(g)._jdf.queryExecution().executedPlan().toString() + g.nodes._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    deep = "f(" * 20_000
    fallback.build(spark.createDataFrame([("p/deep.ts", deep), ("p/ok.ts", "class A {}")], "relative_path string, content string"), str(tmp_path / "r"))
    assert [(r["filePath"], r["error"][:14]) for r in spark.read.parquet(str(tmp_path / "r")).collect()] == [("p/deep.ts", "RecursionError")]


def test_fallback_names_of_many(spark):
    """A base that its own file declares, one that others declare, first by path, and a name that every file has."""
    from siltstone.operators import fallback

    files = [(f"p/f{i}.ts", "class C {\n  m() {}\n}\nclass D extends C {}\n" + ("class Far {}\n" if i in (3, 7) else "class E extends Far {}\n" if i == 5 else "")) for i in range(40)]
    g = fallback.build(spark.createDataFrame(files, "relative_path string, content string"))
    edges = {(r["type"], r["source"], r["target"]) for r in g.edges.collect()}
    assert edges == {("DEFINED_IN", f"Method::m::p/f{i}.ts", f"Class::C::p/f{i}.ts") for i in range(40)} | {("INHERITS", f"Class::D::p/f{i}.ts", f"Class::C::p/f{i}.ts") for i in range(40)} | {
        ("INHERITS", "Class::E::p/f5.ts", "Class::Far::p/f3.ts")
    }


def test_index_in_parts(spark, tmp_path):
    """One index of 100 documents: several tasks, one parse, and the same rows as of the whole."""
    documents = [field(1, f"src/f{d}.ts") + b"".join(occurrence(f"{P}C{d}#m{i}().", [i, 0, 5], 1, [i, 0, i + 1, 0]) for i in range(30)) for d in range(100)]
    documents[7] += field(3, field(1, P + "C7#") + field(4, field(1, P + "C8#") + field(3, 1)))
    data = field(1, b"meta") + b"".join(field(2, d) + field(3, b"skip" * i) for i, d in enumerate(documents))
    (tmp_path / "whole.scip").write_bytes(data)
    occurrences, relations = scip.read_scip(spark, str(tmp_path / "whole.scip"), partition_bytes=len(data) // 8)
    want = scip.parse_index(data)
    assert sorted(map(tuple, occurrences.collect())) == sorted(want[0]) and list(map(tuple, relations.collect())) == want[1] and len(want[0]) == 3000
    reader = scip.ScipReader([str(tmp_path / "whole.scip")], len(data) // 8)
    parts = reader.partitions()
    assert 8 <= len(parts) <= 12 and sum(len(p.spans) for p in parts) == 100
    manifest = spark.createDataFrame([(f"demo/src/f{d}.ts",) for d in range(100)], "relative_path string")
    built = graph.build(occurrences, relations, manifest, "demo")
    plan = built.edges._jdf.queryExecution().executedPlan().toString() + built.nodes._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" not in plan and plan.count("MapInArrow") == 1 and built.nodes.count() == 3100  # the index is parsed already; what is left is the sweep
    assert "Generate" not in plan  # no container is repeated
    (tmp_path / "two").mkdir()
    for name in ("a.scip", "b.scip"):
        (tmp_path / "two" / name).write_bytes(index())
    twice, _ = scip.read_scip(spark, str(tmp_path / "two"))
    assert twice.count() == 22 and twice.select("doc").distinct().count() == 4
    (tmp_path / "cut.scip").write_bytes(data[:-3])
    (tmp_path / "none.scip").write_bytes(b"")
    with pytest.raises(Exception, match="cut short"):
        scip.read_scip(spark, str(tmp_path / "cut.scip"))
    assert scip.read_scip(spark, str(tmp_path / "none.scip"))[0].count() == 0


def test_doctor_of_settings_and_models(spark, tmp_path):
    root = tree(tmp_path)
    settings = Settings(project="demo", source_root=str(root), store_root=str(tmp_path / "stores"), graph_backend="source")
    stores = pipeline.build(spark, settings)
    said = lambda **more: {r["store"].split(":")[0]: (r["status"], r["rows"], r["store"]) for r in pipeline.doctor(spark, stores, **more).collect()}
    found = said(settings=settings, provider=vectors.hashed_provider)
    assert found["sources"] == ("pass", 3, "sources: 1 TypeScript") and found["languages"][0] == found["backend"][0] == found["rejects"][0] == found["embeddings"][0] == "pass"
    (root / "b.py").write_text("x = 1")
    (root / "bad.md").write_bytes(b"# \xff\n" * 20)
    pipeline.run_stage(spark, settings, "audit", override=True)
    pipeline.run_stage(spark, settings, "cards", by_content=True)
    later = said(settings=Settings(project="demo", source_root=str(root), store_root=stores.root, graph_backend="scip"), provider=lambda texts: [[0.0] * 7 for _ in texts])
    assert later["languages"] == ("warn", 1, "languages: python") and later["backend"][0] == "fail" and later["embeddings"][:2] == ("fail", 7)
    gone = said(settings=Settings(source_root=str(tmp_path / "none"), store_root=stores.root, graph_backend="source"), provider=lambda texts: 1 / 0)
    assert gone["sources"][0] == "fail" and "ZeroDivisionError" in gone["embeddings"][2]


def test_occurrences_are_read_once(spark):
    symbol = F.concat(F.lit("scip-typescript npm s 1.0 src/`a.ts`/f"), F.col("id"), F.lit("()."))
    rows = spark.range(4).select(
        F.lit(1).cast("long").alias("doc"), F.col("id").cast("int").alias("ord"), F.lit("src/a.ts").alias("relative_path"), symbol.alias("symbol"), F.lit(1).alias("roles"),
        F.array(F.col("id").cast("int"), F.lit(0), F.lit(3)).alias("range"), F.lit(None).cast("array<int>").alias("enclosing"),
    )
    none = spark.createDataFrame([], "doc long, ord int, relative_path string, source string, target string, is_implementation boolean")
    built = graph.build(rows, none, spark.createDataFrame([("p/src/a.ts",)], "relative_path string"), "p")
    assert "Range (" not in built.edges._jdf.queryExecution().optimizedPlan().toString() and built.nodes.count() == 5
