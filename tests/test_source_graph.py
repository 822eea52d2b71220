"""Graphs of sources: what a file settles by itself, and what is read without tokens."""

import random

from siltstone.operators import fallback, graph, modules
from siltstone.operators.parser import Parser

PLAIN = 'import { x } from "y";\n\nexport class C extends B.D {\n  m(a) {\n    a += 1;\n    return run(a);\n  }\n\n  n() {\n    return this.m("}");\n  }\n}\n'


class Slow(Parser):
    def plain_methods(self, out):
        pass

    def plain_statements(self, out):
        pass


def tree(nodes):
    return nodes if nodes is None else [(n.kind, n.start, n.end, n.name, tree(n.children), tree(n.body)) for n in nodes]


def test_plain_sources_need_no_tokens(monkeypatch):
    plain = Parser.read

    def refused(self):
        assert not plain(self), self.tokens[-1]
        return False

    monkeypatch.setattr(Parser, "read", refused)
    inside, outside = (Parser(PLAIN, True).statements()[i] for i in (0, 1))
    assert inside.kind == "import_statement" and [m.name for m in outside.children[0]._body] == ["m", "n"]


def test_plain_heads_and_all_tokens():
    """Heads by patterns against heads by tokens, in any surroundings."""
    rng = random.Random(7)
    parts = [
        "import { a, b as c } from './x';", "import d, * as e from \"y\" ;", "import {a}\nfrom './x'\n", "import { class } from './q';", "import 'z';", "export ", "default ", "abstract ", "class C {", "class D extends a.C {",
        "export class E implements A, B<C> {", "class extends ", "m(a) {", "get(x) {\n", "constructor(q, r) {", "async n() {", "if (a) {", "for (const x of y) {", "function f(a) {", "const g = (x) => {", "}", "}", "}\n", "};", ")", "(",
        "[", "]", "{", "run(a);", "\n", "\n", " ", ";", ",", "// c(\n", "/** d( */\n", "'s('", "'", '"', "`u${v}`", "`", "a / b", "/re(/g", "<", "@dec ", "interface I {", "x = 1", "é", "#p", "\\",
    ]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        made = []
        for reader in (Parser, Slow):
            try:
                made.append(tree(reader(text, True).statements()))
            except (ValueError, IndexError, AttributeError) as e:
                made.append(type(e))
        assert made[0] == made[1], text


def test_a_file_settles_its_own(spark, monkeypatch):
    """References that a file's own declarations settle, and calls that nothing can, meet no join; nodes and edges are read off one pass."""
    plain, made = fallback.staged, {}

    def noted(df, name):
        made[name] = plain(df, name)
        return made[name]

    monkeypatch.setattr(fallback, "staged", noted)
    files = [("p/a.ts", PLAIN.replace(" extends B.D", "")), ("p/b.ts", "class A {\n  m() { gone(); }\n}\nclass B extends A {\n  n() { this.m(); this.k(); }\n}\n"), ("p/c.md", "class"), ("p/d.json", "{}")]
    g = fallback.build(spark.createDataFrame(files, "relative_path string, content string"))
    assert [r["target"] for r in made["asking"].collect()] == ["k"]  # a class above may have it
    assert "Join" not in graph.resolved(g)._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["type"], r["source"], r["target"]) for r in g.edges.collect()} == {
        ("DEFINED_IN", "Method::m::p/a.ts", "Class::C::p/a.ts"), ("DEFINED_IN", "Method::n::p/a.ts", "Class::C::p/a.ts"), ("CALLS", "Method::m::p/a.ts", "Function::run::unresolved.file"),
        ("CALLS", "Method::n::p/a.ts", "Method::m::p/a.ts"), ("DEFINED_IN", "Method::m::p/b.ts", "Class::A::p/b.ts"), ("DEFINED_IN", "Method::n::p/b.ts", "Class::B::p/b.ts"),
        ("CALLS", "Method::m::p/b.ts", "Function::gone::unresolved.file"), ("INHERITS", "Class::B::p/b.ts", "Class::A::p/b.ts"), ("CALLS", "Method::n::p/b.ts", "Method::m::p/b.ts"),
        ("CALLS", "Method::n::p/b.ts", "Function::k::unresolved.file"),
    }
    assert sorted(r["id"] for r in g.nodes.where("filePath = 'p/c.md' OR filePath = 'p/d.json'").collect()) == ["Config::c.md::p/c.md"]


def test_every_end_is_a_node(spark):
    """Edges of sources are closed as they are made: the join that would check it finds the same. A function that is also a constant is a node."""
    files = {
        "p/a.ts": "import { f as g, Gone } from './b';\nimport * as b from './b';\nexport class A extends Gone implements I, J<K> {\n  constructor() { super(); g(); b.h(); b.none(); }\n}\n",
        "p/b.ts": "const f = (a) => 1;\nexport namespace N {\n  export function f() { h(); }\n}\nexport const h = () => f();\nexport { f };\nclass Far extends Base { m() { this.m(); this.up(); } }\n",
        "p/c.ts": "const k = (a) => 1;\nexport class Base {\n  up() {}\n  up(a) { lost(); }\n}\nclass Base {}\ninterface I extends L {}\nfunction dup() {}\nfunction dup() { dup(); }\n", "p/d.py": "x", "p/e.ts": None,
    }
    g = fallback.build(spark.createDataFrame(list(files.items()), "relative_path string, content string"))
    rows = lambda df: sorted(map(str, df.collect()))
    checked = graph.resolved(graph.Graph(g.nodes, g.edges)).select(*g.edges.columns)
    assert g.closed and rows(graph.resolved(g)) == rows(checked) and len(rows(checked)) == g.edges.count() > 15
    ids = [r["id"] for r in g.nodes.collect()]
    assert len(ids) == len(set(ids)) and "Function::f::p/b.ts" in ids and "Function::k::p/c.ts" not in ids


def test_statements_with_and_without_texts(spark):
    """What hands names on is the same read off texts at once or beforehand, and a text that says nothing has an empty array, which is cheap to hand over."""
    files = spark.createDataFrame(
        [("p/a.ts", "import d, { x as y } from './b'; // export * from './no'\nexport { y as z };\nexport default d;\n"), ("p/b.ts", "xexport * from './a';\nexport * as n from './a';"), ("p/c.ts", "let from = 1;")],
        "filePath string, content string",
    )
    before = files.select("filePath", modules.statements(files["content"]).alias("said"))
    assert [len(r["said"]) for r in before.orderBy("filePath").collect()] == [3, 1, 0]
    for one, other in zip(modules.facts(files), modules.facts(before), strict=True):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect())) != []
