"""Splitting of code and prose."""

import random
import re

from pyspark.sql import functions as F

from siltstone.functions.paths import JAVASCRIPT, TYPESCRIPT
from siltstone.functions.text import bounded, first_lines, like_search, plain_doc
from siltstone.operators import chunks
from siltstone.operators.parser import Parser, plain_end, split
from siltstone.operators.textsplit import split_text

TS = (
    'import { a } from "a";\nimport type { B } from "./b";\n\n/**\n * A registry of shapes.\n */\nexport class Shapes extends Base<B> implements Set {\n'
    + "  private readonly size: number = 3;\n  names: string[] = [];\n\n  constructor(private a: number, b = { c: 1 }) {\n    super();\n  }\n\n  /** Draws. */\n  draw(n: number): string {\n"
    + "    const t = `x${n > 1 ? `${n}` : '}'}`;\n" * 12
    + "    return t.replace(/[/}]\"/g, '');\n  }\n"
    + "".join(f"\n  m{i}<T>(x: T): T | undefined {{\n    if (x) {{\n      return x;\n    }}\n    return undefined;\n  }}\n" for i in range(5))
    + "}\n\nexport const f = (x: number) => {\n  return x;\n};\n\ninterface P {\n  a: number;\n  b(): void;\n}\n\ntype U = { a: 1 } | { b: 2 };\n"
)


def shape(found):
    return [(c.chunk_type, c.hierarchical_name, c.start_line, c.end_line) for c in found]


def test_typescript_atoms():
    found = split(TS, "shapes.ts", TYPESCRIPT)
    names = [c.hierarchical_name for c in found]
    assert names[:3] == ["shapes.import_statement_L0", "shapes.import_statement_L1", "shapes.comment_L3"]
    assert names[3:8] == ["shapes.Shapes.size", "shapes.Shapes.names", "shapes.Shapes.constructor", "shapes.Shapes.comment_L14", "shapes.Shapes.draw"]
    draw = found[7]
    assert (draw.chunk_type, draw.start_line, draw.end_line, draw.jsdoc_text) == ("method_definition", 15, 29, "/** Draws. */")
    assert names[8:13] == [f"shapes.Shapes.m{i}" for i in range(5)]
    assert [c.chunk_type for c in found[13:]] == ["lexical_declaration", "interface_declaration"]
    for c in found:
        assert TS.encode()[c.start_byte : c.end_byte].decode() == c.source_text


def test_javascript_short_class_is_one_chunk():
    text = "class A {\n  x = 1;\n  go() {\n    return 1;\n  }\n}\n\nasync function long(a) {\n" + "  while (a) {\n    a -= 1;\n  }\n" * 4 + "}\nmodule.exports = { A };\n"
    assert shape(split(text, "m.js", JAVASCRIPT)) == [("class_declaration", "m.A", 0, 5), ("function_declaration", "m.long", 7, 20)]


def test_long_statements_are_entered():
    body = "    work();\n" * 60
    text = "function run() {\n  try {\n" + body + "    if (a) {\n      b();\n    }\n  } catch (e) {\n    // gone\n  }\n}\n"
    assert shape(split(text, "r.js", JAVASCRIPT)) == [("if_statement", "r.run.try_statement_L1.if_statement_L62", 62, 64)]


def test_odd_sources():
    for text in ("", "}", "class", "export", "`", "'", "/*", "function (", "if", "a = b\n/c/d", "é = 1", "x.class = 1", "@a class B {}", "{" * 50):
        split(text, "x.ts", TYPESCRIPT)


def atoms(spark, rows):
    return spark.createDataFrame(rows, "file string, chunk_type string, hierarchical_name string, source_text string, start_line int, end_line int, start_byte int, end_byte int, jsdoc_text string")


def test_merge(spark):
    spans = [("r.a", 0, 0), ("r.b", 2, 5), ("r.C.x", 8, 9), ("r.C.y", 12, 30), ("r.C.z", 33, 41), ("r.C.w", 43, 51), ("r.C.v", 53, 60), ("r.C.u", 80, 84)]
    rows = [("f", "t", n, n, s, e, s * 10, e * 10 + 5, None) for n, s, e in spans]
    got = chunks.merge_table(atoms(spark, rows)).orderBy("start_byte").collect()
    assert [(r["chunk_type"], r["hierarchical_name"], r["start_line"], r["end_line"]) for r in got] == [
        ("merged_block", "r.merged_L0_L5", 0, 5), ("merged_block", "r.C.merged_L8_L9", 8, 9), ("t", "r.C.y", 12, 30), ("merged_block", "r.C.merged_L33_L60", 33, 60),
        ("merged_block", "r.C.merged_L80_L84", 80, 84),
    ]
    assert got[0]["source_text"] == "r.a\n\nr.b"


def test_text_split():
    assert split_text("") == [] and split_text("short") == ["short"]
    text = "\n\n".join(f"paragraph {i} " + "word " * 40 for i in range(6))
    parts = split_text(text)
    assert all(len(p) <= 512 for p in parts) and parts[0].startswith("paragraph 0")
    assert [p for p in parts if p.startswith("paragraph")] == parts
    long = "x" * 1200
    assert [len(p) for p in split_text(long)] == [512, 512, 276]
    assert split_text("a b c d e f", size=5, overlap=2) == ["a b c", "c d", "d e", "e f"]


def test_documents(spark):
    files = spark.createDataFrame([("p/a.ts", TS), ("p/r.md", "words " * 200), ("p/c.json", "{}"), ("p/e.ts", "")], "relative_path string, content string")
    documents, rejects = chunks.chunk_documents(files)
    got = documents.collect()
    assert {r["source_file"] for r in got} == {"p/a.ts", "p/r.md"} and rejects.count() == 0
    prose = sorted((r for r in got if r["source_file"] == "p/r.md"), key=lambda r: r["hierarchical_name"])
    assert prose[0]["chunk_type"] == ".md_file" and prose[0]["hierarchical_name"] == "r.md_chunk_1"
    assert prose[0]["page_content"].startswith("// Context: File: p/r.md | Chunk: 1\n\nwords")
    draw = next(r for r in got if r["hierarchical_name"] == "a.Shapes.draw")
    assert draw["page_content"].startswith("// Documentation:\nDraws.\n\n// Context: File: p/a.ts | Chunk: a > Shapes > draw\n\n\ndraw(")


def test_text_functions(spark):
    row = spark.createDataFrame([("/**\n * One.\n *\n *   Two  \n */", "É%_x", "abcdef")], "c string, s string, t string")
    out = row.select(plain_doc(F.col("c")), bounded(F.col("t"), 3), bounded(F.lit(None).cast("string"), 3), like_search([F.col("s")], "é"), like_search([F.col("s")], "X"), like_search([F.col("s")], "%_X")).first()
    assert tuple(out) == ("One.\nTwo", "abc […]", "", False, True, True)


def test_plain_bodies_are_passed_over():
    lines = "    a += 1;\n" * 1000
    reader = Parser("class C {\n  m(a) {\n" + lines + "    '}'; // }\n  }\n  async n() {\n" + lines + "  }\n}\n", True)
    [node] = reader.statements()
    assert len(reader.tokens) < 40 and [(m.kind, m.name) for m in node.body] == [("method_definition", "m"), ("method_definition", "n")]
    assert [len(m.body) for m in node.body] == [1002, 1000] and node.body[0].body[-1].kind == "comment"
    for odd in ("a < b; return { c }", "return class { d() { e(); } }", "x / y; }/", "return [) }"):
        assert plain_end("{ " + odd + " }", 0) is None, odd
    assert plain_end("{ `${'}'}` + \"}\"; /* } */ }", 0) == 27


def test_first_lines(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bc", "\n", "\r", "\r\n", ""]) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[first_lines(F.col("t"), n).alias(f"n{n}") for n in (1, 2, 4)])
    for r in made.collect():
        assert [r["n1"], r["n2"], r["n4"]] == ["\n".join(re.split("\r\n|\r|\n", r["t"])[:n]) for n in (1, 2, 4)], r
    assert "split(" not in made._jdf.queryExecution().analyzed().toString()  # a text isn't cut into all of its lines
