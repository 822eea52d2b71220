"""Names over imports, re-exports and inheritance against plain Python."""

import random

from pyspark.sql import functions as F

from siltstone.operators import fallback, modules


def test_facts(spark):
    a = (
        "import D, { x as y, type T } from './b';\nimport * as all from '../q/c.js';\nimport { join } from 'path';\n// import { no } from './no';\n/* export * from './no' */\n"
        "export * from './d/index';\nexport * as ns from '../../e';\nexport { one,\n two as three, default as four } from './f.tsx';\nexport { y as z, own };\nexport default class Main extends D {}\n"
    )
    files = spark.createDataFrame([("p/s/a.ts", a), ("p/q/index.js", "export default async function go() {}\nexport * from 'pkg';\n"), ("p/n.ts", None)], "filePath string, content string")
    imports, exports = modules.facts(files)
    assert {tuple(r) for r in imports.collect()} == {
        ("p/s/a.ts", "D", "p/s/b", "default"), ("p/s/a.ts", "y", "p/s/b", "x"), ("p/s/a.ts", "T", "p/s/b", "T"), ("p/s/a.ts", "all", "p/q/c", "*"), ("p/s/a.ts", "join", None, "join"),
    }
    assert {tuple(r) for r in exports.collect()} == {
        ("p/s/a", "*", "p/s/d/index", "*"), ("p/s/a", "ns", "e", "*"), ("p/s/a", "one", "p/s/f", "one"), ("p/s/a", "three", "p/s/f", "two"), ("p/s/a", "four", "p/s/f", "default"),
        ("p/s/a", "z", "p/s/b", "x"), ("p/s/a", "default", "p/s/a", "Main"), ("p/q", "default", "p/q/index", "go"), ("p/q/index", "default", "p/q/index", "go"),
    }


def plain(ask, declared, exports):
    """By rounds: the nearest declaration, one that was named before one that was exported as a whole, then the least id."""
    front, seen = {(*ask, 0)}, set()
    while front:
        hits = [(starred, declared[s, n]) for s, n, starred in front if (s, n) in declared]
        if hits:
            return min(hits)[1]
        seen |= {(s, n) for s, n, _ in front}
        further = {}
        for s, n, starred in front:
            for stem, known, to, name in exports:
                if stem == s and (known == n or (known == "*" and n != "default")):
                    key = (to, n if known == "*" else name)
                    if key not in seen:
                        further[key] = min(further.get(key, 1), 1 if known == "*" else starred)
        front = {(*k, v) for k, v in further.items()}
    return None


def test_names_against_rounds(spark):
    """Random modules with circles, several ways and names that lead nowhere."""
    rng = random.Random(6)
    stems, names = [f"m{i}" for i in range(25)], [f"n{i}" for i in range(8)] + ["default"]
    declared = {(rng.choice(stems), rng.choice(names)): f"id{i:02d}" for i in range(15)}
    exports = {(rng.choice(stems), k, rng.choice(stems), "*" if k == "*" else rng.choice(names)) for k in rng.choices([*names, "*", "*", "*"], k=60)}
    asked = [(s, n) for s in stems for n in names]
    got = modules.resolved_names(
        spark.createDataFrame([(s, n, "Function") for s, n in asked], "stem string, name string, type string"),
        spark.createDataFrame([(s, n, "Function", i) for (s, n), i in declared.items()], "stem string, name string, type string, id string"),
        spark.createDataFrame(list(exports), "stem string, known string, to_stem string, to_name string"),
    ).collect()
    want = {(s, n): i for s, n in asked if (i := plain((s, n), declared, exports))}
    assert {(r["stem"], r["name"]): r["id"] for r in got} == want and len(got) == len(want) > len(declared)


def test_inherited_members(spark):
    bases = [("A", "B"), ("B", "C"), ("C", "A"), ("D", "B"), ("D", "E"), ("F", "Gone")]
    members = [("C", "x", "C.x"), ("E", "x", "E.x"), ("B", "y", "B.y"), ("A", "y", "A.y")]
    asked = [(o, n) for o in "ABCDEF" for n in "xyz"]
    got = modules.inherited(spark.createDataFrame(asked, "owner string, name string"), spark.createDataFrame(members, "owner string, name string, id string"), spark.createDataFrame(bases, "owner string, base string"))
    assert {(r["owner"], r["name"]): r["id"] for r in got.collect()} == {
        ("A", "x"): "C.x", ("B", "x"): "C.x", ("C", "x"): "C.x", ("D", "x"): "E.x", ("E", "x"): "E.x", ("A", "y"): "A.y", ("B", "y"): "B.y", ("C", "y"): "A.y", ("D", "y"): "B.y"
    }


def test_graph_over_barrels(spark):
    """A base by import before one of the same name elsewhere; a default class; a method of a base in another file."""
    files = {
        "p/a/base.ts": "export class Base {\n  hum() {\n  }\n}\n", "p/0/base.ts": "export class Base {\n  hum() {\n  }\n}\n", "p/a/index.ts": "export { Base as Root } from './base';\nexport * from './util';\n",
        "p/a/util.ts": "export function tool() {\n}\n", "p/d.ts": "import { Root as Base, tool } from './a';\nexport default class Main extends Base {\n  run() {\n    this.hum();\n    tool();\n  }\n}\n",
        "p/e.ts": "import Whatever from './d';\nclass Sub extends Whatever {\n  go() {\n    this.hum();\n    this.lost();\n  }\n}\n",
    }
    g = fallback.build(spark.createDataFrame(list(files.items()), "relative_path string, content string"))
    edges = {(r["type"], r["source"], r["target"]) for r in g.edges.where(F.col("type") != "DEFINED_IN").collect()}
    hum = "Method::hum::p/a/base.ts"
    assert edges == {
        ("INHERITS", "Class::Main::p/d.ts", "Class::Base::p/a/base.ts"), ("CALLS", "Method::run::p/d.ts", hum), ("CALLS", "Method::run::p/d.ts", "Function::tool::p/a/util.ts"),
        ("INHERITS", "Class::Sub::p/e.ts", "Class::Main::p/d.ts"), ("CALLS", "Method::go::p/e.ts", hum), ("CALLS", "Method::go::p/e.ts", "Function::lost::unresolved.file"),
    }


def test_rounds_read_declarations_worked_out_once(spark, monkeypatch):
    """Following a chain of modules, or of classes, doesn't work out all declarations anew in every round."""
    plain, made = modules.staged, []

    def noted(df, name):
        made.append((name, df.inputFiles()))
        return plain(df, name)

    monkeypatch.setattr(modules, "staged", noted)
    asked = spark.createDataFrame([("m0", "f", "Function")], "stem string, name string, type string")
    declared = spark.createDataFrame([("m3", "f", "Function", "id")], "stem string, name string, type string, id string")
    exports = spark.createDataFrame([(f"m{i}", "f", f"m{i + 1}", "f") for i in range(3)], "stem string, known string, to_stem string, to_name string")
    assert [tuple(r) for r in modules.resolved_names(asked, declared, exports).collect()] == [("m0", "f", "Function", "id")]
    owners = spark.createDataFrame([("c0", "go")], "owner string, name string")
    members = spark.createDataFrame([("c2", "go", "id")], "owner string, name string, id string")
    bases = spark.createDataFrame([("c0", "c1"), ("c1", "c2")], "owner string, base string")
    assert [tuple(r) for r in modules.inherited(owners, members, bases).collect()] == [("c0", "go", "id")]
    rounds = [files for name, files in made if name == "found"]
    assert len(rounds) == 7 and all(any("/known-" in f for f in files) for files in rounds) and [name for name, _ in made].count("known") == 2
