"""Paths, languages, audit, gate and sources."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import paths
from siltstone.operators import audit, gate
from siltstone.sources import config, corpus, tree


def table(spark, values, column):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def mapped(spark, values, function):
    rows = table(spark, values, "p").select("p", function(F.col("p")).alias("out")).collect()
    return {r["p"]: r["out"] for r in rows}


def test_extensions(spark):
    cases = {"a/b.D.TS": ".ts", "a/.bashrc": "", "x\\y.Js": ".js", "..x": ".x", "a.": ".", "Makefile": "", "a.b/c": "", "c++.c++": ".c++"}
    assert mapped(spark, cases, paths.ext_of) == cases


def test_providers(spark):
    cases = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", "ts": "typescript", ".TS": "typescript", ".py": None}
    assert mapped(spark, cases, paths.provider_for_ext) == cases
    assert mapped(spark, ["a/b.ts", "a\\b.ts", "a/b"], paths.provider_for_path) == {"a/b.ts": "typescript", "a\\b.ts": "typescript", "a/b": None}


def test_categories(spark):
    cases = {
        "src/a.ts": "CODE", "src/a.js": "CODE", "a.md": "TEXT", "a.mdx": "TEXT", "a.yml": "TEXT", "a.yaml": "TEXT", "package.json": "CONFIG", "a.py": "UNKNOWN",
        "Makefile": "UNKNOWN", "i.png": "UNKNOWN",
    }
    assert mapped(spark, cases, paths.classify) == cases


def test_support(spark):
    cases = {
        "a.ts": ("VALIDATED", "typescript"), "a.js": ("VALIDATED", "javascript"), "a.py": ("UNSUPPORTED", "python"), "a.go": ("UNSUPPORTED", "go"), "a.sh": ("UNSUPPORTED", "bash"),
        "a.cpp": ("UNSUPPORTED", "cpp"), "a.md": ("TEXT", None), "a.yml": ("TEXT", None), "a.json": ("CONFIG", None), "a.svg": ("IGNORED", None), "a.css": ("IGNORED", None),
    }
    assert {k: tuple(v) for k, v in mapped(spark, cases, paths.language_support).items()} == cases


def test_provider_rules(spark):
    with pytest.raises(ValueError):
        paths.LanguageProvider("x", ())
    with pytest.raises(ValueError):
        paths.LanguageProvider("x", ("ts",))
    with pytest.raises(ValueError):
        paths.LanguageProvider("x", (".x",), min_lines=60)
    with pytest.raises(ValueError):
        paths.registry((*paths.PROVIDERS, paths.LanguageProvider("x", (".ts",))))
    assert paths.all_extensions() == [".js", ".jsx", ".mjs", ".ts", ".tsx"]
    assert paths.validated_languages() == ["javascript", "typescript"]
    assert paths.provider_table(spark).count() == 2


CLEAN = ["p/src/a.ts", "p/src/b.js", "p/README.md", "p/package.json", "p/x.css", "p/i.svg"]
MIXED = ["p/a.ts", "p/b.py", "p/c.go", "p/d.sh", "p/e.py"]


def test_gate(spark):
    clean, mixed = (gate.coverage(table(spark, files, "relative_path")) for files in (CLEAN, MIXED))
    assert gate.decide(clean).proceed and gate.blocking(clean).count() == 0
    assert [(r["language"], r["count"]) for r in gate.blocking(mixed).orderBy("language").collect()] == [("bash", 1), ("go", 1), ("python", 2)]
    assert not gate.decide(mixed).proceed
    assert gate.decide(mixed, override=True).proceed
    assert gate.decide(mixed, ask=lambda _: " Y ").proceed and not gate.decide(mixed, ask=lambda _: "no").proceed
    assert gate.indexed(mixed).first()["files"] == 5
    assert "python" in gate.rendered(mixed)


def test_valid_files(spark):
    cases = [
        ("p/a.ts", 10, True), ("p/a.TS", 10, False), ("p/a.ts", 0, False), ("p/a.ts", 500_000, True), ("p/a.ts", 500_001, False), ("p/package.json", 999_999, True),
        ("p/package.json", 1_000_000, False), ("p/README.md", 0, True), ("p/a.min.js", 10, False), ("p/a.test.ts", 10, False), ("p/yarn.lock", 10, False), ("p/a.d.ts", 10, True),
    ]
    rows = spark.createDataFrame(cases, "p string, size long, want boolean")
    assert rows.where(audit.valid_file(F.col("p"), F.col("size")) != F.col("want")).count() == 0


def test_importance(spark):
    text = "/** d */\nexport class A {}\nconst a = require('x');\n" + "\n" * 12
    row = spark.createDataFrame([("p/src/package.json", text), ("p/a.ts", None)], "p string, c string").select(audit.importance(F.col("p"), F.col("c")).alias("i")).collect()
    assert tuple(row[0]["i"]) == (3 + 2 + 3 + 1 + 5 + 2, ["exports", "documented", "critical_config", "core_directory"], 15)
    assert tuple(row[1]["i"]) == (0, [], 0)


def test_scan(spark, tmp_path):
    for name, data in {
        "src/a.ts": b"x\r\ny\rz", "tmp/b.ts": b"no", "src/node_modules/c.js": b"no", "bad.md": b"ok\xff\xfe!", "empty.md": b"", "deep/er/d.json": b"{}"
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r["relative_path"]: r for r in corpus.scan(spark, str(tmp_path), "proj").collect()}
    assert sorted(rows) == ["proj/bad.md", "proj/deep/er/d.json", "proj/src/a.ts"]
    assert rows["proj/src/a.ts"]["content"] == "x\ny\nz" and rows["proj/bad.md"]["content"] == "ok!"
    assert not rows["proj/bad.md"]["strict"] and rows["proj/src/a.ts"]["strict"]


def test_strict_json(spark):
    cases = {'{"a": 1}': True, '{"a": 1} x': False, '{"a": NaN}': True, '{"a": 1, "a": 2}': True, "{a: 1}": False, "": False, "3": True, "// c\n{}": False}
    rows = corpus.strict_json(table(spark, [*cases, None], "content"), "content").collect()
    assert {r["content"]: r["valid"] for r in rows} == {**cases, None: False}


def test_settings(tmp_path):
    path = tmp_path / "c.ini"
    path.write_text("[DEFAULT]\nPROJECT = demo\nmin_score = 7\nother = x\n")
    assert config.load_settings(str(path)) == config.Settings(project="demo", min_score=7)
    with pytest.raises(FileNotFoundError):
        config.load_settings(str(tmp_path / "none.ini"))


def test_tree(spark, tmp_path):
    """What is pruned isn't listed, empty files are there, and of a huge file only its name is."""
    for name, data in {
        "src/a.ts": b"x\r\ny\rz", "tmp/b.ts": b"no", "src/node_modules/c.js": b"no", "bad.md": b"ok\xff\xfe!\xef\xbf\xbd", "README.md": b"", "deep/er/d.json": b"{}", "node_modules.md": b"yes"
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    with open(tmp_path / "huge.bin", "wb") as f:
        f.truncate(3 << 30)  # sparse: takes no room
    (tmp_path / "src" / "loop").symlink_to(tmp_path)
    (tmp_path / "src" / "nowhere.ts").symlink_to(tmp_path / "none")
    rows = {r["relative_path"]: r for r in tree.walk(spark, f"file://{tmp_path}", "proj").collect()}
    assert sorted(rows) == ["proj/README.md", "proj/bad.md", "proj/deep/er/d.json", "proj/huge.bin", "proj/node_modules.md", "proj/src/a.ts"]
    assert rows["proj/src/a.ts"]["content"] == "x\ny\nz" and rows["proj/bad.md"]["content"] == "ok!�" and rows["proj/README.md"]["content"] == ""
    assert (rows["proj/bad.md"]["strict"], rows["proj/README.md"]["strict"], rows["proj/huge.bin"]["strict"]) == (False, True, None)
    assert (rows["proj/huge.bin"]["content"], rows["proj/huge.bin"]["size"], rows["proj/README.md"]["size"]) == (None, 3 << 30, 0)
    same = {r["relative_path"]: r["content"] for r in corpus.scan(spark, str(tmp_path / "deep"), "proj").collect()}
    assert same == {"proj/er/d.json": "{}"}
    kept = audit.kept(audit.audited(tree.walk(spark, str(tmp_path), "proj")), 0).select("relative_path").collect()
    assert {r[0] for r in kept} == {"proj/README.md", "proj/bad.md", "proj/deep/er/d.json", "proj/node_modules.md", "proj/src/a.ts"}
    assert all(r["content"] is None for r in tree.walk(spark, str(tmp_path), "proj", content=False).collect())
    (tmp_path / "none_here").mkdir()
    assert tree.walk(spark, str(tmp_path / "none_here"), "p").count() == 0
    with pytest.raises(Exception, match="no_such_root"):
        tree.walk(spark, str(tmp_path / "no_such_root"), "p").count()


def test_tree_lists_no_pruned_folder():
    listed = []
    folders = {"/r": [("node_modules", True, 0), ("src", True, 0), ("a", False, 5)], "/r/src": [("dist", True, 0), ("b", False, 7), ("lib", True, 0)], "/r/src/lib": [("c", False, 0)]}
    folders |= {"/r/node_modules": [(f"f{i}", False, 1) for i in range(10_000)], "/r/src/dist": []}
    got = list(tree.walked("/r", lambda f: listed.append(f) or folders[f], frozenset(corpus.EXCLUDED_DIRS)))
    assert got == [("a", 5), ("src/b", 7), ("src/lib/c", 0)] and sorted(listed) == ["/r", "/r/src", "/r/src/lib"]


def test_tree_in_partitions(spark, tmp_path):
    files = [(f"f{i}", 10) for i in range(100)] + [("big", 1000), ("huge", 10**12)]
    groups = list(tree.dealt(iter(files), 10**6, 300))
    assert [f for g in groups for f in g] == files and all(sum(s for _, s in g if s < 10**6) <= 300 or len(g) == 1 for g in groups)
    for i in range(40):
        (tmp_path / f"f{i}.md").write_text("x" * 100)
    spark.dataSource.register(tree.FileTree)
    read = spark.read.format("filetree").options(path=str(tmp_path), partitionBytes="1000", excluded="").load()
    assert read.rdd.getNumPartitions() == 4 and sorted(r["relative_path"] for r in read.collect()) == sorted(f"f{i}.md" for i in range(40))
    place = tree.Place("mock://x")
    assert not place.local and tree.Place("file:///a/").base == "/a" and tree.Place("/").base == "/"
