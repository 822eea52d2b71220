"""Search through indexes against full scans."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions.text import like_search
from siltstone.operators import search, trigrams
from siltstone.operators.trigrams import TrigramIndex, grams_wanted
from siltstone.operators.vectorindex import VectorIndex


def texts(rng, n):
    word = lambda: "".join(rng.choice("abcdeXYé💡") for _ in range(rng.randint(1, 6)))
    return [(i, " ".join(word() for _ in range(rng.randint(0, 30))) if rng.random() > 0.05 else None, f"src/{word()}.json") for i in range(n)]


def test_trigrams_against_scan(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    table = spark.createDataFrame(texts(rng, 400), "id long, text string, path string").repartition(5)
    index = TrigramIndex(spark, str(tmp_path), "id", ("path", "text")).write(table)
    whole = [r["text"] for r in table.collect() if r["text"]]
    wanted = [t[i : i + rng.randint(1, 9)] for t in rng.sample(whole, 8) for i in [rng.randrange(max(1, len(t) - 9))]]
    for w in [*wanted, "src/a", ".JSON", "no such text", "ab%cd", "a_c", "é💡", "", "x" * 50, "xyé"]:
        want = sorted(r["id"] for r in table.where(like_search([F.col("path"), F.col("text")], w)).collect())
        assert sorted(r["id"] for r in index.search(w).collect()) == want, w
    monkeypatch.setattr("siltstone.operators.trigrams.IN_PLACE", 1)
    assert index.search("src/").count() == 400 and index.candidates("ab") is None and index.candidates("src/").count() == 400


def test_few_texts_are_read(spark, tmp_path):
    rows = [(i, f"common words in all of them and number {i:06d}x") for i in range(5000)]
    index = TrigramIndex(spark, str(tmp_path), "id", ("text",)).write(spark.createDataFrame(rows, "id long, text string"))
    assert [r["id"] for r in index.search("NUMBER 004321x").collect()] == [4321] and index.candidates("number 004321x").count() < 50
    plan = index.search("number 004321x")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id" in plan or "PushedFilters: [EqualTo(id" in plan or "Or(EqualTo(id" in plan or "IsNotNull(id), EqualTo(id" in plan


def test_grams_between_wildcards():
    assert grams_wanted("ABcd%xy_1234") == ["123", "234", "abc", "bcd"] and grams_wanted("ab") is None and grams_wanted("a\\%bcd") is None and grams_wanted("%_%") is None


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_vectors_against_scan(spark, tmp_path, metric):
    rng = random.Random(9)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [m + rng.gauss(0, 0.05) for m in middles[i % 40]], i % 3) for i in range(2000)]
    rows += [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, rows[7][1], 1), (5003, rows[7][1], 2)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>, label int").repartition(4)
    index = VectorIndex(spark, str(tmp_path), "id", metric=metric).write(table)
    for q, k, where in ((rows[7][1], 5, None), (rows[11][1], 30, F.col("label") == 1), ([0.1] * 16, 3, None), (rows[3][1], 5, F.col("label") > 5)):
        want = [(r["id"], round(r["similarity"], 9)) for r in search.nearest(table, q, k, "id", metric=metric, where=where).collect()]
        assert [(r["id"], round(r["similarity"], 9)) for r in index.nearest(q, k, where).collect()] == want
    index.nearest(rows[7][1], 5)
    assert index.clusters > 30 and index.opened < index.clusters / 3
    assert index.nearest(rows[3][1], 3000).count() == (2002 if metric == "cosine" else 2003) and index.opened == index.clusters
    empty = VectorIndex(spark, str(tmp_path / "none"), "id", metric=metric).write(table.limit(0))
    assert empty.nearest([1.0] * 16, 3).count() == 0
    with pytest.raises(ValueError):
        VectorIndex(spark, "", "id", metric="dot")


def test_postings_are_lists(spark, tmp_path, monkeypatch):
    rows = [(f"k{i}", f"common words in all of them and number {i:06d}x" if i % 9 else None) for i in range(3000)]
    index = TrigramIndex(spark, str(tmp_path / "a"), "id", ("text", "id")).write(spark.createDataFrame(rows, "id string, text string").coalesce(1))
    lists = spark.read.parquet(str(tmp_path / "a/postings"))
    assert lists.count() < 9000 < 100_000 < lists.agg(F.sum("n")).first()[0] and lists.where("n <> size(keys)").count() == 0
    wide = "\U0010ffff\x00ÀZ"
    assert trigrams.grams_of(wide.encode()).tolist() == sorted(map(trigrams.packed, ("\U0010ffff\x00À", "\x00Àz"))) and not len(trigrams.grams_of(b"ab")) and not len(trigrams.grams_of(None))
    [part] = [b for b in trigrams._lists(1)(iter([pa.RecordBatch.from_pydict({"k": [1, 2, 3], "t": [b"abcd", None, b"xbcd"]})]))]
    assert [(n, keys) for n, keys in zip(part["n"].to_pylist(), part["keys"].to_pylist(), strict=True)] == [(1, [1]), (2, [1, 3]), (1, [3])]
    monkeypatch.setattr(trigrams, "BLOCK", 1)
    parts = list(trigrams._lists(1)(iter([pa.RecordBatch.from_pydict({"k": [1, 2, 3], "t": [b"abcd", None, b"xbcd"]})])))
    assert [keys for p in parts for keys in p["keys"].to_pylist()] == [[1], [1], [3], [3]] and index.search("NUMBER 000010X").count() == 1
