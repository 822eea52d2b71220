"""The store of versions, and cards in it."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import cards
from siltstone.operators.versions import Conflict, Versions
from siltstone.plans import pipeline
from siltstone.streaming import ingest

ROWS = "id string, v int, tags array<string>"


def rows(spark, values):
    return spark.createDataFrame([(k, v, [str(v)]) for k, v in values], ROWS)


def held(store, version=None):
    out = [(r["id"], r["v"]) for r in store.read(version).collect()]
    assert len(out) == len(dict(out))
    return dict(out)


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_against_a_dictionary(spark, tmp_path):
    """Random changes, compaction and vacuum: a reader sees what a dictionary holds."""
    rng, store, want = random.Random(4), Versions(spark, str(tmp_path / "s"), buckets=4), {}
    with pytest.raises(FileNotFoundError):
        store.read()
    for step in range(8):
        new = {f"k{rng.randrange(30)}": rng.randrange(100) for _ in range(rng.randrange(12))}
        out = {f"k{rng.randrange(30)}" for _ in range(rng.randrange(8))}
        store.upsert(rows(spark, new.items()), keys(spark, out))
        want = {k: v for k, v in want.items() if k not in out} | new
        if step in (3, 6):
            store.compact()
            assert all(len(v) <= 1 for v in store.live().values())
        if step == 6:
            store.vacuum()
        assert held(store) == want
    assert held(store, 2) != want if 2 in {e.version for e in store.log()} else True


def test_writer_that_died(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    store.upsert(rows(spark, [("a", 1), ("b", 1)]))
    real, store._commit = store._commit, lambda entry: (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        store.upsert(rows(spark, [("a", 2), ("c", 2)]), token="batch 1")
    assert held(store) == {"a": 1, "b": 1} and (tmp_path / "s" / "_version=2").exists()
    store._commit = real
    assert store.upsert(rows(spark, [("a", 3)]), token="batch 1") == 2 == store.upsert(rows(spark, [("a", 9)]), token="batch 1")  # the second doesn't count
    assert held(store) == {"a": 3, "b": 1}
    with pytest.raises(Conflict):
        store._commit(store.log()[-1])
    (tmp_path / "s" / "_version=9").mkdir()
    assert store.vacuum() == [9] and held(store) == {"a": 3, "b": 1}


def test_compaction_touches_what_changed(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"), buckets=8)
    store.upsert(rows(spark, [(f"k{i}", i) for i in range(200)]))
    store.upsert(rows(spark, [("k7", -1)]), keys(spark, ["k7"]))
    store.compact()
    last = store.log()[-1]
    assert (last.kind, len(last.alone), last.gone) == ("compact", 1, 0) and last.rows < 200 / 4
    assert held(store)["k7"] == -1 and len(held(store)) == 200 and held(store, 1)["k7"] == 7
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # every bucket has one version: nothing is merged
    store.upsert(rows(spark, [("k7", -2)]))
    merged = store._rows(store.log(), {b: v for b, v in store.live().items() if len(v) > 1})
    assert merged.count() < 200 / 4 and store.compact(3) is None and held(store)["k7"] == -2
    assert store.vacuum() == [2] and held(store)["k7"] == -2


def test_odd_rows(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    store.upsert(spark.createDataFrame([], ROWS))
    assert held(store) == {} and store.compact() is None
    store.upsert(rows(spark, [("a", 1), ("a", 5), ("a", 3), (None, 1), ("", 2)]), keys(spark, ["", "zz", None]))
    assert held(store) == {"a": 5, "": 2}
    store.upsert(rows(spark, [("b", None)]).withColumn("new", F.lit("x")))  # a column that came later
    assert {r["id"]: (r["v"], r["new"]) for r in store.read().collect()} == {"a": (5, None), "": (2, None), "b": (None, "x")}
    with pytest.raises(ValueError):
        store.upsert(rows(spark, []).withColumn("_live", F.lit(True)))
    store.replace(rows(spark, [("c", 1)]))
    assert held(store) == {"c": 1} and store.vacuum() == [1, 2, 3] and held(store) == {"c": 1}


def test_cards_of_changed_and_deleted_files(spark, tmp_path):
    nodes = spark.createDataFrame([], "id string, name string, filePath string, line int, type string")
    stores, asked = pipeline.Stores(str(tmp_path)), []

    def run(files, **options):
        frame = spark.createDataFrame([(p, c, True) for p, c in files.items()] + [("bad", "x", False)], "relative_path string, content string, strict boolean")
        made = []
        summarise = lambda path, code: (_ for _ in ()).throw(OSError) if code == "fails" else f"{path}={code}"
        out = pipeline.run_cards(frame, frame.select("relative_path"), nodes, stores, summarise=summarise, **options).collect()
        asked.append(made)
        assert len({r["id"] for r in out}) == len(out)
        return {r["relative_path"]: r["summary"] for r in out}

    assert run({"a": "1", "b": "1", "c": "1"}, resume=True) == {"a": "a=1", "b": "b=1", "c": "c=1"}  # no store yet
    assert run({"a": "2", "b": "1", "d": "1"}, resume=True) == {"a": "a=1", "b": "b=1", "d": "d=1"}  # c is gone, a keeps its card
    assert run({"a": "2", "b": "1", "d": "1"}, resume=True, by_content=True) == {"a": "a=2", "b": "b=1", "d": "d=1"}
    for i in range(pipeline.COMPACT_VERSIONS):
        assert run({"a": f"x{i}"}, resume=True, by_content=True) == {"a": f"a=x{i}"}
    assert max(map(len, cards.card_store(spark, stores.cards).live().values())) < pipeline.COMPACT_VERSIONS
    assert run({"a": "1"}) == {"a": "a=1"} and spark.read.parquet(stores.cards).count() == 1
    assert [r["relative_path"] for r in spark.read.parquet(stores.card_rejects).collect()] == ["bad"]


def test_stream_batch_again(spark, tmp_path, monkeypatch):
    """A batch that dies before its version counts, and one that dies behind it, are run again and count once."""
    root, store, marks = tmp_path / "src", str(tmp_path / "cards"), str(tmp_path / "marks")
    root.mkdir()
    (root / "a.md").write_text("About shapes and what they are.")
    nodes = spark.createDataFrame([], "id string, name string, filePath string, line int, type string")
    real = Versions._commit

    def killed_before(self, entry):
        raise OSError("killed")

    def killed_behind(self, entry):
        real(self, entry)
        raise OSError("killed")

    for commit in (killed_before, killed_behind, real):
        monkeypatch.setattr(Versions, "_commit", commit)
        query = ingest.stream_cards(ingest.stream_files(spark, str(root), "demo"), nodes, store, marks)
        if commit is real:
            query.awaitTermination()
        else:
            with pytest.raises(Exception, match="killed"):
                query.awaitTermination()
    assert cards.card_store(spark, store).read().count() == 1 and len(cards.card_store(spark, store).log()) == 1
