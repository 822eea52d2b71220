"""JSON arrays in parts against Spark's reader of whole documents."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.sources import corpus, jsonarray


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice(['a"b', "\\", '\\"', "[{,", "x\ny", "é💡", "", '"', "\\\\", "]}"])
    if kind < 4:
        return rng.choice([None, True, 1.5, -3, "plain"])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", 'q"', "nodes", "z,"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("seed", range(3))
def test_spans_of_any_document(monkeypatch, seed):
    """Whatever the pieces that are read at a time, elements are cut where they end."""
    rng = random.Random(seed)
    for _ in range(60):
        elements = [value(rng) for _ in range(rng.randrange(8))]
        indent = rng.choice([None, 1, 2])
        monkeypatch.setattr(jsonarray, "READ_BYTES", rng.choice([1, 2, 3, 7, 1000]))
        plain = json.dumps(elements, indent=indent, ensure_ascii=rng.random() < 0.5).encode()
        named = json.dumps({"x": ["no"], "y": "nodes", "nodes": elements, "edges": [1]}, indent=indent).encode()
        for data, name in ((plain, None), (b" " + plain + b"\n", None), (named, "nodes")):
            spans = list(jsonarray.element_spans(io.BytesIO(data), len(data), name))
            assert [json.loads(data[a:b]) for a, b in spans if data[a:b].strip()] == elements
            stretches = list(jsonarray.dealt_spans(iter(spans), rng.choice([1, 20, 10**6])))
            again = [data[a:b] for begin, end in stretches for a, b in jsonarray.element_spans(io.BytesIO(data), end, begin=begin)]
            assert [json.loads(t) for t in again if t.strip()] == elements


def test_documents_that_are_no_arrays():
    spans = lambda data, name=None: list(jsonarray.element_spans(io.BytesIO(data), len(data), name))
    for data, name, match in ((b'{"a": [1]}', None, "no array"), (b'{"a": [1]}', "nodes", "no array nodes"), (b"[1, 2", None, "no end"), (b'["a', None, "inside a string"), (b"", None, "no array")):
        with pytest.raises(ValueError, match=match):
            spans(data, name)
    assert spans(b"[]") == [(1, 1)] and spans(b'{"nodes": []}', "nodes") == [(11, 11)]


def test_large_document_in_parts(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"relative_path": f"p/f{i}.ts", "score": i % 9, "reasons": ["exports", 'odd "one"\n'][: i % 3], "lines": i, "size": 10 * i, "extra": {"a": [i]}} for i in range(20_000)]
    (tmp_path / "m.json").write_text(json.dumps(rows, indent=1))
    size = (tmp_path / "m.json").stat().st_size
    reader = jsonarray.JsonArrayReader([str(tmp_path / "m.json")], None, size // 6)
    assert 6 <= len(reader.partitions()) <= 8
    got = jsonarray.read_array(spark, str(tmp_path / "m.json"), corpus.MANIFEST, partition_bytes=size // 6)
    want = spark.read.schema(corpus.MANIFEST).json(str(tmp_path / "m.json"), multiLine=True)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 20_000
    assert corpus.read_manifest(spark, str(tmp_path / "m.json")).where(F.col("score") == 3).count() == want.where(F.col("score") == 3).count()
    (tmp_path / "g.json").write_text(json.dumps({"edges": [{"source": "a", "target": "b"}], "nodes": [{"id": "a", "line": rng.randrange(9)}, {"id": "b"}]}))
    inferred, whole = jsonarray.read_array(spark, str(tmp_path / "g.json"), array="nodes"), spark.read.json(str(tmp_path / "g.json"), multiLine=True).select(F.inline("nodes"))
    assert inferred.schema == whole.schema and sorted(map(str, inferred.collect())) == sorted(map(str, whole.collect()))
