"""Model calls with limits, and questions step by step."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from siltstone.functions import calls, vectors
from siltstone.functions.calls import Caller, Limits
from siltstone.operators import cards
from siltstone.plans import pipeline
from siltstone.plans.loop import LIMIT, NOTHING, STOPPED, Action, Loop, planned

QUICK = Limits(deadline=0.2, retries=1, backoff=0.01, workers=4)


def test_retries_deadline_and_order():
    tried = {}

    def call(n):
        tried[n] = tried.get(n, 0) + 1
        if n == 3:
            time.sleep(5)
        if n == 4 and tried[n] == 1:
            raise OSError("once")
        if n == 5:
            raise ValueError("always")
        time.sleep(0.02 * (6 - n))
        return n * 10

    began = time.monotonic()
    got = list(Caller(call, QUICK).all([(n,) for n in range(6)]))
    assert time.monotonic() - began < 2
    assert [(o.value, o.error, o.tries) for o in got] == [(0, None, 1), (10, None, 1), (20, None, 1), (None, "Late: no answer in 0.2 s", 2), (40, None, 2), (None, "ValueError: always", 2)]


def test_few_calls_at_a_time():
    now, most, lock = 0, 0, threading.Lock()

    def call(_):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.02)
        with lock:
            now -= 1

    list(Caller(call, QUICK).all([(n,) for n in range(20)]))
    assert most == QUICK.workers


def test_a_server_that_hangs_costs_its_deadlines(spark):
    """Not every file's deadline: after some that hang in a row a task calls no more."""
    files = spark.createDataFrame([(f"f{i:03d}", "code") for i in range(400)], "relative_path string, content string").coalesce(1)
    limits = Limits(deadline=0.3, retries=0, workers=4, patience=8)
    began = time.monotonic()
    rows = cards.summaries(files, lambda path, code: time.sleep(60), limits).collect()
    assert time.monotonic() - began < 25 and len(rows) == 400
    assert all(r["summary"] == cards.FALLBACK and r["error"] for r in rows) and 8 <= sum(r["tries"] for r in rows) <= 12
    some = cards.summaries(files, lambda path, code: time.sleep(60) if path == "f007" else path, limits).where("error IS NOT NULL").collect()
    assert [(r["relative_path"], r["error"], r["tries"]) for r in some] == [("f007", "Late: no answer in 0.3 s", 1)]
    texts = spark.createDataFrame([(f"t{i}",) for i in range(40)], "t string").coalesce(1)
    made = vectors.embed(texts, "t", lambda ts: time.sleep(60) if "t9" in ts else vectors.hashed_provider(ts), limits=limits)
    assert made.where("embedding IS NULL").count() == vectors.BATCH


def test_tokens():
    assert calls.bounded_tokens("one, two three", 3) == "one, two" and calls.bounded_tokens("short", 9) == "short" and calls.bounded_tokens("", 0) == ""
    assert calls.bounded_tokens("abcdefghijkl mn", 2) == "abcdefghijkl" and calls.bounded_tokens("x" * 100, 3) == "x" * 18 and calls.bounded_tokens("  a  " * 9, 2) == "  a    a"


def test_failed_summaries_are_told(spark, tmp_path):
    nodes = spark.createDataFrame([], "id string, name string, filePath string, line int, type string")
    files = spark.createDataFrame([("a", "1", True), ("b", "2", True), ("bad", "3", False)], "relative_path string, content string, strict boolean")
    asked = str(tmp_path / "asked")

    def summarise(path, code):
        with open(asked, "a") as f:
            f.write(path)
        if path == "b":
            raise OSError("no server")
        return f"of {path}"

    stores = pipeline.Stores(str(tmp_path / "s"))
    out = pipeline.run_cards(files, files.select("relative_path"), nodes, stores, summarise=summarise, limits=Limits(retries=2, backoff=0.01))
    assert {r["relative_path"]: r["summary"] for r in out.collect()} == {"a": "of a", "b": cards.FALLBACK}
    assert {(r["relative_path"], r["error"], r["tries"]) for r in spark.read.parquet(stores.card_rejects).collect()} == {("b", "OSError: no server", 3), ("bad", "bytes aren't valid UTF-8", 0)}
    with open(asked) as f:
        assert sorted(f.read()) == ["a", "b", "b", "b"]  # nothing is asked twice for the rejects' sake


class Shelf:
    """Lookups without stores."""

    def __init__(self, spark=None):
        self.spark, self.made = spark, []

    def run(self, tool, argument, files=None):
        self.made.append((tool, argument, files))
        if tool == "chunks":
            raise OSError("no chunks")
        return f"{tool} of {argument}", ["a.ts"] if tool == "cards" else []


def test_plan_without_a_model():
    shelf = Shelf()
    told = Loop(shelf).ask("what is in package.json and tsconfig.json", "t")
    q = "what is in package.json and tsconfig.json"
    assert shelf.made == [("cards", q, None), ("chunks", q, ["a.ts"]), ("relations", q, None), ("json", "package.json", None), ("json", "tsconfig.json", None)]
    assert told.whole and [s.tool for s in told.steps] == ["cards", "chunks", "relations", "json", "json", "answer"] and "chunks failed: no chunks" in told.answer
    assert planned("q", (), ()) == Action("cards", "q") and NOTHING


def test_limit_of_steps():
    shelf = Shelf()
    told = Loop(shelf, lambda question, steps, before: Action("relations", str(len(steps)))).ask("on and on")
    assert not told.whole and told.answer == STOPPED and len(told.steps) == LIMIT == 12 and len(shelf.made) == LIMIT - 1
    assert shelf.made[0] == ("cards", "on and on", None)  # whatever the chooser wants
    done = Loop(shelf, lambda question, steps, before: Action("answer", "done") if len(steps) == LIMIT - 1 else Action("json", "x")).ask("just")
    assert done.whole and done.answer == "done" and len(done.steps) == LIMIT


def test_threads_are_known_and_go_on(spark, tmp_path):
    memory, stop = str(tmp_path / "memory"), 2

    def chooser(question, steps, before):
        if question == "breaks" and len(steps) == stop:
            raise KeyboardInterrupt
        return Action("relations", question) if len(steps) < 3 else Action("answer", f"{question} after {[q for q, _ in before]}")

    assert Loop(Shelf(spark), chooser, memory=memory).ask("one", "t").answer == "one after []"
    with pytest.raises(KeyboardInterrupt):
        Loop(Shelf(spark), chooser, memory=memory).ask("breaks", "t")
    stop, again = 99, Shelf(spark)
    told = Loop(again, chooser, memory=memory).ask("breaks", "t")
    assert told.answer == "breaks after ['one']" and len(again.made) == 1 and [s.tool for s in told.steps] == ["cards", "relations", "relations", "answer"]
    last = Loop(Shelf(spark), chooser, memory=memory)
    assert last.history("t") == (("one", "one after []"), ("breaks", "breaks after ['one']")) and last.history("other") == ()
    assert last._store().read().where(F.col("thread") == "t").count() == 10
