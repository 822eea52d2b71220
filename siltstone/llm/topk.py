"""Exact top-k inner-product search by MaxScore.

A query's components are its terms, and a term's posting list holds the component's value in every vector. Values
may be negative, so each list is measured from its least contribution: what a vector adds beyond it is between 0
and the list's bound. Lists are ordered by falling bound. The essential ones are those at the front without which no
vector could reach the k-th best score known so far, even if it had all that the others can add; they are traversed.
Vectors that stay competitive are probed in the others, one list after another, and drop out as soon as what is left
can't lift them to that score.

Vectors stay where they lie: every Arrow batch of a task is a shard with its own posting lists. Queries come to them in
blocks of bounded size, as broadcasts, each query with a score that its k-th best reaches at least: first that of a
pilot of some thousand vectors, then that of the shards which the task has been through. The shards' best are merged.
Scores are integers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest
from math import isqrt
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, staged_folder, unstage

K = 20
#: Queries that go to the shards at a time, and vectors that give them their first threshold.
BLOCK_ROWS, PILOT_ROWS = 8192, 4096
#: Queries that are asked in Python's integers at a time.
WIDE_ROWS = 1024
#: The largest shard.
SHARD_ROWS = 8192
#: Queries that go through a shard together, and lists that are traversed, and probed, at a time once the essential ones are through.
GROUP, STEP, STRIDE = 64, 8, 4
#: Vectors are probed once less than one in so many is competitive.
DENSE = 64
BEST = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as a double; null for vectors with a null or non-finite component."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda x: F.floor(x * F.lit(float(scale)))))


def narrow_bound(size: int) -> int:
    """Components of at most so much have products that fit a long, in vectors of so many."""
    return isqrt(((1 << 61) - 1) // max(size, 1))


def exact_type(most: float, size: int) -> type:
    """The narrowest number type in which products of vectors of so many components, of at most so much, are exact."""
    reach = int(most) ** 2 * max(size, 1)
    if reach >= 1 << 61:
        raise ValueError(f"components reach {most} in vectors of up to {size}: products don't fit a long")
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64


def least_of(kind: type) -> float | int:
    """Below every score."""
    return -(1 << 62) if kind is np.int64 else -np.inf


class Shard:
    """Posting lists of some vectors: one row per term, its least and greatest value, and the vectors' keys."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.lists = ids, np.ascontiguousarray(matrix.T)
        self.low, self.high = matrix.min(axis=0), matrix.max(axis=0)
        self.none = least_of(matrix.dtype.type)
        self.touched = self.entries = 0  # list entries that queries looked at, and those that there were

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, thresholds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best vectors for each of a few queries that reach its threshold, ties to smaller keys: query, position, score.

        The queries share an order of lists, by their mean bound, so the essential lists of all are a prefix, and one
        matrix product traverses them.
        """
        size, n = self.lists.shape
        thresholds = np.full(len(queries), self.none, queries.dtype) if thresholds is None else thresholds
        least = np.minimum(queries * self.low, queries * self.high)
        bound = np.maximum(queries * self.low, queries * self.high) - least
        order = np.argsort(-bound.sum(axis=0), kind="stable")
        least, bound, queries = least[:, order], bound[:, order], queries[:, order]
        base = least.sum(axis=1)
        rest = np.zeros((len(queries), size + 1), queries.dtype)  # what a vector may have without the lists before
        rest[:, :size] = np.cumsum(bound[:, ::-1], axis=1)[:, ::-1]
        rest += base[:, None]
        self.entries += len(queries) * size * n
        # without its essential lists, all that the others add up to stays below the threshold
        essential = int(min(size, (rest >= thresholds[:, None]).sum(axis=1).max(initial=0)))
        if not (rest[:, 0] >= thresholds).any():
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, queries.dtype),)
        score = queries[:, :essential] @ self.lists[order[:essential]] - least[:, :essential].sum(axis=1)[:, None]  # above the base
        same = self.ids[None, :] == own[:, None]
        score[same] = self.none
        if n > k:  # k vectors have this much already
            thresholds = np.maximum(thresholds, np.partition(score, n - k, axis=1)[:, n - k] + base)
        at = essential
        while True:  # where many vectors are competitive yet, traversing more lists is cheaper than probing for each
            alive = (score >= (thresholds - rest[:, at])[:, None]) & ~same
            if at == size or np.count_nonzero(alive) * DENSE < alive.size:
                break
            upto = min(at + STEP, size)
            score += queries[:, at:upto] @ self.lists[order[at:upto]] - least[:, at:upto].sum(axis=1)[:, None]
            at = upto
        self.touched += len(queries) * at * n
        traversed, (of, at) = at, np.nonzero(alive)
        score = score[of, at]
        for begin in range(traversed, size, STRIDE):
            end = min(begin + STRIDE, size)
            probed = self.lists[np.ix_(order[begin:end], at)].T
            self.touched += probed.size
            score = score + (queries[of, begin:end] * probed).sum(axis=1) - least[of, begin:end].sum(axis=1)
            keep = score + rest[of, end] >= thresholds[of]
            of, at, score = of[keep], at[keep], score[keep]
        score = score + base[of]
        order = np.lexsort((self.ids[at], -score, of))
        of, at, score = of[order], at[order], score[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        return of[place < k], at[place < k], score[place < k]


def _by_size(rows: pa.RecordBatch | pa.Table, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, keys and matrix of the vectors (id, v) of each length: others have no product with them."""
    ids, column = rows.column(0).to_numpy(), rows.column(1)
    vectors = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = vectors.offsets.to_numpy()
    sizes, flat = np.diff(offsets), vectors.values.to_numpy()
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield own, ids[own], flat[offsets[own][:, None] + np.arange(size)].astype(kind)


class Asked:
    """Queries of one length: keys, vectors, the score that the k-th best of each reaches at least, and the best scores so far."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, thresholds: np.ndarray):
        self.keys, self.vectors, self.thresholds = keys, vectors, thresholds
        self.held: dict[int, np.ndarray] = {}

    def meet(self, shard: Shard, k: int) -> Iterator[pa.RecordBatch]:
        """Each query's best in a shard; the thresholds follow."""
        for i in range(0, len(self.keys), GROUP):
            own = slice(i, i + GROUP)
            of, at, scores = shard.best(self.vectors[own], self.keys[own], k, self.thresholds[own])
            if not len(of):
                continue
            yield pa.RecordBatch.from_pydict({"query_id": self.keys[own][of], "vec_id": shard.ids[at], "score": scores.astype(np.int64)})
            for q in np.unique(of).tolist():
                held = np.concatenate([self.held.get(i + q, scores[:0]), scores[of == q]])
                if len(held) >= k:
                    held = np.partition(held, len(held) - k)[len(held) - k :]
                    self.thresholds[i + q] = max(self.thresholds[i + q], held[0])
                self.held[i + q] = held


def _searched(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple], kind: type, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) to the best of each shard for queries by their length."""
    asked = {size: Asked(keys, vectors, thresholds.copy()) for size, (keys, vectors, thresholds) in queries.items()}
    for batch in batches:
        for begin in range(0, batch.num_rows, SHARD_ROWS):
            for _, ids, matrix in _by_size(batch.slice(begin, SHARD_ROWS), kind):
                if matrix.shape[1] in asked:
                    yield from asked[matrix.shape[1]].meet(Shard(ids, matrix), k)


def _piloted(batches: Iterator[pa.RecordBatch], pilot: pa.Table, kind: type, k: int) -> Iterator[pa.RecordBatch]:
    """Queries (id, v) with the score of their k-th best in the pilot; null where it has fewer."""
    first = {matrix.shape[1]: Shard(ids, matrix) for _, ids, matrix in _by_size(pilot, kind)} if pilot.num_rows else {}
    for batch in batches:
        reached: list[int | None] = [None] * batch.num_rows
        for places, keys, vectors in _by_size(batch, kind):
            if (shard := first.get(vectors.shape[1])) is None:
                continue
            for i in range(0, len(keys), GROUP):
                of, _, scores = shard.best(vectors[i : i + GROUP], keys[i : i + GROUP], k)
                last = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else []
                for q in last:
                    if q >= k - 1 and of[q - k + 1] == of[q]:
                        reached[places[i + of[q]]] = int(scores[q])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reached, pa.int64())], names=["id", "v", "block", "reached"])


def _wide(batches: Iterator[pa.RecordBatch], queries: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) to the k best for each query (id, v), in Python's integers; scores beyond a long count as the least or greatest."""
    asked = list(zip(queries["id"].to_pylist(), queries["v"].to_pylist(), strict=True))
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True))
        for key, vector in asked:
            scored = [(-max(-(1 << 63), min((1 << 63) - 1, sum(map(mul, vector, v)))), i) for i, v in rows if i != key and len(v) == len(vector)]
            best = nsmallest(k, scored)
            if best:
                yield pa.RecordBatch.from_pydict({"query_id": [key] * len(best), "vec_id": [i for _, i in best], "score": [-s for s, _ in best]})


def _ask_wide(queries: DataFrame, candidates: DataFrame, path: str, k: int) -> None:
    """Exact scores of queries with candidates where either has huge components: queries go to where the candidates are, some at a time."""
    numbered = queries.distinct()
    blocks = max(1, -(-numbered.count() // WIDE_ROWS))
    for block in range(blocks):
        own = numbered.where(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == block).toArrow()
        if own.num_rows:
            sent = candidates.sparkSession.sparkContext.broadcast(own)
            candidates.mapInArrow(lambda batches, sent=sent: _wide(batches, sent.value, k), BEST).write.mode("append").parquet(path)
            sent.unpersist()


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """Each query's k best vectors by integer inner product, its own key left out: `query_id`, `rank`, `vec_id`, `score`.

    Vectors that are null or hold a null or non-finite component take no part, neither do rows without a key. A
    vector has no product with one of another length. Repeated rows of a key are candidates each; ranks among rows
    that tie in score and key are arbitrary and their values equal. A repeated query is asked once, if its vectors
    are equal. Fewer candidates than k give fewer rows. Rows with components so large that products may not fit a long
    are scored in Python's integers; such a score beyond a long counts as the least or greatest long, and so does a component.
    Other columns don't matter, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), quantised(F.col(vector)).alias("v"))
    rows = staged(rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()), "vectors")
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    path, whole = staged_folder(spark, "best"), rows
    bound = narrow_bound(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    if not (huge := rows.where(largest > bound)).isEmpty():
        rows = staged(rows.where(F.coalesce(largest <= bound, F.lit(True))), "narrow")
        _ask_wide(huge.where("query").select("id", "v"), whole.select("id", "v"), path, k)
        _ask_wide(rows.where("query").select("id", "v"), huge.select("id", "v"), path, k)
    n = rows.agg(F.count("*").alias("n"), F.count_if("query").alias("q"), F.max(largest).alias("most"), F.max(F.size("v")).alias("size")).first()
    kind = exact_type(n["most"] or 0.0, n["size"] or 0)
    here = rows.select("id", "v")
    sampled = F.pmod(F.xxhash64("id", F.lit("pilot")), F.lit(max(1, n["n"]))) < PILOT_ROWS
    pilot = spark.sparkContext.broadcast(here.where(sampled).limit(2 * PILOT_ROWS).toArrow())
    blocks = max(1, -(-n["q"] // BLOCK_ROWS))
    asked = rows.where("query").select("id", "v").distinct().withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int"))
    asked = staged(asked.mapInArrow(lambda batches: _piloted(batches, pilot.value, kind, k), "id long, v array<long>, block int, reached long"), "queries")
    for block in range(blocks):
        own = asked.where(F.col("block") == block).select("id", "v", "reached").toArrow()
        reached = [least_of(kind) if r is None else r for r in own["reached"].to_pylist()]
        thresholds = np.array(reached, kind)
        sent = spark.sparkContext.broadcast({vs.shape[1]: (keys, vs, thresholds[at]) for at, keys, vs in _by_size(own, kind)} if own.num_rows else {})
        best = here.mapInArrow(lambda batches, sent=sent: _searched(batches, sent.value, kind, k), BEST)
        best.write.mode("append").parquet(path)
        sent.unpersist()
    for done in {id(d): d for d in (asked, rows, whole)}.values():
        unstage(done)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(BEST).parquet(path)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
