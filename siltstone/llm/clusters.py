"""Exact centroid clustering with Yinyang bounds.

Centroids are cut into groups once. Every vector carries its cluster, an upper bound of the distance to its centroid and
one lower bound per group on the distance to the group's other centroids. When centroids have moved, bounds give way by the
moves. A vector whose upper bound is below all of its lower bounds keeps its cluster unseen (the global filter); else its
distance is made exact, groups whose bound isn't above it are let through (the group filter), and of these the centroids
are scanned, whose distances are exact.

Components are whole numbers held in doubles. Distances are exact: in doubles where products can't reach 2^53, else in Python's
integers. Bounds are rounded outward, so a filter never passes over a centroid that is as near.

Vectors stay where they lie and are written with their bounds after each round; only sums per cluster come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

K, ROUNDS = 16, 3
#: Centroids to a group.
PER_GROUP = 4
#: Bounds are widened by this part.
SLACK = 1e-9
LONGEST = (1 << 63) - 1

Centroids = list[list[int]]


def whole_components(vector: Column, size: int, scale: int = 64) -> Column:
    """floor(scale * x) of every component as a double; null for vectors of another size, or with a null or non-finite component or product."""
    wide = F.transform(vector.cast("array<double>"), lambda x: x * F.lit(float(scale)))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # F.floor gives a long; larger doubles are whole already
    floor = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    return F.when((F.size(vector) == size) & ~F.coalesce(bad, F.lit(True)), F.transform(wide, floor))


def grouped(centroids: Centroids, per_group: int = PER_GROUP) -> list[list[int]]:
    """Numbers of centroids in groups of near ones: a few Lloyd rounds among the centroids themselves."""
    points = np.array(centroids, dtype=np.float64)
    middles = points[:: per_group][: max(1, -(-len(points) // per_group))].copy()
    for _ in range(5):
        own = ((points[:, None, :] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(len(middles)):
            if (own == g).any():
                middles[g] = points[own == g].mean(axis=0)
    return [np.flatnonzero(own == g).tolist() for g in range(len(middles)) if (own == g).any()]


@dataclass
class Step:
    """What a round needs: the centroids, their groups, and how far centroids and groups moved since the round before (None: first)."""

    centroids: Centroids
    groups: list[list[int]]
    moves: list[float] | None = None

    def __post_init__(self) -> None:
        self.near = np.array([[float(x) for x in c] for c in self.centroids])
        self.norms = (self.near**2).sum(axis=1)
        self.most = max((abs(x) for c in self.centroids for x in c), default=0)


class Points:
    """Some vectors, and their exact squared distances to centroids: in doubles where nothing reaches 2^53, else in Python's integers."""

    def __init__(self, points: np.ndarray, step: Step):
        self.points, self.step = points, step
        most = max(float(np.abs(points).max(initial=0.0)), float(step.most))
        self.small = 8 * most * most * points.shape[1] < 2.0**53
        self.kind = np.int64 if self.small else object

    def to_all(self, of: np.ndarray, members: list[int]) -> np.ndarray:
        """Of every one of some points to every one of some centroids."""
        points = self.points[of]
        if self.small:
            return ((points**2).sum(axis=1)[:, None] + self.step.norms[members] - 2 * points @ self.step.near[members].T).astype(np.int64)
        return self._whole(np.repeat(of, len(members)), np.tile(members, len(of))).reshape(len(of), len(members))

    def to_own(self, of: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Of every one of some points to a centroid each."""
        if self.small:
            return ((self.points[of] - self.step.near[to]) ** 2).sum(axis=1).astype(np.int64)
        return self._whole(of, to)

    def _whole(self, of: np.ndarray, to: np.ndarray) -> np.ndarray:
        out = np.empty(len(of), dtype=object)
        for n, (i, c) in enumerate(zip(of.tolist(), to.tolist(), strict=True)):
            out[n] = sum((int(a) - b) ** 2 for a, b in zip(self.points[i], self.step.centroids[c], strict=True))
        return out


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def assign(points: Points, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Cluster, squared distance (exact where it was looked at, else -1), upper bound, lower bound per group, and how many distances were taken per point.

    Without a cluster nothing is known of the points, and every centroid is scanned.
    """
    step, n = points.step, len(points.points)
    groups, best, taken = step.groups, np.full(n, -1, dtype=points.kind), np.zeros(n, np.int64)
    if cluster is None:
        cluster, upper, lower, open_ = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, len(groups))), np.arange(n)
    else:
        moves = np.array(step.moves)
        upper = (upper + moves[cluster]) * (1 + SLACK)
        lower = np.maximum(0.0, lower - np.array([moves[g].max() for g in groups])) * (1 - SLACK)
        open_ = np.flatnonzero(upper >= lower.min(axis=1))  # the global filter
    best[open_] = points.to_own(open_, cluster[open_])
    upper[open_] = _root(best[open_]) * (1 + SLACK)
    taken[open_] = 1
    at, own, look = cluster.copy(), best.copy(), np.zeros((n, len(groups)), bool)
    look[open_] = upper[open_, None] >= lower[open_]  # the group filter, by the exact distance
    scanned = []
    for g, members in enumerate(groups):
        rows = np.flatnonzero(look[:, g])
        if len(rows):
            found = points.to_all(rows, members)
            taken[rows] += (cluster[rows, None] != np.array(members)[None]).sum(axis=1)
            scanned.append((rows, g, found))
            for j, c in enumerate(members):
                better = (found[:, j] < best[rows]) | ((found[:, j] == best[rows]) & (c < at[rows]))
                best[rows[better]], at[rows[better]] = found[better, j], c
    left = np.flatnonzero(at != cluster)
    for g, members in enumerate(groups):  # the centroid that a point leaves bounds its group from now on
        was = left[np.isin(cluster[left], members)]
        lower[was, g] = np.minimum(lower[was, g], _root(own[was]) * (1 - SLACK))
    for rows, g, found in scanned:
        others = np.where(np.array(groups[g])[None] == at[rows, None], np.inf, _root(found))
        lower[rows, g] = others.min(axis=1) * (1 - SLACK)
    upper[open_] = _root(best[open_]) * (1 + SLACK)
    return at, best, upper, lower, taken


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _stepped(batches: Iterator[pa.RecordBatch], step: Step, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows (id, v, cluster, upper, lower) after a round; of the last round (id, cluster, distance)."""
    size = len(step.centroids[0])
    for batch in batches:
        if not batch.num_rows:
            continue
        points, known = _matrix(batch.column(1), size), {}
        if step.moves is not None:
            known = dict(zip(("cluster", "upper", "lower"), (batch.column(2).to_numpy(), batch.column(3).to_numpy().copy(), _matrix(batch.column(4), len(step.groups)).copy()), strict=True))
        points = Points(points, step)
        at, best, upper, lower, taken = assign(points, *[known.get(k) for k in ("cluster", "upper", "lower")])
        if last:
            unseen = np.flatnonzero(best == -1)
            best[unseen] = points.to_own(unseen, at[unseen])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int64()), pa.array([min(int(d), LONGEST) for d in best], pa.int64())], names=["id", "cluster", "distance"])
            continue
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, lower.shape[1]), pa.int32()), pa.array(lower.ravel()))
        columns = [batch.column(0), batch.column(1), pa.array(at, pa.int64()), pa.array(upper), flat, pa.array(taken)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "cluster", "upper", "lower", "taken"])


def _summed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (v, cluster, taken) to sums: per cluster the components' sums as decimal texts, the vectors, and the distances taken."""
    sums: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        points, at, taken = _matrix(batch.column(0), size), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        small = float(np.abs(points).max(initial=0.0)) * len(points) < 2.0**53
        for c in np.unique(at).tolist():
            own = points[at == c]
            total = [int(x) for x in own.sum(axis=0)] if small else [sum(int(x) for x in column) for column in own.T]
            known = sums.setdefault(c, [[0] * size, 0, 0])
            known[0] = [a + b for a, b in zip(known[0], total, strict=True)]
            known[1] += len(own)
            known[2] += int(taken[at == c].sum())
    for c, (total, n, taken) in sums.items():
        yield pa.RecordBatch.from_pydict({"cluster": [c], "total": [[str(x) for x in total]], "n": [n], "taken": [taken]})


def _merged(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of whole clusters, added up."""
    sums: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            known = sums.setdefault(row["cluster"], [[0] * size, 0, 0])
            known[0] = [a + int(b) for a, b in zip(known[0], row["total"], strict=True)]
            known[1], known[2] = known[1] + row["n"], known[2] + row["taken"]
    for c, (total, n, taken) in sums.items():
        yield pa.RecordBatch.from_pydict({"cluster": [c], "total": [[str(x) for x in total]], "n": [n], "taken": [taken]})


SUMS = "cluster long, total array<string>, n long, taken long"


def cluster_sums(rows: DataFrame, size: int) -> list[tuple[int, list[int], int, int]]:
    """Cluster, its components' sums, its vectors and the distances taken: summed in each task, then per cluster; at most one row per cluster comes to the driver."""
    part = rows.select("v", "cluster", "taken").mapInArrow(lambda batches: _summed(batches, size), SUMS)
    found = part.repartition("cluster").mapInArrow(lambda batches: _merged(batches, size), SUMS).collect()
    return [(r["cluster"], [int(x) for x in r["total"]], r["n"], r["taken"]) for r in found]


def clustered(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding", per_group: int = PER_GROUP,
    seen: list[int] | None = None,
) -> tuple[DataFrame, Centroids]:
    """Each vector's `cluster` and squared `distance`, by its key, and the final centroids, which number at most k.

    The first centroids are the k vectors with the smallest sha256 of `1:<key>`, equal keys by their components. Rounds assign every
    vector to the nearest centroid, ties to the smaller number, and put a centroid in the floor of its vectors' means; one that
    has none stays. Then vectors are assigned once more. With fewer than k vectors each of them starts a centroid. Vectors that are null,
    have another size or hold a null or non-finite component take no part. A vector without a key is assigned, but starts no centroid, so
    if no vector has a key there are no rows. Repeated rows count each. A distance beyond the longest long is given as that. Other columns don't
    matter, whatever their names. What goes to every task is k centroids; what comes to the driver is a sum per cluster. `seen` is
    given the number of distances that each round but the last one took.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_components(F.col(vector), size, scale).alias("v"))
    rows = staged(rows.where(F.col("v").isNotNull()), "vectors")
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    first = rows.where(F.col("id").isNotNull()).orderBy(order, "v").limit(k).collect()
    none = rows.select("id", F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False))
    if not first:
        return none, []
    step = Step([[int(x) for x in r["v"]] for r in first], [])
    step.groups = grouped(step.centroids, per_group)
    for _ in range(rounds):
        after = staged(rows.mapInArrow(lambda batches, step=step: _stepped(batches, step, False), "id long, v array<double>, cluster long, upper double, lower array<double>, taken long"), "clusters")
        unstage(rows)
        sums = cluster_sums(after, size)
        if seen is not None:
            seen.append(sum(s[3] for s in sums))
        means = {c: [x // n for x in total] for c, total, n, _ in sums}
        moved = [means.get(c, old) for c, old in enumerate(step.centroids)]
        far = [float(np.sqrt(float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))))) * (1 + SLACK) for x, y in zip(step.centroids, moved, strict=True)]
        rows, step = after, Step(moved, step.groups, far)
    out = staged(rows.mapInArrow(lambda batches: _stepped(batches, step, True), "id long, cluster long, distance long"), "assigned")
    unstage(rows)
    return out, step.centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def inertia(assigned: DataFrame, centroids: Centroids, key: str = "vec_id") -> DataFrame:
    """Assigned vectors with the sums of distances over their cluster (`cluster_inertia`) and over all (`inertia`) and their centroid's digest."""
    whole = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total, digests = sum(int(r["s"]) for r in whole), [centroid_digest(c) for c in centroids]
    of = {r["cluster"]: (min(int(r["s"]), LONGEST), digests[r["cluster"]]) for r in whole}
    table = assigned.sparkSession.createDataFrame([(c, *v) for c, v in of.items()], "of long, cluster_inertia long, centroid_sha256 string")
    met = assigned.join(F.broadcast(table), F.col("cluster") == F.col("of"))
    return met.select(
        F.col("id").alias(key), F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", F.lit(min(total, LONGEST)).cast("long").alias("inertia"), "centroid_sha256"
    )
