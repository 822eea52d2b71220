"""Exact nearest vectors by an inverted file of clusters: the triangle inequality says which clusters can hold them.

    index/vectors/cluster=7/*.parquet    rows of the table with `apart`, the distance to the cluster's centre
    index/clusters/*.parquet             centre, number of vectors, least and greatest distance from the centre

A vector of a cluster is at least |d(query, centre) - d(vector, centre)| away, so a cluster has a least distance. Clusters are opened by it, and
those aren't whose least distance is above that of the k-th best so far. For cosine, vectors are measured at length one, where
the squared distance is 2 - 2 cos.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine, literal, norm, squared_distance
from ..staging import staged

#: Clusters of an index at most, and rounds in which centres move to the middle of a sample's clusters.
MOST_CLUSTERS, ROUNDS, SAMPLE_PER_CLUSTER = 1024, 3, 32
#: Clusters that are opened first, and by how many times more in every round.
OPENED, GROWTH = 4, 4
#: Distances are taken in doubles; bounds give way by this part.
SLACK = 1e-6
METRICS = ("cosine", "l2")


def _measured(vector: Column, metric: str) -> Column:
    """The vector as it is measured: in doubles, for cosine at length one; null if it has no length."""
    wide = vector.cast("array<double>")
    if metric == "l2":
        return wide
    length = norm(vector)
    return F.when(length > 0, F.transform(wide, lambda x: x / length))


def _centres(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Middles of a bounded sample's clusters."""
    centres = sample[:clusters].copy()
    for _ in range(ROUNDS):
        own = (sample @ centres.T * -2 + (centres**2).sum(axis=1)).argmin(axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass
class VectorIndex:
    """An index at a path: of which key and vector, and by which metric. `opened` and `clusters` tell of the last search."""

    spark: SparkSession
    path: str
    key: str
    vector: str = "embedding"
    metric: str = "cosine"
    opened: int = field(default=0, init=False)
    clusters: int = field(default=0, init=False)

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"metric is one of {', '.join(METRICS)}")

    def write(self, table: DataFrame, clusters: int | None = None) -> VectorIndex:
        """Index all rows that have a vector (of the length that most have is assumed of all; for cosine, one that isn't zero).

        Centres come from a sample of at most SAMPLE_PER_CLUSTER vectors a cluster, picked by key hash; the root of the number of rows is the
        number of clusters, up to MOST_CLUSTERS, unless it is given. They are what goes to every task.
        """
        rows = staged(table.withColumn("_measured", _measured(F.col(self.vector), self.metric)).where(F.col("_measured").isNotNull()), "vectors")
        n = rows.count()
        k = max(1, min(MOST_CLUSTERS, clusters or int(n**0.5)))
        share = F.pmod(F.xxhash64(F.col(self.key).cast("string"), F.lit("centres")), F.lit(max(1, n))) < k * SAMPLE_PER_CLUSTER
        picked = rows.where(share).select("_measured", F.xxhash64(F.col(self.key).cast("string")).alias("h")).orderBy("h").limit(2 * k * SAMPLE_PER_CLUSTER).collect()
        if not picked:
            picked = rows.select("_measured").limit(k).collect()
        centres = _centres(np.array([r["_measured"] for r in picked]), k) if picked else np.zeros((0, 1))
        schema = T.StructType([*table.schema.fields, T.StructField("apart", T.DoubleType()), T.StructField("cluster", T.IntegerType())])

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = (points @ centres.T * -2 + (centres**2).sum(axis=1)).argmin(axis=1)
                apart = np.sqrt(((points - centres[own]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(apart), pa.array(own, pa.int32())], names=schema.names)

        ordered = rows.select(*table.columns, "_measured").mapInArrow(assigned, schema)
        # few files a cluster, and no task for a whole large one: rows of a cluster are dealt by their key as well
        spread = ordered.repartition("cluster", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(4)))
        spread.sortWithinPartitions("cluster", "apart").write.mode("overwrite").partitionBy("cluster").parquet(f"{self.path}/vectors")
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/schema")
        stored = self._stored()
        about = stored.groupBy("cluster").agg(F.count("*").alias("n"), F.min("apart").alias("least"), F.max("apart").alias("most"))
        table_of = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
        about.join(F.broadcast(table_of), "cluster").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clusters")
        return self

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/vectors")

    def bounds(self, query: list[float]) -> list[tuple[float, int]]:
        """Clusters by the least distance that a vector of theirs can have from a query."""
        q = np.array(query, dtype=np.float64)
        if self.metric == "cosine":
            q = q / np.linalg.norm(q)
        out = []
        for r in self.spark.read.parquet(f"{self.path}/clusters").collect():  # MOST_CLUSTERS rows at most
            d = float(np.linalg.norm(q - np.array(r["centre"])))
            out.append((max(0.0, d * (1 - SLACK) - r["most"] * (1 + SLACK) - SLACK, r["least"] * (1 - SLACK) - d * (1 + SLACK) - SLACK), r["cluster"]))
        return sorted(out)

    def nearest(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        """The k best rows with `similarity` (for l2 the squared distance, the least first), ties by key, as of a scan of all; a filter comes before.

        Clusters are opened a few at first, then several times as many, until no other can hold a better vector.
        """
        rows = self._stored()
        measure = (cosine if self.metric == "cosine" else squared_distance)(F.col(self.vector), literal(query))
        order = [F.desc("similarity") if self.metric == "cosine" else F.asc("similarity"), F.col(self.key)]
        ranked, best = (self.bounds(query) if any(query) or self.metric == "l2" else []), None
        begin, step, self.clusters = 0, OPENED, len(ranked)
        while begin < len(ranked):
            own = rows.where(F.col("cluster").isin([c for _, c in ranked[begin : begin + step]]))
            own = own if where is None else own.where(where)
            found = own.withColumn("similarity", measure).where(F.col("similarity").isNotNull()).drop("apart", "cluster")
            best = staged((found if best is None else best.unionByName(found)).orderBy(*order).limit(k), "nearest")
            begin, step = begin + step, step * GROWTH
            last = [r[0] for r in best.select("similarity").collect()]
            if len(last) == k and begin < len(ranked):
                worst = min(last) if self.metric == "cosine" else max(last)
                reach = max(0.0, 2 - 2 * worst) ** 0.5 if self.metric == "cosine" else worst**0.5
                if ranked[begin][0] > reach * (1 + SLACK) + SLACK:
                    break
                # of those that are left only the ones within reach
                ranked = ranked[:begin] + [r for r in ranked[begin:] if r[0] <= reach * (1 + SLACK) + SLACK]
        self.opened = min(begin, len(ranked))
        if best is None:
            best = rows.withColumn("similarity", F.lit(0.0)).drop("apart", "cluster").limit(0)
        return best.orderBy(*order)
