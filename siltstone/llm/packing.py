"""Best-fit packing of documents into bins of a fixed number of words, under conflicts.

Two documents of one duplicate cluster never share a bin, and a bin takes a bounded number of documents of one source. That bound gives
way by need: once there are as many bins as the words need at least, a document that no bin takes under it goes to the tightest one
that has room and none of its cluster. So tables of few sources fill their bins as others do.
Bins are kept in the order of what they have left, each with a bitmap of its duplicate clusters and bitmaps of the
sources it holds once, twice and so on. A document goes to the tightest bin that has room and no conflict: a
successor search by size, continued upwards until a compatible bin is found, else a new bin.

Documents are dealt to shards of a bounded number, by hash, and each shard packs its own, longest first. A bin
that is left half empty at a shard's end is one of thousands.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .mixing import word_count

CAPACITY = 4096
MAX_PER_SOURCE = 4
SHARD_DOCS = 8192


class Bins:
    """Open bins by what they have left."""

    def __init__(self, capacity: int, max_per_source: int):
        self.capacity, self.max_per_source = capacity, max_per_source
        self.left: list[int] = []  # the distinct residuals of bins with room, ascending
        self.at: dict[int, list[int]] = {}  # residual to its bins, oldest first
        self.words: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def new(self) -> int:
        self.words.append(0)
        self.clusters.append(0)
        self.sources.append([0] * self.max_per_source)
        return len(self.words) - 1

    def fits(self, b: int, source: int, cluster: int) -> bool:
        return not (self.clusters[b] & cluster or self.sources[b][-1] & source)

    def tightest(self, size: int, source: int, cluster: int) -> int | None:
        """The bin with the least room that takes it; a source of 0 is no source, and has no bound."""
        for i in range(bisect_left(self.left, size), len(self.left)):
            for b in self.at[self.left[i]]:
                if self.fits(b, source, cluster):
                    return b
        return None

    def put(self, b: int, size: int, source: int, cluster: int) -> None:
        before = self.capacity - self.words[b]
        if before in self.at and b in self.at[before]:
            self.at[before].remove(b)
            if not self.at[before]:
                del self.at[before]
                self.left.pop(bisect_left(self.left, before))
        self.words[b] += size
        self.clusters[b] |= cluster
        level = next((i for i, seen in enumerate(self.sources[b]) if not seen & source), -1)
        self.sources[b][level] |= source
        after = self.capacity - self.words[b]
        if after:
            if after not in self.at:
                insort(self.left, after)
                self.at[after] = []
            self.at[after].append(b)


def pack_shard(docs: list[tuple], capacity: int, max_per_source: int, loosen: bool = False) -> tuple[list[tuple], list[int]]:
    """Pieces (document's number, piece, first word, words, bin) and the bins' words, of (id, size, source, cluster).

    A document longer than a bin fills bins of its own and goes on as what is left. With `loosen` the bound per source gives way
    once there are as many bins as the words need.
    """
    least = -(-sum(d[1] for d in docs) // capacity)
    sources = {s: 1 << i for i, s in enumerate(dict.fromkeys(d[2] for d in docs))}
    shared = [c for c, n in Counter(d[3] for d in docs).items() if n > 1]
    clusters = {c: 1 << i for i, c in enumerate(shared)}
    bins, pieces = Bins(capacity, max_per_source), []
    for i, (_, size, source, cluster) in enumerate(docs):
        whole, rest = divmod(size, capacity)
        for p in range(whole):
            b = bins.new()
            bins.words[b] = capacity
            pieces.append((i, p, p * capacity, capacity, b))
        if not rest:
            continue
        s, c = sources[source], clusters.get(cluster, 0)
        b = bins.tightest(rest, s, c)
        if b is None and loosen and len(bins.words) >= least:
            b = bins.tightest(rest, 0, c)
        b = bins.new() if b is None else b
        bins.put(b, rest, s, c)
        pieces.append((i, whole, whole * capacity, rest, b))
    return pieces, bins.words


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None,
    capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per piece: the key, `piece`, `start` (its first word, from 0), `n_words`, `bin_id`, `bin_words`.

    `cluster` names a document's duplicate cluster, as `near_duplicates` gives them; by default documents with the same text up to case are one.
    `max_per_source` is what a bin takes of a source while there are fewer bins than the words of a shard need.
    Only keys, word counts, sources and cluster hashes move. Documents without a word (null, empty, blank texts)
    have one row with no words and a null bin. Rows that repeat are documents of one cluster, so they land in
    different bins. Ties in size go by key. Keys are longs; what isn't one counts as null. A null source is a source of its own.
    Other columns are dropped, whatever their names.
    """
    cluster = F.xxhash64(F.lower(F.col(text))) if cluster is None else cluster
    sized = docs.select(F.col(key).cast("long").alias("id"), word_count(F.col(text)).alias("size"), F.col(source).cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    sized = staged(sized, "sized")
    shards = max(1, -(-sized.where(F.col("size") > 0).count() // shard_docs))
    shard = F.pmod(F.xxhash64("id", "size", F.lit("shard")), F.lit(shards))
    dealt = sized.where(F.col("size") > 0).withColumn("shard", shard)
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.pmod("size", F.lit(capacity)).desc(), "id", "size", "source")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, group in _shards(batches):
            pieces, words = pack_shard(group, capacity, max_per_source, loosen=True)
            for i in range(0, len(pieces), 50_000):
                n, p, start, size, b = zip(*pieces[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([group[j][0] for j in n], pa.int64()), pa.array(p, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                        pa.array([(at << 32) + x for x in b], pa.int64()), pa.array([words[x] for x in b], pa.int64()),
                    ],
                    names=["id", "piece", "start", "n_words", "bin_id", "bin_words"],
                )

    out = dealt.select("id", "size", "source", "cluster", "shard").mapInArrow(packed, "id long, piece long, start long, n_words long, bin_id long, bin_words long")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    empty = sized.where(F.col("size") == 0).select("id", zero.alias("piece"), zero.alias("start"), zero.alias("n_words"), none.alias("bin_id"), none.alias("bin_words"))
    return out.unionByName(empty).withColumnRenamed("id", key)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (id, size, source, cluster, shard), sorted by shard, as one list per shard."""
    at, group = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for *row, shard in zip(*columns, strict=True):
            if shard != at:
                if group:
                    yield at, group
                at, group = shard, []
            group.append(tuple(row))
    if group:
        yield at, group
