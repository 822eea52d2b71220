"""Near-duplicate documents by circulant MinHash.

Two permutations serve all coordinates of a signature: the first scatters shingles over the universe, the second,
shifted circularly by k, gives the k-th coordinate's order. Bands of the signature bring candidates together, and
exact Jaccard similarities on full shingle sets decide.

Texts with the same words are one node from the start, whatever the size of their group. Nodes that share a band
are joined to the band's first node, and connected components of that graph are candidate clusters: every
candidate pair lies inside one. Only members of clusters are looked at again, by their shingle sets.

A cluster is cut into blocks of bounded size, each with the same few of its nodes as pilots, and a block's sets meet in
one task, where a prefix filter and a union-find skip the pairs that can't be linked or already are. A family of near
copies is one component after that, as its blocks hang together by the pilots; its work grows with its size, not the
square of it. Where a cluster of several blocks falls into more than one component, links between blocks may be left:
nodes that share a band meet once more, unless all nodes of the band are connected by then. So nothing emits the pairs of
a group, and every pair that shares a band is either compared or known to be connected.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_words_of, staged, unstage
from .graph import components

SHINGLE = 5
#: Coordinates of a signature, and the largest probability with which a link at the threshold may share no band.
COORDINATES, MISS = 256, 1e-4
#: Documents, and shingles, that one block of a candidate cluster or of a band holds, about; and pilots that all blocks of a cluster have.
BLOCK_DOCS, BLOCK_SHINGLES, PILOTS = 256, 1_000_000, 4
#: So many members of clusters are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
CACHE = 200_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Texts to sets of 64-bit shingle hashes, with a bounded cache of word hashes."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def of(self, words: list[str]) -> np.ndarray:
        """The distinct shingles, sorted; the whole sequence is one if there are fewer words than a shingle takes."""
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        n = min(self.size, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * _PRIME + h[k : len(h) - n + 1 + k]
        return np.unique(_mixed(out))


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of 32-bit integers, up to a last step that keeps their order by high bits."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows: the most rows that keep the probability of missing a link at the threshold below MISS."""
    for rows in range(16, 1, -1):
        if (1 - (percent / 100) ** rows) ** (COORDINATES // rows) < MISS:
            return COORDINATES // rows, rows
    return COORDINATES, 1


def signature(shingles: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """The k-th coordinate is the least of second(first(s) + k) over the shingles, in circles of 2^32."""
    first = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    first = (first ^ (first >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(first), 4096):
        part = first[i : i + 4096]
        step = max(1, min(size, 16384 // len(part)))
        for k in range(0, size, step):
            shift = np.arange(k, min(k + step, size), dtype=np.uint32)
            out[k : k + step] = np.minimum(out[k : k + step], _second(part[None, :] + shift[:, None]).min(axis=1))
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        h = h * _PRIME + sig.reshape(bands, rows)[:, r].astype(np.uint64)
    return _mixed(h).view(np.int64)


def _print(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            prints, sizes, banded = [], [], []
            for t in batch.column(1).to_pylist():
                words = lower_words_of(t)
                s = shingler.of(words)
                sizes.append(len(s))
                prints.append(_print(words) if words else None)
                banded.append(band_hashes(signature(s, bands * rows), bands, rows) if words else None)
            arrays = [batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(banded, pa.list_(pa.int64())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "print", "n_shingles", "bands", "row"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, node), sorted: an edge from every node to the first of its band. Streams; holds one batch."""
    band = head = None
    for batch in batches:
        b, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(b):
            continue
        starts = np.append(True, b[1:] != b[:-1])
        heads = n[np.maximum.accumulate(np.where(starts, np.arange(len(b)), 0))]
        if b[0] == band:
            heads[: np.argmax(b != band) if b[-1] != band else len(b)] = head
        band, head = b[-1], heads[-1]
        far = n != heads
        yield pa.RecordBatch.from_pydict({"u": n[far], "v": heads[far]})


def linked_groups(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> np.ndarray:
    """Exact connected components of sets, linked if 100 * intersection >= percent * union; a root for each.

    Sets come in ascending size, and each is held only against earlier ones that share one of its rarest
    shingles (two linked sets must) and aren't connected with it yet. Sets with the same `known` label are from the start.
    """
    sizes = np.array([len(s) for s in sets])
    flat, where, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(flat), np.int64)
    rank[np.argsort(freq, kind="stable")] = np.arange(len(flat))
    parts = np.split(rank[where], np.cumsum(sizes)[:-1])
    freq_of = np.empty(len(flat), np.int64)
    freq_of[rank] = freq
    root = np.arange(len(sets))
    if known is not None:
        first: dict[int, int] = {}
        root = np.array([first.setdefault(c, i) for i, c in enumerate(known)])
    members: dict[int, set[int]] = {}
    postings: dict[int, list[int]] = defaultdict(list)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def as_set(x: int) -> set[int]:
        if x not in members:
            members[x] = set(parts[x].tolist())
        return members[x]

    for x in np.argsort(sizes, kind="stable").tolist():
        n = int(sizes[x])
        most = n - (percent * n + 99) // 100 + 1
        prefix = np.sort(parts[x])[:most]
        prefix = prefix[freq_of[prefix] > 1].tolist()
        found: set[int] = set()
        for p in prefix:
            found.update(postings[p])
            postings[p].append(x)
        for y in sorted(found, reverse=True):
            if 100 * sizes[y] < percent * n or (a := find(x)) == (b := find(y)):
                continue
            both = len(as_set(x) & as_set(y))
            if 100 * both >= percent * (n + int(sizes[y]) - both):
                root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(len(sets))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, label, print, text) to shingle sets as bytes; another text under the same key drops out."""
    shingler = Shingler()
    for whole in batches:
        for begin in range(0, whole.num_rows, 500):
            batch, kept, sets = whole.slice(begin, 500), [], []
            for i, (digest, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = lower_words_of(text)
                if _print(words) == digest:
                    kept.append(i)
                    sets.append(shingler.of(words).tobytes())
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sets, pa.binary())], names=["node", "label", "shingles"])


def _solved(percent: int):
    """Rows (group, lo, hi, node, known, shingles), sorted by all but the last two: links (u, v) that connect what is linked in a run of
    the first three and wasn't known to be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            unique = {node: (known, shingles) for node, known, shingles in group}  # rows of one key may repeat
            names, known = list(unique), [k for k, _ in unique.values()]
            if len(set(known)) < 2:
                continue
            roots = linked_groups([np.frombuffer(s, np.uint64) for _, s in unique.values()], percent, known)
            far = [i for i in range(len(names)) if known[i] != known[roots[i]]]
            yield pa.RecordBatch.from_pydict({"u": pa.array([names[i] for i in far], pa.int64()), "v": pa.array([names[roots[i]] for i in far], pa.int64())})

    return run


def _links(meeting: DataFrame, percent: int) -> DataFrame:
    ordered = meeting.select("group", "lo", "hi", "node", "known", "shingles").repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "node")
    return staged(ordered.mapInArrow(_solved(percent), "u long, v long"), "links")


def _blocks(docs: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(docs / BLOCK_DOCS), F.ceil(weight / BLOCK_SHINGLES))


def _within_clusters(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links inside the blocks of clusters, and with their pilots."""
    placed = sets.join(sizes.select("label", "blocks"), "label")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    large = placed.where("blocks > 1")
    pilots = large.groupBy("label", F.pmod(F.xxhash64("node", F.lit("pilot")), F.lit(PILOTS)).alias("p")).agg(F.min("node").alias("node"))
    everywhere = large.join(pilots.select("node"), "node", "left_semi").withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meeting = placed.withColumn("lo", own).unionByName(everywhere.select(*placed.columns, "lo"))
    return _links(meeting.select(F.col("label").alias("group"), "lo", F.col("lo").alias("hi"), "node", F.col("node").alias("known"), "shingles"), percent)


def _across_blocks(banded: DataFrame, sets: DataFrame, open_labels: DataFrame, percent: int) -> DataFrame | None:
    """Links that blocks keep apart: among nodes (`node`, `label`, `known` component) of clusters that several components are left of,
    by the bands that still hold more than one. A band's blocks meet in pairs."""
    rows = staged(banded.join(open_labels, "node"), "open-bands")
    bands = rows.groupBy("band").agg(F.count("*").alias("docs"), F.sum("n").alias("weight"), F.min("known").alias("a"), F.max("known").alias("b")).where("a <> b")
    bands = staged(bands.select("band", _blocks(F.col("docs"), F.col("weight")).alias("blocks")), "bands")
    if bands.isEmpty():
        return None
    held = rows.join(bands, "band").join(sets.select("node", "shingles"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    found = _links(other.select(F.col("band").alias("group"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "known", "shingles"), percent)
    unstage(rows)
    unstage(bands)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: `n_shingles`, `component_id` (smallest key reachable over links), `kept`, `row`.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct 5-word shingles
    (A-Z lower-cased; with fewer words, the whole sequence as one shingle). A link at the threshold is missed
    with a probability below MISS (4e-5 at 85, 3e-6 at 80), one above it far more rarely. Null, empty and blank texts have
    no shingle and stay alone. Rows with the same key and text are one document, each returned; ties don't arise. Rows
    without a key are documents too, whose component is named by the smallest key among them, null if they have none.
    Other columns are dropped, whatever their names. `row` is xxhash64 of key and text: it tells rows of one key apart.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    hashed = rows.withColumn("row", F.xxhash64("id", "text"))
    signed = staged(hashed.mapInArrow(_signed(*banding(percent)), "id long, print binary, n_shingles long, bands array<long>, row long"), "signed")
    own = signed.where(F.col("print").isNotNull()).select("id", "print", "n_shingles", "row")
    nodes = own.groupBy("print").agg(F.min("id").alias("first_id"), F.max("n_shingles").alias("n"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    firsts = signed.select("id", F.col("print").alias("own"), "bands")
    banded = nodes.join(firsts, (nodes["first_id"] == firsts["id"]) & (nodes["print"] == firsts["own"])).select("node", "n", F.explode("bands").alias("band"))
    edges = banded.select("band", "node").repartition("band").sortWithinPartitions("band", "node").mapInArrow(_runs, "u long, v long")
    clusters = components(edges.distinct())

    members = staged(clusters.join(nodes, "node").select("node", "label", "print", "first_id", "n"), "members")
    sizes = members.groupBy("label").agg(F.count("*").alias("docs"), F.sum("n").alias("weight"))
    sizes = staged(sizes.select("label", _blocks(F.col("docs"), F.col("weight")).alias("blocks")), "sizes")
    wanted = members.select("node", "label", "print", F.col("first_id").alias("id"))
    few = members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(wanted) if few else wanted, "id").select("node", "label", "print", "text")
    sets = staged(met.mapInArrow(_sets, "node long, label long, shingles binary"), "sets")

    links = _within_clusters(sets, sizes, percent)
    labels = components(links)
    large = sizes.where("blocks > 1").select("label")
    if not large.isEmpty():
        known = members.join(large, "label", "left_semi").select("node", "label")
        known = known.join(labels.withColumnRenamed("label", "found"), "node", "left").select("node", "label", F.coalesce("found", "node").alias("known"))
        torn = known.groupBy("label").agg(F.min("known").alias("a"), F.max("known").alias("b")).where("a <> b").select("label")
        apart = staged(known.join(torn, "label", "left_semi").select("node", "known"), "apart")
        across = None if apart.isEmpty() else _across_blocks(banded, sets, apart, percent)
        if across is not None:
            labels = components(links.unionByName(across))
            unstage(across)
        unstage(apart)
    for done in (members, sizes, sets, links):
        unstage(done)
    settled = nodes.join(labels, "node", "left").select("print", "first_id", F.coalesce("label", "node").alias("label"))
    least = settled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = settled.join(least, "label").select("print", "component_id")
    # texts without words have no print: they go around the join, where all of them would have the same key
    worded = own.join(named, "print").select("id", "n_shingles", "component_id", "row")
    out = worded.unionByName(signed.where(F.col("print").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"), "row"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "row")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (group, lo, hi, ...), sorted by the first three, as one list per run of those, without them."""
    at, group = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for row in zip(*columns, strict=True):
            if row[:3] != at:
                if group:
                    yield group
                at, group = row[:3], []
            group.append(row[3:])
    if group:
        yield group
