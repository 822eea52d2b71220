"""Passages that repeat across documents, exactly or with small changes, by collinear chaining.

Seeds are hashes of k words in a row; of every window of such seeds the least is taken (minimizers), so equal
stretches give equal seeds wherever they stand. All occurrences of a seed are joined to its first one, in the
document with the smallest key: a seed with n occurrences gives n - 1 matches, not their square. Seeds that are
frequent in a sample are dealt to parts by document, so that no task has all of one; the least of the parts' first occurrences
is the first of all, and as these seeds are a bounded number, their first ones go to where the occurrences are.

The matches of two documents are chained: the best ascending chain under a cost per word of gap comes from one pass in
text order with a Fenwick tree of prefix maxima. Chains are aligned word by word, also across their gaps and
beyond their ends; where a gap leaves too few equal words they are cut, and each piece is judged alone. Pieces that
touch in a document are one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

SEED_WORDS, WINDOW = 8, 8
GAP_COST = 0.1
#: Words beyond a chain's ends that an alignment may take in.
MARGIN = 48
MIN_WORDS, MIN_IDENTITY = 40, 0.8
#: An extension ends where its score (1 for an equal word, -2 for another) falls so far below its best.
DROP = 6
#: Words on each side of a seed that travel with it, to see whether an extension ends there; equal words without a seed are fewer.
CONTEXT = 16
CACHE = 200_000
#: Of one document in SAMPLE the seeds are counted; those found HOT times are dealt to PARTS parts, at most MOST_HOT of them. This is about
#: balance only: what isn't found to be frequent is matched in one run, with the same first occurrence.
SAMPLE, HOT, PARTS, MOST_HOT = 64, 64, 32, 100_000
SEEDS = "seed long, part int, id long, at int, before long, after long"
MATCHES = "id long, other long, at int, other_at int, ends byte"
#: Bytes of slices that are handed on together.
SLICES = 1 << 24
#: Slices begin and end at multiples of so many words, so that a passage which many documents have is one slice of its holder, or a few.
GRID = 64
#: A slice that at least one chain in so many asks for (so many slices at most) is copied for SALTS parts of the chains, if they are MANY at least.
SHARE, SALTS, MANY = 1000, 32, 1024

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Words:
    """Texts to arrays of 64-bit word hashes, with a bounded cache. Words are cut as bytes: blanks and A-Z are the same there."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    @staticmethod
    def split(text: str | None) -> list[bytes]:
        """The words of a text with A-Z lower-cased; bytes are split at the six ASCII blanks."""
        return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []

    def hashed(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def of(self, text: str | None) -> np.ndarray:
        return self.hashed(self.split(text))


def seeds_of(words: np.ndarray, k: int = SEED_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Minimizers: their hashes and first words. Texts shorter than a seed have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _PRIME + words[i : i + n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    w = min(window, n)
    least = np.lib.stride_tricks.sliding_window_view(h, w).argmin(axis=1) + np.arange(n - w + 1)
    at = np.unique(least)
    # in a text that repeats one seed over and over, every window's worth of such seeds needs one only
    again = np.append(False, (h[at[1:]] == h[at[:-1]]) & (np.diff(at) < window))
    begin = at[np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))]
    step = (at - begin) // window
    at = at[~again | np.append(False, step[1:] != step[:-1])]
    return h[at].view(np.int64), at.astype(np.int32)


def contexts_of(words: np.ndarray, at: np.ndarray, k: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The CONTEXT words before and after the seeds at some places, four bits of each: 0 where the text has none, else 1 to 15.

    Equal words have equal bits, so what differs here differs; in a long the nearest word before a seed has the highest bits,
    the nearest one after it the lowest.
    """
    codes = np.zeros(len(words) + 2 * CONTEXT + 1, np.uint8)
    codes[CONTEXT : CONTEXT + len(words)] = words % np.uint64(15) + np.uint64(1)
    pairs = codes[:-1] | codes[1:] << 4
    steps = np.arange(0, CONTEXT, 2)
    begin = at.astype(np.int64)[:, None] + steps  # codes start CONTEXT before the words
    return tuple(np.ascontiguousarray(pairs[i]).view("<i8")[:, 0] for i in (begin, begin + CONTEXT + k))


def open_ends(before: np.ndarray, other_before: np.ndarray, after: np.ndarray, other_after: np.ndarray) -> np.ndarray:
    """Whether an extension of matches may go beyond their contexts: bit 1 to the left, bit 2 to the right.

    The rule of `_extension` over the contexts; their words are at least as often equal as the real ones, so one that ends there
    ends in the texts as well, after CONTEXT - 1 words at most.
    """
    out = np.zeros(len(before), np.int8)
    for bit, mine, theirs, order in ((1, before, other_before, range(CONTEXT - 1, -1, -1)), (2, after, other_after, range(CONTEXT))):
        mine, differ = mine.view(np.uint64), (mine ^ theirs).view(np.uint64)
        score, best, alive = np.zeros(len(mine), np.int8), np.zeros(len(mine), np.int8), np.ones(len(mine), bool)
        for i in order:
            mask = np.uint64(15 << (4 * i))
            score += np.where(((differ & mask) == 0) & ((mine & mask) != 0), 1, -2).astype(np.int8)
            np.maximum(best, score, out=best)
            alive &= best - score <= DROP
        out |= np.where(alive, bit, 0).astype(np.int8)
    return out


def _seeded(hot: np.ndarray):
    """Rows (id, text) to seeds with their contexts, and the part that they are matched in: 0, or one of PARTS for frequent seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i in range(0, len(texts), 1000):
                found = []
                for t in texts[i : i + 1000]:
                    hashed = words.of(t)
                    seeds, at = seeds_of(hashed)
                    found.append((seeds, at, *contexts_of(hashed, at)))
                owner = np.repeat(ids[i : i + 1000], [len(f[0]) for f in found])
                seed, at, before, after = (np.concatenate(c) for c in zip(*found, strict=True))
                dealt = ((owner.astype(np.uint64) * _PRIME) >> np.uint64(40)) % np.uint64(PARTS) + np.uint64(1)
                part = np.where(np.isin(seed, hot), dealt, 0).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"seed": seed, "part": part, "id": owner, "at": at, "before": before, "after": after})

    return run


def _frequent(rows: DataFrame) -> np.ndarray:
    """Seeds that are frequent in a sample of the documents, by the hash of their keys: a bounded number."""
    some = rows.where(F.pmod(F.xxhash64("id", F.lit("seeds")), F.lit(SAMPLE)) == 0).mapInArrow(_seeded(np.zeros(0, np.int64)), SEEDS)
    counted = some.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    return counted.orderBy(F.desc("n"), "seed").limit(MOST_HOT).select("seed").toArrow()["seed"].to_numpy()


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seed, part, id, at, before, after), sorted: each occurrence in another document with the first one, and where a stretch around it
    may be long (`ends`). Occurrences in parts other than 0 are handed on with their seed and contexts, the first of a part with `first`.
    Streams; holds one batch.
    """
    last = None
    for batch in batches:
        seed, part, doc, at, before, after = (batch.column(i).to_numpy() for i in range(6))
        if not len(seed):
            continue
        starts = np.append(True, (seed[1:] != seed[:-1]) | (part[1:] != part[:-1]))
        if last is not None and (seed[0], part[0]) == last[:2]:
            starts[0] = False
        head = np.maximum.accumulate(np.where(starts, np.arange(len(seed)), -1))
        firsts = [c[np.maximum(head, 0)] for c in (doc, at, before, after)]
        if n := int(np.count_nonzero(head < 0)):
            for c, value in zip(firsts, last[2:], strict=True):
                c[:n] = value
        last = (seed[-1], part[-1], *(c[-1] for c in firsts))
        dealt = part > 0
        far = (doc != firsts[0]) & ~dealt
        other, other_at, other_before, other_after = (c[far] for c in firsts)
        ends = open_ends(before[far], other_before, after[far], other_after)
        nothing, zero = np.zeros(len(ends), np.int64), np.zeros(int(dealt.sum()), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(c))
                for c in (
                    (doc[far], doc[dealt]), (other, zero), (at[far], at[dealt]), (other_at, zero.astype(np.int32)), (ends, zero.astype(np.int8)), (nothing, seed[dealt]),
                    (nothing, before[dealt]), (nothing, after[dealt]), (np.zeros(len(ends), bool), np.ones(len(zero), bool)), (np.zeros(len(ends), bool), starts[dealt]),
                )
            ],
            names=["id", "other", "at", "other_at", "ends", "seed", "before", "after", "dealt", "first"],
        )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences with the first ones of their seeds (id, other, at, other_at, before, other_before, after, other_after) to matches."""
    for batch in batches:
        ends = open_ends(*(batch.column(i).to_numpy() for i in range(4, 8)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ends)], names=["id", "other", "at", "other_at", "ends"])


def _matches(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each seed of a document with the first occurrence in another: (id, other, at, other_at, ends); and what is staged for it."""
    seeds = rows.mapInArrow(_seeded(_frequent(rows)), SEEDS)
    ordered = seeds.repartition("seed", "part").sortWithinPartitions("seed", "part", "id", "at")
    found = staged(ordered.mapInArrow(_matched, f"{MATCHES}, seed long, before long, after long, dealt boolean, first boolean"), "matches")
    least = F.min(F.struct("id", "at", "before", "after")).alias("f")
    heads = found.where("first").groupBy("seed").agg(least)  # MOST_HOT rows at most
    heads = heads.select("seed", F.col("f.id").alias("other"), F.col("f.at").alias("other_at"), F.col("f.before").alias("other_before"), F.col("f.after").alias("other_after"))
    frequent = found.where("dealt").select("seed", "id", "at", "before", "after").join(F.broadcast(heads), "seed").where("id <> other")
    frequent = frequent.select("id", "other", "at", "other_at", "before", "other_before", "after", "other_after").mapInArrow(_met, MATCHES)
    return found.where("NOT dealt").select("id", "other", "at", "other_at", "ends").unionByName(frequent), found


def chains_of(x: np.ndarray, y: np.ndarray, k: int = SEED_WORDS, cost: float = GAP_COST) -> list[tuple[np.ndarray, np.ndarray]]:
    """Split matches (first words in one text and in the other) into ascending chains, best first.

    A match scores k; going from one to the next costs `cost` for every word of gap in either text. So the best
    predecessor of a match is the one with the greatest score + cost * (x + y) among those before it in both
    texts: matches are taken by x, and a Fenwick tree over the ranks of y holds prefix maxima.
    """
    order = np.lexsort((-y, x))  # for equal x the greater y first: such matches don't follow one another
    xs, ys = x[order].tolist(), y[order].tolist()
    ranks = (np.unique(y[order], return_inverse=True)[1] + 1).tolist()
    size = max(ranks)
    best, holder = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * len(xs), [-1] * len(xs)
    for i, (a, b, rank) in enumerate(zip(xs, ys, ranks, strict=True)):
        top, pick, r = float("-inf"), -1, rank - 1
        while r > 0:
            if best[r] > top:
                top, pick = best[r], holder[r]
            r -= r & -r
        through = top - cost * (a + b - 2 * k)  # gaps are counted between the end of one match and the start of the next
        if pick >= 0 and through > 0:
            before[i] = pick
        score[i] = k + max(through, 0.0)
        value, r = score[i] + cost * (a + b), rank
        while r <= size:
            if value > best[r]:
                best[r], holder[r] = value, i
            r += r & -r
    used, out = [False] * len(xs), []
    for i in sorted(range(len(xs)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            chain.reverse()
            out.append((np.array([xs[j] for j in chain]), np.array([ys[j] for j in chain])))
    return out


def reaching(spans: list[tuple[int, int, int]], min_words: int) -> list[bool]:
    """Which spans (first word, end, open ends) of a document lie in a stretch of so many words that spans may cover together.

    An alignment takes in MARGIN words at most beyond an open end, CONTEXT - 1 beyond another, so no part of a passage is left out,
    equal words or not; lone seeds of shorter repeats are.
    """
    reach = [CONTEXT - 1, MARGIN]
    wide = [(max(lo - reach[ends & 1], 0), hi + reach[ends >> 1]) for lo, hi, ends in spans]
    order = sorted(range(len(wide)), key=lambda i: wide[i])
    out, run, low, high = [False] * len(wide), [], 0, -1
    for i in [*order, None]:
        if i is None or wide[i][0] > high + 2:
            for j in run:
                out[j] = high - low >= min_words
            if i is None:
                break
            run, low, high = [], wide[i][0], -1
        run.append(i)
        high = max(high, wide[i][1])
    return out


def _chained(min_words: int):
    """Rows (id, other, at, other_at, ends), sorted, to the chains that may be part of a passage."""
    names = ["id", "other", "xs", "ys"]

    def batch_of(doc: int, found: list[tuple[int, np.ndarray, np.ndarray, int]]) -> list[tuple]:
        kept = reaching([(int(x[0]), int(x[-1]) + SEED_WORDS, ends) for _, x, _, ends in found], min_words)
        return [(doc, *f[:3]) for f, k in zip(found, kept, strict=True) if k]

    def ended(x: np.ndarray, y: np.ndarray, ends: dict[tuple[int, int], int]) -> int:
        """Open ends of a chain: its first match's to the left, any match's to the right, as the last one may lie inside others."""
        every = [ends[m] for m in zip(x.tolist(), y.tolist(), strict=True)]
        return every[0] & 1 | (2 if any(e & 2 for e in every) else 0)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, found, ready = None, [], []
        for own, other, x, y, opened in _pairs(batches):
            if own != doc:
                ready += batch_of(doc, found)
                doc, found = own, []
                if len(ready) >= 2000:
                    yield packed(ready)
                    ready = []
            ends: dict[tuple[int, int], int] = {}
            for m, e in zip(zip(x.tolist(), y.tolist(), strict=True), opened.tolist(), strict=True):
                ends[m] = ends.get(m, 0) | e  # a match stands twice if rows of one key repeat
            found += [(other, *chain, ended(*chain, ends)) for chain in chains_of(x, y)]
        ready += batch_of(doc, found)
        if ready:
            yield packed(ready)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        ids, others, xs, ys = zip(*rows, strict=True)
        lists = [pa.array(v, pa.list_(pa.int32())) for v in (xs, ys)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), *lists], names=names)

    return go


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """One (id, other, at, other_at, ends) per run of equal (id, other), the last three as arrays; a run may go over batches."""
    key, parts = None, []
    joined = lambda: (np.concatenate(c) for c in zip(*parts, strict=True))
    for batch in batches:
        a, b, x, y, ends = (batch.column(i).to_numpy() for i in range(5))
        if not len(a):
            continue
        cuts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(a)], strict=True):
            if (a[lo], b[lo]) != key and key is not None:
                yield *key, *joined()
                parts = []
            key = (a[lo], b[lo])
            parts.append((x[lo:hi].astype(np.int64), y[lo:hi].astype(np.int64), ends[lo:hi]))
    if key is not None:
        yield *key, *joined()


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two short word arrays."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, word in enumerate(a):
        new = np.append(i + 1, np.minimum(row[1:] + 1, row[:-1] + (b != word)))
        row = np.minimum.accumulate(new - steps) + steps  # insertions in one go
    return int(row[-1])


def _extension(equal: np.ndarray) -> tuple[int, int]:
    """How many words an end gains, and how many of them are equal."""
    score = np.cumsum(np.where(equal, 1, -2))
    if not len(score):
        return 0, 0
    dropped = np.maximum(np.maximum.accumulate(score), 0) - score > DROP
    stop = int(np.argmax(dropped)) if dropped.any() else len(score)
    if not stop or (top := int(np.argmax(score[:stop]))) < 0 or score[top] <= 0:
        return 0, 0
    return top + 1, int(equal[: top + 1].sum())


Piece = tuple[int, int, int, int, int, int]


def _good(piece: Piece) -> bool:
    return piece[5] >= MIN_IDENTITY * piece[4]


def _steps(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int) -> np.ndarray:
    """Per match of a chain that isn't inside the ones before it: first words, ends, and the columns and equal columns up to its end."""
    columns = equal = 0
    ex, ey = int(xs[0]), int(ys[0])
    out = []
    for ax, ay in zip(xs.tolist(), ys.tolist(), strict=True):
        if ax - ay != ex - ey:  # on another diagonal: an edit script bridges what lies between
            lap = max(ex - ax, ey - ay, 0)
            if lap >= k:
                continue
            gap_a, gap_b = a[ex : ax + lap], b[ey : ay + lap]
            n = max(len(gap_a), len(gap_b))
            columns += n
            equal += n - _edits(gap_a, gap_b)
            ex, ey = ax + lap, ay + lap
        if ax + k > ex:
            same = a[ex : ax + k] == b[ey : ay + k]
            columns += len(same)
            equal += int(same.sum())
            ex, ey = ax + k, ay + k
        out.append((ax, ay, ex, ey, columns, equal))
    return np.array(out)


def _cut(columns: np.ndarray, equal: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Split a chain into runs of matches (first, last) that are equal enough, the longest first, given the columns and equal columns
    up to the end of each match."""
    percent = round(100 * MIN_IDENTITY)
    score = 100 * equal - percent * columns
    out, todo = [], [(0, len(score))]
    while todo:
        lo, hi = todo.pop()
        if lo == hi:
            continue
        part = score[lo:hi]
        top = np.maximum.accumulate(part[::-1])[::-1]
        # the last match up to which the columns from a match on, its own included, are equal enough
        far = np.searchsorted(-top, (100 - percent) * k - part, side="right") - 1
        at = np.arange(hi - lo)
        if (far == at).all():
            out += [(i, i) for i in range(lo, hi)]
            continue
        first = int(np.argmax(columns[lo + far] - columns[lo:hi]))
        out.append((lo + first, lo + int(far[first])))
        todo += [(lo, lo + first), (lo + int(far[first]) + 1, hi)]
    return sorted(out)


def _stretched(a: np.ndarray, b: np.ndarray, piece: Piece, low: tuple[int, int], high: tuple[int, int]) -> Piece:
    """A piece with what it gains beyond its ends, within bounds."""
    x, ex, y, ey, columns, equal = piece
    n = min(x - low[0], y - low[1], MARGIN)
    if n > 0:
        more, right = _extension(a[x - n : x][::-1] == b[y - n : y][::-1])
        x, y, columns, equal = x - more, y - more, columns + more, equal + right
    n = min(high[0] - ex, high[1] - ey, MARGIN)
    if n > 0:
        more, right = _extension(a[ex : ex + n] == b[ey : ey + n])
        ex, ey, columns, equal = ex + more, ey + more, columns + more, equal + right
    return x, ex, y, ey, columns, equal


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int = SEED_WORDS) -> list[Piece]:
    """Align two word arrays along a chain: bounds in each (first, end), columns, and columns that are equal, of every piece.

    A chain that is equal enough is one piece. Others are cut at the gaps that they bridge into pieces that are, each with what
    it gains at its ends as far as it stays equal enough.
    """
    steps = _steps(a, b, xs, ys, k)
    x, y = int(xs[0]), int(ys[0])
    whole = _stretched(a, b, (x, int(steps[-1, 2]), y, int(steps[-1, 3]), int(steps[-1, 4]), int(steps[-1, 5])), (0, 0), (len(a), len(b)))
    if _good(whole):
        return [whole]
    out, runs = [], _cut(steps[:, 4], steps[:, 5], k)
    for n, (i, j) in enumerate(runs):
        x, y = steps[i, :2].tolist()
        ex, ey = steps[j, 2:4].tolist()
        columns, equal = (k + steps[j, 4:] - steps[i, 4:]).tolist()
        core = (x, ex, y, ey, columns, equal)
        low = tuple(steps[runs[n - 1][1], 2:4].tolist()) if n else (0, 0)
        high = tuple(steps[runs[n + 1][0], :2].tolist()) if n + 1 < len(runs) else (len(a), len(b))
        ways = (low, high), (low, (ex, ey)), ((x, y), high)
        good = [p for p in (_stretched(a, b, core, *way) for way in ways) if _good(p)]
        out.append(max(good, key=lambda p: p[4], default=core))
    return out


def _covered(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """The stretches of a text that spans hold, each once."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], min(s["hi"], size)) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, spans, text) to the words of each span, as bytes of 32-bit hashes. A text is read once for all its spans."""
    words = Words()
    names = ["id", "lo", "hi", "words"]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    ready, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            doc, spans, text = (batch.column(c)[i].as_py() for c in range(3))
            cut = words.split(text)
            hashed = np.zeros(len(cut), np.uint32)
            for lo, hi in _covered(spans, len(cut)):  # what no span holds isn't looked at
                hashed[lo:hi] = (words.hashed(cut[lo:hi]) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for span in spans:
                piece = hashed[span["lo"] : span["hi"]].tobytes()
                ready.append((doc, span["lo"], span["hi"], piece))
                held += len(piece) + 32
                if held > SLICES:
                    yield packed(ready)
                    ready, held = [], 0
    if ready:
        yield packed(ready)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "start", "end", "other", "other_start", "other_end", "columns", "equal"]
    for batch in batches:
        rows = []
        for doc, other, xs, ys, lo, olo, a, b in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
            xs, ys = np.array(xs) - lo, np.array(ys) - olo
            if xs[-1] + SEED_WORDS > len(a) or ys[-1] + SEED_WORDS > len(b):  # another text under the same key
                continue
            rows += [(doc, x + lo, ex + lo, other, y + olo, ey + olo, columns, equal) for x, ex, y, ey, columns, equal in align(a, b, xs, ys)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def _joined(min_words: int):
    """Pieces (id, start, end, other, other_start, other_end, columns, equal), sorted, to passages."""
    names = ["id", "start", "n_words", "other", "other_start", "other_words", "columns", "equal"]

    def passage(run: list[tuple]) -> tuple:
        doc, start = run[0][:2]
        end = max(r[2] for r in run)
        best = max(run, key=lambda r: (r[7], -r[3]))
        return doc, start, end - start, best[3], best[4], best[5] - best[4], best[6], best[7]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if run and (row[0] != run[0][0] or row[1] > max(r[2] for r in run) + 2):
                    rows.append(passage(run))
                    run = []
                if run and len(run) >= 64:  # what counts of many pieces is their reach and the best of them
                    run = [(*run[0][:2], max(r[2] for r in run), *max(run, key=lambda r: (r[7], -r[3]))[3:])]
                run.append(row)
            rows = [r for r in rows if r[2] >= min_words]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
        if run and (last := passage(run))[2] >= min_words:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in last], names=names)

    return go


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per passage of a document that an earlier one (by key) has as well: the key, `start` (first word, from 0),
    `n_words`, and of its longest equal piece `other_id`, `other_start`, `other_words`, `columns`, `equal`.

    Stretches are found from SEED_WORDS + WINDOW - 1 equal words in a row on; every repeat of `min_words` equal words is
    covered, and so is any other stretch that an alignment from one common seed on takes in. Where pieces that different documents had
    first touch, they are one passage, and its length counts. The first document with a passage has no row for it, and all others are
    reported against it. Null, empty and short texts give none; nor do rows without a key. Rows of one key are one
    document: repeats inside it don't count. Ties in length go to the smaller other key. Other columns are dropped.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    matches, found = _matches(rows)
    # by a hash of the key: a repartition by the key itself might be left out where that is how a side is dealt already
    chains = matches.repartition(F.xxhash64("id")).sortWithinPartitions("id", "other", "at", "other_at")
    chains = staged(chains.mapInArrow(_chained(min_words), "id long, other long, xs array<int>, ys array<int>"), "chains")
    unstage(found)
    below = lambda c: (F.floor(F.greatest(F.element_at(c, 1) - MARGIN, F.lit(0)) / GRID) * GRID).cast("int")
    above = lambda c: (F.ceil((F.element_at(c, -1) + SEED_WORDS + MARGIN) / GRID) * GRID).cast("int")
    placed = chains.select("*", below("xs").alias("lo"), above("xs").alias("hi"), below("ys").alias("other_lo"), above("ys").alias("other_hi"))
    spans = placed.select("id", "lo", "hi").union(placed.select("other", "other_lo", "other_hi")).distinct()
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # as many as a text's stretches of GRID words allow, whatever the chains
    sliced = spans.join(rows, "id").select("id", "spans", "text").mapInArrow(_sliced, "id long, lo int, hi int, words binary")
    sliced = staged(sliced, "slices")
    there = sliced.select(F.col("id").alias("other"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), F.col("words").alias("other_words"))
    keys = ["other", "other_lo", "other_hi"]
    asked = staged(placed.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= MANY), "asked")
    hot = asked.where(F.col("n") * SHARE >= chains.count()).select(*keys, F.lit(True).alias("hot"))  # SHARE rows at most
    salted = placed.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    there = there.join(F.broadcast(hot), keys, "left").withColumn("salt", copies).drop("hot")
    paired = salted.join(sliced, ["id", "lo", "hi"]).join(there, [*keys, "salt"])
    paired = paired.select("id", "other", "xs", "ys", "lo", "other_lo", "words", "other_words")
    pieces = paired.mapInArrow(_aligned, "id long, start long, end long, other long, other_start long, other_end long, columns long, equal long")
    ordered = pieces.repartition("id").sortWithinPartitions("id", "start", "end", "other", "other_start")
    out = ordered.mapInArrow(_joined(min_words), "id long, start long, n_words long, other long, other_start long, other_words long, columns long, equal long")
    out = staged(out, "passages")
    for done in (chains, sliced, asked):
        unstage(done)
    return out.withColumnsRenamed({"id": key, "other": "other_id"})
