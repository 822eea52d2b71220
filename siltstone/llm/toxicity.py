"""Toxicity by class-conditional Kneser-Ney models.

Two character n-gram models of words, one of toxic and one of ordinary texts, share their backoff: a pooled
Kneser-Ney model of the same and lower orders whose lower orders count distinct continuations. In either model

    P_c(x | h) = (max(count_c(h x) - D, 0) + D * kinds_c(h) * P_shared(x | h)) / count_c(h)

so an expression that one class lacks costs what the class's discounted mass leaves for it, and one that both
lack has the same backoff in both: only the ratio of their backoff weights stays. The log-likelihood ratio of a
word is thus a sum of one number for each of its characters.

All labelled texts are counted, whole. An n-gram, what it backs off to and what shares its history end in the same characters before
the last one; so n-grams are dealt by these, each group of them is worked out by itself, and the numbers go back to the words that
have the n-grams. Words that are often met are looked up where the texts are; the rest are joined.

A document is judged by the ratio per scored symbol, and by how far single words exceed a margin, per symbol as well. Two
weights and a bias, fitted on training rows that the models didn't count, turn these into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage
from .subwords import Padded, hashed

#: Order and margin have the least log loss of orders 4 to 9 and margins 2, 4 and 6 on folds inside the training rows.
ORDER = 9
DISCOUNT = 0.75
MARGIN = 4.0
#: Characters before an n-gram's last one that its group goes by; so many characters of distinct words make a group, about.
CONTEXT = 3
GROUP = 200_000
#: At most so many words, the most frequent ones, are looked up where the texts are. The result is the same for any number.
COMMON = 300_000
CACHE = 200_000
#: Ratios of words are multiples of this, so that their sums don't depend on an order.
GRAIN = 2.0**-20

#: From the first to the last letter or digit between blanks: digits and signs inside a word belong to it.
WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted hashes of n-grams and of histories, each with its log ratio."""

    order: int
    grams: np.ndarray
    gram_ratio: np.ndarray
    histories: np.ndarray
    history_ratio: np.ndarray

    def word_ratios(self, vocabulary: list[str]) -> np.ndarray:
        if not vocabulary:
            return np.zeros(0)
        padded = Padded(vocabulary, self.order - 1)
        grams, owner = padded.grams(self.order)
        hist = _histories(padded, self.order)
        known, at = _find(self.grams, grams)
        back, bat = _find(self.histories, hist)
        value = np.where(known, _take(self.gram_ratio, at), np.where(back, _take(self.history_ratio, bat), 0.0))
        return np.bincount(owner, value, len(vocabulary))


def _histories(padded: Padded, order: int) -> np.ndarray:
    """For each n-gram, in order, the hash of all but its last character."""
    if order == 1:
        return np.zeros(int(padded.sizes.sum()), np.uint64)
    hashes, owner = padded.grams(order - 1)
    return hashes[np.append(owner[1:] == owner[:-1], False)]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[at] if len(values) else np.zeros(len(at))


def class_ratios(vocabulary: list[str], counts: np.ndarray, order: int = ORDER, discount: float = DISCOUNT) -> ToxicityModel:
    """Fit both models from word counts: a row per word, a column per class (ordinary, toxic)."""
    codes, by_class = _counted_grams(vocabulary, counts, order)
    return _fitted_grams(codes, by_class, np.full(len(codes), 1 / 256), 0, discount)


def _counted_grams(vocabulary: list[str], counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of words as rows of code points, with a row of counts for each, from a row of counts for each word."""
    padded = Padded(vocabulary, order - 1)
    at, owner = padded.windows(order)
    codes = padded.codes[at[:, None] + np.arange(order)]
    _, pick, where = np.unique(hashed(codes), return_index=True, return_inverse=True)
    return codes[pick], np.column_stack([np.bincount(where, counts[owner, k], len(pick)) for k in range(counts.shape[1])])


def _fitted_grams(codes: np.ndarray, counts: np.ndarray, lower: np.ndarray, known: int, discount: float) -> ToxicityModel:
    """Both models from distinct n-grams and their counts by class, and the shared probability of each one's last `known` characters.

    All n-grams that end in the same `known` + 1 characters, the last one of any kind, have to be there.
    """
    order = codes.shape[1]
    if not len(codes):
        empty = np.zeros(0)
        return ToxicityModel(order, empty.astype(np.uint64), empty, empty.astype(np.uint64), empty)
    keys = hashed(codes)
    by = np.argsort(keys)
    codes, counts, lower, keys = codes[by], counts[by], lower[by], keys[by]
    histories, after = np.unique(hashed(codes[:, :-1]), return_inverse=True)

    def masses(c: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per history, the sum of its n-grams' counts and how many of them there are."""
        return np.bincount(own, c), np.bincount(own, c > 0)

    def discounted(c: np.ndarray, own: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total, kinds = masses(c, own)
        return (np.maximum(c - discount, 0) + discount * kinds[own] * lower) / np.maximum(total[own], 1e-9)

    shared = lower
    for n in range(known + 1, order):  # lower orders: in how many distinct longer n-grams is this one the end?
        low, one, where = np.unique(hashed(codes[:, order - n :]), return_index=True, return_inverse=True)
        longer = np.unique(hashed(codes[:, order - n - 1 :]), return_index=True)[1]
        kinds = np.bincount(where[longer], minlength=len(low)).astype(float)
        own = np.unique(hashed(codes[one, order - n : -1]), return_inverse=True)[1]
        shared = discounted(kinds, own, shared[one])[where]
    shared = discounted(counts.sum(axis=1), after, shared)
    probability, back = [], []
    for c in counts.T:
        total, kinds = masses(c, after)
        seen = total > 0
        back.append(np.where(seen, discount * kinds / np.where(seen, total, 1), 1.0))
        probability.append(np.maximum(c - discount, 0) / np.where(seen, total, 1)[after] + back[-1][after] * shared)
    ratio = lambda x: (np.log(np.maximum(x[1], 1e-300)) - np.log(np.maximum(x[0], 1e-300))).astype(np.float32)
    return ToxicityModel(order, keys, ratio(probability), histories, ratio(back))


class Scorer:
    """Features of texts, from a model that gives the ratios of words; those that it doesn't know (NaN) are told apart."""

    def __init__(self, model: ToxicityModel | CommonWords, margin: float = MARGIN):
        self.model, self.margin = model, margin
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.names: list[str] = []
        self.ratios, self.sizes = np.zeros(0), np.zeros(0)

    def _look_up(self, found: list[str]) -> None:
        """Take in what stands between blanks, with the word inside of each; a word's end is a symbol as well."""
        names = [m[0] if (m := WORD.search(f)) else "" for f in found]
        sizes = np.array([len(w) + 1 if w else 0 for w in names], float)
        self.at.update(zip(found, range(len(self.at), len(self.at) + len(found)), strict=True))
        self.names += names
        self.ratios = np.append(self.ratios, np.where(sizes > 0, self.model.word_ratios(names), 0))
        self.sizes = np.append(self.sizes, sizes)

    def sums(self, texts: list[str | None]) -> Iterator[tuple[float, float, float, list[str], list[float]]]:
        """Per text: log ratios, what single words have above the margin, symbols; and the words that aren't known, with counts."""
        for i in range(0, len(texts), 256):
            bags = [Counter(t.lower().split()) if t else Counter() for t in texts[i : i + 256]]
            if len(self.at) > CACHE:
                self._clear()
            if new := list({f for bag in bags for f in bag if f not in self.at}):
                self._look_up(new)
            for bag in bags:
                at = np.fromiter(map(self.at.__getitem__, bag), np.int64, len(bag))
                c, x = np.fromiter(bag.values(), float, len(bag)), self.ratios[at]
                lost = np.flatnonzero(np.isnan(x))
                x[lost] = 0
                yield c @ x, c @ np.maximum(x - self.margin, 0), c @ self.sizes[at], [self.names[j] for j in at[lost].tolist()], c[lost].tolist()

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: the log ratio, and what single words have above the margin, both per symbol."""
        return np.array([(a / max(n, 1), b / max(n, 1)) for a, b, n, _, _ in self.sums(texts)]).reshape(-1, 2)


@dataclass(frozen=True)
class CommonWords:
    """Ratios of words, by word."""

    known: dict[str, float]

    def word_ratios(self, vocabulary: list[str]) -> np.ndarray:
        return np.array([self.known.get(w, math.nan) for w in vocabulary], float)


@dataclass(frozen=True)
class Trained:
    """What was counted (`w`, `n0`, `n1`, `n`) and the ratios of these words (`w`, `n`, `ratio`), both staged; the weights of the features."""

    order: int
    words: DataFrame
    ratios: DataFrame
    common: CommonWords
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))


def _counted(rows: DataFrame) -> DataFrame:
    """Distinct words of texts (`t`, `y`): how often they are in those of label 0, of label 1, and in all (`w`, `n0`, `n1`, `n`)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int | None, Counter] = {0: Counter(), 1: Counter(), None: Counter()}

        def told() -> Iterator[pa.RecordBatch]:
            for y, bag in found.items():
                own: Counter = Counter()
                for f, n in bag.items():
                    if m := WORD.search(f):
                        own[m[0]] += n
                yield pa.RecordBatch.from_pydict({"w": pa.array(list(own), pa.string()), "y": pa.array([y] * len(own), pa.int32()), "n": pa.array(list(own.values()), pa.int64())})
                bag.clear()

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update(t.lower().split())
                if sum(map(len, found.values())) > 2 * CACHE:
                    yield from told()
        yield from told()

    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}")
    return rows.where("t IS NOT NULL").select("t", "y").mapInArrow(count, "w string, y int, n long").groupBy("w").agg(of(0), of(1), F.sum("n").alias("n"))


def _shared_below(words: DataFrame, order: int, context: int) -> DataFrame:
    """The shared probability of the last `context` characters of every counted n-gram of one character more: `x0`, `x1`, ..., `shared`."""
    names = [f"x{i}" for i in range(context + 1)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            padded = Padded(batch.column(0).to_pylist(), order - 1)
            codes = padded.codes[padded.windows(order)[0][:, None] + np.arange(order - context - 1, order)]
            codes = codes[np.unique(hashed(codes), return_index=True)[1]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in codes.T], names=names)

    top = staged(words.where("n0 + n1 > 0").select("w").mapInArrow(cut, ", ".join(f"{x} int" for x in names)).distinct(), "grams")
    kinds = {context + 1: top}
    for n in range(context, 0, -1):  # in how many distinct longer ones is each the end?
        kinds[n] = kinds[n + 1].groupBy(*names[context + 1 - n :]).agg(F.count("*").alias("kinds"))
    shared = None
    for n in range(1, context + 1):
        own = names[context + 1 - n :]
        mass = kinds[n].groupBy(*own[:-1]).agg(F.sum("kinds").alias("mass"), F.count("*").alias("after"))
        met = kinds[n].crossJoin(F.broadcast(mass)).withColumn("shared", F.lit(1 / 256)) if shared is None else kinds[n].join(mass, own[:-1]).join(shared, own[1:])
        value = (F.greatest(F.col("kinds") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("after") * F.col("shared")) / F.col("mass")
        shared = met.select(*own, value.alias("shared"))
    return staged(top.join(shared, names[1:]) if shared is not None else top.withColumn("shared", F.lit(1 / 256)), "shared")


def word_ratios(words: DataFrame, order: int = ORDER, context: int = CONTEXT, group: int = GROUP) -> DataFrame:
    """Words with counts (`w`, `n0`, `n1`, `n`) to their log ratios (`w`, `n`, `ratio`), staged; words without counts by what the others tell.

    Words are dealt by how they begin, so that most n-grams come once from a group of them; the n-grams are dealt by the characters
    before the last one, get their numbers, and these go back to the group of words.
    """
    context = min(context, order - 1)
    size = words.agg(F.sum(F.length("w") + 1)).first()[0] or 0
    groups = 1 + int(size) // group
    dealt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int")
    near = [f"x{i}" for i in range(context)]
    words = words.withColumn("p", dealt(F.substring("w", 1, 3)))

    def cut(table: pa.Table) -> pa.Table:
        codes, counts = _counted_grams(table["w"].to_pylist(), np.column_stack([table["n0"].to_numpy(), table["n1"].to_numpy()]).astype(float), order)
        raw = np.ascontiguousarray(codes, "<u4").tobytes()
        gram = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(0, len(raw) + 1, 4 * order, dtype=np.int32)), pa.py_buffer(raw)])
        before = [pa.array(c.astype(np.int32)) for c in codes[:, order - 1 - context : order - 1].T]
        return pa.Table.from_arrays([pa.array(np.full(len(codes), table["p"][0].as_py(), np.int32)), gram, pa.array(counts[:, 0]), pa.array(counts[:, 1]), *before], names=["p", "gram", "n0", "n1", *near])

    def fit(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(left["gram"].to_pylist()), "<u4").reshape(-1, order)
        keys = hashed(codes)
        found, pick, where = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.column_stack([np.bincount(where, left[n].to_numpy(), len(found)) for n in ("n0", "n1")])
        codes, seen = codes[pick], counts.any(axis=1)
        below = hashed(np.column_stack([right[f"x{i}"].to_numpy() for i in range(context + 1)]).astype(np.uint32))
        by = np.argsort(below)
        at = _find(below[by], hashed(codes[seen, order - context - 1 :]))[1]
        model = _fitted_grams(codes[seen], counts[seen], _take(right["shared"].to_numpy()[by], at), context, DISCOUNT)
        value = np.zeros(len(found))
        value[seen] = model.gram_ratio
        known, at = _find(model.histories, hashed(codes[~seen, :-1]))
        value[~seen] = np.where(known, _take(model.history_ratio, at), 0.0)
        return pa.Table.from_arrays([left["p"], pa.array(keys.view(np.int64)), pa.array(value[where])], names=["p", "gram", "value"])

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right["gram"].to_numpy().view(np.uint64)
        by = np.argsort(keys)
        none = np.zeros(0)
        model = ToxicityModel(order, keys[by], right["value"].to_numpy()[by], none.astype(np.uint64), none)
        ratio = np.round(model.word_ratios(left["w"].to_pylist()) / GRAIN) * GRAIN
        return pa.Table.from_arrays([left["w"], left["n"], pa.array(ratio)], names=["w", "n", "ratio"])

    grams = words.groupBy("p").applyInArrow(cut, f"p int, gram binary, n0 double, n1 double, {', '.join(f'{x} int' for x in near)}".rstrip(", "))
    grams = grams.select("p", "gram", "n0", "n1", dealt(*near).alias("q"))
    below = _shared_below(words, order, context)
    values = grams.groupBy("q").cogroup(below.withColumn("q", dealt(*near)).groupBy("q")).applyInArrow(fit, "p int, gram long, value double")
    out = staged(words.groupBy("p").cogroup(values.groupBy("p")).applyInArrow(put, "w string, n long, ratio double"), "ratios")
    unstage(below)
    return out


def _common(ratios: DataFrame) -> CommonWords:
    """The most frequent words, as many as the bound lets in."""
    step = F.floor(F.log2("n") * 8)
    least, room = None, COMMON
    for row in sorted(ratios.where("n > 0").groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    if least is None:
        return CommonWords({})
    rows = ratios.where((F.col("n") > 0) & (step >= least)).select("w", "ratio").toArrow()
    return CommonWords(dict(zip(rows["w"].to_pylist(), rows["ratio"].to_pylist(), strict=True)))


def _text_keys(text: str | Column) -> tuple[Column, Column]:
    """What a text's features are found again by; equal texts have equal features."""
    return F.xxhash64(text).alias("_h"), F.length(text).alias("_l")


def _features(docs: DataFrame, text: str, model: Trained) -> DataFrame:
    """Features of the distinct texts (`_h`, `_l`, `f0`, `f1`), staged. Copies of a text add to sums and symbols alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model.common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            whole, lost = [], []
            for h, n, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), scorer.sums(batch.column(0).to_pylist()), strict=True):
                whole.append((h, n, None, 1.0, *found[:3]))
                lost.extend((h, n, w, c, 0.0, 0.0, 0.0) for w, c in zip(*found[3:], strict=True))
            kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 4]
            for rows in filter(None, (whole, lost)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_h", "_l", "w", "c", "a", "b", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(text, *_text_keys(text))
    said = staged(rows.mapInArrow(run, "_h long, _l int, w string, c double, a double, b double, n double"), "said")

    def summed(ratios: DataFrame) -> DataFrame:
        above = F.greatest(F.col("ratio") - MARGIN, F.lit(0.0))
        met = said.where("w IS NOT NULL").join(ratios.select("w", "ratio"), "w", "left")
        met = met.select("_h", "_l", (F.col("c") * F.col("ratio")).alias("a"), (F.col("c") * above).alias("b"), "n", F.col("ratio").isNull().alias("lost"))
        every = said.where("w IS NULL").select("_h", "_l", "a", "b", "n", F.lit(False).alias("lost")).unionByName(met)
        out = every.groupBy("_h", "_l").agg(*[F.sum(c).alias(c) for c in "abn"], F.max("lost").alias("lost"))
        per = lambda c: F.coalesce(F.col(c) / F.greatest("n", F.lit(1.0)), F.lit(0.0))
        return staged(out.select("_h", "_l", per("a").alias("f0"), per("b").alias("f1"), "lost"), "features")

    out = summed(model.ratios)
    if not out.where("lost").isEmpty():  # words that were in none of the texts of the training
        unstage(out)
        new = staged(said.where("w IS NOT NULL").select("w").distinct().join(model.ratios, "w", "left_anti"), "new")
        more = word_ratios(model.words.unionByName(new.select("w", *[F.lit(0).cast("long").alias(n) for n in ("n0", "n1", "n")])), model.order)
        out = summed(model.ratios.unionByName(more.join(new, "w", "left_semi")))
        unstage(more)
        unstage(new)
    unstage(said)
    return out.drop("lost")


def _fitted(rows: DataFrame) -> np.ndarray:
    """Logistic weights and bias of features (`f0`, `f1`, `y`) by damped Newton steps with a small ridge, from sums over all rows."""
    n, ones, *spread = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), F.stddev_pop("f0"), F.stddev_pop("f1")).first()
    if ones in (0, n):
        rate = (ones + 0.5) / (n + 1)
        return np.array([0.0, 0.0, np.log(rate / (1 - rate))])
    scale = np.array(spread) + 1e-9
    x = [F.col("f0") / float(scale[0]), F.col("f1") / float(scale[1]), F.lit(1.0)]
    w = np.zeros(3)
    for _ in range(40):
        z = sum((float(v) * c for v, c in zip(w, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        at = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], p.alias("p"), "y")
        pull = [F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(3)]
        bend = [F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(3) for j in range(3)]
        got = np.array(at.agg(*pull, *bend).first(), float)
        step = np.linalg.solve(got[3:].reshape(3, 3) + 1e-3 * np.eye(3), got[:3] - 1e-3 * w)
        w += step * min(1, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    w = np.append(w[:-1] / scale, w[-1])
    return np.array([float(f"{v:.9g}") for v in w])  # the order of sums shows behind that


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", order: int = ORDER, judges: Column | None = None) -> Trained:
    """Fit on all labelled documents (0 or 1; others are left out) and their whole texts.

    A fifth of them, by key hash, isn't counted but fits the weights. A key that is labelled twice counts once, as 1 if any row says so.
    Documents without a text don't count. Without documents of both classes the score is the share of label 1. Words of the documents
    without a label get their ratios along with the counted ones; they tell the models nothing. `judges` is false for documents that
    have no label to learn from: their texts needn't meet the labels.
    """
    judged = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1)).dropna().groupBy("k").agg(F.max("y").alias("y"))
    weighs = F.pmod(F.xxhash64("k", F.lit("weights")), F.lit(5)) == 0
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.lit(True) if judges is None else judges, F.lit(True)).alias("judges"))
    met = texts.where(F.col("judges") & ~weighs).join(judged.where(~weighs), "k", "left").select("t", "y")
    apart = texts.where(~F.col("judges") | weighs).select("t", F.lit(None).cast("int").alias("y"))
    words = staged(_counted(met.unionByName(apart)), "words")
    ratios = word_ratios(words, order)
    model = Trained(order, words, ratios, _common(ratios))
    held = texts.where(F.col("judges") & weighs).join(judged.where(weighs), "k")
    features = _features(held, "t", model)
    rows = staged(held.select(*_text_keys("t"), "y").join(features, ["_h", "_l"]).select("f0", "f1", "y"), "held")
    weights = _fitted(rows)
    for done in (features, rows):
        unstage(done)
    return Trained(order, words, ratios, model.common, weights)


def score(docs: DataFrame, model: Trained, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with `score`, the probability of label 1, for every row and whole text. Texts aren't shuffled.

    Null and empty texts, and texts without letters or digits, have neutral features. Repeated rows score alike. Only the most frequent
    words travel as a broadcast. Columns that aren't kept don't matter, whatever their names; a kept `score` is replaced.
    """
    kept = docs.select(*[c for c in keep if not isinstance(c, str) or c != "score"], *_text_keys(text))
    met = kept.join(_features(docs, text, model), ["_h", "_l"], "left")
    z = sum((float(v) * F.coalesce(c, F.lit(0.0)) for v, c in zip(model.weights, (F.col("f0"), F.col("f1"), F.lit(1.0)), strict=True)), F.lit(0.0))
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))
    return met.select(*[c for c in kept.columns if c not in ("_h", "_l")], p.alias("score"))
