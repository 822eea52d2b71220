"""Quality classifier on supervised subword embeddings.

Every word stands for its own hash and those of its character n-grams, and so does every line's end; each hash bucket
has a learned vector. A document's vector is the mean over its words' buckets. A linear layer and a softmax over two
classes follow. Vectors and layer are trained together by stochastic gradient descent in numpy.

The layer is linear, so a bucket's vector times the difference of the two classes' weights is one number per
bucket; scoring adds such numbers up, which is the same sum in another order.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_texts, sampled_labels, words_of
from .subwords import Padded

BUCKETS = 1 << 17
DIM = 12
GRAMS = (2, 3, 4)
EPOCHS = 6
RATE = 0.5
#: A document's shares of its buckets are small: the vectors' steps are longer than the layer's.
VECTOR_RATE = 20
#: The bound of the training sample: so many labelled rows of each class.
MAX_DOCS_PER_CLASS = 3_000
CACHE = 100_000


def word_features(vocabulary: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, whole words and their character n-grams, and the number of the word that each is of."""
    if not vocabulary:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = Padded(vocabulary)
    hashes, owners = [], []
    for n in GRAMS:
        h, owner = padded.grams(n)
        hashes.append(h % np.uint64(buckets))
        owners.append(owner)
    whole = np.add.reduceat(_placed(padded), padded.starts)
    hashes.append((whole ^ (whole >> np.uint64(32))) % np.uint64(buckets))
    owners.append(np.arange(len(vocabulary)))
    return np.concatenate(hashes).astype(np.int64), np.concatenate(owners)


def _placed(padded: Padded) -> np.ndarray:
    """A hash of each code point and its place in its word, to be summed to a hash of the word."""
    place = np.arange(len(padded.codes)) - np.repeat(padded.starts, padded.sizes)
    h = (padded.codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def tokens_of(text: str | None) -> Counter:
    """The words of a text, and a token for each line's end; a null text is an empty one."""
    return Counter(words_of(text)) + Counter({"\n": 1 + (text or "").count("\n")})


class Features:
    """Bucket counts of documents, with a bounded cache of words' buckets."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def prepare(self, bags: list[Counter]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        new = list({w for bag in bags for w in bag if w not in self.known})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids, owner = word_features(part, self.buckets)
            cuts = np.cumsum(np.bincount(owner, minlength=len(part)))[:-1]
            self.known.update(zip(part, np.split(ids[np.argsort(owner, kind="stable")], cuts), strict=True))

    def of(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets and their shares, which sum to 1."""
        if not bag:
            return np.zeros(0, np.int64), np.zeros(0)
        parts = [self.known[w] for w in bag]
        counts = np.repeat(np.fromiter(bag.values(), float, len(bag)), [len(p) for p in parts])
        ids, where = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(where, counts, len(ids))
        return ids, total / total.sum()


@dataclass(frozen=True)
class QualityModel:
    """One number per bucket, and a bias: a fixed size, whatever the corpus."""

    buckets: np.ndarray
    bias: float


@dataclass
class Network:
    """Bucket vectors, a linear layer and a softmax over two classes."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator, buckets: int, dim: int) -> Network:
        return cls(((rng.random((buckets, dim)) - 0.5) / dim).astype(np.float32), np.zeros((dim, 2), np.float32), np.zeros(2, np.float32))

    def probabilities(self, ids: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A document's vector, and the softmax over the classes."""
        hidden = share @ self.vectors[ids]
        out = hidden @ self.layer + self.bias
        p = np.exp(out - out.max())
        return hidden, p / p.sum()

    def gradients(self, ids: np.ndarray, share: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log loss of one document: for the vectors of its buckets, the layer and the bias."""
        hidden, p = self.probabilities(ids, share)
        p[label] -= 1
        return np.outer(share, self.layer @ p), np.outer(hidden, p), p

    def step(self, ids: np.ndarray, share: np.ndarray, label: int, rate: float) -> None:
        vectors, layer, bias = self.gradients(ids, share, label)
        self.layer -= rate * layer
        self.bias -= rate * bias
        self.vectors[ids] -= rate * VECTOR_RATE * vectors


def fit(texts: list[str], labels: np.ndarray, prior: float = 0.0, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, seed: int = 9) -> QualityModel:
    """Stochastic gradient descent, one document a step, with a falling rate. `prior` is added to the bias."""
    rng = np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        return QualityModel(np.zeros(buckets), math.log(rate / (1 - rate)))
    features, rows = Features(buckets), []
    for i in range(0, len(texts), 256):
        bags = [tokens_of(t) for t in texts[i : i + 256]]
        features.prepare(bags)
        rows += [(ids.astype(np.int32), share.astype(np.float32)) for ids, share in map(features.of, bags)]
    network = Network.fresh(rng, buckets, dim)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            network.step(*rows[i], int(labels[i]), RATE * (1 - done / steps))
            done += 1
    gap = network.layer[:, 1] - network.layer[:, 0]
    return QualityModel((network.vectors @ gap).astype(np.float32), float(network.bias[1] - network.bias[0]) + prior)


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id",
    max_docs_per_class: int = MAX_DOCS_PER_CLASS,
) -> QualityModel:
    """Fit on a bounded sample of labelled documents, picked by key hash, in the order of key and text.

    Labels other than 0 and 1, and documents without a text, don't count. Without documents of both classes the
    score is the share of label 1. The bound, not the corpus, sets what comes to the driver.
    """
    sample, rates = sampled_labels(labels, key, label, max_docs_per_class)
    rows = labelled_texts(docs, sample, key, text).toArrow().sort_by([("k", "ascending"), ("t", "ascending")])
    prior = math.log(rates[0] / rates[1]) if len(rates) == 2 else 0.0
    return fit(rows["t"].to_pylist(), rows["y"].to_numpy(), prior)


class Scorer:
    def __init__(self, model: QualityModel):
        self.model, self.features, self.known = model, Features(len(model.buckets)), {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i in range(0, len(texts), 256):
            bags = [tokens_of(t) for t in texts[i : i + 256]]
            if len(self.known) > CACHE:
                self.known.clear()
            new = list({w for bag in bags for w in bag if w not in self.known})
            for j in range(0, len(new), 20_000):
                part = new[j : j + 20_000]
                ids, owner = word_features(part, len(self.model.buckets))
                sums, sizes = np.bincount(owner, self.model.buckets[ids], len(part)), np.bincount(owner, minlength=len(part))
                self.known.update(zip(part, zip(sums.tolist(), sizes.tolist(), strict=True), strict=True))
            for j, bag in enumerate(bags):
                total, n = 0.0, 0
                for word, c in bag.items():
                    value, k = self.known[word]
                    total += c * value
                    n += c * k
                out[i + j] = self.model.bias + total / n
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with `score`, the probability of label 1, for every row and whole text. One pass, no shuffle.

    Null and empty texts are scored as a line without words. Repeated rows score alike. The model has a fixed size and
    travels as a broadcast. Columns that aren't kept don't matter, whatever their names; a kept `score` is replaced.
    """
    kept = docs.select(*[c for c in keep if not isinstance(c, str) or c != "score"], F.col(text).alias("_text"))
    schema = kept.drop("_text").schema.add("score", "double", False)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            p = scorer.scores(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], names=schema.names)

    return kept.mapInArrow(run, schema)
