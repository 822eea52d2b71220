"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector of its own. An n-gram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place; a text's profile bundles (adds) the vectors of its n-grams, and so does a
language's prototype over all its training texts. A text gets the language of the closest prototype by cosine.

Letters' vectors come from a hash of their code point, so any script has as many as it has letters, and no table of
them is kept or sent: tasks work out those of the n-grams that they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

DIM = 2048
SEED = 20
#: Training with more different labels than this raises: a model holds one vector for each.
MAX_LANGUAGES = 1000
SEGMENT = 1 << 20
#: Vectors of so many n-grams are kept in a task (one byte for each dimension).
CACHE = 16_384
#: So many n-gram counts are held in a training task before they are bundled.
PENDING = 2_000_000
#: N-grams whose vectors are worked on at a time.
PART = 2048

_BITS = np.uint64(21)
_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether a code point is a letter; what isn't is a break between words."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _is_letter


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letter trigrams of a text with their counts; runs of other characters are one break.

    An n-gram's number holds its code points, 21 bits each, 0 for a break. Very long texts are taken in segments that
    overlap by a trigram, so memory stays bounded.
    """
    letters, parts = _letters(), []
    lowered = text.lower()
    carry = np.zeros(1, np.uint64)
    for i in range(0, len(lowered) + 1, SEGMENT):
        points = np.frombuffer(lowered[i : i + SEGMENT].encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = np.where(letters[points], points, 0).astype(np.uint64)
        last = i + SEGMENT > len(lowered)
        ids = np.concatenate([carry, ids, np.zeros(1, np.uint64)]) if last else np.concatenate([carry, ids])
        ids = ids[np.concatenate([[True], (ids[1:] | ids[:-1]) > 0])]
        if len(ids) >= 3:
            parts.append(np.unique((((ids[:-2] << _BITS) | ids[1:-1]) << _BITS) | ids[2:], return_counts=True))
        carry = ids[-2:]
    return _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def letter_vectors(points: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """A row of -1 and 1 for each code point, from the bits of hashes of it and the place in the row."""
    h = points.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(-(-dim // 64), dtype=np.uint64) + np.uint64(seed << 44)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h + np.uint64(0x9E3779B97F4A7C15)) if shift == 30 else h
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8), axis=1)[:, :dim]
    return bits.astype(np.int8) * 2 - 1


def gram_vectors(codes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Bound vectors of n-grams: the product of their letters' vectors, rotated by 2, 1 and 0."""
    mask = (np.uint64(1) << _BITS) - np.uint64(1)
    letters = [codes >> (_BITS * np.uint64(2)), (codes >> _BITS) & mask, codes & mask]
    points, where = np.unique(np.concatenate(letters), return_inverse=True)
    vectors = letter_vectors(points, dim, seed)
    first, second, third = np.split(where, 3)
    return np.roll(vectors, 2, axis=1)[first] * np.roll(vectors, 1, axis=1)[second] * vectors[third]


def bundled(codes: np.ndarray, counts: np.ndarray, dim: int, seed: int) -> np.ndarray:
    out = np.zeros(dim)
    for i in range(0, len(codes), PART):
        out += counts[i : i + PART].astype(np.float64) @ gram_vectors(codes[i : i + PART], dim, seed).astype(np.float64)
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Prototypes of unit length, one row per language. Its size is languages times dimensions, whatever the corpus."""

    languages: list[str]
    prototypes: np.ndarray
    seed: int

    @property
    def dim(self) -> int:
        return self.prototypes.shape[1]


def train(docs: DataFrame, text: str = "text", label: str = "lang", dim: int = DIM, seed: int = SEED) -> LanguageModel:
    """Bundle a prototype for each label over all rows that have a text and a label.

    Each task bundles what it reads, and its sums per language and dimension are added up: what is shuffled doesn't depend
    on how many texts a language has, so one with most of the rows costs nothing more. A task holds a bounded number of
    counts and hands on what it has before it holds more. More than MAX_LANGUAGES labels raise.
    """

    def sums(found: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in found.items():
            vector = bundled(*_merged(parts), dim, seed)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dim, "i": np.arange(dim, dtype=np.int32), "v": vector})

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        held = 0
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = gram_counts(t)
                found.setdefault(lang, []).append(counts)
                held += len(counts[0])
                if held > PENDING:
                    found = {k: [_merged(parts)] for k, parts in found.items()}
                    held = sum(len(parts[0][0]) for parts in found.values())
                    if 2 * held > PENDING:
                        yield from sums(found)
                        found, held = {}, 0
        yield from sums(found)

    rows = docs.select(F.col(label).alias("lang"), F.col(text).alias("text")).dropna()
    added = staged(rows.mapInArrow(bundle, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")), "prototypes")
    languages = sorted(r["lang"] for r in added.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: {languages[:3]} ...")
    prototypes = np.zeros((len(languages), dim))
    table = added.toArrow()
    place = {lang: k for k, lang in enumerate(languages)}
    prototypes[[place[lang] for lang in table["lang"].to_pylist()], table["i"].to_numpy()] = table["v"].to_numpy()
    unstage(added)
    lengths = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return LanguageModel(languages, prototypes / np.where(lengths > 0, lengths, 1), seed)


class Scorer:
    """Cosines of texts with the prototypes. Vectors of n-grams are kept once they are worked out, up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((CACHE, model.dim), np.int8)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        listed = codes.tolist()
        new = [c for c in listed if c not in self.row]
        if len(self.row) + len(new) > CACHE:
            self.row.clear()
            new = listed
        if new:
            begin = len(self.row)
            self.vectors[begin : begin + len(new)] = gram_vectors(np.array(new, np.uint64), self.model.dim, self.model.seed)
            self.row.update(zip(new, range(begin, begin + len(new)), strict=True))
        return np.array([self.row[c] for c in listed])

    def profile(self, text: str) -> np.ndarray | None:
        """The bundle of a text's n-grams; None without a letter."""
        codes, n = gram_counts(text)
        if not len(codes):
            return None
        out = np.zeros(self.model.dim)
        for i in range(0, len(codes), PART):
            out += n[i : i + PART].astype(np.float32) @ self.vectors[self._rows(codes[i : i + PART])].astype(np.float32)
        return out

    def cosines(self, text: str) -> np.ndarray | None:
        """None for texts without a letter."""
        profile = self.profile(text)
        return None if profile is None else self.model.prototypes @ profile / max(float(np.linalg.norm(profile)), 1e-9)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with `lang_pred` and `score`, the cosine (0 where it is below), for every row. One pass, no shuffle.

    Null, empty and letterless texts, and all texts under a model without languages, get `und` and 0. Equal
    cosines go to the first language by code point. Repeated rows are judged alike. Columns that aren't kept don't
    matter, whatever their names; a kept one that is called like an output is replaced.
    """
    kept = docs.select(*[c for c in keep if not isinstance(c, str) or c not in ("lang_pred", "score")], F.col(text).alias("_text"))
    schema = kept.drop("_text").schema.add("lang_pred", "string", False).add("score", "double", False)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                cosines = scorer.cosines(t) if t and model.languages else None
                best = None if cosines is None else int(np.argmax(cosines))
                langs.append("und" if best is None else model.languages[best])
                scores.append(0.0 if best is None else float(min(1.0, max(0.0, cosines[best]))))
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(predict, schema)
