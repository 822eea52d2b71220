"""Quality rules as a short-circuit cascade, in built-in expressions only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, words_col

#: About so many different texts are the sample on which costs and rejections are estimated. They put the rules in order;
#: results don't depend on it.
SAMPLE_ROWS = 4096

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named condition under which a document is rejected. It may use `text` and the base columns.

    `work` is what deciding it takes for a document, in characters that are looked at: by default those of its text. The base
    columns are there for every document, so a rule that only compares them costs as much as a character.
    """

    name: str
    rejects: Column
    work: Column | None = None


def base_columns(text: Column) -> dict[str, Column]:
    """Counts that every document gets. They expect the array of its words in a column `_words`."""
    words = F.col("_words")
    kept_lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_lines": bind(kept_lines, lambda ls: F.struct(F.size(ls).alias("n"), F.size(F.array_distinct(ls)).alias("d"))),
        "n_repeat_words": _repeat_words(words),
    }


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included.

    Sorting window hashes with their positions puts equal windows side by side, so the cost is n log n even
    in texts that repeat themselves throughout.
    """

    def windows(w: Column) -> Column:
        at = lambda i, k: F.get(w, i + F.lit(k))
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))

    def spread(found: Column) -> Column:
        """The number of words that windows at the found positions, in order, cover."""
        gaps = F.zip_with(found, F.slice(found, F.lit(2), F.size(found)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    def by_pairs(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda e, j: F.get(s, j)["h"] == e["h"]
            return F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"])

        return bind(pairs, repeated)

    def by_packed(hashes: Column) -> Column:
        """44 bits of each hash and 20 of its position in one long; null if those hash bits are ambiguous."""
        packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h, 20).bitwiseOR(i.cast("long"))))
        head = lambda x: F.shiftright(x, 20)
        repeated = bind(packed, lambda s: F.filter(s, lambda e, i: (head(F.get(s, i - 1)) == head(e)) | (head(F.get(s, i + 1)) == head(e))))

        def settled(found: Column) -> Column:
            places = F.transform(found, lambda e: e.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))
            full = F.array_distinct(F.transform(places, lambda i: F.get(hashes, i)))
            return F.when(F.size(full) == F.size(F.array_distinct(F.transform(found, head))), places)

        return F.when(F.size(hashes) < 1 << 20, bind(repeated, settled))

    def covered(hashes: Column) -> Column:
        return bind(F.sort_array(F.coalesce(by_packed(hashes), by_pairs(hashes))), spread)

    counted = bind(
        F.when(F.size(words) >= 4, bind(words, windows)),
        lambda h: F.when(h.isNotNull(), covered(h)),
    )
    return F.coalesce(counted, F.lit(0)).cast("long")


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules in the manner of published web-corpus filters.

    Rejected are texts with words of under 2 or over 14 characters on average; over 0.4 symbols a word; 4 or more repeated
    lines that make up over half of all lines; over 30 % of words in repeated 3-word windows; over 40 % of characters (blanks
    aside) that aren't letters, or that are capitals; under 5 different words, or fewer than half of them in shorter texts.
    """
    words, n, t, compared = F.col("_words"), F.col("n_words"), F.col(text), F.lit(1)
    other = F.length(F.regexp_replace(t, r"[\p{L}\x20\x09-\x0D]+", ""))
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    return [
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n), compared),
        Rule("symbols", 10 * F.col("n_symbols") > 4 * n, compared),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_text_lines")), compared),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 30 * n, compared),
        Rule("few_letters", 10 * other > 4 * F.col("word_chars")),
        Rule("capitals", 10 * capitals > 4 * F.col("word_chars")),
        Rule("one_word", 2 * F.size(F.array_distinct(words)) < F.least(n, F.lit(10)), F.col("word_chars")),
    ]


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `_words` and the base counts."""
    cols = base_columns(F.col(text))
    out = docs.withColumn("_words", words_col(F.col(text))).withColumns(cols)
    return (
        out.withColumn("n_dup_lines", (F.col("n_lines.n") - F.col("n_lines.d")).cast("long"))
        .withColumn("n_text_lines", F.col("n_lines.n").cast("long"))
        .drop("n_lines")
    )


def measured(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[list[float], Mapping[tuple[bool, ...], int]]:
    """Each rule's mean work on a sample of the texts that the base rule leaves, and how many documents each set of rules rejects there.

    The sample is all texts whose hash is below a bound, from all partitions, so it depends on neither order nor partitions; a
    text that many documents have is evaluated once and counts for each. Only sums come to the driver.
    """
    n = docs.count()
    hashed = docs.select(F.col(text).alias(text), F.xxhash64(text, F.lit("sample")).alias("h")).where(F.col(text).isNotNull())
    whole = 1 << 52
    picked = hashed.where(F.pmod("h", F.lit(whole)) < int(whole * min(1.0, sample_rows / max(n, 1))))
    sample = with_base(picked.groupBy("h").agg(F.first(text).alias(text), F.count("*").alias("_n")), text).where(~base_failed())
    hits = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    works = [F.coalesce((F.length(text) if r.work is None else r.work).cast("double"), F.lit(1.0)).alias(f"w{i}") for i, r in enumerate(rules)]
    sums = [F.sum(F.col(f"w{i}") * F.col("_n")).alias(f"w{i}") for i in range(len(rules))]
    rows = sample.select("_n", *hits, *works).groupBy(*[f"r{i}" for i in range(len(rules))]).agg(F.sum("_n").alias("n"), *sums).collect()
    flags = Counter({tuple(r[f"r{i}"] for i in range(len(rules))): r["n"] for r in rows})
    return [sum(r[f"w{i}"] for r in rows) / max(1, flags.total()) for i in range(len(rules))], flags


def ordered_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost on a sample: the best first, then the best on the documents that it leaves, and so on.

    Rules that reject nothing more go by cost, the cheapest first; ties keep the given order. Order changes what is computed, never which
    documents are kept.
    """
    costs, flags = measured(docs, rules, text, sample_rows)
    left, out, seen = list(range(len(rules))), [], Counter(flags)
    while left:
        gain = lambda i: sum(n for f, n in seen.items() if f[i]) / max(costs[i], 1e-9)
        best = max(left, key=lambda i: (gain(i), -costs[i], -i))
        out.append(rules[best])
        left.remove(best)
        seen = Counter({f: n for f, n in seen.items() if not f[best]})
    return out


def apply_rules(
    docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS,
    min_words: int = 50, max_repeat_percent: int = 50,
) -> DataFrame:
    """Add base counts, `base_failed` and `kept` to documents.

    One CASE chain holds the rules: Spark evaluates its branches one after another and stops at the first
    that rejects, so cheap and strict rules spare the others their work. No shuffle, no Python.

    Null, empty and blank texts have zero counts and fail the base rule; no text fails for its length alone. An empty
    table gives an empty one. Repeated rows are judged alike. Other columns pass through, whatever their names; those that share a
    name with an output are replaced.
    """
    rules = default_rules(text) if rules is None else list(rules)
    outputs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines", "n_repeat_words", "base_failed", "kept"]
    kept = {c: c if c == text else f"_{text}_{i}" for i, c in enumerate(docs.columns) if c == text or c not in outputs}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in kept.items()])
    failed = base_failed(min_words, max_repeat_percent)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in ordered_rules(plain.select(text), rules, text, sample_rows):
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False))
    judged = with_base(plain, text).withColumn("base_failed", failed).withColumn("kept", verdict.otherwise(F.lit(True)))
    # a generator of one row: filters on its columns stay behind it, where a projection's would be evaluated once more in the filter
    return judged.select(*[F.col(n).alias(c) for c, n in kept.items()], F.inline(F.array(F.struct(*outputs))))
