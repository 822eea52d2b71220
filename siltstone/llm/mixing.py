"""Mixing sources to target weights by entropy balancing.

Every document i gets a rate r_i in (0, cap), at which it is repeated. Among all rates that give each source its
target number of tokens, those closest in entropy to "each document once" are wanted. The dual of this convex
problem has one multiplier per source, and its solution tilts documents exponentially:

    r_i / (cap - r_i) = exp(lambda_source * z_i) / (cap - 1),    z_i = (tokens_i / mean tokens of source) ** tilt

`tilt` is the power of a document's tokens that the entropy isn't weighted with: 1 would weigh all documents alike
and make rare sources favour their longest documents, 0 gives one rate per source. Newton steps on the multipliers
are distributed: each sums a gradient and a curvature per source over a histogram of document sizes.

Rates are rounded to copies by carrying the remainder from one document to the next, longest first, inside
bounded groups of a source, so a source misses its target by little more than its shortest documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, staged, unstage

CAP = 2
TILT = 0.25
#: Documents of a source that are rounded together, about.
GROUP_ROWS = 2048
TOLERANCE = 1e-6
STEPS = 40


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), percent: int = 150, cap: float = CAP) -> DataFrame:
    """Sources with their `target`, from one row per source: `source`, `source_size`.

    In code-point order, null last, sources weigh `weights`, repeated. They share `percent` of all tokens; a target
    stops at `cap` times its source's size, and what is above is shared again by weight until none is: each round
    is one aggregation over the sources. If all targets are at their cap, the mix is smaller than asked.
    """
    ranked = _numbered(sizes, [F.col("source").isNull(), F.col("source").cast("binary")])
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    weighed = staged(ranked.select("source", "source_size", share.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most")), "weights")
    total = weighed.agg(F.sum("source_size").alias("s"), F.sum("w").alias("w"), F.sum("most").alias("m")).first()
    wanted = (total["s"] or 0) * percent / 100
    level = None
    full_most, full_w = 0.0, 0.0
    if wanted < (total["m"] or 0):
        while True:  # each round fixes the sources that the present share would overfill; their number only grows
            level = (wanted - full_most) / ((total["w"] or 0) - full_w)
            now = weighed.agg(
                F.coalesce(F.sum(F.when(F.col("most") <= level * F.col("w"), F.col("most"))), F.lit(0.0)).alias("m"),
                F.coalesce(F.sum(F.when(F.col("most") <= level * F.col("w"), F.col("w"))), F.lit(0.0)).alias("w"),
            ).first()
            if now["w"] <= full_w:
                break
            full_most, full_w = now["m"], now["w"]
    target = F.col("most") if level is None else F.least(F.col("most"), F.lit(level) * F.col("w"))
    return weighed.select("source", "source_size", target.alias("target"))


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rank rows from 0 in a total order: range partitions are numbered inside and shifted by the sizes before them."""
    parted = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "numbered")
    parted = parted.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = parted.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    return parted.join(before, "part").withColumn("rank", F.col("before") + F.col("place")).drop("at", "part", "place", "before")


def _rate(multiplier: Column, z: Column, cap: float) -> Column:
    return F.lit(float(cap)) / (1 + F.lit(float(cap) - 1) * F.exp(-F.greatest(F.least(multiplier * z, F.lit(60.0)), F.lit(-60.0))))


def solve(histogram: DataFrame, cap: float = CAP) -> DataFrame:
    """Multipliers per source (`source`, `multiplier`) from rows (`source`, `size`, `n`, `z`, `target`).

    Newton steps inside a bracket that each gradient's sign narrows; a step that leaves it, or meets no curvature,
    halves it instead. Sources whose target is all that the cap allows sit at its end.
    """
    state = histogram.groupBy("source").agg(
        F.first("target").alias("target"), F.sum(F.col("n") * F.col("size")).alias("tokens"), F.max("z").alias("z_max"), F.min("z").alias("z_min")
    )
    edge = F.lit(60.0) / F.greatest(F.col("z_min"), F.lit(1e-9))
    start = F.when(F.col("target") >= cap * F.col("tokens"), edge).otherwise(0.0)
    state = staged(state.select("source", "target", "tokens", start.alias("multiplier"), (-edge).alias("low"), edge.alias("high")), "dual")
    for _ in range(STEPS):
        rate = _rate(F.col("multiplier"), F.col("z"), cap)
        mass = F.col("n") * F.col("size") * rate
        sums = (
            histogram.select(F.col("source").alias("of"), "size", "n", "z").join(state, F.col("of").eqNullSafe(F.col("source")))
            .groupBy("source").agg(F.sum(mass).alias("got"), F.sum(mass * (1 - rate / cap) * F.col("z")).alias("slope"))
        )
        both = state.alias("a").join(sums.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "got", "slope")
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        done = F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
        newton = F.col("multiplier") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        stepped = both.withColumns({"low": low, "high": high, "newton": newton, "done": done | (F.col("target") >= cap * F.col("tokens"))})
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        after = F.when(F.col("done"), F.col("multiplier")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        following = staged(stepped.select("source", "target", "tokens", after.alias("multiplier"), "low", "high", "done"), "dual")
        left = following.where(~F.col("done")).limit(1).count()
        unstage(state)
        state = following.drop("done")
        if not left:
            break
    return state.select("source", "multiplier")


def _rounded(cap: int):
    """Copies of rows (source, group, id, size, source_size, target, rate), sorted by group and falling size.

    In each group every document takes what the carried remainder allows, between 0 and the cap. Rows stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, carry = None, 0.0
        for batch in batches:
            copies = []
            for source, group, size, rate in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 6)), strict=True):
                if (source, group) != at:
                    at, carry = (source, group), 0.0
                n = 0
                if size:
                    carry += size * rate
                    n = min(cap, max(0, int(carry / size + 0.5)))
                    carry -= n * size
                copies.append(n)
            names = ["source", "id", "size", "source_size", "target", "rate", "copies"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(copies, pa.int64())], names=names)

    return run


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1),
    percent: int = 150, cap: int = CAP, tilt: float = TILT,
) -> DataFrame:
    """One row per document: its key, `source`, `size` (words), `source_size`, `target`, `rate`, `copies`, `taken` = copies * size.

    Texts aren't moved: after the word count only keys, sources and sizes are. Documents without a word (null,
    empty, blank) take none. A null source is a source. Repeated rows are mixed as documents of their own; ties in
    size go by key, then by nothing that differs. A source whose target is its cap is taken `cap` times whole.
    An empty table gives an empty one. Other columns are dropped, whatever their names.
    """
    sized = staged(docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")), "sized")
    sources = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.count_if(F.col("size") > 0).alias("full")), "sources")
    goals = targets(sources.select("source", "source_size"), weights, percent, cap)
    known = sources.alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "target")
    known = staged(known.withColumnRenamed("source", "name"), "goals")
    z = F.pow(F.col("size") * F.col("full") / F.col("source_size"), F.lit(float(tilt)))
    counts = sized.where(F.col("size") > 0).groupBy("source", "size").agg(F.count("*").alias("n"))
    histogram = staged(counts.join(known, F.col("source").eqNullSafe(F.col("name"))).select("source", "size", "n", z.alias("z"), "target"), "histogram")
    solved = solve(histogram, cap).withColumnRenamed("source", "of")
    known = known.join(solved, F.col("name").eqNullSafe(F.col("of")), "left").drop("of")
    rate = F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap))).otherwise(_rate(F.col("multiplier"), z, cap))
    rated = sized.join(known, F.col("source").eqNullSafe(F.col("name"))).select(
        "source", F.pmod(F.xxhash64("id", "size"), F.ceil(F.col("docs") / GROUP_ROWS)).alias("group"), "id", "size", "source_size", "target",
        F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"),
    )
    for done in (histogram, sources):
        unstage(done)
    dealt = rated.repartition("source", "group").sortWithinPartitions("source", "group", F.desc("size"), "id")
    kind = dealt.schema["id"].dataType.simpleString()
    out = dealt.mapInArrow(_rounded(cap), f"source string, id {kind}, size long, source_size long, target double, rate double, copies long")
    return out.select(F.col("id").alias(key), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
