"""Removal of boilerplate lines that many sites share, in built-in functions only.

A HyperLogLog sketch per line hash counts the distinct sites of a line; partial sketches merge in the aggregation,
so a line on every page of a corpus is one small sketch per task. Where the estimate is near the threshold an exact
distinct count decides.

Sites are counted twice. Lines on many sites are found first, over all pages. A page that consists mostly of such lines
says nothing about them: it is a copy of a page elsewhere, or has no content of its own. So the second count asks for the
sites on which a line is a minor part of a page. Lines that pass it are boilerplate and are cut from every page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 8
#: A page is evidence for a line's spread if lines on many sites hold at most this percentage of its characters.
MINOR_PERCENT = 50
LG_K = 12
#: Estimates within this part of the threshold (six standard errors of such a sketch), or within one, count exactly.
NEAR = 0.1
#: So many hashes of boilerplate lines may be written into the plan; more are joined.
IN_PLACE = 4096


def line_key(line: Column) -> Column:
    """Hash of a line without the blanks around it; null if it has no word."""
    trimmed = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed != "", F.xxhash64(trimmed))


def _lines(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    rows = docs.select(
        F.col(key).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("row"), F.length(text).alias("page"),
        F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("site"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"),
    )
    return rows.withColumn("hash", line_key(F.col("line"))).where(F.col("hash").isNotNull())


def spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """Rows (`hash`, `site`) to the hashes on at least `min_sites` distinct sites, with `sites`: exact near the threshold, else estimated."""
    margin = max(1, round(NEAR * min_sites))
    estimates = lines.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    estimates = staged(estimates.where(F.col("sites") >= min_sites - margin), "spread")
    near = estimates.where(F.col("sites") <= min_sites + margin).select("hash")
    exact = lines.join(near, "hash", "left_semi").groupBy("hash").agg(F.count_distinct("site").alias("sites"))
    out = staged(estimates.where(F.col("sites") > min_sites + margin).unionByName(exact.where(F.col("sites") >= min_sites)), "spread")
    unstage(estimates)
    return out


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, minor_percent: int = MINOR_PERCENT, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Hashes of boilerplate lines, with the `sites` on which each is a minor part of a page."""
    lines = _lines(docs, key, text, site)
    wide = spread(lines.select("hash", "site"), min_sites)
    hits = lines.join(wide, "hash", "left_semi").select("id", "row", "site", "page", "at", "hash", F.length("line").alias("chars"))
    pages = hits.groupBy("id", "row", "site", "page").agg(F.collect_set(F.struct("at", "hash", "chars")).alias("hits"))  # a page's own lines only
    held = F.aggregate("hits", F.lit(0).cast("long"), lambda total, hit: total + hit["chars"])
    minor = staged(pages.where(100 * held <= minor_percent * F.col("page")).select("site", F.explode("hits.hash").alias("hash")).distinct(), "minor")
    out = spread(minor, min_sites)
    unstage(wide)
    unstage(minor)
    return out


def remove_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, minor_percent: int = MINOR_PERCENT,
    key: str = "doc_id", text: str = "text", site: str = "source",
) -> DataFrame:
    """The documents with boilerplate lines cut out of `text`, and `n_lines` and `n_removed` (both long).

    Lines split at newlines are compared without the blanks around them; lines without a word are never cut. A null
    site is a site of its own. Null texts stay null with no lines; an empty text is one line, and so is what stays of a
    page of boilerplate alone. Repeated rows are cut alike. Other columns pass through; columns named like an output are
    replaced. While the boilerplate lines are few, pages are cut where they lie; only beyond IN_PLACE lines do pages move.
    """
    plain = docs.drop(*[c for c in ("n_lines", "n_removed") if c not in (key, text, site)])
    bad = boilerplate(plain, min_sites, minor_percent, key, text, site).select("hash")
    few = [r["hash"] for r in bad.limit(IN_PLACE + 1).collect()]
    # every column under a name of its own, so that none of the table's can clash
    names = {c: f"c{i}" for i, c in enumerate(plain.columns)}
    wide = plain.select(*[F.col(c).alias(n) for c, n in names.items()])
    if len(few) <= IN_PLACE:
        unstage(bad)
        known = lambda line: line_key(line).isin(few)
    else:
        hits = _lines(plain, key, text, site).join(bad, "hash", "left_semi")
        found = hits.groupBy("row", "id").agg(F.collect_set("hash").alias("hashes"))
        own = F.xxhash64(names[key], names[text]) == F.col("row")
        wide = wide.join(found, own & F.col(names[key]).eqNullSafe(F.col("id")), "left")
        known = lambda line: F.array_contains("hashes", line_key(line))
    page = F.col(names[text])
    parts = F.split(page, "\n")
    kept = F.filter(parts, lambda line: ~F.coalesce(known(line), F.lit(False)))
    lines = F.when(page.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    cut = wide.select("*", lines.alias("n_lines"), kept.alias("kept"))
    gone = F.when(page.isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long")
    rest = F.when(gone > 0, F.array_join("kept", "\n")).otherwise(page)
    return cut.select(*[(rest if c == text else F.col(n)).alias(c) for c, n in names.items()], "n_lines", gone.alias("n_removed"))
