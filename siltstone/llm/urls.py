"""Verdicts on urls: rules by host and path, and for urls that no rule fits, trust and distrust over the graph of hosts.

Hosts are nodes. A link in a page is an edge from its host to the host it names, and a host and the domain it belongs to
link to each other. Trust starts at hosts with allowed pages and follows the edges; distrust starts at hosts with blocked
pages and goes against them, as who links to bad hosts is likely bad. Both are personalised PageRank. A host whose distrust
exceeds its trust by a margin is blocked.

Scores are whole numbers, UNIT to a seed, so that sums don't depend on the order of their terms. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

#: What a host gets as a seed if all of its pages have the verdict.
UNIT = 10**8
#: A score goes on by DAMPING[0] parts in DAMPING[1], at most ROUNDS times, less often if no score changes any more.
DAMPING, ROUNDS = (17, 20), 12
#: So many rounds are one job; what they give is written down.
STEPS = 4
#: A host is blocked if its distrust exceeds its trust by so much: what a lone host has whose pages are all blocked.
MARGIN = UNIT * (DAMPING[1] - DAMPING[0]) // DAMPING[1]
#: Arcs of one host that go by one key of a join; hosts with more have several keys.
ARCS_PER_KEY = 1 << 16
#: Blocked hosts up to this number are broadcast.
BROADCAST_HOSTS = 1 << 20
#: Hosts with at least one page in so many are as many at most, and always broadcast.
HOT_SHARE = 1000

LINK = r"""[Hh][Rr][Ee][Ff][\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^"'<>\x20\x09-\x0D/?#]+)"""
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class UrlRule:
    """A verdict (`allow` or `block`) on the urls of a host and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From the first `://` to the next `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """From behind the host to the next `?`, `#` or the end; empty for null or without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting(rules: Sequence[UrlRule], host: Column, path: Column, value: str) -> Column:
    """An attribute of the longest rule that fits, the first of equals; null if none does."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        out = out.when(((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path), F.lit(getattr(rule, value)))
    return out


def _domain(host: Column) -> Column:
    """What is behind a host's first dot, if that has a dot of its own."""
    rest = F.regexp_extract(host, r"^[^.]+\.(.+\..+)$", 1)
    return F.when(rest != "", rest)


def host_edges(pages: DataFrame) -> DataFrame:
    """Pages (`host`, `html`) to distinct edges (`source`, `target`): links to other hosts, and hosts with their domains, both ways."""
    named = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    linked = pages.where(F.col("host") != "").select(F.col("host").alias("source"), F.explode(named).alias("target"))
    linked = linked.withColumn("target", F.translate("target", UPPER, UPPER.lower())).where("source <> target").distinct()
    hosts = pages.select("host").unionByName(linked.select(F.col("target").alias("host"))).where("host <> ''").distinct()
    under = hosts.select(F.col("host").alias("source"), _domain(F.col("host")).alias("target")).where("target IS NOT NULL")
    back = under.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return linked.unionByName(under).unionByName(back).distinct()


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Trust and distrust (`host`, `trust`, `distrust`, longs) from seeds (`host`, `good`, `bad`, up to UNIT) over edges (`source`, `target`).

    Trust goes along the edges, distrust against them; a host deals out DAMPING of its score in equal parts, rounded down, and has
    the rest of its seed. Hosts without a score aren't there. A host with many arcs has several keys, so that no key of a join has more
    than about ARCS_PER_KEY. Scores are written to the shared folder every few rounds. Repeated edges count once.
    """
    kept = F.lit(DAMPING[1] - DAMPING[0])
    both = edges.select(F.lit("t").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"))
    arcs = both.unionByName(edges.select(F.lit("d").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"))).distinct()
    arcs = staged(arcs, "arcs")
    degrees = arcs.groupBy("kind", "from").agg(F.count("*").alias("arcs")).withColumn("keys", F.ceil(F.col("arcs") / ARCS_PER_KEY).cast("long"))
    degrees = staged(degrees, "degrees")
    # a host of many arcs would have one key in this join as well, so the few such hosts go to where the arcs are
    many = degrees.where(F.col("keys") > 1).select("kind", "from", F.col("arcs").alias("many"), "keys")
    keyed = arcs.join(F.broadcast(many), ["kind", "from"], "left")
    part = F.pmod(F.xxhash64("to"), F.coalesce("keys", F.lit(1)))
    keyed = staged(keyed.select("kind", "from", part.alias("part"), "to"), "arcs")
    unstage(arcs)
    base = seeds.select(
        "host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("good").alias("seed")), F.struct(F.lit("d").alias("kind"), F.col("bad").alias("seed")))).alias("s")
    )
    base = staged(base.select("s.kind", "host", F.floor(F.col("s.seed") * kept / F.lit(DAMPING[1])).alias("score")).where("score > 0"), "seeds")
    # scores never fall from one round to the next, so equal sums mean equal scores
    total = lambda df: sorted(tuple(r) for r in df.groupBy("kind").agg(F.sum(F.col("score").cast("decimal(38,0)"))).collect())
    scores, last = base, None
    for begin in range(0, rounds, STEPS):
        after = scores
        for _ in range(begin, min(begin + STEPS, rounds)):
            after = _round(after, base, keyed, degrees)
        after = staged(after, "scores")
        if scores is not base:
            unstage(scores)
        scores, before, last = after, last, total(after)
        if last == before:
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0).cast("long"))
    out = staged(scores.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust")), "hosts")
    for done in {id(d): d for d in (keyed, degrees, base, scores)}.values():
        unstage(done)
    return out


def _round(scores: DataFrame, base: DataFrame, keyed: DataFrame, degrees: DataFrame) -> DataFrame:
    """Scores (`kind`, `host`, `score`) after one round more."""
    met = scores.join(degrees.withColumnRenamed("kind", "of"), (F.col("kind") == F.col("of")) & (F.col("host") == F.col("from")))
    dealt = met.select(
        "kind", "from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("keys") - 1)).alias("part"), F.expr(f"score div arcs * {DAMPING[0]} div {DAMPING[1]}").alias("flow")
    )
    flows = keyed.join(dealt.where("flow > 0"), ["kind", "from", "part"]).select("kind", F.col("to").alias("host"), F.col("flow").alias("score"))
    return flows.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))


def judge(pages: DataFrame, rules: Sequence[UrlRule], key: str = "page_id", url: str = "url", html: str = "html", rounds: int = ROUNDS, margin: int = MARGIN) -> DataFrame:
    """Every page's `host`, `path`, `rule` (null if none fits) and `verdict`, with its key, `trust` and `distrust` (0 for hosts without).

    The longest rule decides; without one the host's scores do: `block` if distrust exceeds trust by `margin`, else `allow`. Seeds are a
    host's shares of allowed and of blocked pages, by rules. Null urls and those without `://` have an empty host and path, fit no rule and
    are allowed; they and their links are no part of the graph. Null html has no links. Repeated rows count as pages each. Other columns
    are dropped, whatever their names. An empty table gives an empty one.
    """
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    ruled = rows.withColumns({name: fitting(rules, F.col("host"), F.col("path"), value) for name, value in (("rule", "name"), ("said", "verdict"))})
    share = lambda verdict: F.expr(f"count_if(said = '{verdict}') * {UNIT} div count(*)")
    counts = staged(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"), F.count("*").alias("pages")), "counts")
    scores = propagated(host_edges(rows), counts, rounds)
    bad = scores.where((F.col("trust") > 0) | (F.col("distrust") > 0)).join(counts.select("host", "pages"), "host")
    out = _scored(ruled.drop("html"), bad, counts)
    blocked = F.coalesce(F.col("distrust") - F.col("trust") >= margin, F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    verdict = F.coalesce("said", F.when(blocked, "block").otherwise("allow")).alias("verdict")
    return out.select(F.col("key").alias(key), "host", "path", "rule", verdict, zero("trust"), zero("distrust"))


def _scored(rows: DataFrame, scores: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows with their host's scores: few hosts are broadcast, of many only those that hold much of all pages; the others' pages move."""
    found = scores.select(F.col("host").alias("of"), "trust", "distrust", "pages")
    if len(found.limit(BROADCAST_HOSTS + 1).select(F.lit(1)).collect()) <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(found), F.col("host") == F.col("of"), "left")
    least = (counts.agg(F.sum("pages")).first()[0] or 0) / HOT_SHARE
    hot = [r["host"] for r in counts.where(F.col("pages") >= least).select("host").limit(HOT_SHARE + 1).collect()]
    rest = rows.where(~F.col("host").isin(hot)).join(found, F.col("host") == F.col("of"), "left")
    return rest.unionByName(rows.where(F.col("host").isin(hot)).join(F.broadcast(found.where(F.col("of").isin(hot))), F.col("host") == F.col("of"), "left"))
