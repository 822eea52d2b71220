"""Clusters, url verdicts and repaired conversations against plain Python, and on odd tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import clusters, dialogue, packing, queries, rules, topk, urls
from siltstone.llm.common import read_table

VECTORS = "vec_id long, embedding array<double>"


def lloyd(rows, k, rounds, size):
    """Plain clustering of (key, vector) with whole components: cluster and distance per row, and centroids."""
    whole = [(key, [math.floor(64 * x) for x in v]) for key, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{key}".encode()).hexdigest(), v) for key, v in whole if key is not None)[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in whole]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(whole, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return sorted((key if key is not None else -1, nearest(v)[1], nearest(v)[0]) for key, v in whole), centroids


def found(assigned):
    return sorted((r["id"] if r["id"] is not None else -1, r["cluster"], r["distance"]) for r in assigned.collect())


def test_clusters_of_blobs(spark):
    """Well apart, so that most distances aren't taken after the first rounds, and the result is that of all distances."""
    rng = random.Random(3)
    centres = [[rng.uniform(-50, 50) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.5) for c in centres[i % 12]]) for i in range(1200)]
    seen = []
    got, centroids = clusters.clustered(spark.createDataFrame(rows, VECTORS).repartition(5), k=12, rounds=6, size=6, per_group=3, seen=seen)
    want, theirs = lloyd(rows, 12, 6, 6)
    assert centroids == theirs and found(got) == want
    assert seen[0] == 1200 * 12 and seen[-1] < 1200 * 12 / 2


def test_clusters_huge_ties_and_odd(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(60)]  # many ties
    rows += [(100 + i, [1e30 * (i + 1), -1e-300, 2.0**40]) for i in range(3)]  # beyond longs
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, math.nan, 2.0]), (203, [1.0, math.inf, 2.0]), (204, [1.0]), (None, [0.5, 0.5, 0.5]), (7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], VECTORS + ", cluster int, id string, upper double")
    got, centroids = clusters.clustered(df, k=8, rounds=4, size=3, per_group=2)
    want, theirs = lloyd(rows, 8, 4, 3)
    assert centroids == theirs and found(got) == sorted((k, c, min(d, clusters.LONGEST)) for k, c, d in want)
    out = clusters.inertia(got, centroids).collect()
    assert len(out) == len(want) and len({r["inertia"] for r in out}) == 1
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, theirs[r["cluster"]])).encode()).hexdigest() for r in out)


def test_clusters_few_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 5.0])]
    got, centroids = clusters.clustered(spark.createDataFrame(rows, VECTORS), k=16, size=2)
    assert (found(got), centroids) == lloyd(rows, 16, 3, 2)
    for none in ([], [(None, [1.0, 2.0])], [(1, [1.0])]):
        got, centroids = clusters.clustered(spark.createDataFrame(none, VECTORS), size=2)
        assert not centroids and not clusters.inertia(got, centroids).collect()


def test_bounds_hold():
    """After every round the bounds enclose the true distances."""
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(300, 5)) * 64)
    centroids = points[:9].astype(int).tolist()
    groups, known, moves = clusters.grouped(centroids, 3), {}, None
    assert sorted(c for g in groups for c in g) == list(range(9))
    for _ in range(5):
        step = clusters.Step(centroids, groups, moves)
        at, _, upper, lower, _ = clusters.assign(clusters.Points(points, step), *[known.get(c) for c in ("cluster", "upper", "lower")])
        true = np.sqrt(((points[:, None] - step.near[None]) ** 2).sum(axis=2))
        assert (true[np.arange(300), at] == true.min(axis=1)).all() and (upper >= true.min(axis=1)).all()
        for g, members in enumerate(groups):
            others = np.where(np.array(members)[None] == at[:, None], np.inf, true[:, members])
            assert (lower[:, g] <= others.min(axis=1)).all()
        known = {"cluster": at, "upper": upper, "lower": lower}
        after = [(points[at == j].sum(axis=0) // max(1, (at == j).sum())).astype(int).tolist() if (at == j).any() else c for j, c in enumerate(centroids)]
        moves = [math.dist(a, b) for a, b in zip(centroids, after, strict=True)]
        centroids = after


# --- urls

PAGES = "page_id long, url string, html string"


def plain_host(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2]) if found else ("", "")


def plain_scores(edges, good, bad, rounds):
    out = {}
    for kind, arcs, seeds in (("trust", edges, good), ("distrust", {(b, a) for a, b in edges}, bad)):
        degree = {a: sum(1 for x, _ in arcs if x == a) for a, _ in arcs}
        base = {h: s * 3 // 20 for h, s in seeds.items()}
        scores = dict(base)
        for _ in range(rounds):
            after = dict(base)
            for a, b in arcs:
                after[b] = after.get(b, 0) + scores.get(a, 0) // degree[a] * 17 // 20
            scores = after
        for h, s in scores.items():
            out.setdefault(h, {"trust": 0, "distrust": 0})[kind] = s
    return out


def test_links_carry_distrust(spark, monkeypatch):
    """Who links to blocked hosts is blocked, who is linked to by trusted ones isn't; hosts with many arcs have several keys."""
    monkeypatch.setattr(urls, "ARCS_PER_KEY", 3)
    links = lambda *hosts: "".join(f'<a HREF = "https://{h}/x">' for h in hosts)
    good, bad = [f"good{i}.com" for i in range(7)], [f"bad{i}.net" for i in range(7)]
    rows = [(i, f"http://{h}/a", links("Fine.org", *good)) for i, h in enumerate(good)] + [(20 + i, f"http://{h}/es/", None) for i, h in enumerate(bad)]
    rows += [(40, "http://farm.org/", links(*bad)), (41, "http://fine.org/p?q#f", links("good0.com")), (42, "http://lone.org", "<a href='/x'>"), (43, None, links("bad0.net")), (44, "no url", ""), (45, "HTTP://A.Net/fr", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES + ", host string, verdict int")
    got = {r["page_id"]: r for r in urls.judge(df, queries.URL_RULES).collect()}
    assert {k: got[k]["verdict"] for k in range(40, 46)} == {40: "block", 41: "allow", 42: "allow", 43: "allow", 44: "allow", 45: "allow"}
    assert got[45]["host"] == "a.net" and got[45]["path"] == "/fr" and got[43]["host"] == "" and got[20]["rule"] == "net/es/"
    edges = {(h, t) for h in good for t in ("fine.org", *good) if h != t} | {("farm.org", b) for b in bad} | {("fine.org", "good0.com")}
    want = plain_scores(edges, dict.fromkeys(good, urls.UNIT), dict.fromkeys(bad, urls.UNIT), urls.ROUNDS)
    assert all((r["trust"], r["distrust"]) == tuple(want.get(r["host"], {"trust": 0, "distrust": 0}).values()) for r in got.values())


def test_longest_rule_and_domains(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_HOSTS", 0)  # the way of many hosts
    rows = [
        (1, "http://www.example.com/en/1"), (2, "http://m.www.example.com/en/"), (3, "http://x.example.com/en/"), (4, "http://x.example.com/de/"), (5, "http://notexample.com/en/"),
        (6, "http://a.b.net/es/1"), (7, "http://b.net/en/"), (8, "http://com"), (8, "http://com/"), (None, "http://c.b.net/de"), (9, "http://b.net:80/es/"), (10, "x://u@d.net/fr/\n#"),
    ]
    got = [(r["page_id"], r["rule"], r["verdict"], r["trust"], r["distrust"]) for r in urls.judge(spark.createDataFrame([(*r, None) for r in rows], PAGES), queries.URL_RULES).collect()]
    rule = {(k, r) for k, r, *_ in got}
    assert rule == {(1, "www.example.com/en/"), (2, "www.example.com/en/"), (3, "example.com/en/"), (4, "com/"), (5, "com/"), (6, "net/es/"), (7, None), (8, None), (8, "com/"), (None, None), (9, None), (10, "net/fr/")}
    good = {"www.example.com": 1, "m.www.example.com": 1, "x.example.com": 0.5, "notexample.com": 1, "com": 0.5}
    family = {("a.b.net", "b.net"), ("c.b.net", "b.net"), ("www.example.com", "example.com"), ("m.www.example.com", "www.example.com"), ("x.example.com", "example.com")}
    seed = lambda shares: {h: int(s * urls.UNIT) for h, s in shares.items()}
    want = plain_scores(family | {(b, a) for a, b in family}, seed(good), seed({"a.b.net": 1, "u@d.net": 1, "x.example.com": 0.5}), urls.ROUNDS)
    hosts = {7: "b.net", None: "c.b.net", 1: "www.example.com", 10: "u@d.net", 8: "com"}
    assert all((t, d) == tuple(want[hosts[k]].values()) for k, _, _, t, d in got if k in hosts)
    empty = urls.judge(spark.createDataFrame([], PAGES), queries.URL_RULES)
    assert empty.count() == 0 and empty.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]


# --- conversations

TALK = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """Least cost and audit, by suffixes, of (role, text, fault)."""
    edges = {("n", "s"): "s", ("n", "u"): "o", ("s", "u"): "o", ("c", "u"): "o", ("o", "a"): "c"}
    names = {"u": "user", "a": "assistant"}
    best = {q: (0, "", ()) for q in "nc"}
    for at in range(len(rows), -1, -1):
        items = {} if at < len(rows) else dict(best)
        if at < len(rows):
            role, text, fault = rows[at]
            more = 3 if fault == "truncated" else 0
            for q in "nsoc":
                ways = [(best[q][0] + 4, "D" + best[q][1], best[q][2])] if q in best else []
                for (p, x), to in edges.items():
                    if p == q and to in best and fault not in ("blank", "duplicate"):
                        c, audit, lines = best[to]
                        if role[:1] == x:
                            ways.append((c + more, "K" + audit, (f"{role}:{text}", *lines)))
                        if x in names:
                            ways.append((c + 3 + more, "R" + audit, (f"{names[x]}:{text}", *lines)))
                if ways:
                    items[q] = min(ways)
        for _ in range(3):
            for (p, x), to in edges.items():
                if x in names and to in items:
                    c, audit, lines = items[to]
                    items[p] = min(items.get(p, (1 << 40, "", ())), (c + 3, "I" + audit, (names[x] + ":", *lines)))
        best = items
    return best["n"]


def plain_talks(rows):
    """The whole contract for (conv, turn, role, text) rows."""
    talks = {}
    for conv, turn, role, text in rows:
        own = talks.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in talks.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
            judged.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        faults = [f for *_, f in judged]
        cost, audit, lines = plain_repair(judged)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in dialogue.FAULTS),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def audits(df):
    rows = dialogue.audited(dialogue.repair(queries.damaged(df), gone=F.col("gone"))).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_repair_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, sf_dir).collect()}
    assert got == plain_talks(rows)


def test_repair_of_odd_conversations(spark):
    rng = random.Random(11)
    pick = lambda *v: rng.choice(v)
    rows = [
        (pick(*range(60), None), pick(None, *range(9)), pick("system", "user", "user", "assistant", "assistant", None, "tool", "User"), pick("Yes.", "No?", "cut", " \n", "", None, "end. \t", "é…", "a.b!"))
        for _ in range(900)
    ]
    rows += [(100, t, "user" if t % 3 else "assistant", f"w{t % 7}." if t % 5 else "cut") for t in range(1500)] + [(101, 5, "user", "x." * 200_000)]
    rows += [(c, 0, "user", "gone.") for c in range(1000, 1040)] + [(200, -5, "user", "a."), (200, 1 << 40, "assistant", "b.")]
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], TALK + ", fault int, edit string, gone boolean")
    want = plain_talks(rows)
    assert audits(df.repartition(7)) == want and any(w[-2] == "" for w in want.values())
    empty = dialogue.audited(dialogue.repair(spark.createDataFrame([], TALK)))
    assert empty.collect() == []


def test_repaired_rows_are_well_formed(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "So?"), (1, 2, "user", "So?"), (2, 0, "user", "Hi."), (2, 1, "assistant", "Hi!")]
    got = dialogue.repair(spark.createDataFrame(rows, TALK)).collect()
    assert [(r["edit"], r["repaired"], r["text"], r["price"]) for r in got if r["conv_id"] == 1] == [
        ("K", "system", "Be kind.", 0), ("I", "user", "", 3), ("K", "assistant", "Hello.", 0), ("K", "user", "So?", 0), ("D", None, "So?", 4), ("I", "assistant", "", 3)
    ]
    assert [r["edit"] for r in got if r["conv_id"] == 2] == ["K", "K"]


def test_little_is_held():
    """What items agree on is handed out at once, so a conversation of any length needs little memory."""
    rng, chart, most = random.Random(1), dialogue.Chart(), 0
    for _ in range(20_000):
        chart.read(rng.choice(["user", "assistant", "system", "tool"]), rng.choice([None, None, "blank", "truncated"]))
        chart.settled()
        most = max(most, *(len(i[1]) for i in chart.items.values()))
    assert most < 200


@pytest.mark.parametrize("seed", range(4))
def test_chart_against_suffixes(seed):
    rng = random.Random(seed)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", " ", ""]), "t", rng.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 9))]
        got = list(dialogue.repaired_rows((i, *r) for i, r in enumerate(rows)))
        lines = tuple(f"{r[5]}:{r[2]}" for r in got if r[5] is not None)
        assert (sum(r[6] for r in got), "".join(r[4] for r in got), lines) == plain_repair(rows)


# --- names that clash, and the order of rules

INNER = (
    "_row _own _copies _copy _words n_lines n_words n_removed kept row own copies copy text_lines hash site page at hits h w0 r0 _n c0 c1 c2 c3 c4 id size source_size target rate word_chars n_symbols "
    "n_dup_lines n_text_lines n_repeat_words base_failed component_id n_shingles bin_id piece start group band node label hashes line of name multiplier"
).split()


def clashing(spark, docs):
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in INNER])


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as p

    text = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))
    rows = [(i, text(i) + "\nA line that all have.", "en", f"s{i}", 200) for i in range(10)] + [(20, text(1) + "\nA line that all have.", "en", "s3", 200), (21, "short", "en", "s1", 5)]
    docs = clashing(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    for name, stage in p.STAGES:
        got = stage(spark, docs, "")
        out = got.collect()
        assert out
        if name == "best_fit_packing":
            continue
        assert got.columns == docs.columns
        assert all(r[n] == f"{n}:{r['doc_id']}" for r in out for n in INNER)
        if name == "line_dedup":
            assert all("A line" not in r["text"] for r in out)
        docs = got


def test_rules_keep_columns_of_any_name(spark):
    rows = [(1, "Some words that make a text of their own. " * 3), (2, None)]
    docs = clashing(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    got = rules.apply_rules(docs)
    outputs = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines", "n_repeat_words", "base_failed", "kept"}
    assert set(got.columns) == set(docs.columns) | outputs
    assert all(r[n] == f"{n}:{r['doc_id']}" for r in got.collect() for n in INNER if n not in outputs)


def test_order_of_rules_by_sample(spark):
    """The order follows neither rows nor partitions, nor is it another in a second run; and it takes less work than the given one."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(60, 120))) for _ in range(300)]
    texts += [t.upper() for t in texts[:90]] + [re.sub(" ", " # ", t) for t in texts[90:150]] + [" ".join("1234567" for _ in t.split()) + f" {i}" for i, t in enumerate(texts[150:160])]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    given = [*reversed(rules.default_rules())]
    names = lambda df, n: [r.name for r in rules.ordered_rules(df, given, sample_rows=n)]
    want = names(docs, 250)
    assert names(docs.orderBy(F.rand(1)).repartition(7), 250) == names(docs.orderBy("source").coalesce(1), 250) == want
    costs, flags = rules.measured(docs, given, sample_rows=10**6)
    assert sum(flags.values()) > 400 and costs[[r.name for r in given].index("symbols")] == 1 < costs[[r.name for r in given].index("capitals")]

    def work(order):
        at = {r.name: i for i, r in enumerate(given)}
        total = 0
        for f, n in flags.items():
            for name in order:
                total += n * costs[at[name]]
                if f[at[name]]:
                    break
        return total

    assert work(want) < 0.9 * work([r.name for r in given]) and want[0] == "symbols"
    many = spark.createDataFrame([(i, texts[5]) for i in range(500)], "doc_id long, text string")
    assert sum(rules.measured(many, given, sample_rows=10**6)[1].values()) == 500


# --- search and packing: huge components, pruning, few sources


def test_huge_components_are_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "WIDE_ROWS", 2)
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-50, 50)) for _ in range(3)]) for i in range(80)]
    rows += [(100 + i, [rng.choice([1e10, -3e9, 1e15, 0.0]), float(rng.randrange(-9, 9)), rng.choice([0.0, 1.0, 2.0**40])]) for i in range(30)] + [(200, [1e300, 1.0, 0.0]), (220, [1e300, 0.0]), (7, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in topk.search(df, F.col("vec_id") % 20 == 0, k=9).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    top = (1 << 63) - 1
    whole = [(i, [max(-top - 1, min(top, math.floor(64 * x))) for x in v]) for i, v in rows]
    for q, v in whole:
        if q % 20 == 0:
            scored = [(-max(-top - 1, min(top, sum(a * b for a, b in zip(v, u, strict=True)))), i) for i, u in whole if i != q and len(u) == len(v)]
            assert got.get(q, []) == [(i, -s) for s, i in sorted(scored)[:9]]


def test_share_of_entries_that_are_looked_at():
    """Lists that few vectors are heavy in let most of the others be; where all components are alike there is little to prune."""
    rng = np.random.default_rng(4)
    skewed = np.floor(rng.normal(size=(4000, 64)) * 64 * 0.7 ** np.arange(64)).astype(np.float64)
    alike = np.floor(rng.normal(size=(4000, 64)) * 8).astype(np.float64)
    share = {}
    for name, matrix in (("skewed", skewed), ("alike", alike)):
        shard = topk.Shard(np.arange(4000), matrix)
        known = np.sort(matrix[:64] @ matrix.T, axis=1)[:, -21]  # as earlier shards have found it
        shard.best(matrix[:64], np.arange(64), 20, known)
        share[name] = shard.touched / shard.entries
    assert share["skewed"] < 0.5 < share["alike"] <= 1


def test_one_source_fills_its_bins(spark):
    """Bins of one source are filled like others; near that bound no bin has two of a cluster, and many sources still mix."""
    rng = random.Random(3)
    size = lambda: rng.choice([5, 20, 60, 150, 400]) + rng.randrange(20)
    for sources in ("a", "aaaaab"):
        rows = [(i, " ".join(["w"] * size()) + f" {i % 400}", rng.choice(sources)) for i in range(1500)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = packing.pack(docs, cluster=F.pmod("doc_id", F.lit(400)), capacity=2048).collect()
        fill = {r["bin_id"]: r["bin_words"] for r in got}
        assert sum(fill.values()) / (2048 * len(fill)) > 0.95 and sum(fill.values()) == sum(len(t.split()) for _, t, _ in rows)
        held = {}
        for r in got:
            held.setdefault(r["bin_id"], []).append(r["doc_id"] % 400)
        assert all(len(set(h)) == len(h) for h in held.values())
    group = [(i, 10, f"s{i % 30}", i) for i in range(300)]
    pieces, words = packing.pack_shard(group, 100, 3, loosen=True)
    per = {}
    for i, *_, b in pieces:
        per.setdefault(b, []).append(group[i][2])
    assert len(words) == 30 and all(max(own.count(s) for s in own) <= 3 for own in per.values())  # sources enough: the bound holds


def test_spared_lines_stand_on_copies():
    """By plain counting: lines on eight or more sites are cut everywhere, but for those of families of copies, whose pages share most of their
    shingles, and those that are on fewer sites apart from pages of little else."""
    import duckdb

    rows = duckdb.sql("SELECT doc_id, text, coalesce(source, '') FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    trimmed = lambda line: line.strip(" \t\n\x0b\f\r")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.1/documents.parquet'")
    removed = dict(con.sql(f"SELECT doc_id, n_removed FROM ({queries.SQL_LINES})").fetchall())
    sites, pages = {}, {}
    for doc, text, source in rows:
        for line in map(trimmed, text.split("\n")):
            if line:
                sites.setdefault(line, set()).add(source)
                pages.setdefault(line, set()).add(doc)
    wide = {line for line, s in sites.items() if len(s) >= 8}
    texts = {doc: text for doc, text, _ in rows}
    known = {}

    def shingles(doc):
        if doc not in known:
            known[doc] = set(zip(*[texts[doc].split()[i:] for i in range(5)], strict=False))
        return known[doc]

    source_of = {doc: source for doc, _, source in rows}
    mostly = {doc: sum(len(line) for line in text.split("\n") if trimmed(line) in wide) / max(1, len(text)) for doc, text, _ in rows}
    spared = copied = 0
    for doc, text, _ in rows:
        held = [line for line in map(trimmed, text.split("\n")) if line in wide]
        if removed[doc] == len(held):
            continue
        spared += 1
        near = [e for line in held for e in pages[line] if e != doc]
        copies = any(2 * len(shingles(doc) & shingles(e)) >= len(shingles(doc) | shingles(e)) for e in sorted(near, key=lambda e: abs(len(texts[e]) - len(texts[doc]))))
        assert copies or min(len({source_of[e] for e in pages[line] if mostly[e] <= 0.5}) for line in held) < 8, doc
        copied += copies
    assert len(wide) > 100 and copied == spared > 100 and spared < len(rows) / 10
