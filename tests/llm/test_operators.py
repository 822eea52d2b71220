"""The corpus operators against plain Python on small tables, and on odd ones."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, langid, lines, minhash, mixing, packing, passages, quality, queries, rules, topk, toxicity
from tests.oracle import assert_same, connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 4), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (5, "é" * 9, None, "b", 9), (6, LONG, "en", "a", len(LONG)),
    (7, LONG, "de", "b", len(LONG)), (None, "no key here", "en", "a", 11), (8, "퟿💡 𝒳 #*$ 123 \x0b x", "fr", "b", 5),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    clash = "kept boolean, size int, _words int, rank int, score double, component_id int, bin_id int"
    rows = [(*r, True, 1, 2, 3, 0.5, 6, 7) for r in ODD]
    return spark.createDataFrame(rows, f"{DOCS}, {clash}")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.read_table(spark, sf_dir, "documents")


@pytest.mark.parametrize("name", [n for n in queries.queries() if n in queries.oracle_sql()])
def test_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


# --- language ID


def test_language_of_held_out_texts(spark, docs):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and len(r["text"]) > 40]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


SCRIPTS = {
    "en": "The quick brown fox, and the slow one: they meet by the river.", "ru": "Быстрая лиса встретила медленную у реки, и они говорили.",
    "ar": "التقى الثعلب السريع بالثعلب البطيء عند النهر وتحدثا", "zh": "敏捷的狐狸在河边遇见了缓慢的狐狸,它们交谈了很久。", "el": "Η γρήγορη αλεπού συνάντησε την αργή στο ποτάμι.",
}


def plain_profile(text, dim, seed):
    """Letter by letter and n-gram by n-gram, without counts."""
    letters, out = [], np.zeros(dim)
    for c in "".join(c if c.isalpha() else " " for c in f" {text.lower()} "):
        point = 0 if c == " " else ord(c)
        if point or not letters or letters[-1]:
            letters.append(point)
    vector = {p: langid.letter_vectors(np.array([p]), dim, seed)[0].astype(float) for p in set(letters)}
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        out += np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
    return out


def test_language_by_plain_profiles(spark, docs):
    """Prototypes, cosines and answers of the operator against bundles made one n-gram at a time, in five scripts."""
    rows = [(i, t, lang) for i, (lang, t) in enumerate(SCRIPTS.items())] + [(100 + r["doc_id"], r["text"], r["lang"]) for r in docs.limit(8).collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(frame, dim=512)
    want = {}
    for _, text, lang in rows:
        want[lang] = want.get(lang, 0) + plain_profile(text, 512, model.seed)
    assert model.languages == sorted(want)
    for lang, row in zip(model.languages, model.prototypes, strict=True):
        assert np.allclose(row, want[lang] / np.linalg.norm(want[lang]), atol=1e-9)
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(frame, model).collect()}
    for key, text, _ in rows:
        by = {lang: cosine(plain_profile(text, 512, model.seed), v) for lang, v in want.items()}
        best = max(sorted(by), key=lambda lang: by[lang])
        assert got[key][0] == best and got[key][1] == pytest.approx(by[best], abs=1e-3)
    assert all(got[i][0] == lang for i, lang in enumerate(SCRIPTS))


def test_letters_of_all_scripts_differ():
    points = np.array(sorted({ord(c) for c in "aйعßλ狐河慢中文字"} | set(range(0x4E00, 0x4E00 + 400))))
    vectors = langid.letter_vectors(points, 2048, 1).astype(float)
    products = vectors @ vectors.T / 2048
    assert set(np.unique(vectors)) == {-1, 1} and np.abs(products - np.eye(len(points))).max() < 0.15
    assert abs(vectors.mean()) < 0.01


def test_language_training_hands_on(docs, monkeypatch):
    whole = langid.train(docs, dim=256)
    monkeypatch.setattr(langid, "PENDING", 300)
    parts = langid.train(docs, dim=256)
    assert whole.languages == parts.languages and np.allclose(whole.prototypes, parts.prototypes)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.train(docs, dim=256)


def test_language_cache(docs, monkeypatch):
    model, texts = langid.train(docs, dim=256), [r["text"] for r in docs.limit(20).collect()]
    want = [langid.Scorer(model).cosines(t) for t in texts]
    monkeypatch.setattr(langid, "CACHE", 300)
    monkeypatch.setattr(langid, "PART", 128)
    scorer = langid.Scorer(model)
    assert all(np.allclose(w, scorer.cosines(t), atol=1e-6) for w, t in zip(want, texts, strict=True))


def test_segments_change_nothing(monkeypatch):
    text = "Ab, c déf 12 gh " * 50
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "SEGMENT", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, langid.gram_counts(text), strict=True))


def test_language_odd(odd, empty, docs):
    model = langid.train(docs)
    got = langid.identify(odd, model, keep=("doc_id", "score", "kept")).collect()
    assert len(got) == len(ODD) and all(r["kept"] and 0 <= r["score"] <= 1 for r in got) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    nothing = langid.train(empty)
    assert langid.identify(empty, model).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs, nothing).collect()} == {("und", 0.0)}


# --- mixing


def filled(sizes, weights=(5, 2, 1), percent=150, cap=2):
    """Targets by plain water-filling."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()) * percent / 100, {}
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] >= cap * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: float(cap * sizes[s]) for s in over}


def test_mix(spark, docs):
    got = mixing.mix(docs).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert len(got) == len(texts)
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == len(words(texts[r["doc_id"]]["text"])) and 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = filled(dict(sizes))
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        smallest = min(r["size"] for r in got if r["source"] == s and r["size"])
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], smallest)
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()} == {(r["doc_id"], r["taken"]) for r in got}


def test_rates_solve_the_constraint(docs):
    got = mixing.mix(docs).collect()
    mass, target = Counter(), {}
    for r in got:
        mass[r["source"]] += r["rate"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(math.isclose(mass[s], target[s], rel_tol=1e-4) for s in target)


def test_targets_fill_up(spark):
    rng = random.Random(1)
    for case in range(3):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 500, 9000]) for i in range(12)} | {None: rng.choice([0, 700]), "S": 40, "é": 5}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        want = filled(sizes)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes), case


def test_mix_odd(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r["taken"] == 0 for r in got if not r["size"]) and {r["source"] for r in got} == {"a", "b", None}
    assert mixing.mix(empty).count() == 0


# --- near-duplicates


def shingles(text):
    w = words(lower(text))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def components(rows, percent):
    """(key, set) pairs to the smallest key reachable, over all pairs."""
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


def test_near_duplicates(docs):
    for percent in (85, 80):
        rows = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
        want = components(rows, percent)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, percent=percent).collect()}
        assert {k: r["component_id"] for k, r in got.items()} == want
        assert all(r["n_shingles"] == len(dict(rows)[k]) and r["kept"] == (r["component_id"] == k) for k, r in got.items())


def test_chains_of_near_copies(spark, monkeypatch):
    """A family whose members are linked by steps only, cut into many blocks."""
    rng, base = random.Random(5), [f"v{i}" for i in range(120)]
    rows, text = [], list(base)
    for i in range(60):
        text[rng.randrange(120)] = f"n{i}"
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + i, " ".join(base)) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = components([(k, shingles(t)) for k, t in rows], 85)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame).collect()} == want
    for blocks, broadcast in ((7, 10), (2, 1000), (30, 1000)):  # nodes of different blocks are linked with each other, and not with the pilots
        monkeypatch.setattr(minhash, "BLOCK_DOCS", blocks)
        monkeypatch.setattr(minhash, "BROADCAST_ROWS", broadcast)
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame).collect()} == want


def test_tight_family_needs_no_second_round(spark, monkeypatch):
    """Near copies of one text hang together by the pilots."""
    rng, base = random.Random(6), [f"v{i}" for i in range(150)]
    rows = [(i, " ".join([*base[:k], f"n{i}", *base[k + 1 :]])) for i, k in enumerate(rng.randrange(150) for _ in range(80))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    ran = []
    across = minhash._across_blocks
    monkeypatch.setattr(minhash, "_across_blocks", lambda *args: ran.append(across(*args)) or ran[-1])
    assert {r["component_id"] for r in minhash.near_duplicates(frame).collect()} == {0} and not ran


def test_all_pairs_of_a_thousand(spark):
    """The registered query against all pairs of a whole table."""
    rows = [(r["doc_id"], shingles(r["text"])) for r in common.read_table(spark, "/root/testdata/sf0.01", "documents").collect()]
    want = components(rows, 85)
    got = queries.op3_minhash_dedup(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) < len(rows)
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)


def test_circulant_signature():
    s = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    first = (first ^ (first >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    want = [int(minhash._second(first + np.uint32(k)).min()) for k in range(64)]
    assert minhash.signature(s, 64).tolist() == want
    for percent in (80, 85):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands < minhash.MISS and bands * rows <= minhash.COORDINATES


def test_linked_groups_exact():
    rng = random.Random(3)
    for _ in range(20):
        sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), np.uint64) for _ in range(30)]
        sets += [np.array(sorted(set(s.tolist()) ^ {rng.randrange(60)}) or [1], np.uint64) for s in sets]
        want = components([(i, set(s.tolist())) for i, s in enumerate(sets)], 85)
        assert minhash.linked_groups(sets, 85).tolist() == [want[i] for i in range(len(sets))]


def test_near_odd(odd, empty):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()]
    assert len(got) == len(ODD) and got.count((4, 1, 4, True)) == 2 and (1, 0, 1, True) in got and (3, 0, 3, True) in got
    assert {(g[2], g[3]) for g in got if g[0] in (6, 7)} == {(6, True), (6, False)}
    assert minhash.near_duplicates(empty).count() == 0


# --- packing


def plain_packing(group, capacity, most):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for i, (_, size, source, cluster) in enumerate(group):
        whole, rest = divmod(size, capacity)
        for p in range(whole):
            bins.append([capacity, set(), Counter(), len(bins)])
            out.append((i, p, p * capacity, capacity, len(bins) - 1))
        if rest:
            fit = [b for b in bins if b[0] + rest <= capacity and b[0] < capacity and cluster not in b[1] and b[2][source] < most]
            best = max(fit, key=lambda b: b[0], default=None)
            if best is None:
                best = [0, set(), Counter(), len(bins)]
                bins.append(best)
            best[0] += rest
            best[1].add(cluster)
            best[2][source] += 1
            out.append((i, whole, whole * capacity, rest, best[3]))
    return out, [b[0] for b in bins]


def test_best_fit():
    rng = random.Random(2)
    for case in range(20):
        group = [(i, rng.choice([3, 7, 20, 41, 100, 250]) if case % 2 else rng.randint(1, 250), rng.choice("aaab"), rng.randrange(25)) for i in range(150)]
        group.sort(key=lambda g: (-(g[1] % 100), g[0]))
        pieces, filled_ = packing.pack_shard(group, 100, 3)
        want, bins = plain_packing(group, 100, 3)
        assert sorted(filled_) == sorted(bins) and len(pieces) == len(want) and max(filled_) <= 100
        members = defaultdict(list)
        for i, *_, b in pieces:
            members[b].append(group[i])
        for held in members.values():
            assert len({h[3] for h in held}) == len(held) and max(Counter(h[2] for h in held).values()) <= 3


def test_pack_whole(docs):
    got = packing.pack(docs, capacity=512, shard_docs=50).collect()
    pieces, fill = defaultdict(list), Counter()
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["n_words"]))
        if r["bin_id"] is not None:
            fill[r["bin_id"]] += r["n_words"]
    assert max(fill.values()) <= 512 and all(fill[r["bin_id"]] == r["bin_words"] for r in got if r["bin_id"] is not None)
    for r in docs.collect():
        at = 0
        for i, (piece, start, n) in enumerate(sorted(pieces[r["doc_id"]])):
            assert (piece, start) == (i, at)
            at += n
        assert at == len(words(r["text"]))


def test_pack_odd(odd, empty):
    got = packing.pack(odd).collect()
    assert len({r["bin_id"] for r in got if r["doc_id"] == 4}) == 2
    assert {r["bin_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {None} and {r["doc_id"] for r in got} == {r[0] for r in ODD}
    assert packing.pack(empty).count() == 0


# --- toxicity


def plain_kneser_ney(vocabulary, counts, order, d):
    """Log ratios of words from dictionaries."""
    grams = [Counter(), Counter()]
    for w, c in zip(vocabulary, counts, strict=True):
        s = "\x02" * (order - 1) + w + "\x03"
        for i in range(order - 1, len(s)):
            for k in range(2):
                if c[k]:
                    grams[k][s[i - order + 1 : i + 1]] += c[k]
    levels = [grams[0] + grams[1]]
    for _ in range(order - 1):
        low = Counter()
        for g in levels[-1]:
            low[g[1:]] += 1
        levels.append(low)

    def given(level, g):
        own = [(x, n) for x, n in level.items() if x[:-1] == g[:-1]]
        return level[g], sum(n for _, n in own), len(own)

    def shared(g, i=0):
        if i == order:
            return 1 / 256
        n, total, kinds = given(levels[i], g)
        low = shared(g[1:], i + 1)
        return (max(n - d, 0) + d * kinds * low) / total if total else low

    def ratio(w):
        s, out = "\x02" * (order - 1) + w + "\x03", 0.0
        for i in range(order - 1, len(s)):
            g = s[i - order + 1 : i + 1]
            p = []
            for k in range(2):
                n, total, kinds = given(grams[k], g)
                p.append((max(n - d, 0) + d * kinds * shared(g)) / total if total else shared(g))
            out += math.log(p[1] / p[0])
        return out

    return ratio


def test_class_models_match_plain_ones():
    vocabulary = ["the", "then", "this", "bad", "badly", "bard", "é"]
    counts = np.array([[9, 3], [4, 0], [2, 2], [0, 5], [0, 1], [3, 0], [1, 1]], float)
    for order in (1, 2, 4):
        model = toxicity.class_ratios(vocabulary, counts, order)
        ratio = plain_kneser_ney(vocabulary, counts, order, toxicity.DISCOUNT)
        for w in vocabulary:
            assert model.word_ratios([w])[0] == pytest.approx(ratio(w), abs=1e-4), (order, w)
    unseen = ["bads", "xyz", "th"]  # what neither class has seen costs only their backoff weights
    model, ratio = toxicity.class_ratios(vocabulary, counts, 3), plain_kneser_ney(vocabulary, counts, 3, toxicity.DISCOUNT)
    known = {g for w in vocabulary for g in (("\x02\x02" + w + "\x03")[i : i + 3] for i in range(len(w) + 1))}
    for w in unseen:
        if all(("\x02\x02" + w + "\x03")[i : i + 3] not in known for i in range(len(w) + 1)):
            assert model.word_ratios([w])[0] == pytest.approx(ratio(w), abs=1e-4)


def test_toxic_words_score_high(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice(["ta", "lo", "mi", "re", "su"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(400):
        text = rng.choices(vocabulary, k=rng.randint(5, 60))
        if i % 5 == 0:
            text[:: max(1, len(text) // 3)] = ["grobian" + rng.choice(["", "s", "isch"])] * len(text[:: max(1, len(text) // 3)])
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame.where("doc_id < 300"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert min(got[i] for i in range(300, 400, 5)) > 0.5 > max(got[i] for i in range(300, 400) if i % 5)


def test_all_labelled_texts_are_counted(spark):
    """No bound on labelled rows or on the length of their texts; ratios made in groups are those of all words at once."""
    rng = random.Random(8)
    rows = [(i, f"so w{rng.randrange(90)}x {'grobian' if i % 2 else 'wohl'}{rng.randrange(5)}", i % 2) for i in range(8_000)]
    rows += [(i, "lang " * 11_000 + f"ende{i}", i % 2) for i in range(8_000, 8_020)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weighs = {r["doc_id"] for r in frame.where(F.pmod(F.xxhash64("doc_id", F.lit("weights")), F.lit(5)) == 0).collect()}
    model = toxicity.train(frame, frame)
    plain = {}
    for i, text, y in rows:
        for w in text.split():
            plain.setdefault(w, [0, 0])[y] += i not in weighs
    got = {r["w"]: [r["n0"], r["n1"]] for r in model.words.collect()}
    assert got == plain and sum(v[1] for w, v in plain.items() if w.startswith("grobian")) > 3_000
    counted = {w: c for w, c in plain.items() if any(c)}
    whole = toxicity.class_ratios(list(counted), np.array(list(counted.values()), float))
    for ratios in (model.ratios, toxicity.word_ratios(model.words, group=40)):
        made = {r["w"]: r["ratio"] for r in ratios.collect()}
        assert len(made) == len(plain) and made == pytest.approx(dict(zip(made, whole.word_ratios(list(made)), strict=True)), abs=1e-5)


def test_rare_words_are_joined(spark, monkeypatch):
    """Scores don't depend on which words are looked up where the texts are, nor on words being new."""
    rows = [(i, f"so w{i % 7} {'grobian' if i % 3 == 0 else 'wohl'} {'(so)' * (i % 2)} z{i}", int(i % 3 == 0)) for i in range(200)]
    frame = spark.createDataFrame([*rows, *rows[:9], (None, None, 0)], "doc_id long, text string, toxic int")
    scores = []
    for bound, docs in ((200_000, frame), (3, frame), (0, frame), (200_000, frame.where("doc_id < 190"))):
        monkeypatch.setattr(toxicity, "COMMON", bound)
        model = toxicity.train(docs, frame.where("doc_id < 190"))
        assert len(model.common.known) <= bound
        scores.append(sorted(((r["doc_id"] or -1), r["score"]) for r in toxicity.score(frame, model).collect()))
    assert len(scores[0]) == 210 and all(s == scores[0] for s in scores)


def test_words_keep_digits_and_signs():
    assert toxicity.words("You 1d1ot, f*ck (really)! 'tis_ 12 -- é") == ["you", "1d1ot", "f*ck", "really", "tis", "12", "é"]


def test_features_are_per_symbol():
    model = toxicity.class_ratios(["aa", "bbb"], np.array([[5.0, 1.0], [1.0, 5.0]]), 3)
    one, two = model.word_ratios(["aa", "bbb"])
    got = toxicity.Scorer(model, margin=0.5).features(["aa bbb bbb", "", None])
    assert got[0] == pytest.approx([(one + 2 * two) / 11, (max(one - 0.5, 0) + 2 * max(two - 0.5, 0)) / 11]) and not got[1:].any()


def plain_network(tokens, network, buckets):
    """Probability of class 1 from a mean over tokens' buckets, by loops."""
    parts = [int(b) for t in tokens for b in quality.word_features([t], buckets)[0]]
    hidden = np.mean([network.vectors[b] for b in parts], axis=0)
    out = [sum(hidden[d] * network.layer[d, k] for d in range(len(hidden))) + network.bias[k] for k in range(2)]
    return math.exp(out[1]) / (math.exp(out[0]) + math.exp(out[1]))


def test_forward_pass_and_gradient():
    buckets, rng = 512, np.random.default_rng(0)
    network = quality.Network(rng.normal(size=(buckets, 4)), rng.normal(size=(4, 2)), rng.normal(size=2))
    text = "Some words, and words\nagain é 12"
    tokens = words(text) + ["\n"] * 2
    features = quality.Features(buckets)
    bag = quality.tokens_of(text)
    assert bag == Counter(tokens)
    features.prepare([bag])
    ids, share = features.of(bag)
    want = plain_network(tokens, network, buckets)
    assert network.probabilities(ids, share)[1][1] == pytest.approx(want)
    gap = network.layer[:, 1] - network.layer[:, 0]
    model = quality.QualityModel(network.vectors @ gap, float(network.bias[1] - network.bias[0]))
    assert quality.Scorer(model).scores([text])[0] == pytest.approx(want)
    loss = lambda: -math.log(network.probabilities(ids, share)[1][0])
    for array, gradient in zip((network.vectors, network.layer, network.bias), network.gradients(ids, share, 0), strict=True):
        for at in np.ndindex(gradient.shape):
            own = (ids[at[0]], *at[1:]) if array is network.vectors else at
            before, h = array[own], 1e-5
            array[own] = before + h
            up = loss()
            array[own] = before - h
            down = loss()
            array[own] = before
            assert gradient[at] == pytest.approx((up - down) / (2 * h), abs=1e-6)


def test_rows_in_any_order_train_alike(spark):
    """Repeated keys with different texts: the order that rows come in doesn't matter."""
    rows = [(i % 20, f"{'good clean words' if i % 3 else 'bad junk words'} number {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(20)], "doc_id long, quality int")
    models = [quality.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert np.array_equal(models[0].buckets, models[1].buckets) and models[0].bias == models[1].bias


@pytest.mark.parametrize(("name", "label", "n", "rest"), [("op5_toxicity", "toxic", 4, 2), ("op9_quality_classifier", "quality", 5, 0)])
def test_held_out_accuracy(spark, name, label, n, rest):
    """The registered queries on labelled rows that they didn't learn from."""
    folder = "/root/testdata/sf0.1"
    got = queries.queries()[name](spark, folder)
    rows = got.join(common.read_table(spark, folder, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == rest) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], r[label]) for r in rows if r["held_out"]]
    right = Counter(held)
    print(name, right)
    if label == "toxic":
        assert right[1, 1] >= 0.75 * (right[1, 1] + right[0, 1]) and right[1, 1] >= 0.85 * (right[1, 1] + right[1, 0])
    else:
        assert right[1, 1] + right[0, 0] >= 0.95 * len(held) and right[1, 1] >= 0.98 * (right[1, 1] + right[0, 1])


def test_long_texts_do_not_train(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, y int")
    frame = spark.createDataFrame([(1, "a " * 30_000), (2, "b")], "doc_id long, text string")
    sample, _ = common.sampled_labels(labels, "doc_id", "y", 10)
    assert [(r["k"], r["y"]) for r in common.labelled_texts(frame, sample, "doc_id", "text").collect()] == [(2, 0)]


def test_scores_odd(odd, empty, docs, spark, sf_dir):
    labels = common.read_table(spark, sf_dir, "labels")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        model = module.train(docs, labels)
        got = module.score(odd, model, keep=("doc_id", "score", "rank")).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["rank"] == 3 for r in got)
        assert module.score(empty, model).count() == 0
        none = module.train(empty, labels.limit(0))
        assert {r["score"] for r in module.score(docs, none).collect()} == {0.5}, label


def test_rows_without_a_key_are_not_held_out(spark, tmp_path):
    """Null keys: scored, never held out, never learned from."""
    rows = [(None if i % 7 == 0 else i, f"{'the and of words' if i % 2 else 'der die das ist'} {i}", "en" if i % 2 else "de", "s", 5) for i in range(200)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op1_language_id", "op5_toxicity", "op9_quality_classifier"):
        got = queries.queries()[name](spark, str(tmp_path)).collect()
        assert len(got) == 200 and {r["held_out"] for r in got if r["doc_id"] is None} == {False}


# --- passages


def test_chain_is_the_best(spark):
    """Scores of the first chain against all ascending chains, by dynamic programming over pairs."""
    rng = random.Random(6)
    for _ in range(30):
        pairs = sorted({(rng.randrange(200), rng.randrange(200)) for _ in range(40)})
        x, y = (np.array(v) for v in zip(*pairs, strict=True))
        k, cost = 8, 0.1
        best = [float(k)] * len(pairs)
        for j, (a, b) in enumerate(pairs):
            for i, (c, d) in enumerate(pairs[:j]):
                if c < a and d < b:
                    best[j] = max(best[j], best[i] + k - cost * (a - c + b - d - 2 * k))
        xs, ys = passages.chains_of(x, y)[0]
        score = k * len(xs) - cost * sum((xs[i] - xs[i - 1]) + (ys[i] - ys[i - 1]) - 2 * k for i in range(1, len(xs)))
        assert score == pytest.approx(max(best)) and (np.diff(xs) > 0).all() and (np.diff(ys) > 0).all()


def test_edit_distance():
    assert passages._edits(np.array([1, 2, 3]), np.array([1, 3])) == 1
    assert passages._edits(np.array([1, 2, 3, 4]), np.array([5, 2, 3, 9, 4])) == 2
    assert passages._edits(np.array([]), np.array([1, 2])) == 2


def test_passages_cover_all_repeats(docs):
    n, first = 50, {}
    got = defaultdict(list)
    for r in passages.repeated_passages(docs).collect():
        got[r["doc_id"]].append((r["start"], r["start"] + r["n_words"]))
        assert r["other_id"] < r["doc_id"] and r["equal"] >= passages.MIN_IDENTITY * r["columns"]
    for r in docs.orderBy("doc_id").collect():
        w = words(lower(r["text"]))
        for p in range(len(w) - n + 1):
            if first.setdefault(tuple(w[p : p + n]), r["doc_id"]) != r["doc_id"]:
                assert any(a <= p and p + n <= b for a, b in got[r["doc_id"]])


def test_fuzzy_passage(spark):
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(90)]
    changed = list(shared)
    changed[30], changed[62:64] = "other", []
    text = lambda n, inner: " ".join([f"x{n}{i}" for i in range(40)] + inner + [f"y{n}{i}" for i in range(30)])
    rows = [(5, text(5, shared)), (9, text(9, changed)), (7, text(7, rng.sample(shared, 90)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], r["n_words"], r["other_id"], r["other_start"], r["other_words"], r["columns"], r["equal"]) for r in got] == [(9, 40, 88, 5, 40, 90, 90, 87)]


def test_passages_apart(spark):
    """Two passages that a document shares with one other, far enough apart that the words between outweigh them."""
    rng, rows, want = random.Random(9), [], set()
    own = lambda n: [f"u{rng.getrandbits(60)}" for _ in range(n)]
    for i, (gap, other_gap) in enumerate([(100, 100), (30, 30), (200, 200), (100, 60), (40, 90), (250, 250)]):
        one, two = own(50), own(50)
        rows += [(2 * i, " ".join(own(20) + one + own(other_gap) + two + own(20))), (2 * i + 1, " ".join(own(30) + one + own(gap) + two + own(9)))]
        want |= {(2 * i + 1, 30, 50, 2 * i, 20, 50), (2 * i + 1, 80 + gap, 50, 2 * i, 70 + other_gap, 50)}
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start"], r["n_words"], r["other_id"], r["other_start"], r["equal"]) for r in got} == want


def test_cut_keeps_what_was_whole():
    """Where the whole chain is equal enough it stays one piece; where it isn't, every piece is, and a tail can't take the rest along."""
    a, b = np.arange(200, dtype=np.uint32), np.arange(200, dtype=np.uint32)
    b[20:25] += 1000  # 20 equal words, 5 others, 20 equal words
    b[45:] += 2000
    at = lambda *v: np.array(v)
    assert passages.align(a, b, at(0, 12, 25, 37), at(0, 12, 25, 37)) == [(0, 45, 0, 45, 45, 40)]
    b[100:120] -= 2000
    pieces = passages.align(a, b, at(0, 12, 25, 37, 100, 112), at(0, 12, 25, 37, 100, 112))
    assert pieces == [(0, 45, 0, 45, 45, 40), (100, 120, 100, 120, 20, 20)]
    b[45:] = np.where(np.arange(155) % 3 == 0, b[45:] + 7, np.arange(45, 200))
    tail = passages.align(a, b, at(25, 37), at(25, 37))
    assert len(tail) == 1 and tail[0][0] == 25 and tail[0][1] >= 45 and tail[0][5] >= passages.MIN_IDENTITY * tail[0][4]


def test_passages_with_one_seed(spark):
    """Passages of 60 words with every 10th changed: found wherever one seed is left, alone or not, at any place in the text."""
    rng, rows, want, lone = random.Random(10), [], {}, 0
    own = lambda n: [f"u{rng.getrandbits(60)}" for _ in range(n)]
    for i in range(60):
        shared, lead = own(60), rng.choice((0, 30))
        changed = [w if j % 10 != 9 else own(1)[0] for j, w in enumerate(shared)]
        texts = " ".join(own(20) + shared + own(20)), " ".join(own(lead) + changed + own(rng.choice((0, 30))))
        rows += [(2 * i, texts[0]), (2 * i + 1, texts[1])]
        there, here = (dict(zip(*(v.tolist() for v in passages.seeds_of(passages.Words().of(t))), strict=True)) for t in texts)
        if at := [p for h, p in here.items() if h in there]:
            lone += len(at) == 1
            want[2 * i + 1] = lead, min(at), max(at)
    assert lone >= 5
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(want)
    for doc, (lead, first, last) in want.items():
        end = got[doc]["start"] + got[doc]["n_words"]
        assert got[doc]["start"] <= max(lead, first - passages.MARGIN) + 2 and end >= min(lead + 58, last + 8 + passages.MARGIN) - 2


def test_recall_of_changed_passages(spark):
    """120 words with every 9th, 10th, 12th or 15th changed: nearly all that share a seed are found, and no others."""
    rng, rows, seeded = random.Random(12), [], defaultdict(set)
    own = lambda n: [f"u{rng.getrandbits(60)}" for _ in range(n)]
    doc = 0
    for every in (9, 10, 12, 15):
        for _ in range(40):
            shared = own(120)
            changed = [w if (j + 1) % every else own(1)[0] for j, w in enumerate(shared)]
            texts = " ".join(own(30) + shared + own(20)), " ".join(own(15) + changed + own(40))
            there, here = (set(passages.seeds_of(passages.Words().of(t))[0].tolist()) for t in texts)
            rows += [(doc, texts[0]), (doc + 1, texts[1])]
            if there & here:
                seeded[every].add(doc + 1)
            doc += 2
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) <= set().union(*seeded.values())
    for every, docs in seeded.items():
        assert len(docs) >= 10 and sum(d in got for d in docs) >= 0.9 * len(docs), every
        assert np.mean([got[d]["n_words"] for d in docs if d in got]) > 80


def test_frequent_seeds(spark, monkeypatch):
    """A passage that all documents share is found in all but the first, however its seeds are dealt."""
    rng = random.Random(13)
    own = lambda n: [f"u{rng.getrandbits(60)}" for _ in range(n)]
    shared = own(60)
    rows = [(i, " ".join(own(10) + shared + own(10))) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, 10, 60) for i in range(1, 120)]
    monkeypatch.setattr(passages, "MANY", 20)
    same = []
    for sample, hot in ((1, 2), (1, 64), (64, 64)):
        monkeypatch.setattr(passages, "SAMPLE", sample)
        monkeypatch.setattr(passages, "HOT", hot)
        got = passages.repeated_passages(frame).collect()
        assert sorted((r["doc_id"], r["start"], r["n_words"]) for r in got) == want and all(r["other_id"] < r["doc_id"] for r in got)
        assert {r["other_id"] for r in got} == {0}  # one holder, however frequent its seeds are
        same.append(sorted(tuple(r) for r in got))
    assert same[0] == same[1] == same[2]


def test_passage_of_lines_from_many(spark):
    """A passage of short lines, each of which another document had first."""
    rng = random.Random(14)
    own = lambda n: [f"u{rng.getrandbits(60)}" for _ in range(n)]
    lines_ = [own(15) for _ in range(4)]
    rows = [(i, " ".join(own(20) + line + own(20))) for i, line in enumerate(lines_)]
    rows.append((9, " ".join(own(5) + sum(lines_, []) + own(5))))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], r["n_words"]) for r in got] == [(9, 5, 60)]


def test_contexts():
    """Ends that the contexts close are those that an extension over the words themselves doesn't pass."""
    rng = np.random.default_rng(11)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.where(rng.random(400) < 0.4, rng.integers(0, 2**63, 400, dtype=np.uint64), a)
    at = np.arange(len(a) - 7)
    (before, after), (other_before, other_after) = passages.contexts_of(a, at), passages.contexts_of(b, at)
    ends = passages.open_ends(before, other_before, after, other_after)
    same = a == b
    for p, e in zip(at.tolist(), ends.tolist(), strict=True):
        left, right = passages._extension(same[:p][::-1][:48])[0], passages._extension(same[p + 8 :][:48])[0]
        assert (e & 1 or left < passages.CONTEXT) and (e & 2 or right < passages.CONTEXT)
    assert {0, 1, 2, 3} == set(ends.tolist())


def test_passages_odd(odd, empty):
    got = passages.repeated_passages(odd).collect()
    assert [(r["doc_id"], r["other_id"], r["start"], r["n_words"]) for r in got] == [(7, 6, 0, 60_000)]
    assert passages.repeated_passages(empty).count() == 0


# --- lines and rules


def test_lines_odd(odd, empty):
    got = lines.remove_boilerplate(odd, min_sites=2).collect()
    assert len(got) == len(ODD) and all(r["n_removed"] == 0 for r in got)
    assert [r["n_lines"] for r in got if r["doc_id"] in (1, 2, 3)] == [0, 1, 2]
    assert lines.remove_boilerplate(empty).count() == 0


@pytest.mark.parametrize("in_place", [lines.IN_PLACE, 1])
def test_lines_near_the_threshold(spark, monkeypatch, in_place):
    monkeypatch.setattr(lines, "IN_PLACE", in_place)
    sites = lambda n: [f"s{i}" for i in range(n)]
    body = lambda i, j: "\n".join(f"own words of page {i} {j} {k} go on and on" for k in range(4))
    rows = [(i * 100 + j, f"  seen by {n} \n{body(i, j)}", s) for i, n in enumerate((2, 3, 4, 60)) for j, s in enumerate(sites(n))]
    rows += [(999, "seen by 60\nshort", "s0"), (998, "seen by 60", None)]  # pages of little else, or nothing else
    copy = "a text of one line that stands on every site\nand another one"
    rows += [(2000 + i, copy + (f" {i}" if i % 2 else ""), s) for i, s in enumerate(sites(9))]  # copies, equal or nearly so: no page has their line besides
    got = lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=4)
    cut = {r["doc_id"]: (r["n_removed"], r["text"]) for r in got.collect()}
    assert all(cut[i * 100 + j] == ((1, body(i, j)) if n >= 4 else (0, f"  seen by {n} \n{body(i, j)}")) for i, n in enumerate((2, 3, 4, 60)) for j in range(n))
    assert cut[999] == (1, "short") and cut[998] == (1, "")
    assert all(cut[2000 + i][0] == 0 for i in range(9))


def test_lines_clash(spark):
    """Columns that are called like the operator's own pass through; those called like an output are replaced."""
    names = "hashes string, row long, id long, page long, key string, kept string, hash long, c0 string, n_removed string"
    rows = [(i, f"shared line\nown words of page {i} that are many more than those", f"s{i}", "h", 1, 2, 3, "k", "x", 4, "c", "old") for i in range(9)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}")
    got = lines.remove_boilerplate(frame).collect()
    assert all(r["n_removed"] == 1 and (r["hashes"], r["row"], r["id"], r["page"], r["key"], r["kept"], r["hash"], r["c0"]) == ("h", 1, 2, 3, "k", "x", 4, "c") for r in got)


def test_rules_by_rejection_per_cost(spark, monkeypatch):
    """The greedy order on what earlier rules leave."""
    rule = lambda name: rules.Rule(name, F.lit(False))
    given = [rule("dear"), rule("inside"), rule("cheap"), rule("rare")]
    flags = [(True, False, False, False)] * 6 + [(True, True, True, False)] * 4 + [(False, False, False, True)] * 2 + [(False,) * 4] * 9
    monkeypatch.setattr(rules, "measured", lambda *_: ([0.1, 0.01, 0.01, 0.01], flags))
    assert [r.name for r in rules.ordered_rules(None, given)] == ["inside", "rare", "dear", "cheap"]  # once "inside" has gone first, "cheap" rejects nothing more


def test_rules_odd(odd, empty, docs):
    got = rules.apply_rules(odd).collect()
    assert len(got) == len(ODD) and all(not r["kept"] and r["base_failed"] for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert next(r["n_repeat_words"] for r in got if r["doc_id"] == 6) == 60_000
    assert rules.apply_rules(empty).count() == 0
    order = [r.name for r in rules.ordered_rules(docs, rules.default_rules())]
    assert sorted(order) == sorted(r.name for r in rules.default_rules())


def test_repeats_by_both_ways(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = rules.with_base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        w = words(r["text"])
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        marked = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert r["n_repeat_words"] == len(marked)


# --- search


def test_topk_small_shards(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = np.round(rng.normal(size=(300, 16)), 1).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(301, None), (302, [float("nan")] * 16), (303, [None] * 16), (320, [1.0, 2.0]), (304, vectors[3].tolist()), (304, vectors[3].tolist())]
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "PILOT_ROWS", 30)
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame = plain.withColumns({"id": F.lit("x"), "v": F.lit(1), "query": F.lit(None), "block": F.lit(2), "rank": F.lit(3), "score": F.lit(4)})
    got = defaultdict(list)
    for r in topk.search(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in whole:
        if q % 20 == 0:
            want = sorted(((sum(a * b for a, b in zip(v, u, strict=True)), -i) for i, u in whole if i != q), reverse=True)[:20]
            assert got[q] == [(-i, s) for s, i in want]
    assert topk.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_shard_against_all_scores():
    """Thresholds below, at and above the k-th score, in all number types, with copies that tie."""
    rng = np.random.default_rng(3)
    for case in range(40):
        size, kind = int(rng.integers(1, 30)), (np.float64, np.int64, np.float32)[case % 3]
        matrix = rng.integers(-20, 20, (200, size)).astype(kind)
        matrix[150:] = matrix[:50]
        ids = rng.permutation(1000)[:200]
        shard, queries, own, k = topk.Shard(ids, matrix), rng.integers(-20, 20, (3, size)).astype(kind), ids[[7, 8, 9]], int(rng.integers(1, 30))
        ranked = [sorted((-int(s), int(i)) for s, i in zip(matrix @ q, ids, strict=True) if i != o)[:k] for q, o in zip(queries, own, strict=True)]
        kth = np.array([-r[-1][0] for r in ranked], kind)
        for thresholds in (None, kth - 50, kth, kth + 1, kth + np.array([-50, 0, 1], kind)):
            of, where, scores = shard.best(queries, own, k, thresholds)
            for q in range(3):
                want = [r for r in ranked[q] if thresholds is None or -r[0] >= thresholds[q]]
                assert [(-int(s), int(ids[w])) for o, w, s in zip(of, where, scores, strict=True) if o == q] == want


def test_products_stay_exact(spark):
    assert topk.exact_type(36, 64) is np.float32 and topk.exact_type(1000, 64) is np.float64 and topk.exact_type(1 << 26, 64) is np.int64
    large = [(i, [float((1 << 20) + i), float(i)]) for i in range(25)]
    got = topk.search(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).collect()
    want = sorted(((64 * (1 << 20) * 64 * ((1 << 20) + i), i) for i, _ in large[1:]), reverse=True)[:2]
    assert [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    huge = topk.search(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert [(r["vec_id"], r["score"]) for r in huge.collect()] == [(1, (1 << 63) - 1)]  # one huge row doesn't fail the others


# --- pipeline


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as p

    kept = p.quality_rules(spark, docs, sf_dir)
    cut = common.staged(p.line_dedup(spark, common.staged(kept, "a"), sf_dir), "b")
    single = common.staged(p.near_dedup(spark, cut, sf_dir), "c")
    mixed = common.staged(p.source_mix(spark, single, sf_dir), "d")
    assert cut.columns == single.columns == mixed.columns == docs.columns
    rows = [(r["doc_id"], shingles(r["text"])) for r in cut.collect()]
    want = components(rows, p.NEAR_PERCENT)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(k for k in want if want[k] == k)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 2
    packed = p.best_fit_packing(spark, mixed, sf_dir).collect()
    total = Counter()
    for r in packed:
        total[r["doc_id"]] += r["n_words"]
    size = {r["doc_id"]: len(words(r["text"])) for r in single.collect()}
    assert total == Counter({k: n * size[k] for k, n in copies.items()})
    ran = p.run(spark, sf_dir).collect()
    assert Counter(tuple(r) for r in ran) == Counter(tuple(r) for r in packed)


def test_pipeline_keeps_long_texts(spark):
    """A clean text of over 200,000 words passes the first stage; a text of one word over and over doesn't."""
    import corpus_pipeline as p

    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    long = " ".join(letters(i) for i in range(210_000))
    rows = [(1, long, "en", "a", len(long)), (2, "word " * 60, "en", "a", 300)]
    kept = p.quality_rules(spark, spark.createDataFrame(rows, DOCS), "")
    assert [(r["doc_id"], r["text"] == long) for r in kept.collect()] == [(1, True)]


def test_pipeline_odd(spark, odd, empty):
    """Every stage on odd rows, on none, and with one doc_id on two texts."""
    import corpus_pipeline as p

    plain = odd.select(*[c.split(" ")[0] for c in DOCS.split(", ")])
    for name, stage in p.STAGES:
        got = stage(spark, plain, "")
        assert name == "best_fit_packing" or got.columns == plain.columns
        rows = got.collect()
        assert stage(spark, empty, "").count() == 0
        if name == "line_dedup":
            assert len(rows) == len(ODD)
        if name == "near_dedup":
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((k is None, k or 0) for k in (1, 2, 3, 4, 5, 6, 8, None))
        if name == "source_mix":
            assert {r["doc_id"] for r in rows} <= {4, 5, 6, 7, 8, None} and max(Counter(r["doc_id"] for r in rows if r["doc_id"] != 4).values()) <= 2
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    twice = spark.createDataFrame([(1, one, "en", "s", 1), (5, one, "en", "s", 1), (5, two, "en", "s", 1), (5, two, "en", "s", 1)], DOCS)
    assert sorted((r["doc_id"], r["text"][0]) for r in p.near_dedup(spark, twice, "").collect()) == [(1, "a"), (5, "b")]
    sizes = spark.createDataFrame([(5, "w " * n, "en", s, 1) for n, s in ((900, "a"), (30, "a"), (40, "a"), (2000, "b"))], DOCS)
    copies = {r["_own"]: r["copies"] for r in mixing.mix(sizes.withColumn("_own", F.xxhash64("doc_id", "text", "source")), key="_own").collect()}
    want = Counter({r["text"]: copies[r["_own"]] for r in sizes.withColumn("_own", F.xxhash64("doc_id", "text", "source")).collect()})
    assert Counter(r["text"] for r in p.source_mix(spark, sizes, "").collect()) == +want


def test_pipeline_keeps_short_clean_texts(spark):
    import corpus_pipeline as p

    rows = [(1, "A short but clean text of some words.", "en", "a", 1), (2, "too few words", "en", "a", 1), (3, "# " * 30, "en", "a", 1)]
    assert [r["doc_id"] for r in p.quality_rules(spark, spark.createDataFrame(rows, DOCS), "").collect()] == [1]


def test_shared_folder(spark):
    assert common.shared_dir(spark).startswith(("file:", "/")) and spark.sparkContext.getCheckpointDir() is not None
