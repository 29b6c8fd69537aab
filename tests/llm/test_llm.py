"""Each operator against brute force, a round trip or held-out accuracy, and on odd rows."""

import base64
import collections
import gzip
import hashlib
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docketry.llm import bpe, common, components, dom, extraction, fingerprints, gru, knn, language, lm, mixing, queries, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = (None, "", " \t\n", "a", "Ä", "x " * 3000)


def docs_of(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, len(t) if t is not None else None) for i, t in enumerate(texts)]
    clashing = {c: F.lit("x") for c in ("fp", "score", "id", "size", "next", "c", "mix")}
    return spark.createDataFrame(rows, DOCS).withColumns(clashing)


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()):
    return " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(n))


# ------------------------------------------------------------------ components and SimHash
def find_components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark, monkeypatch):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(60 + i, 61 + i) for i in range(25)] + [(5, 5)]
    want = find_components(90, links)
    got = {r["u"]: r["label"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    # hubs, at either end of the order
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    monkeypatch.setattr(components, "HOT_ROWS", 8)
    links += [(0, i) for i in range(0, 60, 3)] + [(200, i) for i in range(1, 60, 7)] + [(100 + i, 101 + i) for i in range(30)]
    want = find_components(201, links)
    got = {r["u"]: r["label"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: want[x] for x in {x for a, b in links if a != b for x in (a, b)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text, k=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(2)
    base = [prose(rng, rng.randint(5, 60)) for _ in range(20)]
    texts = [*EMPTY, *base, *base[:5], *[t.replace("alpha", "ALPHA", 1) for t in base[:5]], *[t + " end" for t in base], *[prose(rng, 2) for _ in range(10)]]
    fps = [plain_fingerprint(t) for t in texts]
    want = find_components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, texts), tile=8).collect()}
    assert got == {i: (format(f, "016x"), want[i]) for i, f in enumerate(fps)}
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_forest_spans_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    many = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for _ in range(8)]]))
    near = [(i, j) for i in range(len(many)) for j in range(i) if (int(many[i]) ^ int(many[j])).bit_count() <= 4]
    want = find_components(len(many), near)
    assert find_components(len(many), simhash.forest(many, None, 4)) == want
    a, b = many[::2], many[1::2]
    both = np.concatenate([a, b])
    cross = [(i, len(a) + j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= 4]
    assert find_components(len(both), simhash.forest(a, b, 4, (1, 2))) == find_components(len(both), cross)


def test_deduplicate(spark):
    rng = random.Random(4)
    base = [prose(rng, 80) for _ in range(6)]
    near = [" ".join([*t.split()[:40], "changed", *t.split()[41:]]) for t in base[:3]]
    half = [" ".join(t.split()[:40]) + " " + prose(rng, 40) for t in base[3:]]
    texts = [*base, *near, *half, base[0], "", None]
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(docs_of(spark, texts)).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 9, 10, 11, 13]


def test_each_pair_of_joined_texts_is_compared(spark):
    # a far text joins near copies that no candidate links directly
    rng = random.Random(12)
    a, x = prose(rng, 80), prose(rng, 80)
    b = " ".join([*a.split()[:78], "changed", "end"])
    texts = [x, a, b, *[prose(rng, 30) for _ in range(9)]]
    tried = spark.createDataFrame([(0, 1), (0, 2), *[(0, i) for i in range(3, 12)]], "u long, v long")
    keyed = spark.createDataFrame([(7, i) for i in range(12)], "key long, id long")
    picked = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "id long, text binary")
    sized = spark.createDataFrame([(i, 80) for i in range(12)], "id long, size long")
    for block, most in ((2, 3), (5, 11), (256, 12)):
        found = simhash.held_groups(tried, keyed, sized, picked, 5, 0.8, block, most).collect()
        assert {r["id"]: r["label"] for r in found if r["id"] != r["label"]} == {2: 1}


def jaccard_groups(texts, similarity=0.8):
    """Smallest reachable index for each text, by a full comparison of five-word shingle sets."""
    sets, where = [], collections.defaultdict(list)
    for i, t in enumerate(texts):
        w = simhash.words_of((t or "").encode())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} - {()})
        for x in sets[-1]:
            where[x].append(i)
    links = []
    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in where[x] if j < i)
        links += [(i, j) for j, c in common.items() if c >= similarity * (len(s) + len(sets[j]) - c)]
        links += [(i, j) for j in range(i) if not s and not sets[j]]
    return find_components(len(texts), links)


def families(rng, n, size, words, most):
    """Texts of n families: each member is the family's text with up to `most` words changed."""
    out = []
    for _ in range(n):
        base = prose(rng, words).split()
        for _ in range(size):
            w = list(base)
            for at in rng.sample(range(words), rng.randint(0, most)):
                w[at] = f"new{rng.randint(0, 10**6)}"
            out.append(" ".join(w))
    return out


def test_near_copies_against_a_full_comparison(spark):
    # families whose members partly lie beyond the similarity: a failed candidate must not part the others
    texts = families(random.Random(15), 40, 12, 150, 6)
    want = jaccard_groups(texts)
    for block, most in ((8, 4), (256, 4096)):
        got = {r["id"]: r["group"] for r in simhash.near_copy_groups(docs_of(spark, texts), block=block, most=most).collect()}
        assert got == dict(enumerate(want))


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(16)
    texts = [*families(rng, 1, 700, 60, 1), *[prose(rng, 60) for _ in range(60)]]
    rng.shuffle(texts)
    want = jaccard_groups(texts)
    got = {r["id"]: r["group"] for r in simhash.near_copy_groups(docs_of(spark, texts), block=32, most=100).collect()}
    assert got == dict(enumerate(want))


def test_deduplicate_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (2, text), (3, "b"), (3, "c"), (3, "b"), (None, text), (None, text), (4, None), (5, ""), (6, " \t"), (7, "x " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "key", "group", "hub")})
    for part in (docs, docs.repartition(5)):
        kept = [(r["doc_id"], r["text"]) for r in simhash.deduplicate(part).collect()]
        assert sorted((k for k in kept if k[0] is not None), key=lambda x: x[0])[:2] == [(1, text), next(k for k in kept if k[0] == 3)]
        assert collections.Counter(k[0] for k in kept) == {1: 1, 3: 1, None: 2, 4: 1, 7: 1}
    assert simhash.deduplicate(docs).columns == docs.columns
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_spread_join(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(9_000)], "k long, x long")
    names = rows.select("k").distinct().withColumn("n", F.col("k") * 2)
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert common.hot_keys(counts, "k") == [1] and common.hot_keys(counts.filter("n < 9"), "k") == []
    for per_key, hot in ((names, [1]), (names, []), (names.drop("n").join(counts, "k").withColumn("y", F.col("k") * 2), None)):
        got = common.spread_join(rows, per_key, "k", "x", hot)
        assert got.columns[:3] == ["k", "x", "n"] and got.count() == got.select("x").distinct().count() == 9_000
        assert got.filter(F.col("y" if "y" in got.columns else "n") != F.col("k") * 2).isEmpty()


def test_alike_spans_all_pairs():
    rng = np.random.default_rng(13)
    base = [rng.integers(0, 400, 60) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[: len(b) - k], rng.integers(0, 400, k)])) for b in base for k in range(0, 12, 2)] + [np.empty(0, np.int64)] * 2
    near = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    want = find_components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])
    assert find_components(len(sets), simhash.alike(sets, None, 0.8)[0]) == want
    a, b = sets[::2], sets[1::2]
    cross = [(i, len(a) + j) for i in range(len(a)) for j in range(len(b)) if near(a[i], b[j])]
    assert find_components(len(sets), simhash.alike(a, b, 0.8)[0]) == find_components(len(sets), cross)


def test_near_copies_with_distant_fingerprints(spark):
    rng = random.Random(14)
    near = lambda x, y: len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))
    texts = []
    while len(texts) < 12:
        words = prose(rng, 70).split()
        other = [*words[:66], *prose(rng, 4).split()] if rng.random() < 0.5 else [*words[:63], *prose(rng, 3).split()]
        far = (plain_fingerprint(" ".join(words), 5) ^ plain_fingerprint(" ".join(other), 5)).bit_count() > 12
        if far and near(*([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (words, other))):
            texts += [" ".join(words), " ".join(other)]
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(docs_of(spark, texts)).collect())
    assert kept == list(range(0, 12, 2))


# ------------------------------------------------------------------ toxicity
def test_toxicity_learns_words_not_groups():
    rng = random.Random(5)
    fill = "the day was long and we went home by train after work".split()
    line = lambda *w: " ".join([*rng.sample(fill, 6), *w])
    texts, labels = [], []
    for _ in range(150):
        texts += [line("idiot"), line("pathetic", "gay"), line("gay", "idiot"), line(), line("straight"), line()]
        labels += [1, 1, 1, 0, 0, 0]
    fair, free = (toxicity.Scorer(toxicity.fit(texts, labels, f)) for f in (toxicity.FAIRNESS, 0.0))
    neutral = line("gay")
    assert fair.score(neutral) < 0.5 < fair.score(line("idiot"))
    assert abs(fair.score(neutral) - fair.score(neutral.replace("gay", "lesbian"))) < abs(free.score(neutral) - free.score(neutral.replace("gay", "lesbian")))
    assert toxicity.Scorer(toxicity.fit(["a"], [0])).score("a") < 0.5 and 0 <= toxicity.Scorer(toxicity.fit([], [])).score("") <= 1


def test_toxicity_scores_every_row(spark):
    model = toxicity.fit(["bad idiot"] * 9 + ["good day"] * 9, [1] * 9 + [0] * 9)
    docs = docs_of(spark, [*EMPTY, "an idiot", "x " * 50_000 + "idiot"])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == 8 and got[0] == got[1] and got[6] > 0.5 and got[7] > 0.5
    assert docs.select(toxicity.scored(F.col("text"), model).alias("s")).count() == 8
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_toxicity_terms_stay_whole():
    for terms in toxicity.IDENTITY.values():
        for k, term in enumerate(terms):
            assert toxicity.words_of(f"The {term.upper()}, too") == {"the", term, "too"}
            other = toxicity.swapped({term, "x"}, k)
            assert other - {"x"} <= set(terms) - {term} and toxicity.words_of(" ".join(other)) == other


def test_toxicity_scores_against_the_formula(spark):
    rng = random.Random(18)
    texts = [" ".join(rng.choices("nice day idiot stupid walk home gay lesbian trains".split(), k=rng.randint(0, 12))) for _ in range(200)]
    labels = [int("idiot" in t or "stupid" in t) for t in texts]
    rows = spark.createDataFrame([(i, t, y if i % 7 else None) for i, (t, y) in enumerate(zip(texts, labels))] * 2, "doc_id long, text string, toxic int")
    model = toxicity.learn(rows)
    assert model == toxicity.learn(rows.dropDuplicates()) and model.names
    weight = dict(zip(model.names, model.weights))
    for r in toxicity.score(docs_of(spark, texts), model).collect():
        ws = set(re.findall("[a-z]+", texts[r["doc_id"]]))
        found = {f for w in ws for f in [w, *(w[:n] + "*" for n in (4, 5, 6, 7) if len(w) > n)]}
        assert abs(r["score"] - 1 / (1 + math.exp(-model.intercept - sum(weight.get(f, 0.0) for f in found)))) < 1e-9


def test_toxicity_learns_a_label_of_long_texts(spark):
    rows = [(i, "good day " * 5, 0) for i in range(20)] + [(100 + i, "idiot fool " * 2_000, 1) for i in range(20)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert toxicity.Scorer(model).score("an idiot") > 0.5 > toxicity.Scorer(model).score("good day")
    assert toxicity.learn(spark.createDataFrame([], "doc_id long, text string, toxic int")).names == ()


def test_sample(spark):
    rows = spark.createDataFrame([(i % 500, "x" if i % 3 else "y", str(i % 500)) for i in range(6_000)], "h long, g string, t string")
    got = [r["h"] for r in common.sample_of(rows, "h", 100)]
    assert got == sorted(got) and len(got) == len(set(got)) == 100 and common.sample_of(rows.repartition(7), "h", 100) == common.sample_of(rows, "h", 100)
    got = collections.Counter(r["g"] for r in common.sample_of(rows, "h", 50, "g"))
    assert got == {"x": 50, "y": 50}
    assert len(common.sample_of(rows.filter("h < 5"), "h", 100)) == 5 and common.sample_of(rows.limit(0), "h", 9) == common.sample_of(rows.limit(0), "h", 9, "g") == []


# ------------------------------------------------------------------ exact top k
def test_knn(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(120)] + [(500, None), (501, [None] * 8), (502, [math.nan] * 8), (503, [math.inf] * 8), (504, [1.0, 2.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("cell", "id", "twin", "v", "rank", "score")})
    want = plain_top(rows, lambda i: i % 20 == 0)
    # blocks larger than the queries, and smaller
    for block in (512, 7):
        got = knn.top_k(data, F.col("id") % 20 == 0, pivots=6, block=block).collect()
        assert sorted(map(tuple, got)) == want
    assert knn.top_k(data.limit(0), F.col("id") % 20 == 0).count() == 0


def plain_top(rows, is_query, k=10):
    """(query, rank, id, score) by a full comparison; queries that repeat in id and vector once."""
    clip = lambda x: max(-(1 << 63) + 1, min((1 << 63) - 1, x))
    ints = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, v) for i, v in ints if is_query(i)}:
        scored = sorted((-clip(sum(a * b for a, b in zip(v, w))), i) for i, w in ints if i != q and len(w) == len(v))
        out += [(q, r, i, -x) for r, (x, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_knn_odd_rows(spark):
    rng = np.random.default_rng(21)
    vec = lambda d: [float(x) for x in rng.normal(0, 0.3, d)]
    rows = [(i, vec(1 + i % 7)) for i in range(210)]  # more lengths than get pivots
    rows += [(5, vec(3)), (5, rows[5][1]), (10, vec(3)), (10, rows[10][1]), (10, rows[10][1]), (None, vec(3))]
    rows += [(300, []), (305, []), (310, []), (400, [1e15, 1.0]), (405, [1e15, -1.0]), (410, [-1e15, 3.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for lengths in (4, 1):
        got = knn.top_k(data, F.col("id") % 5 == 0, pivots=4, block=16, lengths=lengths).collect()
        assert sorted(map(tuple, got)) == plain_top(rows, lambda i: i % 5 == 0)


def test_own_row_takes_no_place():
    data = np.arange(1, 21, dtype=float)[:, None]
    rows, ids, scores = knn._best(np.array([[1.0]]), np.array([7]), data, np.arange(20), 10)
    assert list(ids) == list(range(19, 9, -1)) and list(scores) == list(range(20, 10, -1)) and set(rows) == {0}
    repeated = np.array([*range(17), 19, 19, 19])
    assert list(knn._best(np.array([[1.0]]), np.array([19]), data, repeated, 10)[1]) == list(range(16, 6, -1))


def test_bounds_leave_cells_out():
    pivots = np.array([[100.0, 0.0], [-100.0, 0.0], [0.0, 1.0]])
    wanted = knn.needed(pivots, np.array([50, 50, 50]), np.array([1.0, 1.0, 1.0]), np.array([5, 0, 0]), np.array([1.0, 0, 0]), 10)
    assert wanted == [(0, 0)]


# ------------------------------------------------------------------ extraction
def test_extraction_on_unseen_layouts():
    model, pages = extraction.default_model(), extraction.labelled_pages(120, seed=123)
    words = lambda blocks: collections.Counter(" ".join(blocks).split())
    found = [(words(b), words(g)) for (_, b), g in zip(pages, extraction.extract_all([h for h, _ in pages], model))]
    both = sum((a & b).total() for a, b in found)
    assert both / sum(a.total() for a, _ in found) > 0.97 and both / sum(b.total() for _, b in found) > 0.97


def test_marginals_are_exact():
    nodes = dom.parse("<div><p>a b c</p><nav><a href=x>d</a></nav></div>")
    forest, rng = extraction.Forest([nodes]), np.random.default_rng(0)
    w, t = rng.normal(size=len(extraction._NAMES)), rng.normal(size=(2, 2, 2))
    own = np.bincount(forest.rows, w[forest.cols], forest.n)
    total, marginal = 0.0, np.zeros(forest.n)
    for k in range(2**forest.n):
        y = [(k >> i) & 1 for i in range(forest.n)]
        p = math.exp(sum(own[i] * y[i] for i in range(forest.n)) + sum(t[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(1, forest.n)))
        total += p
        marginal += p * np.array(y)
    assert np.allclose(forest.marginals(w, t)[0][:, 1], marginal / total)


def test_parser():
    texts = lambda h: [n.text for n in dom.parse(h) if not n.tag]
    assert texts("<p>a&amp;b  <b>c</b>d<br>e<p>f<script>x</p></script><!-- <p> -->g") == ["a&b cd e", "fg"]
    assert texts("<ul><li>a<li>b</ul>c < d <p") == ["a", "b", "c < d"]
    assert texts("") == [] and texts("<style>x") == [] and texts("<td>a<td>b</table>") == ["a", "b"]
    assert texts("<div>" * 5000 + "x") == ["x"]


def test_extraction_rows(spark):
    page = "<html><body><nav><a href=/a>menu</a></nav><article><h1>Title here</h1><p>One sentence of text &copy; here.</p></article><footer>&copy; us</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r["page_id"], r["text"]) for r in extraction.extract(rows).collect())
    assert got == [(1, "Title here One sentence of text © here.")] * 2 + [(2, ""), (3, "")]


P, Q, R = "The committee met on Tuesday to discuss the new budget for the coming year.", "Members agreed that spending on roads should rise, while other areas stay.", "A final vote is expected next month."
#: Pages as their makers might write them, and their main text, by hand.
BY_HAND = [
    (f'<html><body><div id="wrap"><div><h2>Talks</h2><p>{P}</p><p>{Q}</p></div></div></body></html>', f"Talks {P} {Q}"),
    (f'<div id="wrap"><div><h2>Talks</h2><p>{P}</p></div></div>', f"Talks {P}"),
    (f"<p>{P}</p><p>{Q}</p>", f"{P} {Q}"),
    (P, P),
    (f"<article><h1>Talks</h1><p>{P}</p><button>Share this</button><p>{Q}</p></article>", f"Talks {P} {Q}"),
    (f"<article><p>{P}</p><p>Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", f"{P} Then x=2 holds."),
    (f'<article><svg><path d="x"><p>{P}</p><p>{Q}</p></article>', f"{P} {Q}"),
    (f'<body><div><a href="/">Daily Post</a></div><div><a href="/a">Home</a> | <a href="/b">News</a></div><div class="col"><h1>Talks</h1><p>{P}</p><p>{Q}</p><p>{R}</p></div><div><h3>Latest</h3><ul><li><a href="/1">One thing</a></li><li><a href="/2">Other</a></li></ul></div><div>© 2024 Daily Post. All rights reserved.</div></body>', f"Talks {P} {Q} {R}"),
    (f'<body><table><tr><td><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></td><td><h1>Talks</h1><p>{P}</p><p>{Q}</p></td></tr></table><p>&copy; 2024 Daily Post. All rights reserved.</p></body>', f"Talks {P} {Q}"),
    (f'<body><div class="site-header"><p>Daily Post</p></div><div class="navbar"><ul><li><a href="/a">Home</a></li></ul></div><div class="entry-content"><h1>Talks</h1><p>{P}</p><p>{Q}</p></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>I do not agree with this at all.</p></div></div><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div><footer>© Daily Post</footer></body>', f"Talks {P} {Q}"),
    (f'<body><div id="page"><h1>Talks</h1><div>{P}<br><br>{Q}</div></div><footer><p>Contact us</p></footer></body>', f"Talks {P} {Q}"),
    (f"<body><section><h2>Talks</h2><p>{P}</p></section><section><h2>More</h2><p>{Q}</p><p>{R}</p></section></body>", f"Talks {P} More {Q} {R}"),
    ("<article><h1>Yes</h1><p>No.</p></article>", "Yes No."),
    (f'<article><h1>Talks</h1><p>{P}</p><ul><li><a href="/r">Report of the committee on spending</a></li><li>Another point.</li></ul></article>', f"Talks {P} Report of the committee on spending Another point."),
    (f'<main><h1>Talks</h1><p>{P}</p><div class="newsletter-signup"><p>Get our newsletter every week.</p><form><input></form></div><p>{Q}</p></main>', f"Talks {P} {Q}"),
    (f"<body><div><p>We use cookies to give you the best experience.</p><button>OK</button></div><div><h1>Talks</h1><p>{P}</p><p>{Q}</p></div></body>", f"Talks {P} {Q}"),
]


def test_extraction_by_hand():
    model = extraction.default_model()
    found = [" ".join(b) for b in extraction.extract_all([h for h, _ in BY_HAND], model)]
    assert found == [want for _, want in BY_HAND]


def test_extraction_of_long_and_no_pages(spark):
    schema = "page_id long, url string, html string"
    assert extraction.extract(spark.createDataFrame([], schema)).count() == 0
    long_page = "<article><h1>Talks</h1>" + f"<p>{P}</p>" * 20_000 + "</article>"
    got = extraction.extract(spark.createDataFrame([(1, "u", long_page)], schema)).first()["text"]
    assert got == " ".join(["Talks", *[P] * 20_000])


# ------------------------------------------------------------------ BPE
@pytest.fixture(scope="module")
def codec():
    return bpe.codec(common.vocabulary("word_bpe_49k.json"))


def test_bpe_matches_the_library(codec):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(common.vocabulary("word_bpe_49k.json"))
    own.no_truncation(), own.no_padding()
    rng = random.Random(7)
    pool = [*map(chr, range(1, 0x250)), *"İΣςßẞ日本語한국어😀'stmd<|>/ẃ　\x1c", "<|endoftext|>", "'s", "</w>", "the "]
    texts = ["", "  ", "a" * 3000, "ab" * 2000, "!" * 700, "THE'S they'll"] + ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(3000)] + ["".join(rng.choices("abeinrt", k=rng.randint(1, 80))) for _ in range(500)]
    for t in texts:
        e = own.encode(t, add_special_tokens=False)
        assert codec.encode(t).ids == e.ids, t
        assert codec.encode(t).decoded == own.decode(e.ids, skip_special_tokens=False) == codec.decode(e.ids), t


def test_bpe_newer_characters(codec):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(common.vocabulary("word_bpe_49k.json"))
    for start in range(0, 0x110000, 0x4000):
        texts = ["a" + chr(c) + "b é" + chr(c) + "\u0323\u0301" for c in range(start, start + 0x4000) if not 0xD800 <= c < 0xE000]
        for t, e in zip(texts, own.encode_batch(texts, add_special_tokens=False)):
            assert codec.encode(t).ids == e.ids, ascii(t)


def test_bpe_without_the_library(codec):
    # ids of the vocabulary file: lower-cased words with their ends marked
    assert codec.encode("a  A\t!").ids == [320, 320, 256] and codec.encode("a  A\t!").decoded == "a</w> a</w> !</w>"


def test_bpe_cache_is_bounded(codec, monkeypatch):
    small = bpe._Cache(lambda w: (len(w), w), 10)
    assert [small[str(i)][1] for i in range(35)] == [str(i) for i in range(35)] and len(small) <= 10 and len(small.old) <= 10
    assert small["x" * 100][0] == 100 and "x" * 100 not in small


def test_bpe_rows(spark):
    got = {r["doc_id"]: r for r in bpe.encode(docs_of(spark, [*EMPTY]), common.vocabulary("word_bpe_49k.json"), keep=("source",)).collect()}
    assert got[0]["ids"] == got[1]["ids"] == got[2]["ids"] == [] and got[0]["decoded"] == "" and got[5]["n_tokens"] == 3000
    assert bpe.encode(docs_of(spark, []), common.vocabulary("word_bpe_49k.json")).count() == 0
    long_text = docs_of(spark, ["ab " * 300_000 + "c" * 300_000])
    assert bpe.encode(long_text, common.vocabulary("word_bpe_49k.json")).first()["n_tokens"] > 300_000


# ------------------------------------------------------------------ mixing
def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 30), "en", rng.choice(["a", "b", "B", "é", None]), 0) for i in range(3000)] + [(9000, None, None, "zero", None)]
    docs = spark.createDataFrame(rows, DOCS)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    mixed = mixing.mix(docs).select("doc_id", "source", "mix.*").collect()
    taken = collections.Counter()
    for r in mixed:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in order:  # independent draws: within four standard deviations
        rate = target[s] / sizes[s] if sizes[s] else 0
        deviation = ((rate % 1) * (1 - rate % 1) * sum(len((r[1] or "").split()) ** 2 for r in rows if r[3] == s)) ** 0.5
        assert abs(taken[s] - target[s]) <= 4 * deviation + 1e-9
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).select("doc_id", "source", "mix.*").collect()), key=str) == sorted(map(tuple, mixed), key=str)
    assert mixing.emit(mixing.mix(docs)).count() == sum(r["copies"] for r in mixed)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_odd_rows(spark, monkeypatch):
    rows = [(i % 40, "w " * (i % 9), None if i % 3 else f"s{i % 5}") for i in range(400)] + [(None, None, "s1"), (None, "w", "s1"), (7, "w " * 100_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("mix", "_rate", "_copy", "size", "target", "_key", "_salt", "_place", "stop")})
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_"] and mixed.count() == len(rows)
    whole = sorted(map(str, mixed.collect()))
    out = mixing.emit(mixed)
    assert out.columns == docs.columns and out.count() == mixed.agg(F.sum("mix_.copies")).first()[0]
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    monkeypatch.setattr(common, "hot_keys", lambda counts, key: ["s0", None])
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == whole
    again = mixing.mix(docs.filter("doc_id = 7 and source is null")).select("doc_id", "text", "mix_.copies").collect()
    assert len({r["copies"] for r in again}) == 1


def test_copies_are_bernoulli_whatever_the_sizes(spark):
    """Over 1,000 seeds each document's share of copies is the fraction: a long one beside a short one, and one of 31."""
    rows = [(1, 100, "two"), (2, 1, "two")] + [(10 + i, 3_000 if i == 0 else 20 + i, "many") for i in range(31)]
    ids = spark.createDataFrame(rows, "doc_id long, size long, source string")
    seeds = ids.crossJoin(spark.range(1000).withColumnRenamed("id", "seed"))
    digest = F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("doc_id").cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    for fraction in (0.9, 0.7):
        shares = seeds.groupBy("doc_id").agg(F.avg((u < fraction).cast("int")).alias("p")).collect()
        assert all(abs(r["p"] - fraction) < 0.05 for r in shares) and abs(sum(r["p"] for r in shares) / len(shares) - fraction) < 0.01
    assert [r["u"] for r in ids.select(mixing.uniform(7, F.col("doc_id")).alias("u")).collect()] == [r["u"] for r in seeds.filter("seed = 7").orderBy("doc_id").select(u.alias("u")).collect()]
    # and mix() itself, on 200 sources of a long and a short document each, all at a rate of 0.9
    pairs = [(2 * s + long, "w " * (100 if long else 1), f"s{s}") for s in range(200) for long in (0, 1)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1,), share=0.9).select((F.col("doc_id") % 2).alias("long"), "mix.copies").groupBy("long").agg(F.avg("copies").alias("c")).collect()
    assert all(abs(r["c"] - 0.9) < 0.08 for r in got)


def test_running_sums(spark):
    rng = random.Random(17)
    rows = [(i, rng.randint(0, 9)) for i in rng.sample(range(1000), 300)]
    got = {r["k"]: (r["_place"], r["before"]) for r in common.running(spark.createDataFrame(rows, "k long, x long"), [F.col("k")], before=F.col("x")).collect()}
    total = 0
    for n, (k, x) in enumerate(sorted(rows)):
        assert got[k] == (n, total)
        total += x


# ------------------------------------------------------------------ WARC
def test_warc_round_trip(spark, tmp_path):
    texts = ["<p>é\r\n\r\nWARC/1.1\r\n", "", None, "<p>é\r\n\r\nWARC/1.1\r\n", "x" * 100_000, "\n\n", ""]
    pages = spark.createDataFrame([(10 - i, f"http://h/{i} x", t) for i, t in enumerate(texts)], "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("digest", F.lit(1))
    path = str(tmp_path / "w")
    warc.write(pages, path)
    made = {r["metadata"]["page_id"]: r for r in warc.resolved(warc.captures(warc.read(spark, path))).collect()}
    assert len(made) == 7
    for i, t in enumerate(texts):
        r, payload = made[10 - i], (t or "").encode()
        same = [10 - j for j, o in enumerate(texts) if (o or "") == (t or "")]
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r["request"]["type"] == "request" and r["response"]["stated_digest"] == f"sha1:{sha}"
        if min(same) == 10 - i:
            assert r["response"]["type"] == "response" and bytes(r["response"]["payload"]) == payload and r["original"] is None
        else:
            assert r["response"]["type"] == "revisit" and r["original"]["page_id"] == min(same) and r["original"]["payload_digest"] == sha
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*.gz")))
    assert raw.count(b"WARC-Type: request\r\n") == 7 and raw.endswith(b"\r\n\r\n")


def test_warc_odd_rows(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (2, None, "bb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write(pages, path, least=2)
    got = collections.Counter((r["metadata"]["page_id"], r["response"]["type"]) for r in warc.captures(warc.read(spark, path)).collect())
    assert got == {(1, "response"): 2, (None, "response"): 1, (2, "response"): 1}
    warc.write(pages, str(tmp_path / "v"))
    got = collections.Counter((r["metadata"]["page_id"], r["response"]["type"]) for r in warc.captures(warc.read(spark, str(tmp_path / "v"))).collect())
    assert got == {(1, "response"): 1, (1, "revisit"): 1, (None, "response"): 1, (2, "response"): 1}
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.captures(warc.read(spark, str(tmp_path / "e"))).count() == 0


def test_warc_large_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PER_FILE", ((10, 2), (1 << 20, 1), (1 << 62, 1)))
    texts = [f"p{i}" for i in range(9)] + ["x" * 3_000_000, "y" * 5_000, "y" * 5_000, None]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("u")).coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("part-*.gz"))) == 8
    made = {r["metadata"]["page_id"]: r for r in warc.resolved(warc.captures(warc.read(spark, str(tmp_path / "w")))).collect()}
    assert [made[i]["response"]["payload_bytes"] for i in (9, 10, 12)] == [3_000_000, 5_000, 0] and made[11]["original"]["page_id"] == 10 and len(made) == 13


# ------------------------------------------------------------------ language
def test_language(spark):
    rng = random.Random(9)
    stems = {"aa": "the and with for this that from have".split(), "bb": "der und mit von das nicht eine auch".split(), "cc": "les des pour dans une avec sur est".split()}
    made = {k: ["".join(rng.choices(v, k=rng.randint(1, 2))) for _ in range(60)] for k, v in stems.items()}
    rows = [(i, " ".join(rng.choices(made[k], k=rng.randint(20, 60))), k, "s", 0) for i in range(300) for k in [rng.choice("abc") * 2]]
    docs = spark.createDataFrame(rows, DOCS)
    content = language.learn(docs, common.remainder("doc_id", 3) != 1)
    held = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs.filter(common.remainder("doc_id", 3) == 1), content).collect()}
    assert sum(held[r[0]] == r[2] for r in rows if r[0] in held) / len(held) > 0.97
    odd = {r["doc_id"]: r for r in language.identify(docs_of(spark, [*EMPTY, "123 ...", rows[0][1] * 300]), content).collect()}
    assert all(odd[i]["lang_pred"] == "und" and not odd[i]["accepted"] for i in (0, 1, 2, 6)) and odd[7]["lang_pred"] == rows[0][2]
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    none = language.learn(docs, F.lit(False))
    assert none == {} and language.identify(docs.limit(1), none).first()["lang_pred"] == "und"
    assert docs.select(language.judged(F.col("text"), content).alias("j")).filter("j.accepted").count() > 280


def test_language_of_long_texts_and_repeated_rows(spark):
    short, long_ = "the and with for this " * 20, "der und mit von das " * 2_000
    rows = [(i, short, "aa", "s", 0) for i in range(9)] + [(100 + i, long_, "bb", "s", 0) for i in range(9)] + [(50, "this for " * 9, "aa", "s", 0)] * 300
    docs = spark.createDataFrame(rows, DOCS)
    content = language.learn(docs, F.lit(True))
    assert list(content) == ["aa", "bb"] and b"der und" in content["bb"]
    got = collections.Counter((r["doc_id"] >= 100, r["lang_pred"]) for r in language.identify(docs, content).collect())
    assert got == {(False, "aa"): 309, (True, "bb"): 9}
    assert language.identify(docs.limit(0), content).count() == 0 and language.learn(docs.limit(0), F.lit(True)) == {}
    tied = language.Compressors({"x": b"abc " * 50, "y": b"abc " * 50})
    assert tied.predict("abc abc")[0] == "x" and tied.predict("abc abc")[2] == 0.0


def test_language_sizes():
    import zstandard

    content = {"aa": b" the and with for this " * 30, "bb": b" der und mit von das " * 30}
    made = language.Compressors(content)
    for text in ("this is the one", "der das und " * 2_000):
        body = language.plain(text)
        blocks, at = [], 0
        while at < len(body):
            end = min(len(body), at + language.BLOCK)
            end = end if end == len(body) else max(body.rfind(b" ", at + 1, end), at + 1)
            blocks.append(body[at:end])
            at = end
        level = language.SHORT_LEVEL if len(body) <= language.SHORT else language.LEVEL
        want = [sum(len(zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False).compress(b)) for b in blocks) for d in content.values()]
        # a dictionary that is digested beforehand may save a few bytes more or less
        assert b"".join(blocks) == body and np.allclose(made.sizes(body), want, rtol=0.1, atol=8)
        assert made.predict(text)[0] == list(content)[int(np.argmin(want))]


# ------------------------------------------------------------------ language model
def test_gradient():
    rng = np.random.default_rng(0)
    g = gru.Gru(np.array([5, 9, 8, 7, 3]), np.array([4, 2]), share=2, hidden=4)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    x, y, _, _ = gru.lanes([rng.integers(1, 7, size=s) for s in (5, 3, 0, 7)], 2)
    start = np.zeros((2, 4))

    def loss():
        h, states = start, []
        for t in range(len(x)):
            h = g.step(g.p["e"][x[t]], h * (x[t] != 0)[:, None])[0]
            states.append(h)
        at = np.flatnonzero(y.ravel() >= 0)
        return -g.log_probs(np.concatenate(states)[at], y.ravel()[at])[0].mean()

    grad, _ = g._window(x, y, start)
    for k, v in g.p.items():
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in v.shape)
            old, both = v[i], []
            for d in (1e-5, -1e-5):
                v[i] = old + d
                both.append(loss())
            v[i] = old
            assert abs((both[0] - both[1]) / 2e-5 - grad[k][i]) < 1e-7


def test_symbol_probabilities_add_up():
    g = gru.Gru(np.array([5, 9, 8, 7]), np.array([4, 2]), share=2, hidden=4)
    h = np.random.default_rng(1).normal(size=(1, 4)).astype(np.float32)
    logs = g.log_probs(np.repeat(h, 6, axis=0), np.arange(6))[0]
    assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_state_carries_over_windows_and_lanes(monkeypatch):
    rng = np.random.default_rng(2)
    g = gru.Gru(np.arange(1, 9), np.array([4, 2]), share=4, hidden=6)
    texts = [rng.integers(1, 10, size=s) for s in (300, 2, 0, 70, 150)]
    whole = g.score(texts)
    monkeypatch.setattr(gru, "SCORE_LANES", 2)
    monkeypatch.setattr(gru, "SCORE_WINDOW", 7)
    assert np.allclose(whole, g.score(texts), atol=1e-2) and np.allclose(whole, [g.score([t])[0] for t in texts], atol=1e-2)


@pytest.mark.parametrize("shift", [0, 200])
def test_probabilities_in_blocks_by_class(monkeypatch, shift):
    """Sorted by class and in blocks, with logits that need a shift or none, targets have the plain softmax's probabilities."""
    monkeypatch.setattr(gru, "BLOCK", 3)
    rng = np.random.default_rng(4)
    g = gru.Gru(np.arange(1, 9), np.array([4, 2]), share=4, hidden=6)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    g.p["cb"] += shift * np.array([1, 1, -1, 1])
    g.p["wb"][:4] -= shift
    h, y = np.tanh(rng.normal(size=(40, 6))), rng.integers(0, 10, 40)
    soft = lambda s: s - s.max() - np.log(np.exp(s - s.max()).sum())
    classes = [soft(x @ g.p["c"] + g.p["cb"]) for x in h]
    want = [c[i // 4] + soft(x @ g.p["w"][:, i // 4 * 4 : i // 4 * 4 + 4] + g.p["wb"][i // 4 * 4 : i // 4 * 4 + 4])[i % 4] if i < 8 else c[i - 6] for c, x, i in zip(classes, h, y)]
    assert np.allclose(g.log_probs(h, y)[0], want, atol=1e-9)


def test_lm(spark, monkeypatch):
    monkeypatch.setattr(lm, "GLOSSARY", 12)
    monkeypatch.setattr(lm, "VOCABULARY", 6)
    rng = random.Random(10)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(150)] + [*EMPTY, "unseen" * 20, "É é " + "z" * 60]
    docs = docs_of(spark, texts)
    fold = {r["doc_id"]: r["m"] for r in docs.select("doc_id", common.remainder("doc_id", 7).alias("m")).collect()}
    tok = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = collections.Counter()
    for i, t in enumerate(texts):
        if fold[i] != 2:
            c.update(tok(t))
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.score(docs, common.remainder("doc_id", 7) != 2).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, w = got[i], tok(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lm.score(docs, F.lit(False)).filter("train_tokens = 0 and n_known = 0").count() == len(texts)


def test_lm_score_against_a_plain_network(spark, monkeypatch):
    monkeypatch.setattr(lm, "GLOSSARY", 30)
    monkeypatch.setattr(lm, "VOCABULARY", 12)
    monkeypatch.setattr(lm, "GROUP", 10)
    rng = random.Random(19)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(240)] + ["q" * 60 + " new words", ""]
    docs = docs_of(spark, texts)
    counts, reader, net, n = lm.learn(docs, F.lit(True))
    c = collections.Counter(w for t in texts for w in t.encode().split())
    assert {r["word"].encode(): r["c"] for r in counts.collect()} == collections.Counter(map(lm.key_of, (w for t in texts for w in t.encode().split())))
    v = reader.vocabulary
    totals = collections.Counter()
    for w, k in c.items():
        if w not in v:
            totals[lm.bucket(lm.key_of(w))] += k + 1
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, F.lit(True)).collect()}
    for i in (0, 7, 100, 240, 241):
        h, x, total = np.zeros((1, net.hidden), np.float32), 0, 0.0
        for w in [*texts[i].encode().split(), lm.END]:
            h = net.step(net.p["e"][[x]], h)[0]
            x = v.index(w) if w in v else reader.k + lm.bucket(lm.key_of(w))
            total += net.log_probs(h.copy(), np.array([x]))[0][0] / math.log(10)
            if w not in v:
                total += math.log10((c[w] + 1) / (totals[lm.bucket(lm.key_of(w))] + 1))
        assert abs(total - got[i]) < 1e-3 * max(1, abs(total)), i


def test_lm_odd_rows(spark):
    text = "one two three " * 50
    rows = [(1, text), (1, text), (1, text), (1, "other " + text), (None, "one"), (2, None), (3, "long " * 200_000), (3, "z" * 100_000 + " one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "uid", "key", "word", "h", "g")})
    got = lm.score(docs, common.remainder("doc_id", 7) != 99).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {1: 4, None: 1, 2: 1, 3: 2}
    same = [r for r in got if r["doc_id"] == 1 and r["n_tokens"] == 151]
    assert len(same) == 3 and len({(r["n_known"], r["base_score"], r["score"]) for r in same}) == 1 and same[0]["n_known"] == 151
    assert {r["n_tokens"] for r in got if r["doc_id"] == 3} == {200_001, 3}
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_glossary_is_never_empty(spark):
    counts = spark.createDataFrame([(f"w{i}", 7) for i in range(500)] + [("top", 900)], "word string, c long")
    got = [r["word"] for r in lm._most_frequent(counts, 100).collect()]
    assert len(set(got)) == 100 and "top" in got
    assert lm._most_frequent(counts, 1_000).count() == 501 and lm._most_frequent(counts.limit(0), 9).count() == 0


def test_weights_travel():
    g = gru.Gru(np.array([5, 9, 8, 7]), np.array([4, 2]), share=2, hidden=4)
    other = gru.Gru(np.array([1, 1, 1, 1]), np.array([1, 1]), share=2, hidden=4, seed=3).load(g.flat())
    assert all((g.p[k] == other.p[k]).all() for k in g.p)
    again = g.copy().fit([np.array([1, 2, 3] * 900)])
    assert not np.allclose(again.flat(), g.flat()) and (other.flat() == g.flat()).all()


def test_buckets_agree(spark):
    words = ["a", "ab", "abc", "abcd", "é", "straße", "한국어"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", lm.bucket_column(F.col("w")).alias("b")).collect()
    assert all(lm.bucket(r["w"].encode()) == r["b"] for r in got)


# ------------------------------------------------------------------ fingerprints
def test_fingerprints(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(0, 400)) for _ in range(40)] + [*EMPTY, "x y", "x y"]
    ids = rng.sample(range(-50, 1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("next", F.lit(1)).withColumn("s", F.lit(2))
    got = {r["doc_id"]: r for r in fingerprints.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"]).select("doc_id", F.col("next.text").alias("n"), fingerprints.edited(F.col("text"), F.col("next.text")).alias("e")).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        assert got[i]["n"] == nxt and got[i]["e"] == t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]


def test_runs_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN", 5)
    docs = spark.createDataFrame([(i * i, str(i)) for i in range(83)] + [(None, "n")], "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in fingerprints.with_next(docs, ["text"]).select("doc_id", F.col("next.text").alias("n")).collect()}
    assert got == {i * i: str(i - 1 if i else 82) for i in range(83)} | {None: None}
    assert fingerprints.with_next(docs.limit(0), ["text"]).count() == 0


def test_likeness(spark):
    rng = random.Random(12)
    pairs = []
    for n in (3, 30, 300, 3000):
        a = prose(rng, n).split()
        pairs += [(" ".join(a), " ".join(a[: n // 2] + prose(rng, n - n // 2).split())), (" ".join(a), " ".join(a)), (" ".join(a), " ".join(a[: max(1, n // 8)]))]
    pairs += [("", ""), ("", "a b"), (None, "")]
    sets = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(len(w) - 4)} or ({tuple((t or "").split())} if (t or "").split() else set())
    s = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", fingerprints.sketch(F.col("a")).alias("x"), fingerprints.sketch(F.col("b")).alias("y"), fingerprints.sketch(F.concat_ws(" ", "a", "b")).alias("z"))
    for r in s.select("i", fingerprints.likeness(F.col("x"), F.col("y")).alias("l"), fingerprints.containment(F.col("y"), F.col("x")).alias("c"), (fingerprints.merged(F.col("x"), F.col("x")).getField("hashes") == F.col("x.hashes")).alias("m"), (fingerprints.as_text(F.col("x")) == fingerprints.as_text(F.col("y"))).alias("same")).collect():
        a, b = map(sets, pairs[r["i"]])
        want = 1.0 if not a and not b else len(a & b) / len(a | b)
        assert abs(r["l"] - want) < 0.15 and r["m"], pairs[r["i"]][0][:40]
        assert abs(r["c"] - (len(a & b) / len(b) if b else 1.0)) < 0.25
        if (pairs[r["i"]][0] or "") == (pairs[r["i"]][1] or ""):
            assert r["same"] and r["l"] == 1.0


def test_sketch_text_round_trip(spark):
    rng = random.Random(20)
    texts = [None, "", "a", "a b c d e", *[prose(rng, n) for n in (63, 64, 67, 68, 69, 80, 2_000)]]
    s = docs_of(spark, texts).select("doc_id", fingerprints.sketch(F.col("text")).alias("a")).withColumn("b", fingerprints.from_text(fingerprints.as_text(F.col("a"))))
    for r in s.collect():
        assert r["a"] == r["b"]
    # short beside long: one kept whole, the other cut
    long_, short = prose(rng, 3_000), None
    short = " ".join(long_.split()[:60])
    pair = spark.createDataFrame([(long_, short)], "a string, b string").select(fingerprints.containment(fingerprints.sketch(F.col("b")), fingerprints.sketch(F.col("a"))).alias("c"), fingerprints.likeness(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("l")).first()
    assert pair["c"] == 1.0 and abs(pair["l"] - 56 / 2996) < 0.02


def test_next_rows_of_repeated_ids(spark):
    rows = [(1, "a"), (2, "b"), (2, "c"), (2, "b"), (3, "x " * 100_000), (None, "n")]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"]).select("doc_id", "text", F.col("next.text").alias("n")).collect()
    assert len(got) == 6 and collections.Counter(r["n"] for r in got) == {"a": 1, "b": 2, "c": 1, rows[4][1]: 1, None: 1}
    assert {r["text"]: r["n"] for r in got}["a"] == rows[4][1]


# ------------------------------------------------------------------ registry and pipeline
DIR = os.environ.get("DOCKETRY_TESTDATA", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"], "op2_toxicity": ["doc_id", "held_out", "score", "predicted"], "op3_knn": ["query_id", "rank", "vec_id", "score"],
    "op4_extraction": ["page_id", "url", "text", "n_chars"], "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op8_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries(spark, name):
    """Columns, folds and rows of each query, and its values where plain code can tell them."""
    import zlib

    got = queries.QUERIES[name](spark, DIR)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = got.collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    if name in ("op1_simhash", "op2_toxicity", "op5_bpe", "op6_mixing", "op8_language", "op9_lm", "op10_fingerprints"):
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    fold = {"op2_toxicity": (5, 0), "op8_language": (3, 1), "op9_lm": (7, 2)}.get(name)
    for r in rows if fold else ():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1])
    if name == "op2_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    elif name == "op3_knn":
        vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
        assert sorted(map(tuple, rows)) == plain_top(vectors, lambda i: i % 100 == 0)
    elif name == "op4_extraction":
        assert len(rows) == spark.read.parquet(f"{DIR}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    elif name == "op6_mixing":
        taken, target = collections.Counter(), {}
        for r in rows:
            source = docs[r["doc_id"]]["source"]
            taken[source] += r["taken"]
            target[source] = r["target"]
            assert r["taken"] <= 2 * r["size"]
        spread = sum((r["target"] / r["source_size"] % 1) * (1 - r["target"] / r["source_size"] % 1) * r["size"] ** 2 for r in rows) ** 0.5
        assert abs(sum(taken.values()) - sum(target.values())) <= 4 * spread
    elif name == "op7_warc":
        pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
        first = {}
        for k in sorted(pages):
            first.setdefault(pages[k], k)
        for r in rows:
            payload = pages[r["page_id"]]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first[payload] == r["page_id"] else ("revisit", first[payload]))
        assert sorted(r["page_id"] for r in rows) == sorted(pages)
    elif name == "op8_language":
        assert all(0 <= r["score"] <= 1 for r in rows)
        right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
        assert sum(right) / len(right) > 0.9
    elif name == "op10_fingerprints":
        order = sorted(docs, reverse=True)
        after = dict(zip(order, [*order[1:], order[0]]))
        for r in rows:
            text, other = docs[r["doc_id"]]["text"] or "", docs[after[r["doc_id"]]]["text"] or ""
            half = len(text) // 2
            made = text[: len(text) - half] + other[:half]
            assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(made.encode()).hexdigest()
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_all_operators_have_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))


def test_centred_blocks_stand_apart():
    nodes = dom.parse("<body><center>Alpha today.</center><center>Beta <b>bold</b> gamma</center><p>Delta<label>1</label></p></body>")
    assert [n.text for n in nodes if not n.tag] == ["Alpha today.", "Beta bold gamma", "Delta1"]


def test_every_training_text_trains_the_network(spark):
    """Each text moves the weights, whatever its id; a row that repeats counts once."""
    docs = docs_of(spark, [f"wort{i} und noch {i}" for i in range(6)])
    _, reader, _, n = lm.learn(docs, F.lit(True))
    hashed = docs.select(F.xxhash64("doc_id", F.lit(9)).alias("h"), "text")
    trained = lambda rows: lm._trained_on(rows, reader, reader.network(), n).flat()
    whole = trained(hashed)
    assert n == 30 and np.array_equal(whole, trained(hashed.unionByName(hashed.limit(2))))
    assert not any(np.array_equal(whole, trained(hashed.filter(~F.col("text").startswith(f"wort{i}")))) for i in range(6))


def test_words_are_read_without_an_object_for_each(monkeypatch):
    """Words, places and symbols are those of plain splitting, of odd texts too, and a long text's words stay in Arrow's buffers."""
    import tracemalloc

    monkeypatch.setattr(lm, "VOCABULARY", 3)
    texts = ["".join(map(chr, range(128))), " a  B\t\n c ", "", " \x0b ", None, "É\u00a0é \x1c \u3000 \x85x", "q" * 60 + " One " + "Z" * 49 + " one", "one"]
    plain = [(t or "").encode().lower().split() for t in texts]
    words, sizes = lm.words_of(pa.array([t and t.encode() for t in texts], pa.binary()))
    assert [w.encode() for w in words.to_pylist()] == [w for t in plain for w in t] and sizes.tolist() == [len(t) for t in plain]
    glossary = [(b"one", 9), (b"c", 8), (lm.key_of(b"z" * 49), 7), (b"a", 6)]
    reader, at = lm.Reader(glossary, 5, 40, 9, np.ones(lm.BUCKETS)), {w: i for i, (w, _) in enumerate(glossary, 1)}
    sizes, places, symbols, unknown = reader.read(pa.array(texts, pa.string()))
    keys = [lm.key_of(w) for t in plain for w in t]
    assert sizes.tolist() == [len(t) for t in plain] and places.tolist() == [at.get(w, -1) for w in keys]
    assert symbols.tolist() == [at[w] if at.get(w, 3) < 3 else 3 + lm.bucket(w) for w in keys] and unknown.to_pylist() == [w.decode() for w in keys if w not in at]
    monkeypatch.setattr(lm, "READ", 20)
    assert [x.tolist() for x in reader.symbols([t or "" for t in texts])] == [x.tolist() for x in np.split(symbols, np.cumsum(sizes)[:-1])]
    assert reader.symbols([]) == [] and len(reader.read(pa.array([], pa.string()))[0]) == 0
    counted = lm._counted([words, words[:0], words])
    assert dict(zip(counted[0].to_pylist(), counted[1].to_pylist())) == {w.decode(): 2 * n for w, n in collections.Counter(keys).items()}
    text = pa.array(["one two " * 200_000], pa.string())
    tracemalloc.start()
    reader.read(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 400_000


def test_training_works_in_the_same_arrays():
    """Windows after the first ask for no large arrays anew, and have the gradients of fresh ones."""
    import tracemalloc

    rng = np.random.default_rng(6)
    g, room = gru.Gru(np.arange(1, 40), np.ones(8), share=8), gru.Room()
    x, y, _, _ = gru.lanes([rng.integers(1, 40, size=n) for n in rng.integers(20, 60, 600)], 300)
    h = np.zeros((300, g.hidden), np.float32)
    for at in (0, 32, 64, 0):
        tracemalloc.start()
        grad, end = g._window(x[at : at + 32], y[at : at + 32], h, room)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        fresh, same = g._window(x[at : at + 32], y[at : at + 32], h)
        assert np.array_equal(end, same) and all(np.array_equal(grad[k], fresh[k]) for k in g.p)
    assert peak < 2_000_000


def test_gradients_of_frequent_and_rare_inputs_agree(monkeypatch):
    rng = np.random.default_rng(8)
    g = gru.Gru(np.arange(1, 9), np.array([4, 2]), share=4, hidden=6)
    x, y, _, _ = gru.lanes([rng.integers(1, 10, size=30) for _ in range(9)], 4)
    found = []
    for few in (0, 5, 1_000):
        monkeypatch.setattr(gru, "FEW", few)
        found.append(g._window(x, y, np.zeros((4, 6), np.float32))[0]["e"])
    assert np.allclose(found[0], found[2], atol=1e-6) and np.allclose(found[1], found[2], atol=1e-6) and np.abs(found[0]).max() > 1e-4


def test_toxicity_fit_holds_numbers_of_candidates():
    """The fit's memory doesn't grow by a string for each feature of each text."""
    import tracemalloc

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(300)]
    texts = [" ".join(words) for _ in range(400)]
    tracemalloc.start()
    toxicity.fit(texts, [i % 2 for i in range(400)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000
