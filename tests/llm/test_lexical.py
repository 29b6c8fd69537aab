"""Ranked search against the formula by plain loops, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docketry.llm import lexical

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    seen = [(i, Counter(plain_terms(t))) for i, t in docs]
    seen = [(i, c) for i, c in seen if c]
    n_docs, length = len(seen), sum(sum(c.values()) for _, c in seen)
    df = Counter(t for _, c in seen for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in seen:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n, words=60):
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices([f"W{j}" if j % 3 else f"é{j}" for j in range(words)], weights, k=rng.randint(0, 40)))) for i in range(n)]


def test_terms(spark):
    texts = ["A b-C, d_e ÄÖ ä１２ 3x\x00y", None, "", "--", "İSTANBUL ſ K z"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(lexical.terms(F.col("text")).alias("t")).collect()
    assert [r["t"] for r in got] == [plain_terms(t) for t in texts]
    assert [t.encode().translate(lexical._BYTES).split() for t in texts if t] == [[x.encode() for x in plain_terms(t)] for t in texts if t]


def test_threshold_algorithm_in_blocks():
    """Each block against all scores, with and without scores from before, and few rounds where it can stop."""
    rng = np.random.default_rng(1)
    n, span = 300, 12
    counts = rng.integers(0, 12, n).clip(0, span)
    term = np.concatenate([np.sort(rng.choice(span, c, replace=False)) for c in counts]).astype(np.int64)
    tf, weights, ids = rng.integers(1, 4, len(term)), rng.integers(0, 50, span) * 40, rng.permutation(n) * 7
    starts = np.concatenate([[0], np.cumsum(counts)])
    block = lexical.Block(ids, rng.integers(5, 60, n), starts, term, tf, weights, 1000, 30_000)
    for asked in ([0], [1, 5, 7], list(range(span))):
        asked = np.array(asked)
        every = block.scores(np.arange(n), asked)
        want = sorted((-s, i) for s, i in zip(every.tolist(), block.ids.tolist()) if s > 0)
        for k in (1, 10, 1000):
            got, scores = block.best(asked, k, np.empty(0, np.int64), np.empty(0, np.int64), (2, 8))
            assert list(zip((-scores).tolist(), got.tolist())) == want[:k]
        # an earlier best that nothing reaches: no list is read
        block_doc, block.doc = block.doc, None
        got, scores = block.best(asked, 1, np.array([5]), np.array([1 << 60]))
        block.doc = block_doc
        assert got.tolist() == [5]


def test_search_is_that_of_the_formula(spark, monkeypatch):
    rng = random.Random(2)
    docs = corpus(rng, 400)
    docs += [(1000 + i, docs[3][1]) for i in range(30)]  # equal scores
    items = [(i, " ".join(rng.choices([f"w{j}" if j % 3 else f"É{j}" for j in range(80)], k=rng.randint(1, 9)))) for i in range(25)] + [(3, "w1 w2"), (50, "nowhere"), (51, None), (52, "--")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items)
    got = lexical.search(d.repartition(6), q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    # small blocks of documents and of items
    assert sorted(map(tuple, lexical.search(d, q, item_bytes=2_000, postings=50).collect()), key=str) == want


def test_odd_rows(spark):
    docs = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (4, "--"), (None, "a a a"), (5, "b " * 200_000 + "a"), (6, "c")]
    items = [("x", "A"), ("x", "b"), (None, "c"), ("y", None)]
    clash = {c: F.lit("c") for c in ("id", "raw", "n", "terms", "tfs", "rank", "score", "item", "item_id", "term")}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash)
    q = spark.createDataFrame(items, "item string, text string").withColumns({c: F.lit("c") for c in clash if c != "item"})
    got = sorted(map(tuple, lexical.search(d, q, item_col="item").collect()), key=str)
    assert got == plain_search(docs, items) and len(got) == 4
    assert lexical.search(d.limit(0), q, item_col="item").count() == 0 and lexical.search(d, q.limit(0), item_col="item").count() == 0
