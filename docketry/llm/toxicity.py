"""Toxicity scores by a counterfactually regularised classifier.

A logistic model over the presence of words and word beginnings is fitted with numpy on a bounded
sample of labelled texts. For each labelled text that names a group of people, a counterfactual copy
names other groups of the same kind in its place, and the fit pays for the squared change of the
score between the two: what a text says about a group, not that it names one, has to carry the
score. Scoring covers every whole text.

Defined cases: null and empty texts have no features and get the score of the intercept; without
labelled rows of both kinds every text gets the share of toxic rows among them (0 if there are none);
rows with a null label are not learned from; an empty table gives an empty result; texts of any length are
read whole; rows that repeat are learned from once and score alike; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import sample_of

#: Bounds of the learning sample: so many labelled texts, each of up to so many characters; a label that only
#: longer texts have is learned from their starts.
SAMPLE_DOCS = 6_000
SAMPLE_CHARS = 10_000
#: Features kept, by their likelihood ratio with the label; each occurs in LEAST toxic texts or more.
FEATURES = 512
LEAST = 3
PREFIXES = (4, 5, 6, 7)
#: Weight of the penalty on squared counterfactual score changes, and of that on squared weights.
FAIRNESS = 4.0
RIDGE = 3e-5
STEPS = 800
#: Words in a worker's cache.
CACHE_WORDS = 80_000

#: Terms that name groups of people, by kind; a counterfactual swaps within a kind.
IDENTITY = {
    "religion": ("muslim", "muslims", "jewish", "jews", "christian", "christians", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists"),
    "gender": ("woman", "women", "man", "men", "girl", "girls", "boy", "boys", "transgender", "nonbinary"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    "origin": ("black", "white", "asian", "latino", "african", "european", "arab", "immigrant", "immigrants", "refugee", "refugees", "native"),
    "ability": ("disabled", "blind", "deaf", "autistic", "able-bodied"),
    "age": ("old", "elderly", "young", "teenage"),
}
_KIND = {term: kind for kind, terms in IDENTITY.items() for term in terms}
#: A hyphen between letters belongs to a word only in terms that are listed with one.
_HYPHENED = "|".join(re.escape(t) for t in _KIND if "-" in t)
_WORDS = re.compile(rf"(?<![^\W\d_])(?:{_HYPHENED})(?![^\W\d_])|[^\W\d_]+").findall


def words_of(text: str) -> set[str]:
    return set(_WORDS(text.lower()))


def features_of(word: str) -> list[str]:
    """The word and its beginnings; a beginning is marked so that it isn't taken for a word."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def swapped(words: set[str], turn: int) -> set[str] | None:
    """The words with each group term exchanged for another of its kind; None if there is none."""
    named = [w for w in words if w in _KIND]
    if not named:
        return None
    out = words - set(named)
    for w in named:
        terms = IDENTITY[_KIND[w]]
        out.add(terms[(terms.index(w) + 1 + turn % (len(terms) - 1)) % len(terms)])
    return out


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float


def fit(texts: list[str], labels: list[int], fairness: float = FAIRNESS) -> Model:
    """Newton-free full-batch fit: Adam on the logistic loss, the ridge and the counterfactual penalty."""
    y = np.array(labels, np.float32)
    n, toxic = len(y), float(sum(labels))
    if not n or toxic in (0, n):
        share = toxic / n if n else 0.0
        return Model((), (), math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    # candidates occur in LEAST toxic texts or more, which are few; the others are counted for these alone
    bad: Counter[str] = Counter()
    for text, label in zip(texts, labels):
        if label:
            bad.update({f for w in words_of(text) for f in features_of(w)})
    bad = Counter({f: c for f, c in bad.items() if c >= LEAST or f in _KIND})
    # what a text holds stands as numbers of candidates, which take a small part of what their strings would
    number = {f: i for i, f in enumerate(dict.fromkeys([*bad, *_KIND]))}
    times, sets = np.zeros(len(number), np.int64), []
    for text in texts:
        words = words_of(text)
        found = {number[f] for w in words for f in features_of(w) if f in number}
        ids = np.fromiter(found, np.int32, len(found))
        times[ids] += 1
        sets.append(({w for w in words if w in _KIND}, ids))
    seen = {f: int(times[i]) for f, i in number.items()}

    def ratio(f: str) -> float:  # log likelihood ratio of the feature's 2 x 2 table
        def part(k: float, m: float, p: float) -> float:
            return (k * math.log(k / m / p) if k else 0.0) + ((m - k) * math.log((m - k) / m / (1 - p)) if m > k else 0.0)

        return part(bad[f], toxic, seen[f] / n) + part(seen[f] - bad[f], n - toxic, seen[f] / n)

    kept = sorted((f for f, c in seen.items() if 0 < c < n and bad[f] >= LEAST), key=lambda f: (-ratio(f), f))[:FEATURES]
    kept = list(dict.fromkeys([*(t for t in _KIND if seen[t]), *kept]))
    at = {f: i for i, f in enumerate(kept)}

    x = np.zeros((n, len(kept)), np.float32)
    column = np.array([at.get(f, -1) for f in number], np.int32)
    changes = []
    for i, (named, ids) in enumerate(sets):
        columns = column[ids]
        x[i, columns[columns >= 0]] = 1
        if (other := swapped(named, i)) is not None:
            d = np.zeros(len(kept), np.float32)
            for words, sign in ((named, 1), (other, -1)):
                d[[k for k in {at[f] for w in words for f in features_of(w) if f in at}]] += sign
            changes.append(d)
    change = np.array(changes, np.float32).reshape(len(changes), len(kept))
    w, b = np.zeros(len(kept), np.float32), math.log(toxic / (n - toxic))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = x.T @ (p - y) / n + RIDGE * w
        if len(change):
            g += 2 * fairness * (change.T @ (change @ w)) / len(change)
        gb = float((p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**step, 1 - 0.999**step
        w = w - 0.05 * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= 0.05 * (mb / c) / (math.sqrt(vb / d) + 1e-8)
    return Model(tuple(kept), tuple(float(z) for z in w), float(b))


class Scorer:
    def __init__(self, model: Model):
        at = {f: i for i, f in enumerate(model.names)}
        self.weights, self.intercept = model.weights, model.intercept

        class Cache(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                got = tuple(at[f] for f in features_of(word) if f in at)
                if len(word) <= 64:
                    self[word] = got
                return got

        self.cache = Cache()

    def score(self, text: str) -> float:
        hits: set[int] = set()
        for found in map(self.cache.__getitem__, words_of(text)):
            if found:
                hits.update(found)
        z = self.intercept + math.fsum([self.weights[i] for i in hits])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


@lru_cache(maxsize=4)
def _scorer(model: Model) -> Scorer:
    return Scorer(model)


def learn(labelled: DataFrame, fairness: float = FAIRNESS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on up to SAMPLE_DOCS labelled texts, drawn by a hash of the id."""
    label = (F.col(label_col) != 0).cast("int")
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.substring(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 1, SAMPLE_CHARS + 1).alias("text"), label.alias("label"), F.xxhash64(F.col(id_col), F.lit(2)).alias("h"))
    drawn = sample_of(rows, "h", SAMPLE_DOCS)
    short = {r["label"] for r in drawn if len(r["text"]) <= SAMPLE_CHARS}
    kept = [r for r in drawn if len(r["text"]) <= SAMPLE_CHARS or r["label"] not in short]
    return fit([r["text"] for r in kept], [r["label"] for r in kept], fairness)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """-> (id, *keep, score): one row for each row of docs."""
    first = docs.select(F.col(id_col), *keep).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model).score
        for batch in batches:
            scores = pa.array([of(t.as_py() or "") for t in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    return docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, out)


def scored(text: Column, model: Model) -> Column:
    """The score as a column, so that other columns stay where they are."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = _scorer(model).score
        for part in parts:
            yield pd.Series([of(t or "") for t in part], dtype="float64")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text.cast("string"))
