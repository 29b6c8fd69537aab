"""A kept index of texts for ranked search, and small pools of rows that every task holds.

The index has a row for each document: its number of tokens, its terms and how often it has each. Texts are tokenised once,
when it is built; document frequencies and lengths are aggregates over it, and every search reads it instead of the texts,
each column of terms matched against the asked ones as a whole. Rows of a frequent term lie with their documents, so no term
is a hot key. Kept below a path, an index is read again by later sessions.

Pools are configuration, such as the rows of a delegation table or the duties of a department's teams, and what is asked is the
large side. There each task tokenises its own queries and scores them against the rows of their pool, with the pool's own
statistics; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.shared import stable

_SPACE = re.compile(r"\s+")
#: Rows of all pools that travel to every task, and the characters of their texts.
MOST_POOL_ROWS, MOST_POOL_CHARS = 20_000, 8_000_000


def terms_of(text: str | None) -> list[str]:
    """tokenize() in Python: words, then the bigrams of the text without white space."""
    words = _SPACE.sub(" ", text or "").strip(" ")
    flat = words.replace(" ", "")
    return [*filter(None, words.split(" ")), *map(add, flat, flat[1:])]


def raw_idf(n: float, df: float) -> float:
    return math.log(n - df + 0.5) - math.log(df + 0.5)


@dataclass
class Index:
    """rows: (id, n, terms, tfs)."""

    rows: DataFrame
    _seen: dict | None = None

    def sizes(self) -> tuple[int, int, float]:
        """Documents, tokens, and the mean of the raw weights of all terms."""
        if self._seen is None:
            whole = self.rows.agg(F.count("*").alias("n"), F.sum("n").alias("size")).first()
            n, df = whole["n"] or 0, F.col("count")
            counts = stable(self.rows.select(F.explode("terms").alias("term")).groupBy("term").count())
            raw = F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)
            self._seen = {"n": n, "size": whole["size"] or 0, "mean": counts.agg(F.avg(raw)).first()[0] or 0.0, "counts": counts}
        return self._seen["n"], self._seen["size"], self._seen["mean"]

    def weights(self, wanted: list[str]) -> dict[str, float]:
        """idf of those of the terms that occur: ln(N - df + .5) - ln(df + .5); negative ones become a quarter of the mean."""
        n, _, mean = self.sizes()
        spark = self.rows.sparkSession
        asked = spark.createDataFrame([(t,) for t in wanted], "term string")
        found = {r["term"]: raw_idf(n, r["count"]) for r in self._seen["counts"].join(F.broadcast(asked), "term").collect()}
        return {t: w if w >= 0 else fixed.BM25_EPSILON * mean for t, w in found.items()}


def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Tokenises all texts, once; below a path the index is kept there. A null text has no terms, and is a document."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, starts, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                ts = terms_of(text.as_py())
                counts = Counter(ts)
                sizes.append(len(ts))
                terms.extend(counts.keys())
                tfs.extend(counts.values())
                starts.append(len(terms))
            at = pa.array(starts, pa.int32())
            made = [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays(made, names=["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n bigint, terms array<string>, tfs array<int>")
    if path is None:
        return Index(stable(rows))
    rows.write.parquet(path)
    return kept(docs.sparkSession, path)


def kept(spark: SparkSession, path: str) -> Index:
    """An index that build() wrote."""
    return Index(spark.read.parquet(path))


def matched(batch: pa.RecordBatch, asked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among the asked terms, tf) of a batch's postings of asked terms."""
    lists, tfs = batch.column(2), batch.column(3)
    offsets = np.asarray(lists.offsets)
    place = pc.index_in(lists.flatten(), value_set=asked)
    hit = np.asarray(place.is_valid())
    row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    return row[hit], np.asarray(place.drop_null(), dtype=np.int64), np.asarray(tfs.flatten())[hit]


class Pool:
    """The rows of one pool, with its own statistics."""

    def __init__(self, rows: list[tuple[object, str]]):
        counts = [(ident, Counter(terms_of(text))) for ident, text in rows]
        self.ids = [ident for ident, _ in counts]
        df = Counter(t for _, c in counts for t in c)
        n, length = len(counts), sum(sum(c.values()) for _, c in counts)
        raw = {t: raw_idf(n, d) for t, d in df.items()}
        floor = fixed.BM25_EPSILON * sum(raw.values()) / len(raw) if raw else 0.0
        self.lists: dict[str, list[tuple[int, float]]] = {}
        k1, b, average = fixed.BM25_K1, fixed.BM25_B, length / n if n and length else 1.0
        for place, (_, c) in enumerate(counts):
            norm = k1 * (1 - b + b * sum(c.values()) / average)
            for t, tf in c.items():
                self.lists.setdefault(t, []).append((place, (raw[t] if raw[t] >= 0 else floor) * tf * (k1 + 1) / (tf + norm)))

    def best(self, query: str | None, k: int, digits: int = 6) -> list[tuple[object, float]]:
        """The k best rows, ties to the first."""
        scores = [0.0] * len(self.ids)
        for t, times in Counter(terms_of(query)).items():
            for place, w in self.lists.get(t, ()):
                scores[place] += times * w
        order = sorted(range(len(scores)), key=lambda i: (-round(scores[i], digits), i))[:k]
        return [(self.ids[i], round(scores[i], digits)) for i in order]


def small_rows(rows: DataFrame, text_col: str) -> list | None:
    """Rows that may travel to every task, or None if they are more than that."""
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length(text_col)).alias("chars")).first()
    return rows.collect() if size["n"] <= MOST_POOL_ROWS and (size["chars"] or 0) <= MOST_POOL_CHARS else None


def search_pools(queries: DataFrame, name_of: Callable[[object], object], rows_of: Callable[[object], list[tuple[object, str]]], k: int, id_type: str, query_id: str = "query_id", pool: str = "dept", query: str = "query", id_col: str = "rid") -> DataFrame:
    """-> (query_id, rank, id, score): the k best rows of each query's pool.

    name_of(pool value) -> the pool's name; rows_of(name) -> its rows (id, text), in order: a worker builds each pool it meets once.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = queries.sparkSession
    kind, id_kind = queries.schema[query_id].dataType, spark.createDataFrame([], f"x {id_type}").schema["x"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools: dict = {}
        for batch in batches:
            out: list[tuple] = []
            for q, p, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                name = name_of(p)
                if name not in pools:
                    pools[name] = Pool(rows_of(name))
                out += [(q, rank, ident, score) for rank, (ident, score) in enumerate(pools[name].best(text, k), 1)]
            column = lambda i, t: pa.array([r[i] for r in out], t)
            yield pa.RecordBatch.from_arrays([column(0, to_arrow_type(kind)), column(1, pa.int32()), column(2, to_arrow_type(id_kind)), column(3, pa.float64())], names=[query_id, "rank", id_col, "score"])

    return queries.select(query_id, pool, query).mapInArrow(run, f"`{query_id}` {kind.simpleString()}, rank int, `{id_col}` {id_type}, score double")
