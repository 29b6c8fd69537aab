"""Ranked lexical search by Fagin's threshold algorithm.

A text's terms are its runs of letters, digits and characters beyond ASCII, A-Z in lower case. Only terms that items ask
for are kept of each document: one pass over the texts writes a forward index (a document's number of terms, and
how often it has each asked term), from which the corpus statistics follow as aggregates. All numbers but a term's
weight are integers, so scores are exact and equal in every order of work.

The documents are then ranked by the tasks that hold them, in blocks of a bounded number of postings. A block has, for each
term, its postings sorted by impact, and a forward index for random access. For each item the algorithm reads its
terms' lists round by round, the best of each first; looks up every newly met document's impacts for all terms of
the item in the forward index; and keeps the k best. The impacts at which the lists stand add up to the threshold: no document
that has not been met scores more. It stops once the threshold falls strictly below the k-th best score, as at equality a document
with a smaller id might be left. A task carries its k best from block to block, so that later blocks stop sooner, or at once.
Rounds are read some at a time, more each time; this only means that a list may be read further than needed. The k best
of each task meet in one ranking by item.

Items are worked on in blocks by bytes of their terms, so neither the driver nor a task holds more than one block
of them; each block reads the texts once.

Defined cases: null texts, and those without a term, are no documents; items without a term, or whose terms no document
has, get no rows; rows that share an item's id are one item, with the terms of all; a null item id is an id; documents that
repeat an id are ranked each, beside each other; documents without an id count in the statistics and are no
answers; texts of any length are read whole; ties go to the smaller id; fewer than k documents with a score above 0:
all of them; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import cores, stable

K = 10
#: Bytes of the terms of a block of items, with 64 bytes for each.
ITEM_BYTES = 16 << 20
#: Postings in a block of documents, about.
POSTINGS = 1 << 20
#: Entries that are read of each list at first, and at most.
DEPTHS = (8, 256)
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 texts as terms have them: bytes beyond ASCII stay, and what parts terms becomes a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: Column) -> Column:
    """The text's terms, in order; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"({TERM})"), F.lit(1)), F.array().cast("array<string>"))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def forward_index(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, n, terms, tfs) of documents with a term: n counts all terms, terms has the numbers of the asked ones, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, found, often = [], [], [], []
            for ident, raw in zip(batch.column(0), batch.column(1), strict=True):
                words = raw.as_py().translate(_BYTES).split()
                if not words:
                    continue
                counts = Counter(words)
                own = sorted((numbers[w], counts[w]) for w in counts.keys() & numbers.keys())
                ids.append(ident.as_py()), sizes.append(len(words))
                found.append([t for t, _ in own]), often.append([c for _, c in own])
            made = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["id", "n", "terms", "tfs"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("raw")).filter("raw is not null")
    return texts.mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>")


class Block:
    """Some documents: impact-sorted lists by term, and a forward index."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, length: int):
        """Document i has the postings starts[i] to starts[i + 1], ascending by term."""
        order = np.argsort(ids, kind="stable")  # so that a smaller place is a smaller id
        counts = np.diff(starts)[order]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[:-1][order] - (ends - counts), counts)
        self.ids, sizes, term, tf = ids[order], sizes[order], term[at], tf[at]
        doc = np.repeat(np.arange(len(ids)), counts)
        if 90 * int(sizes.max(initial=0)) * documents < 1 << 62:
            m = 10 + (90 * documents * sizes) // length
        else:
            m = np.array([10 + 90 * documents * int(n) // length for n in sizes], np.int64)
        self.span = len(weights)
        self.keys, self.impacts = doc * self.span + term, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        by_impact = np.lexsort((doc, -self.impacts, term))
        self.doc, self.sorted = doc[by_impact], self.impacts[by_impact]
        self.ends = np.searchsorted(term[by_impact], np.arange(self.span + 1))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whole scores, by random access."""
        wanted = docs[:, None] * self.span + asked[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.impacts[at], 0).sum(axis=1)

    def best(self, asked: np.ndarray, k: int, ids: np.ndarray, scores: np.ndarray, depths: tuple[int, int] = DEPTHS) -> tuple[np.ndarray, np.ndarray]:
        """The k best of this block's documents and of those given, best first."""
        asked = asked[self.ends[asked] < self.ends[asked + 1]]
        at, end = self.ends[asked], self.ends[asked + 1]
        threshold, depth = int(self.sorted[at].sum()), depths[0]
        met = np.zeros(len(self.ids), bool)
        while threshold > 0 and (len(scores) < k or threshold >= scores[-1]):
            upto = np.minimum(at + depth, end)
            docs = np.unique(np.concatenate([self.doc[a:b] for a, b in zip(at, upto, strict=True)]))
            docs = docs[~met[docs]]
            met[docs] = True
            got = self.scores(docs, asked)
            keep = got >= (scores[-1] if len(scores) == k else 1)
            if keep.any():
                ids, scores = np.concatenate([ids, self.ids[docs[keep]]]), np.concatenate([scores, got[keep]])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
            threshold = int(self.sorted[upto - 1][upto < end].sum())  # an ended list has nothing more to give
            left = upto < end
            at, end, depth = upto[left], end[left], min(2 * depth, depths[1])
        return ids, scores


def _ranking(items: list[np.ndarray], weights: np.ndarray, documents: int, length: int, k: int, postings: int):
    """mapInArrow over the forward index -> (item, doc_id, score): the k best of the task's documents for each item."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        held: list[tuple] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            # postings of terms without weight add nothing
            term, tf = np.asarray(lists.flatten()), np.asarray(batch.column(3).flatten())
            heavy = weights[term] > 0
            counts = np.add.reduceat(np.append(heavy, False).astype(np.int64), np.asarray(lists.offsets)[:-1] - np.asarray(lists.offsets)[0]) * (np.diff(np.asarray(lists.offsets)) > 0)
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), counts, term[heavy].astype(np.int64), tf[heavy]))
            count += int(heavy.sum())
            if count >= postings:
                yield block(held)
                held, count = [], 0
        if held:
            yield block(held)

    def block(held: list[tuple]) -> Block:
        ids, sizes, counts, term, tf = (np.concatenate([h[i] for h in held]) for i in range(5))
        return Block(ids, sizes, np.concatenate([[0], np.cumsum(counts)]), term, tf, weights, documents, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.empty(0, np.int64)
        best = [(nothing, nothing) for _ in items]
        for b in blocks(batches):
            if len(b.keys):
                best = [b.best(asked, k, *best[i]) for i, asked in enumerate(items)]
        item = np.repeat(np.arange(len(items)), [len(ids) for ids, _ in best])
        joined = [np.concatenate([x[i] for x in best]) if best else nothing for i in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), *[pa.array(x, pa.int64()) for x in joined]], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES, postings: int = POSTINGS) -> DataFrame:
    """-> (item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.explode(terms(F.col(f"`{item_text_col}`"))).alias("term")).distinct()
    size = asked.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    n = -(-size // item_bytes)
    kind = asked.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for i in range(n):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        found = found.unionByName(_of_items(docs, [(r["item_id"], r["terms"]) for r in part], kind, k, id_col, text_col, postings))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _of_items(docs: DataFrame, items: list[tuple], kind: str, k: int, id_col: str, text_col: str, postings: int) -> DataFrame:
    spark = docs.sparkSession
    numbers = {t.encode(): i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    index = stable(forward_index(docs, numbers, id_col, text_col))
    every = index.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
    documents, length = every["n"], every["length"] or 1
    weights = np.zeros(len(numbers), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[r["t"]] = weight(documents, r["count"])
    asked = [np.array(sorted(numbers[t.encode()] for t in ts), np.int64) for _, ts in items]
    # a task ranks many documents, as it hands on k rows for each item
    fewer = index.filter("id is not null").coalesce(4 * cores(spark))
    best = fewer.mapInArrow(_ranking(asked, weights, documents, length, k, postings), "item int, doc_id long, score long")
    names = spark.createDataFrame([(i, ident) for i, (ident, _) in enumerate(items)], f"item int, item_id {kind}")
    return best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
