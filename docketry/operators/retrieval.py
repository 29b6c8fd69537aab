"""Ranked retrieval: chunks, BM25, exact vectors, rank fusion and their measures."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.shared import stable
from docketry.functions.text import tokenize
from docketry.operators import index


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = r"\n\s*\n", least: int = fixed.MIN_CHUNK, most: int = fixed.MAX_CHUNK) -> DataFrame:
    """-> (id, n, text): paragraphs packed up to `most` characters; shorter packs than `least` are dropped.

    A single paragraph is never split. The fold runs over one document's paragraphs in the JVM.
    """
    paragraphs = F.filter(F.transform(F.split(F.col(text_col), separator), lambda p: F.trim(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    joined = lambda a, p: F.when(a["held"] == "", p).otherwise(F.concat(a["held"], F.lit("\n"), p))
    full = lambda a, p: (a["held"] != "") & (F.length(a["held"]) + F.length(p) > most)
    closed = lambda a: F.when(F.length(a["held"]) >= least, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"])
    step = lambda a, p: F.struct(F.when(full(a, p), closed(a)).otherwise(a["done"]).alias("done"), F.when(full(a, p), p).otherwise(joined(a, p)).alias("held"))
    packed = F.aggregate(paragraphs, start, step, closed)
    return docs.select(id_col, F.posexplode(packed).alias("n", "text"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, pool: list[str] = ()) -> DataFrame:
    """-> (*pool, id, term, tf, dl). pool columns divide the corpus into parts with statistics of their own."""
    found = docs.select(*pool, id_col, (tokens if tokens is not None else tokenize(F.col(text_col))).alias("ts"))
    terms = found.select(*pool, id_col, F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    return terms.groupBy(*pool, id_col, "dl", "term").agg(F.count("*").alias("tf"))


def idf(posts: DataFrame, sizes: DataFrame, pool: list[str] = ()) -> DataFrame:
    """-> (*pool, term, idf): ln(N - df + .5) - ln(df + .5); negative ones become a quarter of the mean.

    sizes: (*pool, n, avgdl).
    """
    df = posts.groupBy(*pool, "term").agg(F.count("*").alias("df"))
    df = df.join(F.broadcast(sizes), list(pool)) if pool else df.crossJoin(F.broadcast(sizes))
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*pool).agg(F.avg("raw").alias("mean"))
    raw = raw.join(F.broadcast(mean), list(pool)) if pool else raw.crossJoin(F.broadcast(mean))
    return raw.select(*pool, "term", "avgdl", F.when(F.col("raw") < 0, fixed.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


#: Queries of a block, which travel to all tasks, their bytes, and cells of a matrix that a task makes at once (32 MB).
MOST_QUERIES = 20_000
MOST_BYTES = 64 << 20
MOST_CELLS = 4_000_000


def _blocks(queries: DataFrame, query_id: str, most: int, size: Column) -> list[DataFrame]:
    """The queries in blocks of about `most`, and of MOST_BYTES; size: a query's bytes."""
    told = queries.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    n = max(-(-told["n"] // most), -(-(told["bytes"] or 0) // MOST_BYTES))
    return [queries] if n <= 1 else [queries.filter(F.pmod(F.xxhash64(query_id), F.lit(n)) == b) for b in range(n)]


def bm25(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query", id_col: str = "doc_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    """-> (query, rank, id, score): the k best of all documents for each query, ties to the smaller id. A document without a
    term of the query scores 0, and comes before those whose terms have negative weights. Texts are tokenised once, into an index."""
    return search(queries, index.build(docs, None, id_col, text_col), k, query_id, query_text, id_col, digits)


def search(queries: DataFrame, kept: index.Index, k: int, query_id: str = "query_id", query_text: str = "query", id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """BM25 over an index, as bm25(). Queries travel in blocks; each task scores its documents as products of matrices and hands on its
    k best for each query."""
    n, size, _ = kept.sizes()
    spark, found = kept.rows.sparkSession, None
    # a task ranks many documents, as it hands on k rows for each query
    rows = kept.rows.coalesce(4 * max(8, spark.sparkContext.defaultParallelism))
    kinds = dict(kept.rows.dtypes) | dict(queries.dtypes)
    blocks = _blocks(queries.select(query_id, query_text), query_id, MOST_QUERIES, F.octet_length(query_text))
    for block in blocks:
        asked = sorted((r[query_id], Counter(index.terms_of(r[query_text]))) for r in block.collect())
        weights = kept.weights(sorted({t for _, ts in asked for t in ts}))
        scorer = _Bm25(asked, weights, size / n if n else 1.0, k, digits, (kinds[query_id], queries.schema[query_id].dataType), (kinds["id"], kept.rows.schema["id"].dataType), query_id, id_col)
        part = ranked(rows.mapInArrow(scorer.run, scorer.schema), k, query_id, id_col)
        # of several blocks each is searched and written before the next is fetched, so that the driver holds one block's queries
        part = stable(part) if len(blocks) > 1 else part
        found = part if found is None else found.unionByName(part)
    return found


def ranked(scores: DataFrame, k: int, query_id: str, id_col: str) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_id, "rank", id_col, "score")


class _Best:
    """The k best (score, id) for each of n queries over blocks of rows; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.empty(0)] * n, [[] for _ in range(n)]

    def take(self, scores: np.ndarray, ids: list, first: int = 0) -> None:
        """scores: rows by queries first, first + 1 and so on; ids ascend."""
        k, rows = self.k, len(ids)
        if not rows:
            return
        cut = np.partition(scores, rows - min(k, rows), axis=0)[rows - min(k, rows)]
        for q in range(scores.shape[1]):
            at = np.flatnonzero(scores[:, q] >= cut[q])
            at = at[np.argsort(-scores[at, q], kind="stable")][:k]
            both = [*zip(self.scores[first + q], self.ids[first + q]), *((scores[i, q], ids[i]) for i in at)]
            both.sort(key=lambda x: (-x[0], x[1]))
            self.scores[first + q], self.ids[first + q] = np.array([x[0] for x in both[:k]]), [x[1] for x in both[:k]]


class _Bm25:
    def __init__(self, asked: list, weights: dict[str, float], average: float, k: int, digits: int, query_kind: tuple, id_kind: tuple, query_id: str, id_col: str):
        self.asked, self.weights, self.average, self.k, self.digits = asked, weights, average or 1.0, k, digits
        self.kinds, self.names = (query_kind[1], id_kind[1]), [query_id, id_col, "score"]
        self.schema = f"`{query_id}` {query_kind[0]}, `{id_col}` {id_kind[0]}, score double"

    def _slices(self) -> Iterator[tuple[int, list]]:
        """Runs of queries whose terms by queries stay under MOST_CELLS."""
        start, seen = 0, set()
        for i, (_, ts) in enumerate(self.asked):
            more = seen | ts.keys()
            if i > start and len(more) * (i + 1 - start) > MOST_CELLS:
                yield start, self.asked[start:i]
                start, more = i, set(ts)
            seen = more
        yield start, self.asked[start:]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k1, b = fixed.BM25_K1, fixed.BM25_B
        slices = []
        for start, part in self._slices():
            terms = sorted({t for _, ts in part for t in ts if t in self.weights})
            slices.append((start, part, terms, pa.array(terms, pa.string()), np.array([self.weights[t] for t in terms])))
        best, times = _Best(len(self.asked), self.k), None
        for batch in batches:
            order = pa.array(np.argsort(np.array(batch.column(0).to_pylist(), dtype=object), kind="stable") if batch.num_rows else [], pa.int64())
            for at in range(0, batch.num_rows, 512):
                part = batch.take(order[at : at + 512])
                ids, norm = part.column(0).to_pylist(), k1 * (1 - b + b * np.asarray(part.column(1)) / self.average)
                for start, asked, terms, values, weights in slices:
                    row, place, tf = index.matched(part, values)
                    x = np.zeros((len(ids), len(terms)))
                    x[row, place] = weights[place] * tf * (k1 + 1) / (tf + norm[row])
                    if times is None or len(slices) > 1:
                        at_term = {t: i for i, t in enumerate(terms)}
                        times = np.zeros((len(terms), len(asked)))
                        for q, (_, ts) in enumerate(asked):
                            for t, c in ts.items():
                                if t in at_term:
                                    times[at_term[t], q] = c
                    best.take(np.round(x @ times, self.digits), ids, start)
        yield best_rows(best, [q for q, _ in self.asked], self.kinds, self.names)


def best_rows(best: _Best, queries: list, kinds: tuple, names: list[str]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    sizes = [len(x) for x in best.ids]
    return pa.RecordBatch.from_arrays([
        pa.array([q for q, n in zip(queries, sizes) for _ in range(n)], to_arrow_type(kinds[0])), pa.array([i for x in best.ids for i in x], to_arrow_type(kinds[1])),
        pa.array(np.concatenate([np.empty(0), *best.scores])),
    ], names=names)


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def finite(vector: Column) -> Column:
    """The vector in doubles; null if a component is null, infinite or no number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), vector.cast("array<double>"))


def vectors(queries: DataFrame, data: DataFrame, k: int, query_id: str = "query_id", id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6, same_id: bool = False) -> DataFrame:
    """-> (query, rank, id, score): exact cosine top k. A query meets vectors of its own length, and, unless same_id, no row of
    its own id; a vector of zeros scores 0; vectors that are null or hold null or non-finite components take no part.

    Queries travel in blocks; each task multiplies its vectors with them and hands on its k best for each query.
    """
    kinds, found = dict(data.dtypes) | dict(queries.dtypes), None
    types, names = (queries.schema[query_id].dataType, data.schema[id_col].dataType), [query_id, id_col, "score"]
    rows = data.select(id_col, finite(F.col(vector_col)).alias("_v")).filter("_v is not null")
    for block in _blocks(queries.select(query_id, finite(F.col(vector_col)).alias("_v")).filter("_v is not null"), query_id, MOST_QUERIES, F.size("_v") * 8):
        by_length: dict[int, list] = {}
        for q, v in sorted(((r[query_id], r["_v"]) for r in block.collect()), key=lambda x: x[0]):
            by_length.setdefault(len(v), []).append((q, v))

        def run(batches: Iterator[pa.RecordBatch], asked=by_length) -> Iterator[pa.RecordBatch]:
            held = {d: (_units(np.array([v for _, v in part]).reshape(len(part), d)), [q for q, _ in part], _Best(len(part), k)) for d, part in asked.items()}
            for batch in batches:
                sizes = np.diff(np.asarray(batch.column(1).offsets)) if batch.num_rows else np.empty(0, int)
                for d in set(sizes.tolist()) & set(held):
                    unit_q, ids_q, best = held[d]
                    part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                    ids = part.column(0).to_pylist()
                    order = sorted(range(len(ids)), key=ids.__getitem__)
                    x = _units(np.asarray(part.column(1).flatten(), np.float64).reshape(len(ids), d))[order]
                    ids = [ids[i] for i in order]
                    step = max(1, MOST_CELLS // max(1, len(ids)))
                    for at in range(0, len(ids_q), step):
                        scores = np.round(x @ unit_q[at : at + step].T, digits)
                        if not same_id:
                            place = {q: i for i, q in enumerate(ids_q[at : at + step])}
                            for r, own in enumerate(ids):
                                if own in place:
                                    scores[r, place[own]] = -np.inf
                        best.take(scores, ids, at)
            for unit_q, ids_q, best in held.values():
                for i, s in enumerate(best.scores):
                    keep = s > -np.inf
                    best.scores[i], best.ids[i] = s[keep], [x for x, ok in zip(best.ids[i], keep) if ok]
                yield best_rows(best, ids_q, types, names)

        part = rows.mapInArrow(run, f"`{query_id}` {kinds[query_id]}, `{id_col}` {kinds[id_col]}, score double")
        found = part if found is None else found.unionByName(part)
    return ranked(found, k, query_id, id_col)


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


def fuse(lists: list[DataFrame], k: int, query_id: str = "query_id", id_col: str = "doc_id", constant: int = fixed.RRF_K, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, rank from 1, id), each cut at 4 k."""
    all_ = None
    for one in lists:
        part = one.filter(F.col("rank") <= 4 * k).select(query_id, id_col, (1.0 / (F.lit(constant) + F.col("rank"))).alias("s"))
        all_ = part if all_ is None else all_.unionByName(part)
    fused = all_.groupBy(query_id, id_col).agg(F.round(F.sum("s"), digits).alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_id, "rank", id_col, "score")


def word_overlap(queries: DataFrame, docs: DataFrame, k: int, words, query_id: str = "query_id", query_text: str = "query", id_col: str = "doc_id", text_col: str = "text", recency: str | None = None) -> DataFrame:
    """-> (query, rank, id, score): distinct words in common, ties to the latest, then to the smaller id. Without any none."""
    q = queries.select(query_id, F.explode(F.array_distinct(words(F.col(query_text)))).alias("w"))
    extra = [recency] if recency else []
    d = docs.select(id_col, *extra, F.explode(F.array_distinct(words(F.col(text_col)))).alias("w"))
    scored = d.join(q, "w").groupBy(query_id, id_col, *extra).agg(F.count("*").alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), *[F.desc(c) for c in extra], id_col)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_id, "rank", id_col, "score")


def lexical_overlap(a: Column, b: Column) -> Column:
    """Share of b's distinct words that a has; 0 if b has none."""
    own = F.array_distinct(b)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(a, own)) / F.size(own)).otherwise(F.lit(0.0))


def holders(queries: DataFrame, docs: DataFrame, query_id: str = "query_id", query_text: str = "query", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (query, id): the documents that contain each query's text. Queries travel in blocks; a task reads each of its texts
    once for all of them, by an automaton where one is installed."""
    kinds, types, found = dict(docs.dtypes) | dict(queries.dtypes), (queries.schema[query_id].dataType, docs.schema[id_col].dataType), None
    for block in _blocks(queries.select(query_id, query_text).filter(F.col(query_text).isNotNull()), query_id, MOST_QUERIES, F.octet_length(query_text)):
        by_text: dict[str, list] = {}
        for r in block.collect():
            by_text.setdefault(r[query_text], []).append(r[query_id])

        def run(batches: Iterator[pa.RecordBatch], wanted=by_text) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            within = _finder(list(wanted))
            for batch in batches:
                pairs = [(q, ident) for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)) if text.is_valid for t in within(text.as_py()) for q in wanted[t]]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], to_arrow_type(types[i])) for i in (0, 1)], names=[query_id, id_col])

        part = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{query_id}` {kinds[query_id]}, `{id_col}` {kinds[id_col]}")
        found = part if found is None else found.unionByName(part)
    return found


def _finder(texts: list[str]):
    """text -> which of the texts it contains."""
    always, rest = [t for t in texts if not t], [t for t in texts if t]
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [*always, *(t for t in rest if t in text)]
    automaton = ahocorasick.Automaton()
    for t in rest:
        automaton.add_word(t, t)
    if not rest:
        return lambda text: always
    automaton.make_automaton()
    return lambda text: [*always, *{t for _, t in automaton.iter(text)}]


def self_at(hits: DataFrame, truth: DataFrame, ks: list[int], query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """-> one row (queries, self_at_k...): share of queries with a true document among the k best.

    truth: (query, id), possibly several; queries without one don't count.
    """
    asked = truth.select(query_id).distinct()
    best = hits.join(truth, [query_id, id_col], "left_semi").groupBy(query_id).agg(F.min("rank").alias("r"))
    found = asked.join(best, query_id, "left")
    return found.agg(F.count("*").alias("queries"), *[F.avg((F.coalesce("r", F.lit(1 << 30)) <= k).cast("double")).alias(f"self_at_{k}") for k in ks])


def same_kind_at(hits: DataFrame, kinds: DataFrame, k: int, query_id: str = "query_id", id_col: str = "vec_id", kind: str = "label") -> DataFrame:
    """-> (query, same, any_same): how many of the k best share the query's kind."""
    named = hits.filter(F.col("rank") <= k).join(kinds.select(F.col(id_col), F.col(kind).alias("_k")), id_col)
    both = named.join(kinds.select(F.col(id_col).alias(query_id), F.col(kind).alias("_q")), query_id)
    return both.groupBy(query_id).agg(F.count_if(F.col("_k") == F.col("_q")).alias("same")).withColumn("any_same", F.col("same") > 0)


def candidates(queries: DataFrame, rules: DataFrame, k: int = 5, common: str = "(공통", embedded: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Delegation rows for (query_id, dept, query), with statistics of each department's own pool -> (query_id, rank, rid, score).

    rules: (rid, sheet, group, item, amount_min, amount_max); rows with amounts are left out; a pool is the department's
    sheet and the common sheets. embedded: (query_id, embedding) and (rid, embedding); with it the score fuses both ranked lists.
    """
    texts = rules.filter("amount_min is null and amount_max is null").select("rid", "sheet", F.concat_ws(" ", "group", "item").alias("text"))
    depth = 4 * k if embedded is not None else k
    held = index.small_rows(texts, "text")
    if held is None:
        hits = _pooled(queries, texts, depth, common)
    else:
        rows = sorted((r["rid"], r["sheet"], r["text"]) for r in held)
        sheets = {sheet for _, sheet, _ in rows if not sheet.startswith(common)}

        # departments without a sheet share the pool of the common ones
        rows_of = lambda own: [(rid, text) for rid, sheet, text in rows if sheet == own or sheet.startswith(common)]
        hits = index.search_pools(queries, lambda dept: dept if dept in sheets else None, rows_of, depth, dict(rules.dtypes)["rid"])
    if embedded is None:
        return hits
    asked, known = embedded
    rows = _shared_key(known.select("rid", finite(F.col("embedding")).alias("v")).filter("v is not null").join(texts.select("rid", "sheet"), "rid"), common)
    near = asked.select("query_id", unit(finite(F.col("embedding"))).alias("q")).filter("q is not null").join(queries.select("query_id", "dept"), "query_id")
    pairs = near.withColumn("_key", _own_and_shared("dept")).join(rows.drop("sheet"), "_key").filter(F.size("q") == F.size("v"))
    scored = pairs.select("query_id", "rid", F.round(dot(F.col("q"), unit(F.col("v"))), 6).alias("score"))
    return fuse([hits, ranked(scored, depth, "query_id", "rid")], k, id_col="rid")


def _own_and_shared(dept: str) -> Column:
    """The keys of a department's pool: its own sheet, and the common ones as one."""
    return F.explode(F.array(F.concat(F.lit("="), dept), F.lit("*")))


def _shared_key(rows: DataFrame, common: str) -> DataFrame:
    return rows.withColumn("_key", F.when(F.col("sheet").startswith(common), "*").otherwise(F.concat(F.lit("="), "sheet")))


def _pooled(queries: DataFrame, texts: DataFrame, k: int, common: str) -> DataFrame:
    """candidates() for tables that are too large to travel: postings joined by pool and term."""
    pooled = queries.select("dept").distinct().withColumn("_key", _own_and_shared("dept")).join(_shared_key(texts, common), "_key").select("dept", "rid", "text")
    posts = postings(pooled, "rid", "text", pool=["dept"])
    sizes = pooled.select("dept", F.size(tokenize(F.col("text"))).alias("dl")).groupBy("dept").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    weights = idf(posts, sizes, ["dept"])
    asked = queries.select("query_id", "dept", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "dept", "term").agg(F.count("*").alias("qtf"))
    norm = F.lit(fixed.BM25_K1) * (F.lit(1 - fixed.BM25_B) + F.lit(fixed.BM25_B) * F.col("dl") / F.col("avgdl"))
    score = F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (fixed.BM25_K1 + 1) / (F.col("tf") + norm))
    scored = asked.join(weights, ["dept", "term"]).join(posts, ["dept", "term"]).groupBy("query_id", "dept", "rid").agg(F.round(score, 6).alias("score"))
    every = queries.select("query_id", "dept").join(pooled.select("dept", "rid"), "dept").join(scored, ["query_id", "dept", "rid"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rid")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "rid", "score")


def item_chunks(items: DataFrame, least: int = 300, most: int = 4_000) -> DataFrame:
    """items(item_id, source, kind, body) -> (chunk_id, doc_id, org, doc_type, text): one chunk an item, short bodies left out, long ones cut."""
    kept = items.filter(F.length("body") >= least)
    return kept.select(F.col("item_id").alias("chunk_id"), F.col("item_id").alias("doc_id"), F.col("source").alias("org"), F.col("kind").alias("doc_type"), F.substring("body", 1, most).alias("text"))


def filtered_hits(hits: DataFrame, keep: Column, k: int, query_id: str = "query_id") -> DataFrame:
    """Of ranked hits, fetched deeper than needed, the first k that `keep` holds for, ranked anew."""
    w = Window.partitionBy(query_id).orderBy("rank")
    return hits.filter(keep).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cut_then_filter(hits: DataFrame, keep: Column, first: int, k: int, query_id: str = "query_id") -> DataFrame:
    """The variant that cuts to the first hits before it filters, and so may return fewer than k."""
    return filtered_hits(hits.filter(F.col("rank") <= first), keep, k, query_id)


def draft_search_scores(hits: DataFrame, org: str = "org", doc_type: str = "doc_type", target_org: str = "target_org", target_type: str = "target_type", query_id: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Hits with their own and the target's organisation and type -> (query, same_org_at_3, same_type_at_3, distinct_docs_at_5)."""
    top3 = F.col("rank") <= 3
    return hits.filter("rank <= 5").groupBy(query_id).agg(
        F.count_if(top3 & (F.col(org) == F.col(target_org))).alias("same_org_at_3"), F.coalesce(F.max(top3 & (F.col(doc_type) == F.col(target_type))), F.lit(False)).alias("same_type_at_3"),
        F.count_distinct(doc).alias("distinct_docs_at_5"),
    )


def candidate_recall(gold: DataFrame, hits: DataFrame, key: str = "query_id", rids: str = "rids", rid: str = "rid") -> DataFrame:
    """gold(key, rids), hits(key, rank, rid) -> one row (labelled, candidate_recall, pick_correct): rows without a true id don't count."""
    found = hits.groupBy(key).agg(F.collect_set(rid).alias("c"), F.min_by(rid, "rank").alias("top"))
    labelled = gold.filter(F.size(rids) > 0).join(found, key)
    return labelled.agg(F.count("*").alias("labelled"), F.count_if(F.arrays_overlap(rids, "c")).alias("candidate_recall"), F.count_if(F.array_contains(rids, F.col("top"))).alias("pick_correct"))


def route_by_duties(docs: DataFrame, teams: DataFrame, id_col: str = "doc_id", chars: int = 800) -> DataFrame:
    """docs(id, dept, title, body), teams(dept, ord, team, duties) -> (id, team, score): the department's team whose duties score
    best by BM25 among the department's own; the first on ties, so every document of a department with teams gets one.

    Teams are an organisation's chart: their duties travel to the documents' tasks. A chart that is too large for it is refused.
    """
    held = index.small_rows(teams.select("dept", "ord", "team", F.coalesce("duties", F.lit("")).alias("duties")), "duties")
    if held is None:
        raise ValueError(f"more than {index.MOST_POOL_ROWS} teams, or {index.MOST_POOL_CHARS} characters of duties: route by parts of the chart")
    by_dept: dict = {}
    for r in sorted(held, key=lambda r: r["ord"]):
        by_dept.setdefault(r["dept"], []).append((r["team"], r["duties"]))
    asked = docs.select(F.col(id_col).alias("query_id"), "dept", F.concat("title", F.lit(" "), F.substring("body", 1, chars)).alias("query"))
    hits = index.search_pools(asked, lambda dept: dept, lambda dept: by_dept.get(dept, []), 1, "string", id_col="team")
    return hits.select(F.col("query_id").alias(id_col), "team", "score")


def make_retriever(chunks_: DataFrame, embedded: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "text"):
    """The search that fits what there is: BM25, or, with embeddings (id, embedding), its fusion with vectors.

    -> search(queries (query_id, query[, embedding]), k).
    """

    def search(queries: DataFrame, k: int) -> DataFrame:
        by_words = bm25(queries, chunks_, 4 * k if embedded is not None else k, id_col=id_col, text_col=text_col)
        if embedded is None:
            return by_words
        return fuse([by_words, vectors(queries, embedded, 4 * k, id_col=id_col, same_id=True)], k, id_col=id_col)

    return search
