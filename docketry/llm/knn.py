"""Exact top-k search by inner product: a Voronoi kNN join.

Pivots are drawn from the data; queries and data are grouped by their nearest pivot. From one summary
for each group (its size, its largest distance to the pivot) follow, for every pair of a query group
and a data cell, a largest and a smallest possible score: q.x lies within p.c +- (R|c| + r|p| + R r)
for pivots p, c and radii R, r. The smallest scores of enough cells to hold k + 1 vectors give a score that
every query of the group surely reaches; cells that cannot reach it are left out. Each query is first
solved in the most promising cell that is left. Its k-th best score there, or the group's if that is higher,
is then held against q.c + |q| R of each other cell, and only cells that can reach it are asked. So only the
queries, the smaller side, are replicated, and only to blocks that may matter.

A cell is dealt into slices of about `block` rows, and so are the queries that ask it; a slice of each is one
task's work, solved by itself with numpy, so memory is bounded by two slices whatever the number of queries,
and a vector that a third of the rows share is spread over tasks. The k best of each block meet in one
ranking by query. Vectors are made of integers floor(scale * x); scores are exact.

The LENGTHS most frequent vector lengths get pivots of their own. All further lengths are solved together,
in slices by length, without bounds.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; a query
meets only vectors of its own length; empty vectors score 0; ties go to the smaller id; repeated ids
count as rows of their own, but a query never meets a row with its own id; queries that repeat in id and
vector are one, those that share an id alone are ranked apart; scores beyond 64 bits are given as the
largest or smallest long; fewer than k candidates: all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docketry.llm.common import hot_keys, spread_join, stable

K = 10
SCALE = 1024
PIVOTS = 48
#: More pivots are drawn from larger tables, up to so many: their summaries and products stand on the driver.
MOST_PIVOTS = 512
#: Vector lengths that get pivots of their own.
LENGTHS = 4
#: Data rows, and queries, in a block, about; and queries that are multiplied with it at once.
BLOCK = 4_096
QUERIES = 1_024
#: Sums of products below this are exact in double precision.
_EXACT = float(1 << 53)


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) as doubles, or null for vectors that take no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v) -> (id, v, cell, dist): nearest pivot; vectors of another length get cell -1."""
    with np.errstate(all="ignore"):
        squares = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(1).offsets)) if batch.num_rows else np.empty(0, int)
            cell, dist = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, np.inf)
            same = np.flatnonzero(sizes == pivots.shape[1])
            if len(same) and pivots.shape[1]:
                x = _matrix(batch.column(1).take(pa.array(same)), len(same))
                with np.errstate(all="ignore"):
                    d = np.maximum(squares[None, :] - 2 * (x @ pivots.T) + (x**2).sum(axis=1)[:, None], 0)
                d[np.isnan(d)] = np.inf
                cell[same] = d.argmin(axis=1)
                dist[same] = np.sqrt(d.min(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(dist)], names=["id", "v", "cell", "dist"])

    return rows.mapInArrow(run, "id long, v array<double>, cell int, dist double")


def needed(pivots: np.ndarray, sizes: np.ndarray, reach: np.ndarray, asks: np.ndarray, width: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(query group, data cell) pairs that may hold one of the k best of a query of the group.

    sizes and reach: rows and largest distance by data cell; asks and width: the same of the queries.
    """
    with np.errstate(all="ignore"):
        return _needed(pivots, sizes, reach, asks, width, k)


def _needed(pivots: np.ndarray, sizes: np.ndarray, reach: np.ndarray, asks: np.ndarray, width: np.ndarray, k: int) -> list[tuple[int, int]]:
    norm = np.sqrt((pivots**2).sum(axis=1))
    middle = pivots @ pivots.T
    slack = width[:, None] * norm[None, :] + norm[:, None] * reach[None, :] + width[:, None] * reach[None, :]
    slack = slack * (1 + 1e-9) + 1e-9 * np.abs(middle) + 1e-6  # rounding of the distances
    out = []
    for g in np.flatnonzero(asks):
        low, high = middle[g] - slack[g], middle[g] + slack[g]
        low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
        sure, held = -np.inf, 0
        for c in np.argsort(-low, kind="stable"):
            held += sizes[c]
            if held >= k + 1:  # one of them may be the query itself
                sure = low[c]
                break
        out += [(int(g), int(c)) for c in np.flatnonzero((sizes > 0) & (high >= sure))]
    return out


def _products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    width = max(1, data.shape[1])
    bound = (np.abs(queries).max(initial=0) * np.abs(data).max(initial=0)) * width
    if bound < _EXACT:
        return (queries @ data.T).astype(np.int64)
    if bound < float(1 << 62):
        return queries.astype(np.int64) @ data.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    least, most = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
    return np.clip(np.dot(whole(queries), whole(data).T), least, most).astype(np.int64)


def _best(queries: np.ndarray, ids_q: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries, ids and scores of their k best rows of data."""
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    scores = _products(queries, data)
    least = np.iinfo(np.int64).min
    scores[ids_q[:, None] == ids[None, :]] = least
    take = min(k, scores.shape[1])
    # ties at the edge: of equal scores the first ids stay
    at = scores.shape[1] - take
    edge = np.partition(scores, at, axis=1)[:, at]
    rows, cols, got = [], [], []
    for i in range(len(scores)):
        above = np.flatnonzero(scores[i] >= max(edge[i], least + 1))
        above = above[np.argsort(-scores[i, above], kind="stable")][:take]
        rows.append(np.full(len(above), i)), cols.append(ids[above]), got.append(scores[i, above])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(got)


_FOUND = "query_id long, twin long, id long, score long"


def _solved(own: DataFrame, asking: DataFrame, keys: list[str], k: int, parts: int) -> DataFrame:
    """own(*keys, id, v), asking(*keys, id, twin, v) -> the k best rows of each block for each query of it."""
    dealt = own.select(*keys, "id", "v", F.lit(0).cast("long").alias("twin"), F.lit(False).alias("asks")).unionByName(asking.select(*keys, "id", "v", "twin", F.lit(True).alias("asks")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["asks"].to_numpy()
        q, x = pdf[ask], pdf[~ask]
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "twin": [], "id": [], "score": []}).astype("int64")
        stack = lambda d: np.stack(d["v"].to_numpy()).astype(np.float64).reshape(len(d), -1)
        data, ids, found = stack(x), x["id"].to_numpy(), []
        for at in range(0, len(q), QUERIES):
            part = q.iloc[at : at + QUERIES]
            i, got, score = _best(stack(part), part["id"].to_numpy(), data, ids, k)
            found.append(pd.DataFrame({"query_id": part["id"].to_numpy()[i], "twin": part["twin"].to_numpy()[i], "id": got, "score": score}))
        return pd.concat(found)

    return dealt.repartition(parts, *keys).groupBy(*keys).applyInPandas(solve, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(data: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, lengths: int = LENGTHS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """-> (query_id, rank, id, score): the k highest integer inner products of each query's row. is_query may use the columns id and v."""
    rows = data.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v")).filter("id is not null and v is not null")
    often = [(r["d"], r["n"]) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(lengths + 1).collect()]
    found = data.sparkSession.createDataFrame([], _FOUND)
    for d, n in often[:lengths]:
        part = rows.filter(F.size("v") == d)
        found = found.unionByName(_same_length(part, is_query, k, max(pivots, min(MOST_PIVOTS, int(n**0.5) // 4)), block, d) if d else _other_lengths(part, is_query, k, block))
    if len(often) > lengths:
        found = found.unionByName(_other_lengths(rows.filter(~F.size("v").isin([d for d, _ in often[:lengths]])), is_query, k, block))
    return _ranked(found, k).select("query_id", "rank", "id", "score")


def _asking(rows: DataFrame, is_query: Column) -> DataFrame:
    """The queries, each once: twin tells those apart that share an id."""
    return rows.withColumn("q", is_query).filter("q").withColumn("twin", F.xxhash64("v")).dropDuplicates(["id", "twin"])


def _other_lengths(rows: DataFrame, is_query: Column, k: int, block: int) -> DataFrame:
    rows = stable(rows.withColumn("d", F.size("v")))
    asked = stable(_asking(rows, is_query).select("id", "v", "twin", "d"))
    slices = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    cut = rows.groupBy("d").agg(F.count("*").alias("n")).join(asked.groupBy("d").agg(F.count("*").alias("nb")), "d")
    cut = stable(cut.select("d", "n", slices("n").alias("a"), slices("nb").alias("b")))
    hot = hot_keys(cut, "d")
    place = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = spread_join(rows, cut, "d", "id", hot).select("d", place("a").alias("s"), every("b").alias("t"), "id", "v")
    asking = spread_join(asked, cut, "d", "id", hot).select("d", every("a").alias("s"), place("b").alias("t"), "id", "v", "twin")
    return _solved(own, asking, ["d", "s", "t"], k, max(8, min(20_000, rows.count() // block)))


def _promise(pivots: np.ndarray, reach: np.ndarray, allowed: np.ndarray):
    """mapInArrow over queries (id, v, twin, cell) -> their most promising cell, the others and the largest score in each."""
    with np.errstate(all="ignore"):
        norm = np.sqrt((pivots**2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, others, tops = [], [], []
            if batch.num_rows:
                q = _matrix(batch.column(1), batch.num_rows)
                with np.errstate(all="ignore"):
                    middle, size = q @ pivots.T, np.sqrt((q**2).sum(axis=1))
                    top = middle + size[:, None] * reach[None, :]
                    top += 1e-9 * (np.abs(middle) + size[:, None] * (reach + norm)[None, :]) + 1e-6  # rounding
                top[np.isnan(top)], middle[np.isnan(middle)] = np.inf, -np.inf
                may = allowed[np.asarray(batch.column(3))]
                best = np.where(may, middle, -np.inf).argmax(axis=1)
                for i, first in enumerate(best):
                    rest = np.flatnonzero(may[i])
                    rest = rest[rest != first]
                    firsts.append(int(first)), others.append(rest.astype(np.int32)), tops.append(top[i, rest])
            made = [pa.array(firsts, pa.int32()), pa.array(others, pa.list_(pa.int32())), pa.array(tops, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["id", "v", "twin", "first", "others", "tops"])

    return run


def _same_length(rows: DataFrame, is_query: Column, k: int, pivots: int, block: int, dims: int) -> DataFrame:
    drawn = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(pivots).select("v").collect()
    centres = np.unique(np.array([r["v"] for r in drawn], np.float64).reshape(-1, dims), axis=0)
    placed = stable(_assign(rows, centres))
    n = len(centres)
    sizes, reach, asks, width = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
    summary = placed.withColumn("q", is_query).groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.count(F.when(F.col("q"), 1)).alias("nq"), F.max(F.when(F.col("q"), F.col("dist"))).alias("rq"))
    for r in summary.collect():
        c = r["cell"]
        sizes[c], reach[c], asks[c], width[c] = r["n"], r["r"], r["nq"], r["rq"] or 0
    allowed = np.zeros((n, n), bool)
    for g, c in needed(centres, sizes, reach, asks, width, k):
        allowed[g, c] = True
    asked = stable(_asking(placed, is_query).select("id", "v", "twin", "cell").mapInArrow(_promise(centres, reach, allowed), "id long, v array<double>, twin long, first int, others array<int>, tops array<double>"))
    slices = [max(1, -(-int(s) // block)) for s in sizes]
    of = lambda xs: F.element_at(F.array(*[F.lit(int(x)) for x in xs]), F.col("c") + 1)

    def solved(asking: DataFrame) -> DataFrame:
        """asking (id, v, twin, c) against cell c."""
        asking = stable(asking)
        turns = [0] * n
        for r in asking.groupBy("c").count().collect():
            turns[r["c"]] = -(-r["count"] // block)
        used = [c for c in range(n) if turns[c]]
        if not used:
            return asking.sparkSession.createDataFrame([], _FOUND)
        own = placed.withColumnRenamed("cell", "c").filter(F.col("c").isin(used)).select("c", F.pmod(F.xxhash64("id"), of(slices)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), of(turns) - 1)).alias("t"), "id", "v")
        to = asking.select("c", F.explode(F.sequence(F.lit(0), of(slices) - 1)).alias("s"), F.pmod(F.xxhash64("id", "twin"), of(turns)).cast("int").alias("t"), "id", "v", "twin")
        return _solved(own, to, ["c", "s", "t"], k, max(8, min(20_000, sum(slices[c] * turns[c] for c in used))))

    near = stable(_ranked(solved(asked.select("id", "v", "twin", F.col("first").alias("c"))), k))
    # the k-th best score so far; none if there are fewer
    sure = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "twin", F.col("score").cast("double").alias("sure"))
    open_ = asked.join(sure, ["id", "twin"], "left").select("id", "v", "twin", "sure", F.explode(F.arrays_zip(F.col("others").alias("c"), F.col("tops").alias("top"))).alias("o"))
    more = solved(open_.filter("sure is null or o.top >= sure").select("id", "v", "twin", "o.c"))
    return near.drop("rank").unionByName(more)
