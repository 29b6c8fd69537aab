"""Connected components over a table of edges, wholly distributed.

Alternates the large-star and small-star operations (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014), which need a number of rounds that is logarithmic in practice. Each
half round is one shuffle by vertex; every round is cut with checkpoint(), so that a lost executor costs one
round at most. A hub with very many neighbours is no task's work: its smallest neighbour is found by a
partial aggregate, and its edges stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import HOT_ROWS, hot_keys, stable


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _hubs(edges: DataFrame) -> list:
    """The vertices with the most neighbours, HOT_KEYS at most."""
    return hot_keys(_both(edges).groupBy("u").agg(F.count("*").alias("n")), "u")


def _with_least(edges: DataFrame, hubs: list) -> DataFrame:
    """Adds m, the smallest v of each u. Of hubs it is found by a partial aggregate, so that no task meets all their edges."""
    window = Window.partitionBy("u")
    if not hubs:
        return edges.withColumn("m", F.min("v").over(window))
    of_hub = F.col("u").isin(hubs)
    least = [x for r in edges.filter(of_hub).groupBy("u").agg(F.min("v").alias("m")).collect() for x in (F.lit(r["u"]), F.lit(r["m"]))]
    cold = edges.filter(~of_hub).withColumn("m", F.min("v").over(window))
    return cold.unionByName(edges.filter(of_hub).withColumn("m", F.create_map(*least)[F.col("u")])) if least else cold


def _large_star(edges: DataFrame, hubs: list) -> DataFrame:
    """Joins the larger neighbours of each vertex to its smallest neighbour, or to itself."""
    found = _with_least(_both(edges), hubs).filter("v > u")
    return found.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, hubs: list) -> DataFrame:
    """Joins the smaller neighbours of each vertex, and itself, to the smallest of them."""
    found = _with_least(edges, hubs)
    return found.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of any orderable type -> (u, label): label is the smallest vertex that u reaches.

    Only vertices with an edge to another vertex come out; self-edges and repeats are harmless. An
    empty table gives an empty table. Rows with a null end are left out.
    """
    edges = stable(edges.select("u", "v").filter("u <> v").distinct())
    before = _state(edges)
    if before[0]:
        for _ in range(max_rounds):
            # a vertex has many neighbours within a round only if it had before
            hubs = _hubs(edges) if before[0] > HOT_ROWS else []
            edges = stable(_small_star(_large_star(edges, hubs), hubs))
            after = _state(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("label"))
    return edges.select("u", F.col("v").alias("label")).unionByName(roots)
