"""Sharding by bytes: Karmarkar-Karp differencing of groups that must not be divided.

Rows with equal texts are a group and share a shard; a group's size is its rows' bytes. Differencing keeps
partial partitions: at first one for each group, with all of its bytes in one part. The two whose parts lie furthest
apart (largest less smallest) become one, the fullest part of the one with the emptiest of the other, and so on,
until a single partition is left. Going back through these steps tells each group's shard.

At scale this is done in lots. Groups that hold more than one part in `fine` of a shard's mean are at most
shards * fine in number; the driver differences these alone, which gives the loads that they leave in each shard.
All other groups are dealt by a hash into lots of about `lot` groups, and each lot is differenced by one task together
with one partial partition more: those loads, scaled to the lot's share of the bytes. As it has the largest spread, the
lot's groups fill its valleys, so that a group larger than a shard's mean gets no company and the rest is even. A lot's
remaining spread is about that of its smallest groups; over many lots these add up as a random walk does, while shards
grow in proportion.

The shards of the groups come back to the rows by a join on the text's digest, in which a group of very many
rows is dealt over tasks; slots count through each shard by id in a running sum over ranges, so no task holds a shard.

Defined cases: a null text has no bytes and is in one group with empty ones (checksum 0); texts of any length count
whole; rows that repeat are rows of their own, beside each other; ties of sizes go by the text's digest, so that reruns and
retried tasks agree; rows without an id come last in their shard; fewer groups than shards leave shards empty; an empty
table gives an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import HOT_KEYS, HOT_ROWS, free_name, running, spread_join, stable

SHARDS = 40
#: Bytes that each row takes besides its text.
EXTRA = 16
#: Groups over one part in so many of a shard's mean are large: at most SHARDS * FINE.
FINE = 64
#: Groups in a lot, about.
LOT = 4_096


def differenced(sizes: list[int], parts: int, loads: list[int] | None = None, turn: int = 0) -> np.ndarray:
    """The part of each size. loads: what the parts hold already; turn: which of equally loaded parts comes first.

    A partial partition is its parts' loads, fullest first, less the least of them, and how it was made.
    """
    held = np.array(loads or [0] * parts, np.int64)
    first = np.lexsort(((np.arange(parts) + turn) % parts, -held))
    start = held[first] - held.min()
    made: list[tuple[int, int, np.ndarray]] = []  # for partitions from len(sizes) + 1 on: the two it came from, and its order
    queue: list[tuple[int, int, np.ndarray | None]] = [(-int(s), i, None) for i, s in enumerate(sizes)]
    queue.append((-int(start[0]), len(sizes), start))
    heapq.heapify(queue)

    def full(spread: int, load: np.ndarray | None) -> np.ndarray:
        if load is None:
            load = np.zeros(parts, np.int64)
            load[0] = -spread
        return load

    while len(queue) > 1:
        wide, a, x = heapq.heappop(queue)
        narrow, b, y = heapq.heappop(queue)
        load = full(wide, x) + full(narrow, y)[::-1]
        order = np.argsort(-load, kind="stable")
        load = load[order] - load[order[-1]]
        heapq.heappush(queue, (-int(load[0]), len(sizes) + 1 + len(made), load))
        made.append((a, b, order))
    # back through the steps: which parts of the last partition those of its origins have become
    became: dict[int, np.ndarray] = {queue[0][1]: np.arange(parts)}
    for step in range(len(made) - 1, -1, -1):
        a, b, order = made[step]
        last = became.pop(len(sizes) + 1 + step)
        of_a = np.empty(parts, np.int64)
        of_a[order] = last
        became[a], became[b] = of_a, of_a[::-1]
    named = np.empty(parts, np.int64)
    named[became[len(sizes)]] = first
    return np.array([named[became[i][0]] for i in range(len(sizes))], np.int64)


def _measured(text: Column) -> list[Column]:
    """The text's digest, bytes and checksum."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return [F.unhex(F.md5(raw)).alias("key"), F.octet_length(raw).cast("long").alias("bytes"), F.crc32(raw).alias("crc")]


def assigned(groups: DataFrame, shards: int = SHARDS, fine: int = FINE, lot: int = LOT) -> DataFrame:
    """groups(key, bytes), one row for each group -> (key, shard)."""
    spark = groups.sparkSession
    total = int(groups.agg(F.sum(F.col("bytes").cast("decimal(38,0)"))).first()[0] or 0)
    is_large = F.col("bytes").cast("decimal(38,0)") * F.lit(shards * fine) > F.lit(total).cast("decimal(38,0)")
    # fewer than shards * fine of them, as each holds more than that part of the total
    large = sorted(groups.filter(is_large).select("bytes", "key").collect(), key=lambda r: (-r["bytes"], r["key"]))
    places = differenced([r["bytes"] for r in large], shards)
    loads = [0] * shards
    for r, shard in zip(large, places, strict=True):
        loads[shard] += r["bytes"]
    found = spark.createDataFrame([(r["key"], int(s)) for r, s in zip(large, places, strict=True)], "key binary, shard int")
    small = groups.filter(~is_large)
    n, left = small.count(), total - sum(loads)
    if not n:
        return found
    lots = -(-n // lot)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["bytes"].tolist(), pdf["key"].tolist(), strict=True), key=lambda r: (-r[0], r[1]))
        share = sum(r[0] for r in rows)
        scaled = [x * share // left for x in loads]
        return pd.DataFrame({"key": [r[1] for r in rows], "shard": differenced([r[0] for r in rows], shards, scaled, int(pdf["lot"].iloc[0])).astype("int32")})

    dealt = small.select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(lots)).alias("lot"))
    return found.unionByName(dealt.repartition(max(8, min(20_000, lots)), "lot").groupBy("lot").applyInPandas(solve, "key binary, shard int"))


def sharded(docs: DataFrame, shards: int = SHARDS, extra: int = EXTRA, fine: int = FINE, lot: int = LOT, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """-> the columns `keep` of docs (all, if not given) and a struct of size, text_crc32, shard and slot, the last
    column, named place or, where docs have such a column, with underscores behind."""
    kept = docs.columns if keep is None else keep
    into = free_name(kept, "place")
    quoted = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    rows = stable(docs.select(F.struct(*quoted).alias("kept"), F.col(f"`{id_col}`").alias("id"), *_measured(F.col(f"`{text_col}`"))))
    rows = rows.withColumn("size", F.col("bytes") + extra)
    groups = stable(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    hot = [r["key"] for r in groups.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key").collect()]
    placed = spread_join(rows, stable(assigned(groups, shards, fine, lot)), "key", "id", hot)
    told = running(placed, [F.col("shard"), F.col("id").asc_nulls_last(), F.col("key")])
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    starts = [sum(counts.get(s, 0) for s in range(shard)) for shard in range(shards)]
    slot = F.col("_place") - F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("shard") + 1)
    place = F.struct("size", F.col("crc").alias("text_crc32"), "shard", slot.alias("slot"))
    return told.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(kept)], place.alias(into))


def write(docs: DataFrame, path: str, shards: int = SHARDS, **more) -> None:
    """Writes docs as Parquet, a folder shard=N for each shard; the rows have their slot."""
    placed = sharded(docs, shards, **more)
    place = placed.columns[-1]
    slot = free_name([*docs.columns, "shard"], "slot")
    out = placed.select(*[F.col(f"`{c}`") for c in placed.columns[:-1] if c != "shard"], F.col(f"`{place}`.slot").alias(slot), F.col(f"`{place}`.shard").alias("shard"))
    out.sortWithinPartitions("shard", slot).write.partitionBy("shard").parquet(path)
