"""SimHash near-dedup by tiled exact comparison.

Fingerprints are made map-side. Distinct fingerprints are dealt into tiles that hold one population
count each (and at most about `tile` members, by a hash); two tiles are compared only if their
population counts differ by no more than the radius, since each differing bit changes the count by
one. Within a pair of tiles the same bound on the two 32-bit halves leaves out more. What remains is
compared in full with numpy exclusive-or and bit counts, so the links are exact. A pair of tiles
hands on a spanning forest of its links, never all pairs, so a large group of near copies stays
linear in its size; the components are those of all links.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like
any other; repeated rows share their component; an empty table gives an empty result; the operator
uses only the id and text columns, so others may have any name.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cores, hot_keys, spread_join, stable
from docketry.llm.components import components

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Fingerprints in a tile, about; a pair of tiles is one unit of work of two arrays of 8 bytes each.
TILE = 16_384
_CHUNK = 1 << 15
#: Differing bits up to which fingerprints make candidates of near copies.
NEAR_RADIUS = 8
#: Bands of minima that make candidates of near copies beyond it.
BANDS = 24
#: Texts that candidates join, and their distinct shingles, up to which all of them are compared in one block.
CLUSTER = 4_096
CLUSTER_HASHES = 1 << 20
#: Texts in a slice of a larger cluster, about.
BLOCK = 512


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at the ASCII white space of the contract."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; fewer words: of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, SEED)], np.uint64)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[: len(words) - k]]
    return np.fromiter((h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        bits = np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > n)))


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, fp long): one row for each row of docs."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingle_hashes(words_of(t), shingle)) for t in (x.as_py() or b"" for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, steps: tuple[int, ...] = ()) -> list[tuple[int, int]]:
    """Links (index, index) that span the components of all pairs of a with b (b None: within a) at
    radius or fewer differing bits. Indices are into a followed by b. steps are smaller radii whose
    links come first, so that nearer pairs are preferred."""
    own = b is None
    other, shift = (a, 0) if own else (b, len(a))
    label = np.arange(len(a) + (0 if own else len(b)))
    low = np.uint64(0xFFFFFFFF)
    la, lb = np.bitwise_count(a & low).astype(int), np.bitwise_count(other & low).astype(int)
    ha, hb = np.bitwise_count(a >> np.uint64(32)).astype(int), np.bitwise_count(other >> np.uint64(32)).astype(int)
    key_a, key_b = la * 64 + ha, lb * 64 + hb
    order_b = np.argsort(key_b, kind="stable")
    kinds_b, first_b = np.unique(key_b[order_b], return_index=True)
    ends_b = np.append(first_b[1:], len(order_b))
    links: list[tuple[int, int]] = []
    for within in (*steps, radius):
        for kind in np.unique(key_a):
            near = np.abs(kinds_b // 64 - kind // 64) + np.abs(kinds_b % 64 - kind % 64) <= within
            if own:
                near &= kinds_b >= kind
            if not near.any():
                continue
            ia = np.flatnonzero(key_a == kind)
            ib = np.concatenate([order_b[s:e] for s, e in zip(first_b[near], ends_b[near])])
            vb = other[ib]
            step = max(1, _CHUNK // len(ib))
            for at in range(0, len(ia), step):
                rows = ia[at : at + step]
                hit = np.bitwise_count(a[rows][:, None] ^ vb[None, :]) <= within
                if hit.any():
                    i, j = np.nonzero(hit)
                    _join(label, rows[i], ib[j] + shift, links)
    return links


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray, links: list[tuple[int, int]]) -> None:
    """Adds a link for each pair (i, j) that joins two components as yet apart."""
    while True:
        apart = label[i] != label[j]
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        x, y = label[i[0]], label[j[0]]
        links.append((int(i[0]), int(j[0])))
        label[label == max(x, y)] = min(x, y)


def near_links(reps: DataFrame, radius: int = RADIUS, tile: int = TILE, steps: tuple[int, ...] = ()) -> DataFrame:
    """reps(fp) of distinct fingerprints -> (u, v): spanning links at radius or fewer differing bits.

    The driver gets the 65 counts of fingerprints for each population count, nothing else.
    """
    spark = reps.sparkSession
    level = F.bit_count("fp")
    got = {r["p"]: r["n"] for r in reps.groupBy(level.alias("p")).agg(F.count("*").alias("n")).collect()}
    tiles_of = [-(-got.get(p, 0) // tile) for p in range(65)]
    first = [sum(tiles_of[:p]) for p in range(66)]
    last = [first[min(65, p + radius + 1)] - 1 for p in range(65)]
    start = [first[max(0, p - radius)] for p in range(65)]
    pick = lambda xs: F.element_at(F.array(*[F.lit(int(x)) for x in xs]), level.cast("int") + 1)
    dealt = reps.select(
        "fp", pick(last).alias("last"), pick(start).alias("start"),
        (pick(first[:65]) + F.pmod(F.xxhash64("fp"), F.greatest(pick(tiles_of), F.lit(1))).cast("int")).alias("tile"),
    )
    tiles = stable(dealt.groupBy("tile", "last", "start").agg(F.collect_list("fp").alias("fps")))
    pairs = sum((last[p] - t + 1) for p in range(65) for t in range(first[p], first[p + 1]))
    parts = int(min(20_000, max(4 * cores(spark), pairs // 8)))
    left = tiles.select(F.col("tile").alias("t"), F.explode(F.sequence("tile", "last")).alias("w"), "fps", F.lit(0).alias("side"))
    right = tiles.select(F.explode(F.sequence("start", "tile")).alias("t"), F.col("tile").alias("w"), "fps", F.lit(1).alias("side"))
    members = left.unionByName(right.filter("t <> w")).repartition(parts, "t", "w")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [np.asarray(x, np.int64).view(np.uint64) for x in pdf.sort_values("side")["fps"]]
        both = np.concatenate(sides)
        links = np.array(forest(sides[0], sides[1] if len(sides) > 1 else None, radius, steps), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": both[links[:, 0]].view(np.int64), "v": both[links[:, 1]].view(np.int64)})

    return members.groupBy("t", "w").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, fp long, fingerprint of 16 hex digits, component_id): one row for each row of docs.

    component_id is the smallest id reachable over links, the document's own included.
    """
    fps = stable(with_fingerprints(docs, shingle, id_col, text_col))
    reps = stable(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    labels = components(near_links(reps.select("fp"), radius, tile)).select(F.col("u").alias("fp"), "label")
    labelled = reps.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = stable(labelled.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    of = spread_join(labelled.drop("n"), least, "label", "fp").select("fp", "component_id")
    return spread_join(fps, of, "fp", "doc_id", hot_keys(reps, "fp")).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, text) -> (id, hashes): the distinct shingle hashes, sorted."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(words_of(t), k).view(np.int64)) for t in (x.as_py() or b"" for x in part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "hashes"])

    return docs.mapInArrow(run, "id long, hashes array<long>")


def alike(a: list[np.ndarray], b: list[np.ndarray] | None, similarity: float, label: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (index, index) that span the components of all pairs of a with b (b None: within a) whose sets
    have a Jaccard similarity of `similarity` or more, and the component of each. Sets are sorted; indices are
    into a followed by b.

    label names the component that each is known to belong to. A pair is left untested only if links that
    hold join the two already, so a group of near copies costs about as many tests as it has members.
    """
    own = b is None
    other, shift = (a, 0) if own else (b, len(a))
    label = np.arange(len(a) + (0 if own else len(b))) if label is None else np.unique(label, return_inverse=True)[1]
    sizes = np.array([len(x) for x in other], np.int64)
    index: tuple[np.ndarray, np.ndarray] | None = None
    links: list[tuple[int, int]] = []
    for i, x in enumerate(a):
        apart = label[shift:] != label[i]
        if own:
            apart[: i + 1] = False
        live = np.flatnonzero(apart)
        if not len(live):
            continue
        if 4 * len(live) < len(other):
            flat = np.concatenate([other[j] for j in live])
            at = np.minimum(np.searchsorted(x, flat), max(0, len(x) - 1))
            hit = x[at] == flat if len(x) else np.zeros(len(flat), bool)
            common = np.bincount(np.repeat(np.arange(len(live)), sizes[live])[hit], minlength=len(live))
        else:
            if index is None:
                flat, owner = np.concatenate([np.empty(0, np.int64), *other]), np.repeat(np.arange(len(other)), sizes)
                order = np.argsort(flat, kind="stable")
                index = flat[order], owner[order]
            start = np.searchsorted(index[0], x, "left")
            n = np.searchsorted(index[0], x, "right") - start
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(index[1][at], minlength=len(other))[live]
        j = live[common >= similarity * (len(x) + sizes[live] - common)]
        _join(label, np.full(len(j), i), j + shift, links)
    return links, label


def _grouped(rows: DataFrame, similarity: float, parts: int) -> DataFrame:
    """rows(g, cluster, id, hashes), whole clusters in each block g -> (id, label): the smallest id of each text's group."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("cluster", sort=False):
            _, label = alike([np.asarray(x, np.int64) for x in part["hashes"]], None, similarity)
            out.append(pd.DataFrame({"id": part["id"], "label": part["id"].groupby(label).transform("min")}))
        return pd.concat(out)

    return rows.repartition(parts, "g").groupBy("g").applyInPandas(solve, "id long, label long")


def _solved(rows: DataFrame, similarity: float, parts: int) -> DataFrame:
    """rows(g, i, j, key, side, id, label, hashes) -> (u, v): in each block (g, i, j), for each key, the links that
    span the pairs of side 0 with side 1 that hold."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ends: list[np.ndarray] = []
        for _, part in pdf.groupby("key", sort=False):
            sides = [part[part["side"] == k] for k in (0, 1)]
            if not len(sides[0]) or not len(sides[1]):
                continue
            sets = [[np.asarray(x, np.int64) for x in side["hashes"]] for side in sides]
            ids, label = (np.concatenate([side[c].to_numpy() for side in sides]) for c in ("id", "label"))
            ends.append(ids[np.array(alike(*sets, similarity, label)[0], np.int64).reshape(-1, 2)])
        out = np.concatenate(ends) if ends else np.empty((0, 2), np.int64)
        return pd.DataFrame({"u": out[:, 0], "v": out[:, 1]})

    return rows.repartition(parts, "g", "i", "j").groupBy("g", "i", "j").applyInPandas(solve, "u long, v long")


def _met(asks: DataFrame, members: DataFrame, sets, similarity: float, block: int) -> DataFrame:
    """asks, members (key, id, label) -> (u, v): under each key, every member of asks meets every member of members.

    Keys of few members share a block with others; of more, both sides are dealt into slices, and each pair of
    slices is a block.
    """
    spark = asks.sparkSession
    asks, members = stable(asks), stable(members)
    slices = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    cut = asks.groupBy("key").agg(F.count("*").alias("na")).join(members.groupBy("key").agg(F.count("*").alias("n")), "key")
    cut = stable(cut.select("key", "n", slices("na").alias("a"), slices("n").alias("m")))
    total, hot = members.count(), hot_keys(cut, "key")
    bins = max(1, -(-total // block))
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    g = F.when((F.col("a") == 1) & (F.col("m") == 1), F.struct(F.lit(0).alias("t"), F.pmod(F.xxhash64("key"), F.lit(bins)).alias("k"))).otherwise(F.struct(F.lit(1).alias("t"), F.col("key").alias("k")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = spread_join(asks, cut, "key", "id", hot).select(g.alias("g"), slot("a").alias("i"), every("m").alias("j"), "key", F.lit(0).alias("side"), "id", "label")
    right = spread_join(members, cut, "key", "id", hot).select(g.alias("g"), every("a").alias("i"), slot("m").alias("j"), "key", F.lit(1).alias("side"), "id", "label")
    placed = left.unionByName(right)
    return _solved(placed.join(sets(placed.select("id")), "id"), similarity, int(min(20_000, max(4 * cores(asks.sparkSession), bins))))


def held_groups(candidates: DataFrame, keyed: DataFrame, sized: DataFrame, picked: DataFrame, shingle: int, similarity: float, block: int = BLOCK, most: int = CLUSTER, weight: int = CLUSTER_HASHES) -> DataFrame:
    """candidates(u, v), keyed(key, id), sized(id, size: distinct shingles), picked(id, text) -> (id, label): the smallest id of the
    group of near copies, for each text that stands in a candidate.

    Candidates only say which texts to compare; a link is one whose exact similarity holds, and a candidate that
    fails never stands in for a pair that holds. Where candidates join up to `most` texts of `weight` shingles together,
    all pairs of these are compared, in one block. Of larger clusters, first each text meets its first candidate; then
    those outside the largest group that this makes meet all members of the cluster, or, if they are many themselves,
    the members of each of their keys. So each pair that shares a key is compared or is joined already, and a large
    group of near copies costs in proportion to its size.
    """
    sets = lambda ids: _sets(picked.join(ids.select("id").distinct(), "id", "left_semi"), shingle)
    clusters = stable(components(candidates).withColumnRenamed("u", "id").join(sized, "id"))
    size = stable(clusters.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("w")).withColumn("fits", (F.col("n") <= most) & (F.col("w") <= weight)))
    clusters = clusters.drop("size")
    total = size.filter("fits").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    parts = int(min(20_000, max(4 * cores(candidates.sparkSession), total // (weight // 4))))
    # small clusters share blocks
    small = clusters.join(size.filter("fits").select("label"), "label").select(F.pmod(F.xxhash64("label"), F.lit(parts)).alias("g"), F.col("label").alias("cluster"), "id")
    found = _grouped(small.join(sets(small), "id"), similarity, parts)
    if size.filter("not fits").isEmpty():
        return found
    large = stable(spread_join(clusters, size.filter("not fits").select("label", "n"), "label", "id").select("id", F.col("label").alias("cluster")))
    first = stable(candidates.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("key")).join(large.select("id"), "id", "left_semi"))
    hubs = first.select("key", F.col("key").alias("id"), F.col("key").alias("label")).distinct()
    firm = stable(_met(hubs, first.select("key", "id", F.col("id").alias("label")), sets, similarity, block))
    joined = stable(large.join(components(firm).withColumnRenamed("u", "id"), "id", "left").select("id", "cluster", F.coalesce("label", "id").alias("label")))
    # by clusters whose texts outside the largest group are few slices; else by the keys
    whole = _open_groups(joined.withColumnRenamed("cluster", "key")).withColumn("few", F.col("n") - F.col("largest") <= F.lit(BANDS * block))
    by_cluster = whole.filter("few").select("key", "most", "n")
    keyed = keyed.join(joined.join(whole.filter("not few").select(F.col("key").alias("cluster")), "cluster").select("id", "label"), "id")
    by_key = _open_groups(stable(keyed)).groupBy("x", "n").agg(F.min(F.struct("key", "most")).alias("k")).select("k.*", "n")  # keys with the same members are one
    for rows, groups in ((joined.select(F.col("cluster").alias("key"), "id", "label"), stable(by_cluster)), (keyed, stable(by_key))):
        if not groups.isEmpty():
            members = stable(spread_join(rows, groups, "key", "id").drop("n"))
            firm = firm.unionByName(_met(members.filter("label <> most").drop("most"), members.drop("most"), sets, similarity, block))
    return found.unionByName(components(firm).select(F.col("u").alias("id"), "label"))


def _open_groups(rows: DataFrame) -> DataFrame:
    """rows(key, id, label) -> (key, n, x, most, largest) of the keys with several labels: x tells the members, most is the label of the largest part."""
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"))
    groups = by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.max(F.struct("n", -F.col("label"))).alias("m"))
    return groups.filter("labels > 1").select("key", "n", "x", (-F.col("m.col2")).alias("most"), F.col("m.n").alias("largest"))


def signature_rows(similarity: float) -> int:
    """Minima in a band: as many as leave a pair at the similarity a chance of some 0.4 or more to share one."""
    return max(1, int(math.log(0.4) / math.log(similarity))) if 0 < similarity < 1 else 1


def band_keys(hashes: np.ndarray, rows: int) -> np.ndarray:
    """BANDS keys of a set of hashes: each is made of the minima under `rows` random multiplications."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[None, at : at + 256] * factors[:, None]).min(axis=1), out=least)
    bands = least.reshape(BANDS, rows)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(bands)], np.uint64).view(np.int64)


def fingerprint_links(texts: DataFrame, radius: int) -> DataFrame:
    """(first, fp) -> (u, v): texts of equal fingerprints with the smallest id among them, and spanning links of these at radius or fewer differing bits."""
    hubs = stable(texts.groupBy("fp").agg(F.min("first").alias("hub"), F.count("*").alias("n")))
    links = near_links(hubs.select("fp"), radius)
    ends = links.join(hubs.select(F.col("fp").alias("u"), F.col("hub").alias("a")), "u").join(hubs.select(F.col("fp").alias("v"), F.col("hub").alias("b")), "v")
    equal = spread_join(texts.select("fp", "first"), hubs, "fp", "first").filter("first <> hub").select(F.col("hub").alias("u"), F.col("first").alias("v"))
    return ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).unionByName(equal)


def band_keys_of(texts: DataFrame) -> DataFrame:
    """(first, keys) -> (key, id, hub): the texts of each key that several share, with the smallest id among them."""
    keyed = texts.select(F.explode("keys").alias("key"), F.col("first").alias("id"))
    shared = stable(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    return spread_join(keyed, shared, "key", "id").drop("n")


def one_row_per_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows that repeat an id, the one whose text, then whose whole row, has the smallest hash; rows without an id all stay."""
    if docs.groupBy(id_col).count().filter(F.col(id_col).isNotNull() & (F.col("count") > 1)).isEmpty():
        return docs
    order = F.struct(F.xxhash64(text_col), F.xxhash64(F.to_json(F.struct(F.col("*")))))
    hashed = docs.filter(F.col(id_col).isNotNull()).withColumn("_order", order)
    least = hashed.groupBy(F.col(id_col).alias("_id")).agg(F.min("_order").alias("_least"))
    alone = hashed.join(least, (F.col(id_col) == F.col("_id")) & (F.col("_order") == F.col("_least"))).select(*[F.col(f"`{c}`") for c in docs.columns])
    return alone.dropDuplicates([id_col]).unionByName(docs.filter(F.col(id_col).isNull()))


def near_copy_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = NEAR_RADIUS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most: int = CLUSTER) -> DataFrame:
    """-> (id, group): one row for each id; group is the smallest id of its near copies.

    The tiled comparison of SimHash fingerprints finds candidates at `radius` or fewer differing bits. Pairs at
    the edge of the similarity may differ in more; for them, texts that agree in a whole band of minima of their
    shingle hashes are candidates too: at 0.8 a pair agrees in none of BANDS bands with a chance of 3 in a
    million, above that with less. A link holds if the shingle sets have a Jaccard similarity of `similarity` or
    more, computed exactly (see held_groups). Only texts that stand in a candidate are read again.

    Null text counts as empty; texts without words are copies of each other; rows without an id take no part; of
    rows that repeat an id one_row_per_id names the one that counts; an empty table gives an empty result.
    """
    size = signature_rows(similarity)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps, keys, sizes, digests = [], [], [], []
                for text in (x.as_py() or b"" for x in part.column(1)):
                    hashes = shingle_hashes(words_of(text), shingle)
                    fps.append(fingerprint(hashes))
                    hashes = np.unique(hashes)
                    keys.append(band_keys(hashes, size))
                    sizes.append(len(hashes))
                    digests.append(xxhash.xxh3_128_digest(text))
                made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["id", "fp", "keys", "size", "digest"])

    alone = one_row_per_id(docs, id_col, text_col)
    picked = alone.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("id is not null")
    rows = stable(picked.mapInArrow(run, "id long, fp long, keys array<long>, size long, digest binary"))
    # equal texts fold into one
    texts = stable(rows.groupBy("digest").agg(F.min_by(F.struct("id", "fp", "keys", "size"), "id").alias("t"), F.count("*").alias("n")).select("digest", F.col("t.id").alias("first"), "t.fp", "t.keys", "t.size", "n"))
    keyed = stable(band_keys_of(texts))
    by_band = keyed.filter("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v"))
    candidates = stable(fingerprint_links(texts, radius).unionByName(by_band).distinct())
    labels = held_groups(candidates, keyed.select("key", "id"), texts.select(F.col("first").alias("id"), "size"), picked, shingle, similarity, block, most).withColumnRenamed("id", "first")
    grouped = texts.join(labels, "first", "left").select("digest", F.coalesce("label", "first").alias("group"))
    return spread_join(rows.select("id", "digest"), grouped, "digest", "id", hot_keys(texts, "digest")).select("id", "group")


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group of near copies that with the smallest id.

    Of rows that repeat an id one stays (one_row_per_id); rows without an id all stay.
    """
    groups = stable(near_copy_groups(docs, shingle, similarity, id_col=id_col, text_col=text_col))
    return one_row_per_id(docs, id_col, text_col).join(groups.filter("id <> group").select(F.col("id").alias("_id")), F.col(id_col).cast("long") == F.col("_id"), "left_anti")
