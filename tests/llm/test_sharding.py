"""Sharding by differencing: against the definition step by step, and on odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docketry.llm import common, sharding


def spread_of(sizes, places, parts, loads=None):
    held = list(loads or [0] * parts)
    for s, p in zip(sizes, places, strict=True):
        held[p] += s
    return held, max(held) - min(held)


def plain_differencing(sizes, parts):
    """Lists of (load, members), the two widest joined in opposite order, until one is left: its spread."""
    left = [sorted([(s, [i])] + [(0, [])] * (parts - 1), key=lambda x: -x[0]) for i, s in enumerate(sizes)]
    while len(left) > 1:
        left.sort(key=lambda p: p[0][0] - p[-1][0])
        a, b = left.pop(), left.pop()
        left.append(sorted([(x + y, m + n) for (x, m), (y, n) in zip(a, b[::-1], strict=True)], key=lambda x: -x[0]))
    return left[0][0][0] - left[0][-1][0]


def test_differencing_is_that_of_karmarkar_and_karp():
    # the textbook case: 4, 5, 6, 7, 8 in two parts end 2 apart
    held, spread = spread_of([8, 7, 6, 5, 4], sharding.differenced([8, 7, 6, 5, 4], 2), 2)
    assert spread == 2 and sum(held) == 30
    rng = random.Random(1)
    for parts in (2, 3, 7):
        for n in (0, 1, 5, 40):
            sizes = rng.sample(range(1, 10_000), n)
            places = sharding.differenced(sizes, parts)
            assert len(places) == n and all(0 <= p < parts for p in places)
            if n:
                assert spread_of(sizes, places, parts)[1] == plain_differencing(sizes, parts)


def test_differencing_fills_what_is_held():
    sizes, loads = [10] * 300, [1000, 700, 0, 0]
    held, _ = spread_of(sizes, sharding.differenced(sizes, 4, loads), 4, loads)
    assert sum(held) == 4700 and max(held) - min(held) <= 20
    # a part that holds more than its share gets nothing more
    held, _ = spread_of(sizes, sharding.differenced(sizes, 4, [5000, 0, 0, 0]), 4, [5000, 0, 0, 0])
    assert held[0] == 5000 and max(held[1:]) - min(held[1:]) == 0


def placed(docs, **more):
    return sharding.sharded(docs, **more).select("doc_id", "text", "place.*").collect()


def told(rows, shards):
    """Checks what holds for any rows; returns the bytes of each shard."""
    of_text, slots, held = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw)) and 0 <= r["shard"] < shards
        of_text[raw].add(r["shard"])
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
        held[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in of_text.values())
    for got in slots.values():
        assert [s for s, _ in sorted(got)] == list(range(len(got)))
        ids = [i for _, i in sorted(got)]
        assert ids == sorted(ids, key=lambda i: (i is None, i))
    return [held[s] for s in range(shards)]


def test_shards_are_even_and_groups_whole(spark):
    rng = random.Random(2)
    texts = ["w" * int(rng.paretovariate(1.1) * 40) for _ in range(600)] + ["ä copy"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for lot in (4096, 50):
        rows = placed(docs, shards=7, lot=lot)
        held = told(rows, 7)
        assert len(rows) == 800 and max(held) - min(held) < 0.01 * sum(held) / 7
    assert sorted(map(tuple, placed(docs.repartition(9), shards=7, lot=50))) == sorted(map(tuple, rows))


def test_large_group_stands_alone(spark, monkeypatch):
    rows = [(i, "the same text") for i in range(400)] + [(1000 + i, f"text number {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = None
    for salted in (False, True):
        if salted:
            monkeypatch.setattr(sharding, "HOT_ROWS", 50)
        got = placed(docs, shards=5, lot=40)
        held = sorted(told(got, 5))
        assert held[-1] == 400 * 29 and held[-2] - held[0] <= 40
        whole = whole or sorted(map(tuple, got))
        assert sorted(map(tuple, got)) == whole


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x"), (None, "x"), (7, "x"), (7, "x"), (8, "é" * 300_000), (9, " \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("c") for c in ("place", "size", "key", "bytes", "_place", "_range", "shard", "slot", "n", "kept", "id", "crc")})
    out = sharding.sharded(docs, 3)
    assert out.columns == [*docs.columns, "place_"] and out.filter("place = 'c' and shard = 'c'").count() == len(rows)
    told(out.select("doc_id", "text", "place_.*").collect(), 3)
    assert sharding.sharded(docs.limit(0), 3).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 9}", "s") for i in range(60)], "doc_id long, text string, slot string")
    sharding.write(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == ["doc_id", "shard", "slot", "slot_", "text"] and back.count() == 60
    for s in range(4):
        assert sorted(r["slot_"] for r in back.filter(F.col("shard") == s).collect()) == list(range(back.filter(F.col("shard") == s).count()))


def test_totals_of_hot_keys_are_dealt(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(90)] + [(99, "b")], "x long, k string")
    sums = rows.groupBy("k").agg(F.sum("x").alias("s"))
    want = sorted(map(str, common.joined_totals(rows, sums, "k", "k").collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert sorted(map(str, common.joined_totals(rows, sums, "k", "k", most=1).collect())) == want and len(want) == 91


@pytest.mark.parametrize("name", ["op11_sharding"])
def test_query(spark, name):
    import os

    from docketry.llm import queries

    folder = os.environ.get("DOCKETRY_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    got = queries.QUERIES[name](spark, folder)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    held = told(rows, 40)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    largest = max(Counter({t: sum(r["size"] for r in rows if r["text"] == t) for t in {r["text"] for r in rows}}).values())
    assert max(held) <= max(largest, 1.2 * sum(held) / 40)
