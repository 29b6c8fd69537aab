"""Vector codes against plain loops, and on odd rows."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from docketry.llm import codes

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds, scale=256):
    """(vec_id, code, error) of each row in order of (id, vector), and the codebooks, in whole numbers by loops."""
    kept = sorted(((i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(v, p)) for _, v in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(x[k] for x in xs) // len(xs) for k in range(width)] if xs else c for c, xs in zip(books[p], own)]
    out = []
    for i, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def test_nearest_entry_is_the_first_of_the_nearest():
    rng = np.random.default_rng(1)
    for width, span in ((1, 4), (2, 3), (4, 400), (3, 1 << 40), (4, 1 << 61)):
        entries = rng.integers(-span, span, (23, width))
        entries[7] = entries[3]
        x = np.concatenate([rng.integers(-span, span, (200, width)), entries[:9]])
        index, distance = codes.nearest(x, entries)
        for row, i, d in zip(x.tolist(), index, distance):
            each = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in entries.tolist()]
            assert (int(d), int(i)) == (min(each), each.index(min(each)))


def test_rows_are_searched_in_slices(monkeypatch):
    rng = np.random.default_rng(2)
    x, entries = rng.integers(-50, 50, (300, 4)), rng.integers(-50, 50, (16, 4))
    whole = codes.nearest(x, entries)
    monkeypatch.setattr(codes, "_AT_ONCE", 500)
    assert all((a == b).all() for a, b in zip(whole, codes.nearest(x, entries)))


def test_codes_are_those_of_plain_loops(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)], i % 3 or None) for i in rng.sample(range(500), 90)]
    rows += [(600 + i, rows[0][1], 0) for i in range(40)]  # many equal vectors
    got = codes.compress(spark.createDataFrame(rows, ROWS).repartition(5), parts=4, entries=8).select("vec_id", "compressed.*").collect()
    want, digest = plain([(i, v) for i, v, _ in rows], 4, 8, 2)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted(want)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_odd_rows(spark):
    rng = random.Random(4)
    vector = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    fine = [(i % 20, vector(8), None) for i in range(50)] + [(None, vector(8), 1), (3, [1e30] * 8, 1), (4, [-1e30] * 8, 1)]
    short = [(100 + i, vector(4), 2) for i in range(3)]
    bad = [(200, None, 1), (201, [1.0, None] * 4, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] * 8, 1), (204, vector(7), 1)]
    empty = [(300, [], 1)]
    docs = spark.createDataFrame(fine + short + bad + empty, ROWS).withColumns({c: F.lit("c") for c in ("v", "_v", "compressed", "code", "error", "id", "n", "part")})
    out = codes.compress(docs, parts=4, entries=16)
    assert out.columns == [*docs.columns, "compressed_"]
    rows = out.select("vec_id", "label", "compressed_.*").collect()
    assert len(rows) == len(fine) + len(short) + len(empty)
    want, digest = plain([(r[0], r[1]) for r in short], 4, 16, 2)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in rows if 100 <= (r["vec_id"] or 0) < 200) == sorted(want)
    assert {r["codebooks_sha256"] for r in rows if 100 <= (r["vec_id"] or 0) < 200} == {digest}
    assert [(r["code"], r["error"]) for r in rows if r["vec_id"] == 300] == [("00000000", 0)]
    assert len({r["codebooks_sha256"] for r in rows}) == 3 and all(0 <= r["error"] < 1 << 63 for r in rows)
    assert codes.compress(docs.limit(0), parts=4).count() == 0


def test_sums_of_labels(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (1, 6, "x"), (None, 7, "x"), (None, 8, "x"), (2, (1 << 63) - 1, "x"), (2, 3, "x")], "label int, error long, s string")
    got = sorted((str(r["label"]), r["error"], r["total"]) for r in codes.with_sums(rows, "label", "error", "total").collect())
    assert got == [("1", 5, 11), ("1", 6, 11), ("2", 3, (1 << 63) - 1), ("2", (1 << 63) - 1, (1 << 63) - 1), ("None", 7, 15), ("None", 8, 15)]


def test_codes_stand_for_vectors_near_their_own(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-3, 3) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.01) for x in centres[i % 6]], 0) for i in range(60)]
    data = spark.createDataFrame(rows, ROWS)
    ints = data.select(F.col("vec_id").alias("id"), codes.integers(F.col("embedding"), parts=4).alias("v"))
    books = codes.learn(ints, 4, 6)
    out = codes.compress(data, parts=4, entries=6).select("embedding", codes.approximate(F.col("compressed.code"), books[8]).alias("a")).collect()
    assert all(max(abs(x - y) for x, y in zip(r["embedding"], r["a"])) < 0.1 for r in out)
