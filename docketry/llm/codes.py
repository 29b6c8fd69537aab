"""Vector code compression: each part of a vector becomes the number of its nearest entry in a codebook.

Vectors are made of integers floor(scale * x) and cut into `parts` equal consecutive parts. Each part's codebook
starts as that part of the first vectors by id; each of `rounds` rounds assigns all parts and moves every entry to
the floored mean of its parts. An entry's sums and count come from partial sums in each task and one aggregate, so the
driver gets parts * entries rows whatever the number of vectors. At the end parts are assigned once more.

The nearest entry is found by annular norm pruning: entries stand sorted by norm. A binary search finds those whose norm
lies next to the part's; the nearest of them gives a first distance. As |norm(x) - norm(c)| <= |x - c|, no entry outside the
annulus of norms within that distance can be nearer or as near; a binary search finds the annulus, its ends belong to it,
and its entries alone are compared, exactly, in integers. Of equal distances the lower index wins. All rows of a batch
are searched together, a part at a time.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do those that can't be cut
into `parts` equal parts; vectors of each other length have codebooks of their own, made one length after another;
empty vectors have distance 0 and code 0; components beyond 64 bits are the largest or smallest long, and so are errors;
fewer vectors than entries give smaller codebooks; rows that repeat count each, those of an id in order of their vectors;
rows without an id are coded, and come last where entries are chosen; an empty table gives an empty result; further columns
are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import free_name, joined_totals, stable

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
_MOST = (1 << 63) - 1
#: Numbers in the differences that are taken at once.
_AT_ONCE = 1 << 21


def integers(vector: Column, scale: int = SCALE, parts: int = PARTS) -> Column:
    """floor(scale * x) as longs, or null for vectors that take no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(vector.isNotNull() & (F.size(vector) % parts == 0) & F.coalesce(fine, F.lit(False)), whole)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact: in 64 bits where these suffice."""
    if 4 * x.shape[-1] * max(_largest(x), _largest(c)) ** 2 >= 1 << 62:
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(axis=-1) if x.shape[-1] else np.zeros(len(x), np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row of x, the lower of equally near ones, and its squared distance."""
    step = max(1, _AT_ONCE // (len(entries) * max(1, x.shape[1])))
    if len(x) > step:
        found = [nearest(x[at : at + step], entries) for at in range(0, len(x), step)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    norm = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    own, norms = norm(x), norm(entries)
    by_norm = np.argsort(norms, kind="stable")
    norms = norms[by_norm]
    # the entries whose norms lie on either side of the row's
    at = np.searchsorted(norms, own)
    sides = [by_norm[np.clip(at + side, 0, len(entries) - 1)] for side in (-1, 0)]
    close = np.minimum(*[_distances(x, entries[s]) for s in sides])
    reach = np.sqrt(close.astype(np.float64)) + 1e-9 * (own + norms[-1]) + 1e-6  # and what rounding may take from the norms
    low, high = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    width = high - low
    first = np.cumsum(width) - width
    row = np.repeat(np.arange(len(x)), width)
    entry = by_norm[np.arange(width.sum()) - np.repeat(first - low, width)]
    distance = _distances(x[row], entries[entry])
    best = np.minimum.reduceat(distance, first)
    index = np.minimum.reduceat(np.where(distance == best[row], entry, len(entries)), first)
    return index, best


def _split(v: np.ndarray, parts: int) -> list[np.ndarray]:
    return [v[:, p * (v.shape[1] // parts) : (p + 1) * (v.shape[1] // parts)] for p in range(parts)]


def _sums(books: np.ndarray):
    """mapInArrow over (v) -> (part, entry, n, low, high): the count and the sums of the parts next to each entry, from each
    task; a sum is high * 2^32 + low, component by component."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), np.int64)
        low, high = np.zeros(books.shape, np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            for p, x in enumerate(_split(v, parts)):
                index, _ = nearest(x, books[p])
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(low[p], index, x & 0xFFFFFFFF)
                np.add.at(high[p], index, x >> 32)
        part, entry = np.nonzero(n)
        lists = lambda a: pa.array(list(a[part, entry]), pa.list_(pa.int64()))
        made = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry], pa.int64()), lists(low), lists(high)]
        yield pa.RecordBatch.from_arrays(made, names=["part", "entry", "n", "low", "high"])

    return run


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """rows(id, v) of integers() -> for each length of vectors its codebooks: an array of part, entry and component."""
    out = {}
    for (length,) in sorted(tuple(r) for r in rows.select(F.size("v")).distinct().collect()):
        own = rows.filter(F.size("v") == length)
        first = own.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        books = np.stack(_split(np.array([r["v"] for r in first], np.int64).reshape(len(first), length), parts))
        for _ in range(rounds if length else 0):
            told = own.select("v").mapInArrow(_sums(books), "part int, entry int, n long, low array<long>, high array<long>")
            each = told.select("part", "entry", "n", F.posexplode(F.arrays_zip("low", "high")).alias("at", "s"))
            total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c.split(".")[-1])
            moved = books.copy()
            for r in each.groupBy("part", "entry", "at").agg(total("n"), total("s.low"), total("s.high")).collect():
                moved[r["part"], r["entry"], r["at"]] = ((int(r["high"]) << 32) + int(r["low"])) // int(r["n"])
            books = moved
        out[length] = books
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


def coded(v: Column, books: dict[int, np.ndarray]) -> Column:
    """struct(code, error): the parts' indexes, two hex digits each, and the sum of their squared distances."""

    @F.pandas_udf("code string, error long")
    def run(vectors: pd.Series) -> pd.DataFrame:
        lengths = vectors.map(len).to_numpy() if len(vectors) else np.zeros(0, np.int64)
        code, error = np.empty(len(vectors), object), np.empty(len(vectors), object)
        for length in np.unique(lengths):
            own, rows = books[int(length)], np.flatnonzero(lengths == length)
            x = np.stack(vectors.iloc[rows].to_list()).astype(np.int64).reshape(len(rows), length)
            found = [nearest(part, own[p]) for p, part in enumerate(_split(x, len(own)))]
            code[rows] = [bytes(c).hex() for c in np.stack([f[0] for f in found], axis=1).astype(np.uint8)]
            error[rows] = [min(_MOST, sum(map(int, e))) for e in zip(*[f[1] for f in found], strict=True)]
        return pd.DataFrame({"code": code, "error": error.astype(np.int64)})

    return run(v)


def approximate(code: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code of these codebooks stands for: its entries' components, divided by scale."""

    @F.pandas_udf("array<double>")
    def run(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: None if c is None else np.concatenate([books[p, i] for p, i in enumerate(bytes.fromhex(c))]) / scale)

    return run(code)


def compress(data: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """-> the rows of data that take part, with a struct of code, error and the codebooks' digest as last column, named
    compressed or, where data have such a column, with underscores behind."""
    if entries > 256:
        raise ValueError("a code has two hex digits for each part: at most 256 entries")
    whole = integers(F.col(f"`{vector_col}`"), scale, parts)
    books = learn(data.select(F.col(f"`{id_col}`").alias("id"), whole.alias("v")).filter("v is not null"), parts, entries, rounds)
    v, into = free_name(data.columns, "_v"), free_name(data.columns, "compressed")
    rows = data.withColumn(v, whole).filter(F.col(v).isNotNull())
    names = F.create_map(*[F.lit(x) for length, b in books.items() for x in (length, digest(b))]) if books else F.create_map().cast("map<int,string>")
    made = rows.withColumn(into, coded(F.col(v), books))
    return made.withColumn(into, F.struct(f"{into}.code", f"{into}.error", names[F.size(v)].alias("codebooks_sha256"))).drop(v)


def with_sums(rows: DataFrame, by: str, value: str, into: str) -> DataFrame:
    """Adds the sum of `value` over all rows of equal `by`, nulls together."""
    sums = rows.groupBy(F.col(by).alias("k")).agg(F.sum(F.col(value).cast("decimal(38,0)")).alias("s"))
    limit = F.lit(Decimal(_MOST))
    return joined_totals(rows, stable(sums.select("k", F.least("s", limit).cast("long").alias(into))), "k", by)
