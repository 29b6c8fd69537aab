"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A text's sketch keeps every shingle hash below a fixed fraction of the hash range, so its size
follows the text and two sketches of very unequal texts can still be held against each other: the
hashes of the union below the threshold are the union of the sketches. A short text, of which the
threshold would keep too little to go by, also keeps its FLOOR smallest hashes; that is mergeable as
well, and a comparison then counts the hashes up to the highest value below which both sketches are
complete.

Shingles are runs of five words (fewer words: the whole sequence). A word is hashed once and a
shingle from its words' hashes, so no shingle text is built.

Defined cases: null text counts as empty; texts without words have an empty sketch, two of which are
alike in full (1.0), while one beside any other is 0.0; equal texts have equal sketches; repeated
rows and ids are ordered by their text's hash; rows without an id have no next row; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: The fraction of the hash range that is kept, and the number of hashes that are kept in any case.
FRACTION = 1 / 16
FLOOR = 64
#: Documents in a run of neighbours that one task orders, about.
RUN = 1_000
MOST_RUNS = 20_000
_SPLIT = "[\\x20\\x09-\\x0D]+"
_LEAST, _SPAN = -(1 << 63), 1 << 64


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """Distinct hashes of the text's shingles, smallest first."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, runs).when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(F.array_distinct(_once(hashed, shingles)))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, k: int = SHINGLE, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """struct(hashes, upto): hashes are all of the text's that are no larger than upto."""
    threshold = _LEAST + int(_SPAN * fraction)

    def cut(h: Column) -> Column:
        # a text that is kept whole is complete up to the end of the range
        upto = F.when(F.size(h) <= floor, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.element_at(h, floor), F.lit(threshold)))
        return F.struct(F.filter(h, lambda x: x <= upto).alias("hashes"), upto.alias("upto"))

    return _once(shingle_hashes(text, k), cut)


def merged(a: Column, b: Column) -> Column:
    """Sketch of two texts together: complete up to where both are."""
    upto = F.least(a["upto"], b["upto"])
    return F.struct(F.sort_array(F.filter(F.array_union(a["hashes"], b["hashes"]), lambda x: x <= upto)).alias("hashes"), upto.alias("upto"))


def _counts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    upto = F.least(a["upto"], b["upto"])
    x, y = F.filter(a["hashes"], lambda v: v <= upto), F.filter(b["hashes"], lambda v: v <= upto)
    return F.size(x), F.size(y), F.size(F.array_intersect(x, y))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    x, y, both = _counts(a, b)
    return F.when((F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0), 1.0).when(x + y == 0, 0.0).otherwise(both / (x + y - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too."""
    x, _, both = _counts(a, b)
    return F.when(F.size(a["hashes"]) == 0, 1.0).when(x == 0, 0.0).otherwise(both / x)


def as_text(s: Column) -> Column:
    """upto, a colon, and the hashes joined by dots, in 16 hex digits each: all that merging and comparing need."""
    hexed = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return F.concat(hexed(s["upto"]), F.lit(":"), F.array_join(F.transform(s["hashes"], hexed), "."))


def from_text(text: Column) -> Column:
    """The sketch that as_text() wrote."""
    number = lambda h: ((F.conv(F.substring(h, 1, 8), 16, 10).cast("long") - F.when(F.substring(h, 1, 1) >= "8", F.lit(1 << 32)).otherwise(0)) * (1 << 32)) + F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    parts = F.filter(F.split(F.substring_index(text, ":", -1), "\\."), lambda p: p != "")
    return F.struct(F.transform(parts, number).alias("hashes"), number(F.substring_index(text, ":", 1)).alias("upto"))


def with_next(docs: DataFrame, fields: list[str], id_col: str = "doc_id") -> DataFrame:
    """Adds `next`: a struct of the fields of the row with the next smaller id; after the last, of the first.

    A task orders a run of about RUN neighbours; beyond MOST_RUNS runs they grow longer, as does the run of an id
    that repeats, but a run is sorted on disk where it doesn't fit and read once, never held. A run
    ends at an id that occurs (a percentile), so the row that opens it, seen downwards, is known by its
    id; it alone is sent to the run above as well. The driver gets these ids, nothing else. Rows
    without an id have no next row and are none.
    """
    ident = F.col(id_col)
    n = docs.agg(F.count(ident)).first()[0]
    runs = max(1, min(MOST_RUNS, -(-n // RUN)))
    marks = [i / runs for i in range(1, runs + 1)]
    got = docs.agg(F.percentile_approx(ident, marks, max(10_000, 20 * runs)).alias("p"), F.max(ident).alias("m")).first()
    ends = sorted({*(got["p"] or []), *([got["m"]] if got["m"] is not None else [])})  # run i: ids over ends[i - 1], up to ends[i]
    loose = F.lit(-1) - F.pmod(F.xxhash64(*fields), F.lit(1000)).cast("int")
    if ends:
        step = max(1, int(len(ends) ** 0.5))
        longs = lambda xs: F.array(*[F.lit(int(x)) for x in xs]).cast("array<bigint>")
        below = lambda xs: F.size(F.filter(xs, lambda x: x < ident))
        blocks = F.array(*[longs(ends[i : i + step]) for i in range(0, len(ends), step)])
        block = below(longs(ends[step - 1 :: step]))
        place = F.struct((block * step + F.coalesce(below(F.get(blocks, block)), F.lit(0))).alias("run"), F.coalesce(F.array_contains(F.get(blocks, block), ident), F.lit(False)).alias("opens"))
        dealt = docs.withColumn("_p", place)
        above = F.when(F.col("_p.run") == len(ends) - 1, 0).otherwise(F.col("_p.run") + 1)
        to = F.when(ident.isNull(), F.array(loose)).when(F.col("_p.opens"), F.array(F.col("_p.run"), above)).otherwise(F.array("_p.run"))
    else:
        dealt, to = docs.withColumn("_p", F.lit(0)), F.array(loose)
    dealt = dealt.select("*", F.posexplode(to).alias("_guest", "_at"))
    order = Window.partitionBy("_at").orderBy("_guest", ident.desc_nulls_last(), F.xxhash64(*fields))
    ahead = F.when(ident.isNotNull(), F.lead(F.struct(*fields)).over(order))
    return dealt.withColumn("next", ahead).filter("_guest = 0").drop("_p", "_at", "_guest")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) of the text's n characters replaced by the first as many of the following text."""
    text, n = F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit("")))
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(F.coalesce(following, F.lit("")), F.lit(1), half))
