"""Stratified and seeded samples with orders of their own, and ranked phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed


def round_robin(rows: DataFrame, kind: str, order: Column | str, n: int) -> DataFrame:
    """n rows by turns over the kinds (in their order), each kind's rows in the given order."""
    w = Window.partitionBy(kind).orderBy(order)
    turned = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return turned.orderBy("_r", kind, order).limit(n).drop("_r")


def round_robin_within(rows: DataFrame, keys: list[str], kind: str, order: str, n: int) -> DataFrame:
    """Up to n rows of each key, by turns over its kinds (in their order), each kind's in the given order; the rows of a key are few by nature."""
    turned = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, kind).orderBy(order))).filter(F.col("_r") <= n)
    picked = turned.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy("_r", kind, order)))
    return picked.filter(F.col("_p") <= n).drop("_r", "_p")


def shuffled(seed: int, *keys: str) -> Column:
    """A seeded order that any run reproduces."""
    return F.xxhash64(F.lit(seed), *keys)


def resampled(rows: DataFrame, group: str, key: str, rounds: int, size: int, seed: int = 0) -> DataFrame:
    """-> rows with `round`: for each round `size` rows of each group, drawn by hash."""
    many = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    w = Window.partitionBy("round", group).orderBy(F.xxhash64("round", F.lit(seed), key), key)
    return many.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_n")


def keyphrases(docs: DataFrame, id_col: str, text_col: str, pattern: str = "[가-힣]{2,}", stop: tuple[str, ...] = (), most: int = 20) -> DataFrame:
    """-> (id, word, n, rank): most frequent words, ties by first appearance. Counted within the row, without a shuffle."""
    counted = docs.select(id_col, F.posexplode(top_words(F.col(text_col), pattern, stop, most)).alias("p", "w"))
    return counted.select(id_col, "w.word", F.col("w.n").cast("long").alias("n"), (F.col("p") + 1).alias("rank"))


def top_words(text: Column, pattern: str = "[가-힣]{2,}", stop: tuple[str, ...] = fixed.DRAFT_STOP, most: int = 20) -> Column:
    """array<struct(n, at, word)>: the words are sorted with their places, so that equal ones stand together."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    kept = F.filter(found, lambda w: ~w.isin(*stop)) if stop else found
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i)["w"] != F.element_at(s, F.greatest(i - 1, F.lit(1)))["w"]))

        def counted(at: Column) -> Column:
            ends = F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s) + 1))
            return F.zip_with(at, ends, lambda a, e: F.struct((a - e).alias("less"), F.element_at(s, a)["at"].alias("at"), F.element_at(s, a)["w"].alias("word"), (e - a).alias("n")))

        return F.slice(F.array_sort(once(starts, counted)), 1, most)

    placed = F.array_sort(F.transform(kept, lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    kind = "array<struct<less: int, at: int, word: string, n: int>>"
    return once(placed, lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast(kind)))


def segments(entries: DataFrame, source: str, seq: str, page: str, last_pages: int = fixed.LAST_BODY_PAGES, offset: str | None = None, page_count: str | None = None) -> DataFrame:
    """Adds `first` and `until`: from the own page to that before the next entry's, one page at least; the last
    entry has `last_pages` pages. offset: a column added to stated pages; page_count: one that bounds them.
    """
    w = Window.partitionBy(source).orderBy(seq)
    start = F.col(page) + (F.coalesce(F.col(offset), F.lit(0)) if offset else F.lit(0))
    nxt = F.lead(start).over(w)
    first = F.greatest(F.least(start, F.col(page_count)) if page_count else start, F.lit(1)) if page_count or offset else start
    end = F.coalesce(nxt - 1, start + last_pages - 1)
    return entries.withColumns({"first": first, "until": F.greatest(F.least(end, F.col(page_count)) if page_count else end, first)})


def bodies(entries: DataFrame, pages: DataFrame, source: str, key: list[str], text: str = "text") -> DataFrame:
    """Texts of the pages of each segment, in page order -> (*key, body)."""
    joined = entries.withColumn("page_no", F.explode(F.sequence("first", "until"))).join(pages.select(source, "page_no", text), [source, "page_no"])
    return joined.groupBy(source, *key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", text))), lambda s: s[text]), "\n").alias("body"))


def carry(rows: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """Nulls take the last value before them; an empty string is a value and resets."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
