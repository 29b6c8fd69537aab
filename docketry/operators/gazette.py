"""Gazette issues cut into items by their tables of contents, and how well searches find the items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.extract import toc_entries
from docketry.operators import drafts, retrieval, sampling

#: Pages of an issue that may hold its table of contents.
CONTENTS_PAGES = 6


def entries(pages: DataFrame, contents_pages: int = CONTENTS_PAGES) -> DataFrame:
    """pages(source, page_no, text) -> (source, seq, kind, no, title, page, issuer), seq from 1 in the order of the contents."""
    found = toc_entries(pages.filter(F.col("page_no") <= contents_pages), ["source", "page_no"])
    order = Window.partitionBy("source").orderBy("page_no", "seq")
    return found.withColumn("seq", F.row_number().over(order)).drop("page_no")


def items(pages: DataFrame, contents_pages: int = CONTENTS_PAGES, last_pages: int = fixed.LAST_BODY_PAGES) -> DataFrame:
    """pages(source, page_no from 1, text) -> (source, seq, item_id, kind, no, title, issuer, pdf_pages (first, last), body, body_chars).

    Stated pages are those printed; the offset at which the first title really starts holds for the whole issue. An item reaches up to
    the page before the next one's, has one page at least and stays within the issue; the last has `last_pages` pages at most.
    """
    listed = entries(pages, contents_pages)
    sizes = pages.groupBy("source").agg(F.max("page_no").alias("page_count"))
    placed = listed.join(drafts.page_offset(listed, pages), "source").join(sizes, "source")
    cut = sampling.segments(placed, "source", "seq", "page", last_pages, "offset", "page_count")
    texts = sampling.bodies(cut.select("source", "seq", "first", "until"), pages, "source", ["seq"])
    body = F.coalesce("body", F.lit(""))
    return cut.join(texts, ["source", "seq"], "left").select(
        "source", "seq", F.concat("source", F.lit("#"), "kind", "no").alias("item_id"), "kind", "no", "title", "issuer", F.struct("first", F.col("until").alias("last")).alias("pdf_pages"), body.alias("body"), F.length(body).alias("body_chars"),
    )


def targets(found: DataFrame, n: int = 24, seed: int = 20260909, least: int = 300) -> DataFrame:
    """n items with a body of `least` characters, by turns over the kinds, each kind's in a seeded order."""
    return sampling.round_robin(found.filter(F.col("body_chars") >= least).withColumn("_o", sampling.shuffled(seed, "item_id")), "kind", "_o", n).drop("_o")


def search_report(found: DataFrame, queries: DataFrame, embedded: DataFrame | None = None, k: int = 3) -> DataFrame:
    """-> (retriever, cases, self_at_1, self_at_3, same_kind_at_3) for queries (query_id: the item that is meant, query[, embedding]).

    Each corpus is searched once; with embeddings (doc_id, embedding), vectors and the fusion of both lists come on top.
    """
    chunks = retrieval.item_chunks(found)
    words = retrieval.bm25(queries.select("query_id", "query"), chunks.select("doc_id", "text"), 4 * k if embedded is not None else k)
    lists = [("bm25", words)]
    if embedded is not None:
        near = retrieval.vectors(queries.select("query_id", "embedding"), embedded, 4 * k, id_col="doc_id", same_id=True)
        words, near = words.cache(), near.cache()
        lists = [("bm25", words), ("vector", near), ("hybrid", retrieval.fuse([words, near], k))]
    kinds = found.select("item_id", "kind").distinct()
    all_ = None
    for name, hits in lists:
        part = hits.filter(F.col("rank") <= k).select(F.lit(name).alias("retriever"), "query_id", "rank", "doc_id")
        all_ = part if all_ is None else all_.unionByName(part)
    named = all_.join(kinds.select(F.col("item_id").alias("doc_id"), F.col("kind").alias("_k")), "doc_id").join(kinds.select(F.col("item_id").alias("query_id"), F.col("kind").alias("_q")), "query_id")
    own = F.col("doc_id") == F.col("query_id")
    by_query = named.groupBy("retriever", "query_id").agg(F.max(own & (F.col("rank") == 1)).alias("a"), F.max(own & (F.col("rank") <= 3)).alias("b"), F.max((F.col("_k") == F.col("_q")) & (F.col("rank") <= 3)).alias("c"))
    asked = queries.select("query_id").withColumn("retriever", F.explode(F.array(*[F.lit(n) for n, _ in lists])))
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    return asked.join(by_query, ["retriever", "query_id"], "left").groupBy("retriever").agg(F.count("*").alias("cases"), share("a").alias("self_at_1"), share("b").alias("self_at_3"), share("c").alias("same_kind_at_3"))


def question_overlap(question: Column, title: Column) -> Column:
    """Share of a title's words that a question uses."""
    words = lambda c: F.regexp_extract_all(c, F.lit("([가-힣]{2,})"), F.lit(1))
    return retrieval.lexical_overlap(words(question), words(title))
