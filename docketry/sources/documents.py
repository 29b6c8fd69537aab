"""Document tables from a portal's metadata, the files that are there, and gold lines; and what a service shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import extract, fixed
from docketry.functions.masking import mask_names
from docketry.functions.text import doc_type, page_stats
from docketry.operators.sampling import round_robin_within
from docketry.sources.files import gold_cells, last_wins

#: Why a document is left out.
NO_FILE, BLANK = "no file", "blank"


def collected(metadata: DataFrame, files: DataFrame, max_docs: int | None = None, key: str = "file", order: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """(documents whose file is there, in the order of the metadata's rows, with doc_id; those without, with a reason).

    max_docs counts what is there; as reading ends with the last of them, what is missing behind it isn't told. The order is the
    column's, not that of the rows.
    """
    there = metadata.join(files.select(key).distinct().withColumn("_there", F.lit(True)), key, "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    if max_docs is not None:
        last = there.filter("_there").select(order).orderBy(order).limit(max_docs).agg(F.count("*").alias("n"), F.max(order).alias("last")).first()
        if last["n"] == max_docs:
            there = there.filter(F.col(order) <= (last["last"] if max_docs else -1))
    stem = F.regexp_replace(F.col(key), r"\.[^.]*$", "")
    return there.filter("_there").drop("_there").withColumn("doc_id", stem), there.filter(~F.col("_there")).select(key, F.lit(NO_FILE).alias("reason"))


def page_table(pages: DataFrame, gutters: DataFrame | None = None) -> DataFrame:
    """pages(doc_id, page_no, text), gutters(doc_id, page_no, has_gutter) -> the pages with page_type, leader_ratio, short_line_ratio, lines and
    doc_pages, the number of pages of their document."""
    sized = pages.join(pages.groupBy("doc_id").agg(F.count("*").alias("doc_pages")), "doc_id")
    if gutters is not None:
        sized = sized.join(gutters.select("doc_id", "page_no", "has_gutter"), ["doc_id", "page_no"], "left")
    stats = page_stats(F.coalesce("text", F.lit("")), F.col("has_gutter") if gutters is not None else None)
    rounded = lambda f: F.round(F.col(f"_s.{f}"), 4).alias(f)
    return sized.withColumn("_s", stats).select(*pages.columns, "doc_pages", "_s.page_type", rounded("leader_ratio"), rounded("short_line_ratio"), "_s.lines")


def selected_pages(table: DataFrame, max_pages: int) -> DataFrame:
    """Up to max_pages pages of each document, by turns over their types."""
    return round_robin_within(table, ["doc_id"], "page_type", "page_no", max_pages)


def bodies(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """pages(id, page_no, text) -> (id, body, page_count): all pages' texts, in order, a line break between them."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("body"), F.count("*").alias("page_count"))


def with_gold(docs: DataFrame, gold: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """(documents that gold knows, with their organisation; their cells (doc_id, role, pos, title, name, note)).

    gold: (row_no, key, org, role, title, name, note). A document whose gold rows all say that there is no cell stays, without cells. Of
    several organisations that of the last row counts.
    """
    known, cells = gold_cells(gold, key)
    kept = docs.join(known, key).join(last_wins(gold, [key], "org"), key, "left").withColumn("org", F.coalesce("org", F.lit("")))
    return kept, cells.join(kept.select(key, "doc_id"), key).select("doc_id", "role", "pos", "title", "name", "note")


def with_types(docs: DataFrame, gold: DataFrame, key: str = "file", title: str = "title") -> DataFrame:
    """All documents, with the organisation that gold gives, else an empty one, and their type by title."""
    return docs.join(last_wins(gold, [key], "org"), key, "left").withColumns({"org": F.coalesce("org", F.lit("")), "doc_type": doc_type(F.col(title))})


def numbered_gold(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_no, no, doc_no, org, date, role, title, note) -> (documents (no, doc_no, org, day) by their first row, cells (no, pos, role, title,
    note) in the order of the rows)."""
    first = rows.groupBy("no").agg(F.min_by(F.struct("doc_no", "org", F.replace("date", F.lit("."), F.lit("-")).alias("day")), "row_no").alias("d"))
    line = F.array_sort(F.collect_list(F.struct("row_no", "role", "title", "note")))
    cells = rows.groupBy("no").agg(line.alias("c")).select("no", F.posexplode("c").alias("pos", "c"))
    return first.select("no", "d.*"), cells.select("no", "pos", "c.role", "c.title", "c.note")


def fields(first_pages: DataFrame, cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """first_pages(id, text), cells(id, ord, role, title, name) -> (id, title, agency, dept, drafter, date, doc_no): a document's fields
    from its first page; who drafted is who stands in the line's first drafting cell."""
    drafter = cells.filter(F.col("role") == fixed.ROLES[0]).groupBy(id_col).agg(F.min_by("name", "ord").alias("drafter"))
    text, number = F.col("text"), extract.doc_no(F.col("text"))
    told = first_pages.select(id_col, extract.subject(text).alias("title"), extract.issuer(text).alias("agency"), extract.dept(number).alias("dept"), extract.earliest_date(text).alias("date"), number.alias("doc_no"))
    return told.join(drafter, id_col, "left").withColumn("drafter", F.coalesce("drafter", F.lit("")))


# ---------------------------------------------------------------- what a service shows
def organisations(docs: DataFrame) -> DataFrame:
    """-> (org): organisations that have documents, each once."""
    return docs.filter(F.coalesce("org", F.lit("")) != "").select("org").distinct()


def of_organisation(docs: DataFrame, org: str | None = None) -> DataFrame:
    return docs if not org else docs.filter(F.col("org") == org)


def cards(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """docs(doc_id, org, doc_type, doc_no, date, dept, page_count, body) -> the same without the body, with body_chars, gold_cell_count, has_gold
    and gold_titles in the order of roles and places. No names."""
    rank = F.array_position(F.array(*[F.lit(r) for r in fixed.ROLES]), F.col("role"))
    lines = cells.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "pos", "title"))), lambda c: c["title"]).alias("gold_titles"))
    titles = F.coalesce("gold_titles", F.array().cast("array<string>"))
    shown = docs.join(lines, "doc_id", "left").withColumn("gold_titles", titles)
    return shown.select("doc_id", "org", "doc_type", "doc_no", "date", "dept", "page_count", F.length("body").alias("body_chars"), (F.size("gold_titles") > 0).alias("has_gold"), F.size("gold_titles").alias("gold_cell_count"), "gold_titles")


def shown_body(body: Column, names: list[str]) -> Column:
    """A body as it may be shown: with names masked."""
    return mask_names(F.coalesce(body, F.lit("")), names)
