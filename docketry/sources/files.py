"""Sources: each takes (spark, path) and gives a DataFrame with an explicit schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import fixed

PAGES = "doc_id string, page_no int, text string"


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a header; all columns strings, as they stand."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote='"', escape='"')


def _stem(column: str = "path"):
    return F.regexp_replace(F.element_at(F.split(F.col(column), "/"), -1), r"\.[^.]*$", "")


def text_pairs(spark: SparkSession, folder: str, left: str = "pdf", right: str = "txt") -> tuple[DataFrame, DataFrame]:
    """(pairs (stem, path, truth), skipped (stem, path)): files X.left with their X.right, by stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{left}").load(folder).select(F.col("path"), _stem().alias("stem"))
    truths = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{right}").load(folder).select(_stem().alias("stem"), F.decode("content", "UTF-8").alias("truth"))
    return files.join(truths, "stem"), files.join(truths, "stem", "left_anti")


def pages(spark: SparkSession, folder: str, read_page_texts: Callable[[bytes], list[str]], glob: str = "*.pdf", only: str | None = None) -> DataFrame:
    """-> (doc_id, page_no, text): read_page_texts, an engine of the caller's, turns a file into its pages' texts.

    `only` filters file names before a file is opened.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for stem, content in zip(part["stem"], part["content"]):
                texts = read_page_texts(bytes(content))
                yield pd.DataFrame({"doc_id": [stem] * len(texts), "page_no": range(1, len(texts) + 1), "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    if only:
        files = files.filter(F.element_at(F.split("path", "/"), -1).contains(only))
    return files.select(_stem().alias("stem"), "content").mapInPandas(run, PAGES)


def with_text(page_rows: DataFrame, max_docs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with some text, skipped with a reason); max_docs counts after the blank ones are gone."""
    filled = page_rows.groupBy("doc_id").agg(F.max(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "").alias("some"))
    good, blank = filled.filter("some"), filled.filter("not some").select("doc_id", F.lit("blank").alias("reason"))
    if max_docs is not None:
        good = good.orderBy("doc_id").limit(max_docs)
    return page_rows.join(good, "doc_id", "left_semi"), blank


def existing(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return rows.join(files.select(key), key, "left_semi")


def missing(rows: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rows whose result is not in the side table yet."""
    return rows.join(cached.select(key), key, "left_anti")


def gold_cells(raw: DataFrame, key: str, row_no: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """(documents (key), cells (key, role, pos, title, name, note)): a row of two marks says that a role has no cell.

    Documents that have only such rows stay in the first table. pos counts cells within the role from 0.
    """
    docs = raw.select(key).distinct()
    kept = raw.filter(~((F.col("title") == fixed.NO_CELL) & (F.col("name") == fixed.NO_CELL)))
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy(key, "role").orderBy(row_no)) - 1
    return docs, kept.select(key, "role", pos.alias("pos"), "title", "name", "note")


def last_wins(rows: DataFrame, keys: list[str], value: str, row_no: str = "row_no") -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, row_no).alias(value))


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects; rid is the place in the array."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("rid", "r")).select("rid", "r.*")


def id_lists(rows: DataFrame, key: str, column: str) -> DataFrame:
    """A comma list becomes an array of ints; empty or unreadable parts are left out."""
    found = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    return rows.select(key, F.array_distinct(found).alias("rids"))


def yaml_rules(spark: SparkSession, path: str, pick: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Rows that pick takes from a YAML file, read through Spark; needs PyYAML."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(pick(yaml.safe_load(text)), schema)


def org_chart(raw: DataFrame, lead: str = "팀장", weak_lead: str = "소장") -> tuple[DataFrame, DataFrame]:
    """(dept (dept, bureau, head), team (dept, team, lead, duties)) from (row_no, bureau, dept, team, title, duty).

    Bureau and head: the first row that has one. A team's lead: the last row titled so, else the first weak one. Duties in row order.
    """
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    head = F.when(F.coalesce(F.col("team"), F.lit("")) == "", some("title"))
    dept = raw.groupBy("dept").agg(F.min_by(some("bureau"), F.when(some("bureau").isNotNull(), F.col("row_no"))).alias("bureau"), F.min_by(head, F.when(head.isNotNull(), F.col("row_no"))).alias("head"))
    strong, weak = F.col("title").endswith(lead), F.col("title").endswith(weak_lead)
    duties = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(some("duty").isNotNull(), F.struct("row_no", "duty")))), lambda s: s["duty"]), " ")
    team = raw.filter(some("team").isNotNull()).groupBy("dept", "team").agg(
        F.coalesce(F.max_by("title", F.when(strong, F.col("row_no"))), F.min_by("title", F.when(weak, F.col("row_no"))), F.lit("")).alias("lead"), duties.alias("duties"),
    )
    return dept, team
