"""Delegation tables as workbooks have them: rows are tasks, columns are grades, marks say who decides.

A workbook comes in as a table of its cells. Header columns, carried headings and amount rows are found by aggregates and one
window for each sheet; a sheet is a page of rules, so its rows are few by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.extract import amount_range
from docketry.functions.text import collapse, strip_spaces
from docketry.operators.sampling import carry

CELLS = "book string, sheet string, row int, col int, text string"
#: Where headers are looked for, what heads the tasks' column, and where it is if nothing does.
HEADER_ROWS, HEADER_COLUMNS, NAME_HEADER, NAME_COLUMN = 8, 12, "사무명", 2
#: An amount row is shorter than this.
AMOUNT_ROW_CHARS = 40
DRAFT = "기안"


def cells(spark: SparkSession, folder: str, read_cells: Callable[[bytes], list[tuple]], glob: str = "*.xlsx") -> DataFrame:
    """-> CELLS; read_cells, an engine of the caller's, turns a file into (sheet, row, col, value) with rows and columns from 1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows = [(path.rsplit("/", 1)[-1], str(s), int(r), int(c), str(v)) for s, r, c, v in read_cells(bytes(content)) if v is not None]
                yield pd.DataFrame(rows, columns=["book", "sheet", "row", "col", "text"])

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content").mapInPandas(run, CELLS)


def workbook(content: bytes) -> list[tuple]:
    """Cells of an xlsx file; needs openpyxl."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    import io

    book = openpyxl.load_workbook(io.BytesIO(content), data_only=True)
    return [(sheet.title.strip(), c.row, c.column, c.value) for sheet in book.worksheets for line in sheet.iter_rows() for c in line]


def header_level(text: Column) -> Column:
    """Level that a header cell names: the first key, in order, that it holds; null without one."""
    flat, out = strip_spaces(text), None
    for key, level in fixed.HEADER_LEVELS:
        out = F.when(flat.contains(key), level) if out is None else out.when(flat.contains(key), level)
    return out


def headers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """-> (*keys, levels: map of column to level, name_col, start): for each sheet with a grade's column. Of a column the first level
    counts, of the tasks' headers the last; data start below the last row that heads anything."""
    top = rows.filter((F.col("row") <= HEADER_ROWS) & (F.col("col") <= HEADER_COLUMNS)).withColumns({"level": header_level(F.col("text")), "named": strip_spaces(F.col("text")).contains(NAME_HEADER)})
    heads = top.filter("level is not null or named")
    sheets = heads.groupBy(*keys).agg(F.max("row").alias("last"), F.max(F.when(F.col("named"), F.struct("row", "col")))["col"].alias("named"))
    levels = heads.filter("level is not null").groupBy(*keys, "col").agg(F.min_by("level", "row").alias("level")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col", "level"))).alias("levels"))
    return levels.join(sheets, keys).select(*keys, "levels", F.coalesce("named", F.lit(NAME_COLUMN)).alias("name_col"), (F.col("last") + 1).alias("start"))


def delegation(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """CELLS -> (*keys, row, group, item, amount_min, amount_max, drafter_level, final_level, final_title), a row for each task
    that someone decides.

    A numbered row without a mark heads a group, and ends the task before it. A task without a mark is the parent of the amount
    rows below it, as is a marked one that states no amount; an amount row's item is its parent's text and its own. The highest
    marked grade decides; the lowest grade that is marked as drafting drafts, if any is.
    """
    keys = keys or ["book", "sheet"]
    known = headers(rows, keys)
    body = rows.join(F.broadcast(known) if known.limit(10_001).count() <= 10_000 else known, keys).filter(F.col("row") >= F.col("start"))
    said, level = F.trim(F.col("text")), F.try_element_at("levels", F.col("col"))
    lines = body.groupBy(*keys, "row").agg(
        F.max(F.when(F.col("col") == F.col("name_col"), collapse(F.col("text")))).alias("text"), F.max(F.when(F.col("col") == F.col("name_col") - 1, F.col("text"))).alias("serial"),
        F.max(F.when(said.isin(*fixed.MARKS), level)).alias("final_level"), F.min(F.when(said.contains(DRAFT), level)).alias("drafter_level"),
    ).filter(F.coalesce("text", F.lit("")) != "")
    band = lines.withColumns({"_band": amount_range(F.col("text")), "_marked": F.col("final_level").isNotNull()})
    amount = (F.col("_band.lo").isNotNull() | F.col("_band.hi").isNotNull()) & (F.length("text") < AMOUNT_ROW_CHARS)
    head = ~F.col("_marked") & (F.coalesce("serial", F.lit("")) != "")
    # a heading is a value for both, the empty one for the item; an amount row leaves both as they are
    events = band.withColumns({"_amount": amount, "group": F.when(head, F.col("text")), "_item": F.when(head, "").when(~F.col("_marked") | ~amount, F.col("text"))})
    carried = carry(events, keys, "row", "group", "_item").filter("_marked")
    parent = F.coalesce("_item", F.lit(""))
    item = F.when(F.col("_amount") & (parent != ""), F.concat(parent, F.lit(" "), "text")).otherwise(F.col("text"))
    names = F.create_map(*[F.lit(x) for kv in fixed.LEVEL_NAMES.items() for x in kv])
    return carried.select(*keys, "row", F.coalesce("group", F.lit("")).alias("group"), item.alias("item"), F.col("_band.lo").alias("amount_min"), F.col("_band.hi").alias("amount_max"), "drafter_level", "final_level", names[F.col("final_level")].alias("final_title"))
