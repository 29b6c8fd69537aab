"""Sinks: results as JSON under a run's own folder, texts one file for each partition, tables on the console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_json(df: DataFrame, folder: str, run_id: str) -> str:
    """One folder for each run; an existing run is never overwritten."""
    path = f"{folder.rstrip('/')}/{run_id}"
    df.write.mode("errorifexists").json(path)
    return path


def texts(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def markdown_row(*columns: str) -> Column:
    """| a | b |, with line breaks and bars made harmless."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\n|]", " ") for c in columns]), F.lit(" |"))


def report(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)
