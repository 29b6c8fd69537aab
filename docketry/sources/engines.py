"""Engines of the caller's, such as text generators and embedders, called from tasks: bounded attempts, errors as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StringType, StructField, StructType

ATTEMPTS, BATCH = 2, 32
#: Characters of an error that are kept.
ERROR_CHARS = 300


def called(rows: DataFrame, ask_col: str, call: Callable[[Sequence], Sequence], out: str = "raw", kind: DataType | None = None, attempts: int = ATTEMPTS, batch: int = BATCH, accept: Callable[[object], bool] | None = None) -> DataFrame:
    """Adds `out`, the engine's answer, `error` and `attempts` to rows; each row comes out once, whatever the engine does.

    call gets a list of up to `batch` asks and gives as many answers. Asks that failed are asked again, one at a time, up to
    `attempts` times in all: those of a call that raised or gave another number of answers, and those whose answer is
    null or not accepted. What has failed to the last is null, with the last error. A null ask is not asked.
    """
    schema = StructType([*rows.schema.fields, StructField(out, kind or StringType()), StructField("error", StringType()), StructField("attempts", IntegerType())])

    def tried(asks: list) -> list[tuple[object, str | None]]:
        try:
            got = list(call(asks))
            if len(got) != len(asks):
                raise ValueError(f"{len(got)} answers to {len(asks)} asks")
        except Exception as e:  # noqa: BLE001  an engine may raise anything; its error is data
            return [(None, f"{type(e).__name__}: {e}"[:ERROR_CHARS])] * len(asks)
        return [(a, None) if a is not None and (accept is None or accept(a)) else (None, "no answer" if a is None else f"not accepted: {a}"[:ERROR_CHARS]) for a in got]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            asks = [None if a is None or a != a else a for a in part[ask_col]]
            found: list[tuple] = [(None, None, 0)] * len(asks)
            due = [i for i, a in enumerate(asks) if a is not None]
            for at in range(0, len(due), batch):
                for i, (answer, error) in zip(due[at : at + batch], tried([asks[i] for i in due[at : at + batch]]), strict=True):
                    found[i] = (answer, error, 1)
            for n in range(2, attempts + 1):
                for i in (i for i in due if found[i][1] is not None):
                    found[i] = (*tried([asks[i]])[0], n)
            yield part.assign(**{out: pd.Series([f[0] for f in found], index=part.index, dtype=object), "error": pd.Series([f[1] for f in found], index=part.index, dtype=object), "attempts": [f[2] for f in found]})

    return rows.mapInPandas(run, schema)


def prompt(parts: list[tuple[str, str]], limits: dict[str, int] | None = None):
    """A prompt from (heading, column) pairs: headings and texts, texts cut to limits, empty parts left out."""
    cut = lambda c: F.substring(F.col(c), 1, limits[c]) if limits and c in limits else F.col(c)
    filled = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.concat(F.lit(f"# {heading}\n\n"), cut(c))) for heading, c in parts]
    return F.array_join(F.array_compact(F.array(*filled)), "\n\n")


def menu(options: str):
    """An array of options as lettered lines: A) first, B) second."""
    return F.array_join(F.transform(F.col(options), lambda o, i: F.concat(F.char(i + 65), F.lit(") "), o)), "\n")


def picked(answer: str, options: str):
    """The option whose letter comes first in an answer, thinking aside; null if there is none."""
    bare = F.upper(F.regexp_replace(F.coalesce(F.col(answer), F.lit("")), r"(?s)<think>.*?</think>", ""))
    places = F.transform(F.col(options), lambda o, i: F.struct(F.instr(bare, F.char(i + 65)).alias("at"), i.alias("i"), o.alias("o")))
    return F.array_min(F.filter(places, lambda p: p["at"] > 0))["o"]
