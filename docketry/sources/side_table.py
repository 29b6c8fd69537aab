"""Side tables: results that are dear to make, kept under a key of their content and made only once.

A table is a folder of runs. A fill looks up which keys no finished run has, makes these alone and writes them as a run of its own. A
run counts once it is finished, which Spark marks when all its tasks have committed; what a lost driver leaves behind is never
read, and lost tasks are made again within their run. The key is a digest of a version and all that the result depends on,
so a changed text is made anew and an unchanged one never is. Fills that run at the same time may make a key twice: equal keys have
equal inputs, and one of the rows is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.shared import drop_folder, exists, stable

DONE = "_SUCCESS"


def content_key(version: str, *columns: Column | str) -> Column:
    """Digest of the version and the columns; null and empty differ, and so do places."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("-")) for c in columns]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.sha2(F.concat(F.lit(f"{version};"), *sized), 256)


def runs(spark: SparkSession, path: str) -> list[str]:
    """The finished runs of a table, by name."""
    if not exists(spark, path):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(str(f.getPath()) for f in found if f.isDirectory() and exists(spark, f"{f.getPath()}/{DONE}"))


def read(spark: SparkSession, path: str, schema: str, key: str = "key") -> DataFrame:
    """The table: each key once."""
    done = runs(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*done).dropDuplicates([key])


def fill(wanted: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], schema: str, key: str = "key") -> tuple[DataFrame, int]:
    """Makes what the table lacks of the wanted keys -> (the table, rows made).

    wanted: (key, inputs...); make(rows of missing keys) -> columns of schema, with the key. Rows that make leaves out, as
    those whose engine failed, stay missing, and the next fill makes them.
    """
    spark = wanted.sparkSession
    columns = spark.createDataFrame([], schema).columns
    have = read(spark, path, schema, key)
    todo = stable(wanted.dropDuplicates([key]).join(have.select(key), key, "left_anti"))
    if todo.isEmpty():
        return have, 0
    run = f"{path}/run-{uuid.uuid4().hex}"
    make(todo).select(*columns).write.parquet(run)
    n = spark.read.schema(schema).parquet(run).count()
    return read(spark, path, schema, key), n


def compact(spark: SparkSession, path: str, schema: str, key: str = "key") -> None:
    """Makes one run of all, then drops the others; at any moment each key is in a finished run."""
    before = runs(spark, path)
    if len(before) > 1:
        read(spark, path, schema, key).write.parquet(f"{path}/run-{uuid.uuid4().hex}")
        for run in before:
            drop_folder(spark, run)


def looked_up(rows: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    """Rows with what the table has for them; null where it has nothing."""
    return rows.join(table, key, "left")
