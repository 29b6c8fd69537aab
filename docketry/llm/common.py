"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java and Python forms of the word pattern that the contracts fix.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local session that names none, as in tests, gets one here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    here = spark.sparkContext._jsc.sc().getCheckpointDir()
    if here.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints", "docketry"))
        here = spark.sparkContext._jsc.sc().getCheckpointDir()
    return here.get().rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def modest_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hands whole texts to Python in batches of `rows`, unless the session has a size of its own: of Spark's 10,000
    long rows, both the executor's direct memory and the worker would hold tens of megabytes for each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def cores(spark: SparkSession) -> int:
    return max(8, spark.sparkContext.defaultParallelism)


#: A key that holds more rows than this may be dealt over tasks.
HOT_ROWS = 2_000
#: Keys that are dealt out, at most: the most frequent. Any other holds less than one part in so many of all rows.
HOT_KEYS = 500


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> list:
    """counts(key, n), a row for each key -> the HOT_KEYS most frequent keys of those over HOT_ROWS."""
    often = counts.filter(F.col(n) > HOT_ROWS).orderBy(F.desc(n)).limit(HOT_KEYS)
    return [r[key] for r in often.select(key).collect()]


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, other: str, hot: list | None = None, salts: int = 64) -> DataFrame:
    """Inner join of rows with per_key, which has one row for each key and, unless hot names the keys, the number n of
    their rows. Keys that hold many rows are dealt over `salts` tasks by a hash of the column `other`."""
    hot = hot_keys(per_key, key) if hot is None else hot
    if not hot:
        return rows.join(per_key, key)
    is_hot = F.col(key).isin(hot)
    left = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(other), F.lit(salts)).cast("int")).otherwise(0))
    right = per_key.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def joined_totals(rows: DataFrame, table: DataFrame, key: str, column: str, into: str | None = None, most: int = 50_000, salts: int = 64) -> DataFrame:
    """rows with what `table`, one row for each value of its column `key`, says of their `column`, null matching null: as
    columns, or as a struct `into`. The table is broadcast if it was counted to have at most `most` rows; else the few
    values that hold a large part of the rows are dealt over tasks."""
    rest = [c for c in table.columns if c != key]
    other, packed, salt, own = (free_name(rows.columns, c) for c in ("_key", "_packed", "_salt", "_own"))
    packing = table.select(F.col(key).alias(other), F.struct(*rest).alias(packed))
    if table.limit(most + 1).count() <= most:
        joined = rows.join(F.broadcast(packing), F.col(column).eqNullSafe(F.col(other)))
    else:
        hot = [x for x in hot_keys(rows.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n")), "k") if x is not None]
        is_hot = lambda c: F.coalesce(F.col(c).isin(hot), F.lit(True))
        spread = packing.withColumn(salt, F.explode(F.when(is_hot(other), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        dealt = F.when(is_hot(column), F.pmod(F.xxhash64(*[c for c in rows.columns if c != column]), F.lit(salts)).cast("int")).otherwise(0)
        joined = rows.withColumn(own, dealt).join(spread, F.col(column).eqNullSafe(F.col(other)) & (F.col(own) == F.col(salt))).drop(own, salt)
    if into is None:
        return joined.select(*rows.columns, f"{packed}.*")
    return joined.withColumn(into, F.col(packed)).drop(other, packed)


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds _place (from 0) in the order of all rows, and for each of sums its total over the rows before.

    Rows are dealt by ranges of the order; the driver gets one row of totals for each range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stable(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]).orderBy("_range").collect()
    before: dict[str, list] = {name: [0.0] * ranges for name in ("n", *sums)}
    for name, held in before.items():
        at = dict((r["_range"], r[name] or 0) for r in totals)
        for i in range(1, ranges):
            held[i] = held[i - 1] + float(at.get(i - 1, 0))
    start = lambda name: F.element_at(F.array(*[F.lit(x) for x in before[name]]), F.col("_range") + 1)
    within = Window.partitionBy("_range").orderBy(*order)
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_place", (start("n") + F.row_number().over(within) - 1).cast("long"))
    for name, c in sums.items():
        out = out.withColumn(name, start(name) + F.coalesce(F.sum(c).over(ahead), F.lit(0.0)))
    return out.drop("_range")


def sample_of(rows: DataFrame, hashed: str, n: int, *by: str) -> list[dict]:
    """About n rows (of each group by the columns `by`) with distinct hashes, for a bounded sample on the driver.

    Hashes are dealt into 16 n random buckets, whose smallest are taken by a partial aggregate; the n-th
    smallest of these is the cut. So no task meets more than 16 n hashes of a group, and whole rows are read only
    up to the cut. Of rows that share a hash the smallest counts, so repeated rows count once. Ordered by group and hash.
    """
    bucket = F.pmod(F.xxhash64(hashed, F.lit(5)), F.lit(16 * n)).alias("_b")
    minima = rows.groupBy(*by, bucket).agg(F.min(hashed).alias("_m"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_m")) if by else None
    few = minima.withColumn("_n", place).filter(F.col("_n") <= n) if by else minima.orderBy("_m").limit(n)
    cuts = few.groupBy(*by).agg(F.max("_m").alias("_m")).collect()
    if not cuts or cuts[0]["_m"] is None:
        return []
    within = F.lit(False)
    for r in cuts:
        fits = F.col(hashed) <= F.lit(r["_m"])
        for c in by:
            fits = fits & (F.col(c) == F.lit(r[c]))
        within = within | fits
    rest = [c for c in rows.columns if c not in (*by, hashed)]
    one = rows.filter(within).groupBy(*by, hashed).agg(F.min(F.struct(*rest)).alias("_r")).select(*by, hashed, "_r.*")
    got = sorted((r.asDict() for r in one.toLocalIterator()), key=lambda r: (*(r[c] for c in by), r[hashed]))
    counts: dict[tuple, int] = {}
    out = []
    for r in got:
        group = tuple(r[c] for c in by)
        counts[group] = counts.get(group, 0) + 1
        if counts[group] <= n:
            out.append(r)
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, with as many underscores as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; the folds of the contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file: in folder, else where DOCKETRY_TOKENIZERS or the installed package keeps them."""
    folder = folder or os.environ.get("DOCKETRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
