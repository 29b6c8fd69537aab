"""Event streams: the batch operators' logic over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; ts becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts and sums for each window and key; events later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def with_bands(events: DataFrame, rules, amount_col: str = "value") -> DataFrame:
    """Amount bands (a literal rule array) on a stream; stateless."""
    from docketry.operators.rules import first, open_low_closed_high

    return events.withColumn("band", first(rules, lambda r: open_low_closed_high(F.col(amount_col), r["amount_min"], r["amount_max"])))
