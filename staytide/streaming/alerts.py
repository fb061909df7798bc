"""Alerts for stays that depart from their target, on a stream or a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from staytide.session import shared_dir


def window_means(events: DataFrame, key: str, time: str, value: str, width: str) -> DataFrame:
    """Mean value per key and time window; combined before the shuffle, one small state per window."""
    return (
        events.groupBy(key, F.window(time, width).alias("_w"))
        .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n_events"))
        .select(
            key, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
            "mean_value", "n_events",
        )
    )


def deviations(means: DataFrame, targets: DataFrame, key: str, target: str, tolerance: float) -> DataFrame:
    """Windows whose mean is further than `tolerance` from the target of their key."""
    return (
        means.join(targets.select(key, target), key)
        .withColumn("deviation", F.col("mean_value") - F.col(target))
        .filter(F.abs("deviation") > tolerance)
    )


def alerts(
    events: DataFrame,
    targets: DataFrame,
    key: str,
    time: str,
    value: str,
    target: str,
    width: str,
    tolerance: float,
    delay: str | None = None,
) -> DataFrame:
    """The same plan for both kinds of input; `delay` is the watermark of a stream."""
    if delay is not None:
        events = events.withWatermark(time, delay)
    return deviations(window_means(events, key, time, value, width), targets, key, target, tolerance)


def event_stream(
    spark: SparkSession, path: str, schema: StructType, files: str = "*.parquet", files_per_batch: int = 100
) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Runs a stream over what its source holds now, and reads back the table it wrote.

    Offsets, state and output lie in `folder`; called again with the same one, the stream goes on where it
    ended. Without it, a new folder in the shared one is taken, for a single run.
    """
    spark = stream.sparkSession
    root = folder or shared_dir(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
