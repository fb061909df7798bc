"""Runs in batches that can stop and go on: a batch counts once it stands in the manifest, and a rerun computes the missing ones.

Each batch goes to a folder of its own; its line in the manifest is written after it, as one file, which Spark's commit makes
visible at once or not at all. Readers go by the manifest, so a folder of a run that was stopped is never read, and if two
runs publish the same batch the first line holds.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch int, folder string, committed_ns bigint"


def committed(spark: SparkSession, root: str) -> dict[int, str]:
    """Folder of each published batch. A line per batch, not per row, reaches the driver."""
    lines = spark.createDataFrame([], MANIFEST)
    # makes the manifest if there is none, and adds nothing if there is one
    lines.write.mode("append").parquet(f"{root}/manifest")
    found = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").groupBy("batch")
    return {r.batch: r.folder for r in found.agg(F.min_by("folder", F.struct("committed_ns", "folder")).alias("folder")).collect()}


def publish(spark: SparkSession, root: str, batch: int, rows: DataFrame) -> None:
    folder = f"batch_{batch}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{folder}")
    line = spark.createDataFrame([(batch, folder, time.time_ns())], MANIFEST)
    line.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def run_batches(spark: SparkSession, root: str, batches: Iterable[int], compute: Callable[[int], DataFrame]) -> list[int]:
    """Computes and publishes the batches that the manifest lacks, one after the other; their numbers."""
    done = committed(spark, root)
    missing = [b for b in batches if b not in done]
    for batch in missing:
        publish(spark, root, batch, compute(batch))
    return missing


def read_committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All published batches as one frame, with the number of the batch. `schema` names the columns."""
    folders = committed(spark, root)
    if not folders:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("int"))
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch_(\d+)-[0-9a-f]{32}/", 1).cast("int")
    rows = spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders.values()])
    return rows.select("*", number.alias("batch"))
