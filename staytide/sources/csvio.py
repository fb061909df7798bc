"""CSV and Parquet in and out, with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from staytide.functions.clock import duration_us, elapsed_us, timestamp_or_null
from staytide.functions.values import null_if_nan


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The declared columns of CSV files with a header, by name; other columns are skipped.

    The header gives the order of the columns, the schema their types, so the files are read once and columns can be
    pruned. An absent column raises; so does a file whose header differs from the others'.
    """
    return _reader(spark, path, schema).csv(path).select(*schema.names)


def _reader(spark: SparkSession, path: str, schema: StructType):
    """A reader for files whose header holds the declared columns, in any order, among others."""
    header = spark.read.option("header", True).csv(path).columns
    absent = [n for n in schema.names if n not in header]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    fields = [schema[n] if n in schema.names else StructField(n, StringType()) for n in header]
    return spark.read.schema(StructType(fields)).option("header", True).option("enforceSchema", False)


def _as_text(schema: StructType, names: Sequence[str]) -> StructType:
    return StructType([StructField(f.name, StringType()) if f.name in names else f for f in schema])


def coerce(df: DataFrame, timestamps: Sequence[str] = (), durations: Sequence[str] = ()) -> DataFrame:
    """Text columns as timestamps, or as microseconds; text that is neither becomes NULL."""
    return df.withColumns(
        {
            **{c: timestamp_or_null(c) for c in timestamps},
            **{c: duration_us(c) for c in durations},
        }
    )


def read_events(
    spark: SparkSession,
    path: str,
    schema: StructType,
    timestamps: Sequence[str] = (),
    durations: Sequence[str] = (),
    numbers: Sequence[str] = (),
) -> DataFrame:
    """Event CSV; bad times and NaN values are missing values."""
    df = read_csv(spark, path, _as_text(schema, [*timestamps, *durations]))
    df = coerce(df, timestamps, durations)
    return df.withColumns({c: null_if_nan(c) for c in numbers}) if numbers else df


def with_length(stays: DataFrame, start: str, end: str, out: str = "length_us") -> DataFrame:
    return stays.withColumn(out, elapsed_us(start, end))


def read_stays(spark: SparkSession, path: str, schema: StructType, start: str, end: str) -> DataFrame:
    """Stays CSV with their length in microseconds."""
    return with_length(read_events(spark, path, schema, timestamps=[start, end]), start, end)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet") -> None:
    """One folder per value of `by`. Rows are balanced first: a huge value is split over several
    files, and many small ones share a task."""
    writer = df.hint("rebalance", *[F.col(c) for c in by]).write.partitionBy(*by).mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def read_batches(spark: SparkSession, root: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """All batch folders below a root (`.../batch_<i>/`) as one frame, with the number of the batch."""
    path = f"{root}/batch_*"
    reader = _reader(spark, path, schema) if fmt == "csv" else spark.read.schema(schema)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch_(\d+)/", 1).cast("int")
    return reader.format(fmt).load(path).select(*schema.names, number.alias("batch"))
