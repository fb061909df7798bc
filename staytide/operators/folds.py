"""Folds, row ranges, and the first row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.functions.radix import number_chunk, text_chunk
from staytide.operators.prefix import row_ranks


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1; each label is dealt out evenly in the order of a hash of its keys."""
    hashed = df.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))))
    placed = hashed.withColumn("_chunk", text_chunk("_hash"))
    ranked = row_ranks(placed, [label], "_chunk", ["_hash", key], "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_hash", "_chunk", "_rank")


def _spread(df: DataFrame, key: str) -> Column:
    """Chunk of a numeric key by its distance from the smallest one, so that large, close keys spread too."""
    return number_chunk(F.col(key) - df.agg(F.min(key)).scalar())


def contiguous_folds(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Adds fold 0..k-1; rows in the order of a unique numeric key, cut into k runs of equal length.

    The first folds take one row more each if the rows do not divide evenly.
    """
    placed = df.withColumn("_chunk", _spread(df, key))
    ranked = row_ranks(placed, [], "_chunk", [key], "_rank")
    n = df.agg(F.count(F.lit(1))).scalar()
    size, extra = F.floor(n / k), n % k
    long_part = extra * (size + 1)
    fold = F.when(F.col("_rank") < long_part, F.floor(F.col("_rank") / (size + 1))).otherwise(
        extra + F.floor((F.col("_rank") - long_part) / F.greatest(size, F.lit(1)))
    )
    return ranked.withColumn("fold", fold.cast("int")).drop("_chunk", "_rank")


def row_range(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Rows start..end-1 in the order of a unique numeric key."""
    placed = df.withColumn("_chunk", _spread(df, key))
    ranked = row_ranks(placed, [], "_chunk", [key], "_rank")
    return ranked.filter((F.col("_rank") >= start) & (F.col("_rank") < end)).drop("_chunk", "_rank")


def subset(fold: int) -> Column:
    return F.when(F.col("fold") == fold, "test").otherwise("train")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole first row of each key. An aggregate, so rows shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)
