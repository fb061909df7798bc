"""Joins on keys. Sides are broadcast by Spark itself, below its own size limit.

Skewed keys of these joins are left to Spark's adaptive skew join; no side is replicated
here and none is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_dimension(facts: DataFrame, dimension: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Facts with the attributes of a table that has one row per key."""
    return facts.join(dimension, list(on), how)


def keep_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_semi")


def keep_listed_parents(df: DataFrame, listed: DataFrame, key: str, parent: str) -> DataFrame:
    """All rows of a parent if any of its keys is listed."""
    parents = keep_listed(df, listed, key).select(parent).distinct()
    return df.join(parents, parent, "left_semi")


def drop_parents(df: DataFrame, bad: DataFrame, parent: str) -> DataFrame:
    """No row of a parent that has any bad row. A NULL parent stays."""
    return df.join(bad.select(parent).distinct(), parent, "left_anti")


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().intersect(right.select(key).distinct())


def counted_null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], attribute: str
) -> DataFrame:
    """Left many-to-many join in which NULL keys meet, as (keys, attribute, n) with n equal rows.

    Equal rows are counted before the join, so copies never multiply.
    """
    lefts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_left"))
    rights = (
        right.groupBy(*keys, attribute)
        .agg(F.count(F.lit(1)).alias("_right"))
        .withColumnsRenamed({k: f"_key_{k}" for k in keys})
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return lefts.join(rights, same, "left").select(
        *keys, attribute, (F.col("_left") * F.coalesce(F.col("_right"), F.lit(1))).alias("n")
    )
