"""Cohorts of two sources as one table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staytide.functions.values import in_range

# Age that stands for an unknown one, and lowest plausible height.
UNKNOWN_AGE = 64
LEAST_HEIGHT = 50


def tagged_union(frames: Mapping[str, DataFrame], tag: str = "data_source") -> DataFrame:
    """Frames below each other by column name, with the name of their source."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def pooled_cohort(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Union of sources: unknown ages filled, implausible heights left out, label named `death`."""
    both = tagged_union(frames).withColumn("age", F.coalesce("age", F.lit(UNKNOWN_AGE).cast("double")))
    return both.filter((F.col("height") > LEAST_HEIGHT) & in_range("height")).withColumnRenamed(label, "death")


def pooled_by_moment(frames: Mapping[int, Mapping[str, DataFrame]], label: str) -> DataFrame:
    """Pooled cohorts of several moments of prediction, with the moment as column `mop`."""
    out = None
    for mop, sources in frames.items():
        part = pooled_cohort(sources, label).withColumn("mop", F.lit(mop))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
