"""Counts and summaries that describe a cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.functions.values import as_col, null_if_nan
from staytide.operators.cohort import first_known
from staytide.operators.quantiles import group_medians, group_quantiles


def attrition(df: DataFrame, key: str, steps: Mapping[str, Column]) -> DataFrame:
    """Rows and distinct keys that remain after each further test: (step, n_rows, n_keys).

    All steps are counted in one pass: per key first, then over the keys.
    """
    kept = F.lit(True)
    per_key, total = [], []
    for i, test in enumerate(steps.values()):
        kept = kept & F.coalesce(test, F.lit(False))
        per_key.append(F.count_if(kept).alias(f"_s{i}"))
        total.append(
            F.struct(
                F.lit(i).alias("step_no"),
                F.lit(list(steps)[i]).alias("step"),
                F.coalesce(F.sum(f"_s{i}"), F.lit(0)).cast("bigint").alias("n_rows"),
                F.count_if(F.col(f"_s{i}") > 0).alias("n_keys"),
            )
        )
    return (
        df.groupBy(key).agg(*per_key).agg(F.array(*total).alias("_t")).select(F.inline("_t"))
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df: DataFrame, key: str, label: str, order: Sequence[str]) -> DataFrame:
    """Stays per label; a stay's label is its first known one."""
    return df.groupBy(key).agg(first_known(label, order).alias(label)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, lowest, quartiles and highest value, one row per column."""
    known = {c: null_if_nan(F.col(c).cast("double")) for c in columns}
    stats = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("measure"),
                    F.count(v).alias("n"),
                    F.avg(v).alias("mean"),
                    F.stddev_samp(v).alias("std"),
                    F.min(v).alias("min"),
                    F.max(v).alias("max"),
                )
                for c, v in known.items()
            ]
        ).alias("_s")
    ).select(F.inline("_s"))
    quartiles = group_quantiles(df, [], columns, [0.25, 0.5, 0.75]).select(
        "measure", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )
    return stats.join(quartiles, "measure", "left")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("measure"), F.count_if(F.col(c).isNull()).alias("n_null"))
                for c in columns
            ]
        ).alias("_n")
    ).select(F.inline("_n"))


def split_counts(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Rows below and from a limit on, one row per column."""
    return df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("measure"),
                    F.count_if(F.col(c) < limit).alias("n_below"),
                    F.count_if(F.col(c) >= limit).alias("n_from"),
                )
                for c, limit in limits.items()
            ]
        ).alias("_n")
    ).select(F.inline("_n"))


def group_count(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Number of distinct key combinations, and of rows."""
    per_group = df.groupBy(*[as_col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return per_group.agg(
        F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows")
    )


def multi_row_keys(df: DataFrame, key: str) -> DataFrame:
    return value_counts(df, key).filter(F.col("n") > 1)


def fill_median(df: DataFrame, columns: Sequence[str], over: DataFrame | None = None) -> DataFrame:
    """Missing values become the median over all rows of the column, in `df` or in `over`."""
    source = df if over is None else over
    medians = group_medians(source, [], {c: f"_median_{c}" for c in columns})
    # one row, so this side has a fixed size
    filled = df.crossJoin(F.broadcast(medians))
    return filled.withColumns({c: F.coalesce(c, f"_median_{c}") for c in columns}).drop(
        *[f"_median_{c}" for c in columns]
    )
