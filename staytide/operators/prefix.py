"""Running totals, ranks and lags of groups that may be too large for one task.

Each operator takes a chunk column that rises with the order of the rows. Rows are sorted
within (group, chunk). What a chunk needs to know of the chunks before it, a few numbers per
group, is worked out apart and goes in front of its rows. So no task ever holds a whole
group, the rows are shuffled once, and key columns may be NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staytide.functions.values import as_col


def sums_before(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[Column | str],
    sums: Mapping[str, Column | str],
) -> DataFrame:
    """Adds, per name in `sums`, the sum over the earlier rows of the same group.

    `order` must order the rows of a (group, chunk) fully.
    """
    earlier_chunks = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, chunk).agg(*[F.sum(c).alias(f"_total_{n}") for n, c in sums.items()])
    heads = totals.select(
        *keys,
        chunk,
        F.lit(0).alias("_place"),
        *[F.coalesce(F.sum(f"_total_{n}").over(earlier_chunks), F.lit(0)).alias(f"_add_{n}") for n in sums],
    )
    rows = df.select(
        "*", F.lit(1).alias("_place"), *[as_col(c).alias(f"_add_{n}") for n, c in sums.items()]
    )
    earlier = (
        Window.partitionBy(*keys, chunk).orderBy("_place", *order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.unionByName(heads, allowMissingColumns=True)
        .select(*df.columns, "_place", *[F.sum(f"_add_{n}").over(earlier).alias(n) for n in sums])
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def row_ranks(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """Adds the number of earlier rows of the same group: 0, 1, 2, ..."""
    return sums_before(df, keys, chunk, order, {name: F.lit(1).cast("bigint")})


def lag_in_group(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Adds `value` of the row before, within the group; NULL in its first row."""
    # where the order begins with the value itself, the last value is just the highest
    last = F.max(value) if order[0] == value else F.max_by(value, F.struct(*order))
    by_chunk = Window.partitionBy(*keys).orderBy(chunk)
    heads = (
        df.groupBy(*keys, chunk)
        .agg(last.alias("_last"))
        .select(*keys, chunk, F.lit(0).alias("_place"), F.lag("_last").over(by_chunk).alias("_value"))
    )
    rows = df.select("*", F.lit(1).alias("_place"), F.col(value).alias("_value"))
    in_chunk = Window.partitionBy(*keys, chunk).orderBy("_place", *order)
    return (
        rows.unionByName(heads, allowMissingColumns=True)
        .select(*df.columns, "_place", F.lag("_value").over(in_chunk).alias(name))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )
