"""Exact medians and quantiles without holding a group in one task.

Spark's own `median` keeps all distinct values of a group in one buffer. Here equal values
are counted first, then chunk totals tell which chunk holds the wanted rank, and only that
chunk is sorted. Several columns share one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staytide.functions.radix import number_chunk
from staytide.functions.values import null_if_nan


def _rank(n: Column, q: float) -> Column:
    return (n - 1) * F.lit(float(q))


def _bracket(n: Column, q: float) -> tuple[Column, Column]:
    """The two ranks, from 0, between which a quantile lies."""
    low = F.floor(_rank(n, q))
    return low, F.least(low + 1, n - 1)


def _values_near(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], quantiles: Sequence[float]
) -> DataFrame:
    """The values around each wanted rank: (keys, measure, value, n, _upto).

    `measure` is the place of the column in `columns`; `_upto` counts the group's values up to
    this one, `n` all of them.
    """
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("measure"), null_if_nan(F.col(c).cast("double")).alias("value"))
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("_m"),
    ).select(*keys, "_m.measure", "_m.value")
    known = [F.col(c).isNotNull() for c in (*keys, "value")]
    counts = (
        long.filter(reduce(and_, known))
        .groupBy(*keys, "measure", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_chunk", number_chunk("value"))
        # said here as well as by the join below: both uses of the counts then share one shuffle
        .filter(F.col("_chunk").isNotNull())
    )
    group = [*keys, "measure"]

    everything = Window.partitionBy(*group)
    upto = F.sum("_n").over(everything.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0))
    chunks = (
        counts.groupBy(*group, "_chunk")
        .agg(F.sum("_n").alias("_n"))
        .select(*group, "_chunk", "_n", upto.alias("_upto"), F.sum("_n").over(everything).alias("n"))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )
    wanted = F.lit(False)
    for q in quantiles:
        for rank in _bracket(F.col("n"), q):
            wanted = wanted | ((rank >= F.col("_before")) & (rank < F.col("_upto")))
    holding = chunks.filter(wanted).select(
        *[F.col(c).alias(f"_key_{c}") for c in group], F.col("_chunk").alias("_key_chunk"), "_before", "n"
    )

    # plain equality, so the shuffle of the join also serves the window after it
    same = F.col("_chunk") == F.col("_key_chunk")
    for c in group:
        same = same & (F.col(c) == F.col(f"_key_{c}"))
    in_chunk = (
        Window.partitionBy(*group, "_chunk")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return counts.join(holding, same).select(
        *group, "value", "n", (F.col("_before") + F.sum("_n").over(in_chunk)).alias("_upto")
    )


def _at_rank(rank: Column, test: Column) -> Column:
    return F.min(F.when(test & (F.col("_upto") > rank), F.col("value")))


def group_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], quantiles: Sequence[float]
) -> DataFrame:
    """One row per group and column: (keys, measure, n, q0, q1, ...), interpolated linearly.

    Missing values and rows with a missing key are left out; a group without values gives no row.
    """
    n, found, out = F.col("n"), [], []
    for i, q in enumerate(quantiles):
        low, high = _bracket(n, q)
        found += [
            _at_rank(low, F.lit(True)).alias(f"_low{i}"),
            _at_rank(high, F.lit(True)).alias(f"_high{i}"),
        ]
        share = _rank(n, q) - F.floor(_rank(n, q))
        out.append((F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * share).alias(f"q{i}"))
    near = _values_near(df, keys, columns, quantiles)
    picked = near.groupBy(*keys, "measure").agg(F.max("n").alias("n"), *found)
    name = F.array(*[F.lit(c) for c in columns])[F.col("measure")]
    return picked.select(*keys, name.alias("measure"), "n", *out)


def group_medians(df: DataFrame, keys: Sequence[str], columns: dict[str, str] | Sequence[str]) -> DataFrame:
    """One row per group with the exact median of each column.

    A group whose values are all missing has a row only if another column of it has values.
    """
    names = columns if isinstance(columns, dict) else {c: c for c in columns}
    low, high = _bracket(F.col("n"), 0.5)
    odd = F.col("n") % 2 == 1
    middle = []
    for i, out in enumerate(names.values()):
        own = F.col("measure") == i
        upper = _at_rank(F.when(odd, low).otherwise(high), own)
        middle.append(((_at_rank(low, own) + upper) / 2).alias(out))
    return _values_near(df, keys, list(names), [0.5]).groupBy(*keys).agg(*middle)
