"""Exact medians of many overlapping windows from counts per pane, each event shuffled once however many windows hold it.

The ends of all windows cut time into panes, so that a window is a run of panes. Equal values of a key are counted per pane before
the shuffle; counts add up, so a window's count of a value, or of a chunk of values, is a sum over its panes. Chunk totals of
all windows tell which chunk holds the middle rank of each; only those chunks meet the windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staytide.functions.clock import window_test
from staytide.functions.radix import number_chunk
from staytide.functions.values import null_if_nan


def edges_of(windows: Sequence[tuple[int, int]]) -> list[int]:
    return sorted({t for w in windows for t in w})


def pane_of(offset: str, edges: Sequence[int]) -> Column:
    """Number of the pane that holds an offset between the first and the last edge."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(offset))) - 1


def _within(windows: Sequence[tuple[int, int]], edges: Sequence[int]) -> list[tuple[int, int]]:
    """First and last pane of each window."""
    return [(edges.index(lo), edges.index(hi) - 1) for lo, hi in windows]


def pane_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], offset: str, edges: Sequence[int]) -> DataFrame:
    """(keys, measure, value, pane, n, chunk): how often a key has a value in a pane. Missing keys and values are left out."""
    measures = [F.struct(F.lit(i).alias("measure"), null_if_nan(F.col(c).cast("double")).alias("value")) for i, c in enumerate(columns)]
    rows = df.filter(window_test(offset, edges[0], edges[-1])).select(*keys, pane_of(offset, edges).alias("pane"), F.inline(F.array(*measures)))
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, "value")])
    counts = rows.filter(known).groupBy(*keys, "measure", "value", "pane").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("chunk", number_chunk("value")).filter(F.col("chunk").isNotNull())


def window_medians(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], offset: str, windows: Sequence[tuple[int, int]], window: str = "window"
) -> DataFrame:
    """(keys, window, columns): the median of each column over each window, NULL where a key has no value of it there.

    Windows are half-open, and numbered from 0 in the given order; a key and window without any value gives no row.
    """
    edges = edges_of(windows)
    spans = _within(windows, edges)
    counts = pane_counts(df, keys, columns, offset, edges)
    group = [*keys, "measure"]
    every, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)

    inside = [F.col("pane").between(a, z) for a, z in spans]
    totals = counts.groupBy(*group, "chunk").agg(
        *[F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("bigint")).alias(f"n{i}") for i, test in enumerate(inside)]
    )
    sums = [F.sum(f"n{i}").over(over).alias(f"{name}{i}") for i in range(len(spans)) for name, over in (("upto", upto), ("all", every))]
    running = totals.select("*", *sums)
    seen = F.array(
        *[
            F.struct(
                F.lit(i).alias(window), F.lit(a).alias("first"), F.lit(z).alias("last"), (F.col(f"upto{i}") - F.col(f"n{i}")).alias("before"),
                F.col(f"upto{i}").alias("upto"), F.floor((F.col(f"all{i}") - 1) / 2).alias("low"), F.floor(F.col(f"all{i}") / 2).alias("high"),
            )
            for i, (a, z) in enumerate(spans)
        ]
    )

    def holds(w: Column) -> Column:
        return (w["upto"] > w["before"]) & ((w["low"] >= w["before"]) & (w["low"] < w["upto"]) | (w["high"] >= w["before"]) & (w["high"] < w["upto"]))

    holding = running.select(*[F.col(c).alias(f"_key_{c}") for c in (*group, "chunk")], F.inline(F.filter(seen, holds))).drop("upto")
    same = reduce(and_, [F.col(c) == F.col(f"_key_{c}") for c in (*group, "chunk")])
    met = counts.join(holding, same).filter(F.col("pane").between(F.col("first"), F.col("last")))
    # the frame takes in equal values, which may lie in several panes
    in_chunk = Window.partitionBy(*group, "chunk", window).orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    placed = met.select(*group, "value", window, "low", "high", (F.col("before") + F.sum("n").over(in_chunk)).alias("upto"))

    def at_rank(rank: str, i: int) -> Column:
        return F.min(F.when((F.col("measure") == i) & (F.col("upto") > F.col(rank)), F.col("value")))

    return placed.groupBy(*keys, window).agg(*[((at_rank("low", i) + at_rank("high", i)) / 2).alias(c) for i, c in enumerate(columns)])


def window_maxima(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], offset: str, windows: Sequence[tuple[int, int]], window: str = "window"
) -> DataFrame:
    """(keys, window, columns): the highest value of each column over each window; combined before the one shuffle."""
    ends = [min(lo for lo, _ in windows), max(hi for _, hi in windows)]
    known = reduce(and_, [F.col(c).isNotNull() for c in keys])
    inside = [window_test(offset, lo, hi) for lo, hi in windows]
    highest = [F.max(F.when(test, F.col(c))).alias(f"x{i}_{k}") for i, test in enumerate(inside) for k, c in enumerate(columns)]
    seen = [F.max(test).alias(f"seen{i}") for i, test in enumerate(inside)]
    rows = df.filter(window_test(offset, *ends) & known).groupBy(*keys).agg(*highest, *seen)
    each = F.array(
        *[
            F.struct(F.lit(i).alias(window), F.col(f"seen{i}").alias("seen"), *[F.col(f"x{i}_{k}").alias(c) for k, c in enumerate(columns)])
            for i in range(len(windows))
        ]
    )
    return rows.select(*keys, F.inline(F.filter(each, lambda w: w["seen"]))).drop("seen")
