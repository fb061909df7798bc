"""One feature row per stay, and cohorts for many windows at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.functions.clock import window_test
from staytide.operators import panes
from staytide.operators.quantiles import group_medians


def first_known(c: str, order: Sequence[str]) -> Column:
    """First value that is not missing, in the given order; among equals the lowest, so a lost
    task gives the same value again."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order, c)))


def collapse(
    df: DataFrame,
    keys: Sequence[str],
    spec: Mapping[str, str],
    order: Sequence[str],
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per key. `spec` maps a column to "median", "first", "max", "min", "sum" or "count".

    Medians skip missing values, "first" is the first known value in `order`. Rows with a
    missing key are left out. Every aggregate but the median is combined before the shuffle,
    and the median counts equal values first, so one huge stay is no trouble.
    """
    rename = rename or {}
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    simple = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    aggs = [
        (first_known(c, order) if how == "first" else simple[how](c)).alias(rename.get(c, c))
        for c, how in spec.items()
        if how != "median"
    ]
    medians = {c: rename.get(c, c) for c, how in spec.items() if how == "median"}
    if not medians:
        return df.groupBy(*keys).agg(*aggs)
    middle = group_medians(df, keys, medians)
    if not aggs:
        return middle
    wanted = [*keys, *[rename.get(c, c) for c in spec]]
    return df.groupBy(*keys).agg(*aggs).join(middle, list(keys), "left").select(*wanted)


def side_by_side(m1: DataFrame, m2: DataFrame, value: str) -> DataFrame:
    """Events of two measurements in one frame, each in a column of its own.

    Both can then shrink to one row per key in one pass, instead of two and a join.
    """
    return m1.withColumnRenamed(value, "m1_valuenum").unionByName(
        m2.withColumnRenamed(value, "m2_valuenum"), allowMissingColumns=True
    )


def pair_measurements(
    m1: DataFrame, m2: DataFrame, keys: Sequence[str], value: str, window: tuple[int, int], offset: str
) -> DataFrame:
    """Medians of two measurements within a window, for keys that have both.

    Pairing all values first and taking medians of the pairs gives the same medians; here no
    pair is ever made. `n_pairs` is the number of such pairs.
    """
    m1, m2 = (df.filter(window_test(offset, *window)).select(*keys, value) for df in (m1, m2))
    both = side_by_side(m1, m2, value).withColumns({"n_m1": F.col("m1_valuenum"), "n_m2": F.col("m2_valuenum")})
    spec = {"m1_valuenum": "median", "m2_valuenum": "median", "n_m1": "count", "n_m2": "count"}
    return (
        collapse(both, keys, spec, order=[])
        .filter((F.col("n_m1") > 0) & (F.col("n_m2") > 0))
        .withColumn("n_pairs", F.col("n_m1") * F.col("n_m2"))
    )


def window_starts(moments: Sequence[int], lengths: Sequence[int]) -> list[tuple[int, int]]:
    """(length, moment) pairs of windows that do not begin before admission."""
    return [(w, m) for w in lengths for m in moments if m >= w]


def sweep(
    m1: DataFrame,
    m2: DataFrame,
    keys: Sequence[str],
    offset: str,
    value: str,
    labels: Mapping[int, str],
    moments: Sequence[int],
    lengths: Sequence[int],
    unit: int,
) -> DataFrame:
    """Cohorts of all windows and outcome spans in one plan: (keys, pw, mop, ow, medians, label).

    `labels` maps an outcome span to its 0/1 column on the events of m1; the label of a stay
    is the highest one within the window. Events are shuffled as counts per pane, once for all windows.
    """
    named = window_starts(moments, lengths)
    windows = [((m - w) * unit, m * unit) for w, m in named]
    events = side_by_side(m1.select(*keys, offset, value), m2.select(*keys, offset, value), value)
    measures = ["m1_valuenum", "m2_valuenum"]
    medians = panes.window_medians(events, keys, measures, offset, windows).dropna(subset=measures)
    highest = panes.window_maxima(m1, keys, list(labels.values()), offset, windows)
    names = F.array(*[F.struct(F.lit(w).alias("pw"), F.lit(m).alias("mop")) for w, m in named])
    outcomes = F.array(*[F.struct(F.lit(h).alias("ow"), F.col(c).alias("label")) for h, c in labels.items()])
    rows = medians.join(highest, [*keys, "window"]).withColumn("_w", names[F.col("window")]).withColumn("_o", F.explode(outcomes))
    return rows.select(*keys, "_w.pw", "_w.mop", "_o.ow", *measures, "_o.label")
