"""As-of joins: each row with the last row of another table at or before its time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staytide.functions.radix import time_chunk


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, columns: Sequence[str], width: int
) -> DataFrame:
    """Rows of `left` with `columns` of the last row of `right` of their key with right_time <= time; NULL where there is none.

    Of several at the same time, the highest by `columns` counts. Rows without a key or time find nothing. Times are whole numbers
    in any unit, `width` is that of a chunk of time: rows are sorted per (key, chunk), and each chunk's last row is
    carried to the later ones, so a key with very many rows is spread out.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    given = [F.col(k).alias(n) for k, n in zip(keys, names)]
    found = F.struct(*columns)
    rows = left.select(F.struct(*left.columns).alias("_row"), *given, F.col(time).alias("_t"), F.lit(1).alias("_side"))
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, right_time)])
    marks = right.filter(known).select(*given, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), found.alias("_found"))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_chunk", time_chunk("_t", width))

    last = F.max(F.when(F.col("_side") == 0, F.struct("_t", "_found"))).alias("_last")
    before = Window.partitionBy(*names).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = both.filter(F.col("_t").isNotNull()).groupBy(*names, "_chunk").agg(last)
    carried = heads.select(*[F.col(n).alias(f"_of{n}") for n in (*names, "_chunk")], F.last("_last", ignorenulls=True).over(before)["_found"].alias("_carried"))
    same = reduce(and_, [F.col(n) == F.col(f"_of{n}") for n in (*names, "_chunk")])
    in_chunk = Window.partitionBy(*names, "_chunk").orderBy("_t", "_side", "_found").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.join(carried, same, "left").withColumn("_own", F.last("_found", ignorenulls=True).over(in_chunk))
    chosen = F.coalesce("_own", "_carried")
    # rows without a key or time share a chunk, and no mark lies in it
    return placed.filter("_side = 1").select("_row.*", *[chosen[c].alias(c) for c in columns])
