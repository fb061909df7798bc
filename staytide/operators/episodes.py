"""Episodes: ticks that lie no further apart than a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staytide.functions.radix import time_chunk
from staytide.schemas import HOUR_US


def highest_per_time(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """One row per key and time, with the highest value of each column."""
    return df.groupBy(*keys, time).agg(*[F.max(c).alias(c) for c in columns])


def _chunk_episodes(
    ticks: DataFrame, keys: Sequence[str], time: str, gap: int, chunk_width: int, aggs: Sequence[Column]
) -> DataFrame:
    """Ticks summed up per chunk of time, with the number of the chunk's episode, from 1.

    A chunk is no wider than the gap, so all its ticks belong to one episode. A key then has
    a row per chunk, not per tick, and only these meet in one window.
    """
    if chunk_width > gap:
        raise ValueError("chunks must not be wider than the gap between episodes")
    chunks = (
        ticks.withColumn("_chunk", time_chunk(time, chunk_width))
        .groupBy(*keys, "_chunk")
        .agg(F.min(time).alias("_first"), F.max(time).alias("_last"), *aggs)
    )
    in_order = Window.partitionBy(*keys).orderBy("_chunk")
    far = F.col("_first") - F.lag("_last").over(in_order) > gap
    flagged = chunks.withColumn("_new", F.coalesce(far, F.lit(True)).cast("bigint"))
    return flagged.withColumn("episode", F.sum("_new").over(in_order))


def numbered(
    ticks: DataFrame, keys: Sequence[str], time: str, gap: int, chunk_width: int = HOUR_US
) -> DataFrame:
    """Adds a flag for the tick that starts an episode, and the episode's number from 1.

    A tick starts an episode if it is the first of its key, or more than `gap` after the one
    before. Times must be unique within a key.
    """
    chunks = _chunk_episodes(ticks, keys, time, gap, chunk_width, []).select(
        *keys, "_chunk", "episode", F.when(F.col("_new") == 1, F.col("_first")).alias("_start")
    )
    placed = ticks.withColumn("_chunk", time_chunk(time, chunk_width))
    new = F.coalesce(F.col(time) == F.col("_start"), F.lit(False)).cast("int")
    return placed.join(chunks, [*keys, "_chunk"]).select(
        *ticks.columns, new.alias("new_episode"), "episode"
    )


def episodes(
    ticks: DataFrame,
    keys: Sequence[str],
    time: str,
    gap: int,
    highest: Sequence[str],
    chunk_width: int = HOUR_US,
) -> DataFrame:
    """One row per episode: first and last tick, number of ticks, highest values."""
    aggs = [F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in highest]]
    return (
        _chunk_episodes(ticks, keys, time, gap, chunk_width, aggs)
        .groupBy(*keys, "episode")
        .agg(
            F.min("_first").alias("first_tick"),
            F.max("_last").alias("last_tick"),
            F.sum("_n").alias("n_ticks"),
            *[F.max(c).alias(c) for c in highest],
        )
    )


def episode_end(last_tick: Column, tail: int, active: Column, discharge: Column) -> Column:
    """End of an episode: its last tick and a tail, or the discharge if it was still active then."""
    usual = last_tick + tail
    return F.when(active & (usual < discharge), discharge).otherwise(usual)


def tick_intervals(ticks: DataFrame, start: str, length: int, end: str = "end") -> DataFrame:
    """Ticks as intervals of a fixed length."""
    return ticks.withColumn(end, F.col(start) + length)




def grown(stored: DataFrame, ticks: DataFrame, keys: Sequence[str], time: str, gap: int, highest: Sequence[str], chunk_width: int = HOUR_US) -> DataFrame:
    """The episodes (as of `episodes`) of the keys that have new ticks: theirs so far, and the new ticks.

    New ticks may come before, within, between or after the stored episodes, and join two of them. Only episodes of the changed keys are
    read on, a few rows per key, and only these are returned; see `with_growth` for the whole table. Each tick
    must come once over all batches.
    """
    fresh = episodes(ticks, keys, time, gap, highest, chunk_width)
    kept = stored.join(fresh.select(*keys).distinct(), list(keys), "left_semi").select(*fresh.columns)
    both = kept.unionByName(fresh)
    in_order = Window.partitionBy(*keys).orderBy("first_tick", "last_tick")
    reach = F.max("last_tick").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first_tick") - reach > gap, F.lit(True)).cast("bigint")
    # numbered anew: the flag is worked out below the running sum
    placed = both.withColumn("_opens", opens).withColumn("episode", F.sum("_opens").over(in_order))
    return placed.groupBy(*keys, "episode").agg(
        F.min("first_tick").alias("first_tick"),
        F.max("last_tick").alias("last_tick"),
        F.sum("n_ticks").alias("n_ticks"),
        *[F.max(c).alias(c) for c in highest],
    )


def with_growth(stored: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored episodes with those of the changed keys in place of theirs."""
    return stored.join(changed.select(*keys).distinct(), list(keys), "left_anti").select(*changed.columns).unionByName(changed)
