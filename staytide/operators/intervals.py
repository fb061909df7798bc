"""Joins of events with the intervals they fall into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.functions.radix import time_chunk
from staytide.session import materialize

# Longest interval in mean intervals up to which one width of buckets serves all.
EVEN = 16
# Bits between two levels of bucket widths, and pieces that a key's time of events is cut into at least.
LEVEL_BITS = 3
SPAN_PIECES = 32


def interval_join(
    events: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    end: str,
    how: str = "left",
    closed: bool = False,
    pieces: int = 4,
) -> DataFrame:
    """Events with each interval of their key that holds them: start <= time < end.

    With `closed` the end belongs to the interval too. Overlapping intervals repeat an
    event; with how="left" an event without interval stays, with NULL attributes. Times
    are whole numbers in any unit.

    The join key is (key, bucket of time), so a key with very many events and intervals is
    spread out. While no interval is much longer than the mean one, a bucket is the mean interval cut into
    `pieces`: intervals then touch pieces + 2 buckets on average at most, and each event lies in
    exactly one. Lengths that differ more are joined by levels (`by_levels`). One row about the
    intervals' lengths decides, read when the plan is made.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    last = F.col(end) - (0 if closed else 1)
    valid = intervals.filter(F.col(start) <= last).withColumnsRenamed({k: f"_key_{k}" for k in keys})
    length = F.col(end) - F.col(start)
    sizes = valid.agg(F.ceil(F.avg(length)).alias("mean"), F.max(length).alias("longest")).first()
    if sizes["longest"] is not None and sizes["longest"] > EVEN * max(1, sizes["mean"]):
        return by_levels(events, valid.withColumn("_last", last), keys, time, start, how)
    width = max(1, -(-int(sizes["mean"] or 1) // pieces))
    bucket = [time_chunk(t, width) for t in (F.col(start), last)]
    spread = valid.withColumn("_key_bucket", F.explode(F.sequence(*bucket)))
    placed = events.withColumn("_bucket", time_chunk(time, width))
    same = F.col("_bucket") == F.col("_key_bucket")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    holds = (F.col(time) >= F.col(start)) & (F.col(time) <= last)
    return placed.join(spread, same & holds, how).drop("_bucket", "_key_bucket", *[f"_key_{k}" for k in keys])


def leveled(events: DataFrame, valid: DataFrame, keys: Sequence[str], time: str, start: str) -> DataFrame:
    """Intervals cut to the events' time of their key, with a level each: _from, _to, _level. `valid` has _key_<key> and _last.

    A level's buckets are a power of 2 ** LEVEL_BITS wide. An interval's level is that of its own length, so it touches few
    buckets; but no bucket is wider than a piece of the key's time, so that an open end does not put all events of
    a key into one. Intervals that hold no event's time drop out. `events` is read for the first and last time of each key.
    """
    spans = events.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.min(time).alias("_first_time"), F.max(time).alias("_last_time"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"_key_{k}") == F.col(f"_of_{k}"))
    met = valid.join(spans, same)
    begin, stop = F.greatest(start, "_first_time"), F.least("_last", "_last_time")

    def level(length):
        return F.floor(F.log2(F.greatest(F.lit(1.0), length.cast("double"))) / LEVEL_BITS).cast("int")

    own, most = level(stop - begin), level((F.col("_last_time") - F.col("_first_time")) / SPAN_PIECES)
    cut = met.withColumns({"_from": begin, "_to": stop}).filter("_from <= _to").withColumn("_level", F.least(own, most))
    return cut.drop("_first_time", "_last_time", *[f"_of_{k}" for k in keys])


def level_width(level: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(level) * LEVEL_BITS)


def by_levels(events: DataFrame, valid: DataFrame, keys: Sequence[str], time: str, start: str, how: str) -> DataFrame:
    """The join for intervals of very different lengths.

    Each event probes the levels in use, which are few: one per power of 2 ** LEVEL_BITS among the lengths. Events
    that find nothing are those without a match on (key, time), as that alone decides. The cut intervals are written once,
    as their levels are read off them first.
    """
    cut = materialize(leveled(events, valid, keys, time, start), "leveled")
    levels = [r[0] for r in cut.select("_level").distinct().orderBy("_level").collect()]
    named = [c for c in cut.columns if c not in ("_last", "_from", "_to", "_level") and c not in {f"_key_{k}" for k in keys}]
    if not levels:
        rest = cut.select(*named).limit(0)
        return events.join(rest, F.lit(False), how)
    width = level_width("_level")
    spread = cut.withColumn("_key_bucket", F.explode(F.sequence(time_chunk("_from", width), time_chunk("_to", width)))).withColumnRenamed("_level", "_key_level")
    placed = events.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("_bucket", time_chunk(time, width))
    same = (F.col("_level") == F.col("_key_level")) & (F.col("_bucket") == F.col("_key_bucket"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    holds = F.col(time).between(F.col("_from"), F.col("_to"))
    columns = [*events.columns, *named]
    if how == "inner" or len(levels) == 1:
        return placed.join(spread, same & holds, how).select(*columns)
    met = placed.join(spread, same & holds).select(*columns)
    points = met.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(time).alias("_of_time")).distinct()
    same = F.col(time) == F.col("_of_time")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_of_{k}"))
    return met.unionByName(events.join(points, same, "left_anti"), allowMissingColumns=True).select(*columns)
