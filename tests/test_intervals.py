"""Interval joins of lengths that differ by orders of magnitude, against all pairs, and their buckets."""

import random

import pytest
from pyspark.sql import functions as F

from staytide.functions.radix import time_chunk
from staytide.operators import intervals

OPEN = 9_000_000_000_000


def data(n_events=400, n_spans=300, seed=3):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", None])
    events = [(i, key(), rnd.choice([rnd.randrange(3_600_000), rnd.randrange(0, 3_600_000, 60_000)])) for i in range(n_events)]
    events += [(n_events, "hot", None), (n_events + 1, "alone", 77), (0, "hot", 5), (0, "hot", 5)]
    spans = []
    for i in range(n_spans):
        start = rnd.randrange(-100_000, 3_600_000)
        length = rnd.choice([0, 1, 50, 3_000, 3_000, 60_000, 900_000]) + rnd.randrange(3)
        spans.append((rnd.choice([key(), "none"]), start, OPEN if i % 60 == 0 else start + length, i))
    spans += [("a", None, 10, 900), ("a", 5, None, 901), ("b", 10, 3, 902)]
    return events, spans


def plain(events, spans, how, closed):
    out = []
    for i, k, t in events:
        met = [
            x
            for key, s, e, x in spans
            if None not in (k, t, s, e) and key == k and s <= t and (t <= e if closed else t < e)
        ]
        out += [(i, k, t, x) for x in met] or ([(i, k, t, None)] if how == "left" else [])
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("closed", [False, True])
def test_all_lengths(spark, how, closed):
    events, spans = data()
    e = spark.createDataFrame(events, "id long, k string, t long")
    s = spark.createDataFrame(spans, "k string, s long, e long, x long")
    got = intervals.interval_join(e, s, ["k"], "t", "s", "e", how=how, closed=closed).select("id", "k", "t", "x")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(events, spans, how, closed)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_long_intervals_without_events(spark, how):
    events = spark.createDataFrame([(1, "a", 5)], "id long, k string, t long")
    spans = spark.createDataFrame([("b", 0, 1, 1)] * 40 + [("b", 0, OPEN, 2)], "k string, s long, e long, x long")
    got = [tuple(r) for r in intervals.interval_join(events, spans, ["k"], "t", "s", "e", how=how).select("id", "x").collect()]
    assert got == ([(1, None)] if how == "left" else [])


def test_open_ends_leave_no_large_bucket(spark):
    """One interval in a hundred without an end: no bucket holds a twentieth of a key's events, and intervals touch few."""
    n = F.col("id")
    events = spark.range(40_000).select((n % 2).alias("k"), ((n * 7919) % 3_600_000).alias("t"))
    begin = (n * 104_729) % 3_600_000
    spans = spark.range(4_000).select((n % 2).alias("k"), begin.alias("s"), F.when(n % 100 == 0, OPEN).otherwise(begin + 5_000).alias("e"))
    valid = spans.withColumn("_last", F.col("e") - 1).withColumnRenamed("k", "_key_k")
    cut = intervals.leveled(events, valid, ["k"], "t", "s")
    width = intervals.level_width("_level")
    spread = cut.select("_key_k", "_level", F.explode(F.sequence(time_chunk("_from", width), time_chunk("_to", width))).alias("bucket"))
    assert spread.count() < 20 * spans.count()
    levels = [r[0] for r in cut.select("_level").distinct().collect()]
    assert 1 < len(levels) <= 4
    probes = events.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("bucket", time_chunk("t", width))
    held = probes.join(spread.distinct().withColumnRenamed("_key_k", "k"), ["k", "_level", "bucket"]).groupBy("k", "_level", "bucket").count()
    assert held.agg(F.max("count")).first()[0] < 0.05 * 20_000
    # open-ended ones hold half of the key's events each on average: the result is as large as that
    joined = intervals.interval_join(events, spans, ["k"], "t", "s", "e", how="inner")
    assert joined.count() == joined.filter("s <= t and t < e").count() > 300_000
