"""Edge rows: missing values, window and interval ends, ties, empty groups."""

import math

import pytest
from pyspark.sql import functions as F

from staytide.functions import clock, recode, therapy
from staytide.functions import values as V
from staytide.operators import (
    cohort,
    episodes,
    folds,
    intervals,
    joins,
    metrics,
    prefix,
    profile,
    quantiles,
    select,
    survival,
    targets,
)
from staytide.plans import jobs
from tests.conftest import rows


def test_numeric_text(spark):
    texts = ["1.0", " 12 ", "1e3", "-4", "+.5", "> 89", "", "1_000", "1.0d", "1f", "nan", "inf", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    kept = [r.t for r in select.numeric(df, "t", "v").collect()]
    assert kept == ["1.0", " 12 ", "1e3", "-4", "+.5"]
    assert [r.v for r in df.select(V.number("t").alias("v")).collect()][:5] == [1.0, 12.0, 1000.0, -4.0, 0.5]


def test_missing_values_are_not_plausible(spark):
    df = spark.createDataFrame([(30.0,), (300.0,), (29.9,), (300.1,), (float("nan"),), (None,)], "v DOUBLE")
    assert rows(select.plausible(df, "v", 30, 300)) == [(30.0,), (300.0,)]
    # no lower bound still leaves NaN out
    assert rows(select.plausible(df, "v", high=300)) == [(29.9,), (30.0,), (300.0,)]


def test_medians_skip_missing_values(spark):
    data = [(1, 1.0), (1, 2.0), (1, float("nan")), (1, None), (2, float("nan")), (3, 5.0), (3, 7.0), (3, 100.0)]
    df = spark.createDataFrame(data, "k INT, v DOUBLE")
    assert rows(quantiles.group_medians(df, ["k"], ["v"])) == [(1, 1.5), (3, 7.0)]


def test_median_signs_and_sizes(spark):
    data = [(1, v) for v in (-1e300, -5.0, -1e-9, 0.0, 1e-9, 3.0, 1e300)] + [(2, -3.0), (2, -1.0)]
    df = spark.createDataFrame(data, "k INT, v DOUBLE")
    assert rows(quantiles.group_medians(df, ["k"], ["v"])) == [(1, 0.0), (2, -2.0)]


def test_null_group_keys(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (1, 2.0, 1), (1, 4.0, 2)], "k INT, v DOUBLE, t INT")
    out = cohort.collapse(df, ["k"], {"v": "median", "t": "max"}, ["t"])
    assert rows(out) == [(1, 3.0, 2)]


def test_first_skips_nulls_in_order(spark):
    data = [(1, 3, "c", None), (1, 1, None, 9.0), (1, 2, "b", 8.0), (2, 1, None, None)]
    df = spark.createDataFrame(data, "k INT, t INT, a STRING, b DOUBLE")
    out = cohort.collapse(df, ["k"], {"a": "first", "b": "first"}, ["t"])
    assert rows(out) == [(1, "b", 9.0), (2, None, None)]


def test_window_ends(spark):
    lo, hi = clock.window_before(18, 12, 60)
    assert (lo, hi) == (360, 1080)
    assert clock.window_after(6, 6, 60) == (360, 720)
    df = spark.createDataFrame([(359,), (360,), (1079,), (1080,)], "t LONG")
    assert rows(df.filter(clock.window_test("t", lo, hi))) == [(360,), (1079,)]


def test_half_open_intervals(spark):
    events = spark.createDataFrame([(1, 10), (1, 19), (1, 20), (1, 25), (2, 5), (3, None)], "k INT, t LONG")
    spans = spark.createDataFrame(
        [(1, 10, 20, "a"), (1, 15, 26, "b"), (1, 25, 25, "empty"), (2, 50, 60, "c")], "k INT, s LONG, e LONG, x STRING"
    )
    out = intervals.interval_join(events, spans, ["k"], "t", "s", "e").select("k", "t", "x")
    assert rows(out) == [
        (1, 10, "a"), (1, 19, "a"), (1, 19, "b"), (1, 20, "b"), (1, 25, "b"), (2, 5, None), (3, None, None),
    ]


def test_closed_intervals(spark):
    events = spark.createDataFrame([(1, 10), (1, 20), (1, 30), (1, 31)], "k INT, t LONG")
    spans = spark.createDataFrame([(1, 10, 20, "a"), (1, 20, 30, "b"), (1, 30, 30, "c")], "k INT, s LONG, e LONG, x STRING")
    out = intervals.interval_join(events, spans, ["k"], "t", "s", "e", how="inner", closed=True).select("t", "x")
    assert rows(out) == [(10, "a"), (20, "a"), (20, "b"), (30, "b"), (30, "c")]


def test_interval_join_without_intervals(spark):
    events = spark.createDataFrame([(1, 10)], "k INT, t LONG")
    spans = spark.createDataFrame([], "k INT, s LONG, e LONG, x STRING")
    assert rows(intervals.interval_join(events, spans, ["k"], "t", "s", "e").select("k", "t", "x")) == [(1, 10, None)]


def test_intervals_of_very_unequal_length(spark):
    events = spark.range(0, 2000, 7).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    spans = spark.createDataFrame(
        [(1, i * 3, i * 3 + 1, i) for i in range(600)] + [(1, -10**6, 10**6, -1), (1, 500, 900, -2)],
        "k INT, s LONG, e LONG, x INT",
    )
    out = intervals.interval_join(events, spans, ["k"], "t", "s", "e", how="inner").select("t", "x")
    plain = events.join(spans.drop("k"), (F.col("t") >= F.col("s")) & (F.col("t") < F.col("e"))).select("t", "x")
    assert rows(out) == rows(plain)


def test_episode_gap(spark):
    ticks = spark.createDataFrame(
        [(1, 0, 1), (1, 0, 4), (1, 1440, 2), (1, 2881, 3), (2, -60, 0)], "k INT, t LONG, v INT"
    )
    unique = episodes.highest_per_time(ticks, ["k"], "t", ["v"])
    found = episodes.episodes(unique, ["k"], "t", 1440, ["v"], chunk_width=60)
    assert rows(found) == [(1, 1, 0, 1440, 2, 4), (1, 2, 2881, 2881, 1, 3), (2, 1, -60, -60, 1, 0)]
    marked = episodes.numbered(unique, ["k"], "t", 1440, chunk_width=60).select("k", "t", "new_episode", "episode")
    assert rows(marked) == [(1, 0, 1, 1), (1, 1440, 0, 1), (1, 2881, 1, 2), (2, -60, 1, 1)]
    with pytest.raises(ValueError):
        episodes.episodes(unique, ["k"], "t", 1440, ["v"], chunk_width=1441)


def test_episode_end(spark):
    df = spark.createDataFrame([(100, True, 500), (100, False, 500), (100, True, 160), (100, True, None)], "l INT, a BOOLEAN, d INT")
    end = episodes.episode_end(F.col("l"), 60, F.col("a"), F.col("d"))
    assert [r[0] for r in df.select(end).collect()] == [500, 160, 160, 160]


def test_horizon_labels(spark):
    df = spark.createDataFrame([(10, None), (10, 5), (10, 16), (10, 17)], "t LONG, d LONG")
    labels = clock.horizon_labels("t", "d", [6], unit_per_hour=1)
    assert [r[0] for r in df.select(labels["death_in_6_hours"]).collect()] == [0, 1, 1, 0]
    alive = spark.createDataFrame([(10, 11, "Alive"), (10, 11, "Expired"), (10, 11, None)], "t LONG, d LONG, s STRING")
    labels = clock.horizon_labels("t", "d", [6], unit_per_hour=1, alive=F.col("s") == "Alive")
    assert [r[0] for r in alive.select(labels["death_in_6_hours"]).collect()] == [0, 1, 1]


def test_outcome_strata(spark):
    df = spark.createDataFrame([(None,), (17,), (18,), (41,), (42,)], "d LONG")
    got = [r[0] for r in df.select(clock.outcome_stratum("d", 18, 24, unit=1)).collect()]
    assert got == ["none", "before", "within", "within", "after"]


def test_duration_text(spark):
    texts = ["0 days 01:30:00", "2 days 00:00:00.500000", "-1 days +22:30:00", "1 day", "1:30", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    hour = 3_600_000_000
    want = [hour * 3 // 2, 48 * hour + 500_000, -hour * 3 // 2, 24 * hour, None, None, None]
    assert [r[0] for r in df.select(clock.duration_us("t")).collect()] == want


def test_micros_do_not_depend_on_the_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:30:00.000001' AS t, TIMESTAMP_NTZ '1969-12-31 23:59:59.5' AS u")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = df.select(clock.micros("t"), clock.micros("u")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(got) == (1711852200000001, -500_000)


def test_null_safe_join(spark):
    left = spark.createDataFrame([(1, None), (1, None), (1, True), (2, False)], "k INT, a BOOLEAN")
    right = spark.createDataFrame([(1, None, 7), (1, None, 7), (1, True, 8)], "k INT, a BOOLEAN, x INT")
    out = joins.counted_null_safe_join(left, right, ["k", "a"], "x")
    assert rows(out) == [(1, None, 7, 4), (1, True, 8, 1), (2, False, None, 1)]


def test_anti_join_keeps_null_parents(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k INT, p INT")
    bad = spark.createDataFrame([(1,), (None,)], "p INT")
    assert rows(joins.drop_parents(df, bad, "p").select("k")) == [(2,), (3,)]


def test_one_hot_and_classes(spark):
    df = spark.createDataFrame([("none",), ("invasive",), (None,), ("other",)], "c STRING")
    hot = recode.one_hot("c", recode.VENTILATION_COLUMNS, missing="mv_unknown")
    got = [tuple(r) for r in df.select(hot["mv_invasive"], hot["mv_none"], hot["mv_unknown"]).collect()]
    assert got == [(0, 1, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]
    types = spark.createDataFrame([(-1,), (1,), (2,), (3,), (4,), (None,)], "t INT")
    got = [r[0] for r in types.select(recode.threshold_class("t", recode.THERAPY_CLASSES)).collect()]
    assert got == ["oxygen_therapy", "oxygen_therapy", "unknown", "non_invasive", "invasive", "none"]


def test_first_match_order(spark):
    df = spark.createDataFrame([("WHITE - BLACK",), ("BLACK/CAPE",), ("HISPANIC/LATINO",), ("X",), (None,)], "r STRING")
    got = [r[0] for r in df.select(recode.recode_first_match("r", recode.RACE_BY_SUBSTRING)).collect()]
    assert got == ["WHITE", "BLACK", "LATINO", "X", None]


def test_therapy_types(spark):
    texts = ["Set VT", "ventilator", "hyperventilation", "Pressure Support", "LPM O2", "nasal cannula", "hello", None]
    df = therapy.with_therapy_types(spark.createDataFrame([(t,) for t in texts], "t STRING"), "t")
    assert [r.types for r in df.collect()] == [[4], [2], [], [2, 0], [-1], [1], [], []]


def test_oxygen_share(spark):
    shares = [0.1, 0.2, 0.21, 0.22, 0.5, 1.0, 1.5, 19.9, 20.0, 21.0, 22.0, 22.1, 100.0, float("nan"), None]
    df = spark.createDataFrame([(s,) for s in shares], "s DOUBLE")
    got = [r[0] for r in df.select(therapy.oxygen_share_type("s")).collect()]
    assert got == [0, None, None, None, -1, -1, 0, 0, None, None, None, -1, -1, None, None]


def test_ensemble_interval(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4, 0.5)], [f"p{i}" for i in range(5)])
    r = targets.with_mean_interval(df, [f"p{i}" for i in range(5)]).first()
    half = 1.959963984540054 * math.sqrt(0.025) / math.sqrt(5)
    assert r.average_pred == pytest.approx(0.3)
    assert r.lower_bound == pytest.approx(0.3 - half) and r.upper_bound == pytest.approx(0.3 + half)
    assert r.ci_interval == pytest.approx(2 * half)


def test_ties_at_the_last_rank(spark):
    data = [(1, 0.5, m, 0) for m in range(10, 0, -1)] + [(2, 0.1, 5, 5)]
    df = spark.createDataFrame(data, "k INT, average_pred DOUBLE, m1_valuenum INT, m2_valuenum INT")
    low = targets.lowest_points(df, "k", 3).select("k", "m1_valuenum")
    assert rows(low) == [(1, 1), (1, 2), (1, 3), (2, 5)]
    assert rows(targets.target_points(df, "k", 3)) == [(1, 2.0, 0.0), (2, 5.0, 5.0)]
    codes = targets.grid_target_points(df, "k", 3, m1=(1, 10), m2=(0, 5))
    assert rows(codes) == [(1, 2.0, 0.0), (2, 5.0, 5.0)]


@pytest.mark.parametrize(
    "scores, labels, auc",
    [
        ([0.5, 0.5, 0.5, 0.5], [0, 1, 0, 1], 0.5),
        ([0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1], 1.0),
        ([0.9, 0.8, 0.2, 0.1], [0, 0, 1, 1], 0.0),
        ([0.1, 0.2], [1, 1], None),
    ],
)
def test_auc_edges(spark, scores, labels, auc):
    df = spark.createDataFrame(list(zip(scores, labels)), "s DOUBLE, y INT")
    assert metrics.roc_auc(df, [], "s", "y").first().auc == auc


def test_small_folds(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(13)], "k LONG, y INT")
    got = rows(folds.stratified_folds(df, "k", "y").groupBy("y", "fold").count())
    assert [n for y, _, n in got if y == 1] == [1, 1, 1]
    assert [n for y, _, n in got if y == 0] == [2, 2, 2, 2, 2]
    runs = rows(folds.contiguous_folds(df, "k").groupBy("fold").count())
    assert runs == [(0, 3), (1, 3), (2, 3), (3, 2), (4, 2)]
    few = spark.createDataFrame([(1,), (2,)], "k LONG")
    assert rows(folds.contiguous_folds(few, "k")) == [(1, 0), (2, 1)]


def test_empty_hours(spark):
    df = spark.createDataFrame([(1, 30, 1), (2, 30, 0), (2, 59, 0), (1, 130, 1), (3, -5, 1)], "k INT, t LONG, x INT")
    got = {r.hour: r for r in survival.events_by_hour(df, "k", "t", "x", 60, last_hour=3).collect()}
    assert (got[0].n_expired, got[0].n_survival, got[0].expired_rate) == (1, 1, 0.5)
    assert (got[1].n_expired, got[1].n_survival, got[1].expired_rate) == (0, 0, None)
    assert got[2].n_expired == 1 and len(got) == 4


def test_at_risk(spark):
    df = spark.createDataFrame([(1, 59, 1), (2, 60, 0), (3, 179, 1), (4, 10000, 0)], "k INT, l LONG, x INT")
    got = {r.hour: (r.n_expired, r.n_survival) for r in survival.at_risk(df, "k", "l", "x", 60, last_hour=3).collect()}
    assert got == {0: (1, 2), 1: (1, 1), 2: (0, 1), 3: (0, 1)}


def test_fill_median_of_all_missing(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None)], "k INT, a DOUBLE, b DOUBLE")
    assert rows(profile.fill_median(df, ["a", "b"])) == [(1, None, 1.0), (2, None, 1.0)]


def test_prefix_with_null_keys(spark):
    data = [(None, 1, 1), (None, 2, 1), (1, 1, 5)]
    df = spark.createDataFrame(data, "k INT, t LONG, v INT").withColumn("c", F.col("t"))
    out = prefix.sums_before(df, ["k"], "c", ["t"], {"s": "v"}).select("k", "t", "s")
    assert rows(out) == [(None, 1, 0), (None, 2, 1), (1, 1, 0)]
    lag = prefix.lag_in_group(df, ["k"], "c", ["t"], "t", "b").select("k", "t", "b")
    assert rows(lag) == [(None, 1, None), (None, 2, 1), (1, 1, None)]


def test_labels_of_episodes(spark):
    found = spark.createDataFrame([(1, 0, 9, t) for t in (-1, 2, 3, 4)], "k INT, vent_start INT, vent_end INT, oxygen_therapy_type INT")
    names = [r.category for r in jobs.episode_categories(found, "k").collect()]
    assert names == ["oxygen_therapy", "unknown", "non_invasive", "invasive"]
    old = jobs.episode_categories(found, "k", legacy_labels=True)
    hot = old.withColumns(recode.one_hot("category", recode.VENTILATION_COLUMNS)).collect()
    assert [r.mv_invasive + r.mv_non_vasive for r in hot] == [0, 0, 0, 0]
    assert [r.mv_unknown for r in hot] == [0, 1, 0, 0]
