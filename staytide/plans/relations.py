"""Queries: joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from staytide.functions import clock
from staytide.functions import values as V
from staytide.operators import cohort, episodes, folds, intervals, joins, panes, prefix, profile, quantiles, survival
from staytide.plans.basics import (
    IN_WINDOW,
    WINDOW,
    _offsets,
    big,
    micro_events,
    micro_intervals,
    r6,
)
from staytide.plans.jobs import POOLED_MOMENTS
from staytide.plans.registry import query
from staytide.schemas import HOUR_US
from staytide.session import materialize
from staytide.sources import pooled, tables

# --- joins -------------------------------------------------------------------------------


@query(
    "inner_join_dim",
    """
    SELECT e.event_id, e.stay_id, s.patient_id, coalesce(s.status, '') AS status
    FROM f_m1 e JOIN f_stays s USING (stay_id)""",
)
def inner_join_dim(spark, sf):
    stays = tables.stays(spark, sf).select("stay_id", "patient_id", F.coalesce("status", F.lit("")).alias("status"))
    out = joins.with_dimension(tables.m1_events(spark, sf), stays, ["stay_id"], "inner")
    return out.select("event_id", "stay_id", "patient_id", "status")


@query(
    "left_join_dim",
    """
    SELECT d.stay_id, d.gender, coalesce(s.patient_id, -1) AS patient_id, s.stay_id IS NOT NULL AS stayed
    FROM f_demo d LEFT JOIN f_stays s USING (stay_id)""",
)
def left_join_dim(spark, sf):
    stays = tables.stays(spark, sf).select("stay_id", "patient_id", F.lit(True).alias("stayed"))
    out = joins.with_dimension(tables.demographics(spark, sf), stays, ["stay_id"])
    return out.select(
        "stay_id",
        "gender",
        F.coalesce("patient_id", F.lit(-1)).alias("patient_id"),
        F.coalesce("stayed", F.lit(False)).alias("stayed"),
    )


def _join_sql(end: str, how: str) -> str:
    return f"""
    SELECT e.event_id, CAST(coalesce(epoch_us(i.start_ts), -1) AS BIGINT) AS start_us, coalesce(ROUND(i.score, 6), -1) AS score
    FROM f_m1 e {how} JOIN f_intervals i ON e.stay_id = i.stay_id AND e.ts >= i.start_ts AND e.ts {end} i.end_ts"""


def _interval_join(spark, sf, **how):
    joined = intervals.interval_join(
        micro_events(tables.m1_events(spark, sf)),
        micro_intervals(tables.intervals(spark, sf)),
        ["stay_id"],
        "ts_us",
        "start",
        "end",
        **how,
    )
    return joined.select(
        "event_id",
        F.coalesce("start", F.lit(-1)).alias("start_us"),
        F.coalesce(r6("score"), F.lit(-1.0)).alias("score"),
    )


@query("interval_join", _join_sql("<", "LEFT"))
def interval_join(spark, sf):
    return _interval_join(spark, sf)


@query("interval_join_closed", _join_sql("<=", ""))
def interval_join_closed(spark, sf):
    return _interval_join(spark, sf, how="inner", closed=True)


@query("semi_join", "SELECT stay_id, gender FROM f_demo WHERE stay_id IN (SELECT stay_id FROM f_m2)")
def semi_join(spark, sf):
    kept = joins.keep_listed(tables.demographics(spark, sf), tables.m2_events(spark, sf), "stay_id")
    return kept.select("stay_id", "gender")


@query(
    "semi_join_parent",
    """
    SELECT stay_id, patient_id FROM f_stays WHERE patient_id IN (
      SELECT patient_id FROM f_stays WHERE stay_id IN (SELECT stay_id FROM f_intervals WHERE score > 150))""",
)
def semi_join_parent(spark, sf):
    listed = tables.intervals(spark, sf).filter(F.col("score") > 150)
    kept = joins.keep_listed_parents(tables.stays(spark, sf), listed, "stay_id", "patient_id")
    return kept.select("stay_id", "patient_id")


@query(
    "anti_join_parent",
    """
    SELECT stay_id, patient_id FROM f_stays s WHERE NOT EXISTS (
      SELECT 1 FROM f_stays b WHERE b.patient_id = s.patient_id AND b.status IS NULL)""",
)
def anti_join_parent(spark, sf):
    stays = tables.stays(spark, sf)
    kept = joins.drop_parents(stays, stays.filter(F.col("status").isNull()), "patient_id")
    return kept.select("stay_id", "patient_id")


_SELF = """
    SELECT user_id AS stay_id, CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS day_us, event_type AS string,
           CASE WHEN value > 100 THEN TRUE WHEN value > 20 THEN FALSE END AS active, value FROM events"""


@query(
    "null_safe_join",
    f"""
    WITH a AS ({_SELF}),
    b AS (SELECT stay_id, day_us, string, active, CAST(FLOOR(value) AS BIGINT) % 3 AS kind FROM a WHERE value > 10)
    SELECT a.stay_id, a.day_us, a.string, CAST(CASE a.active WHEN TRUE THEN 1 WHEN FALSE THEN 0 ELSE -1 END AS BIGINT) AS active,
           coalesce(b.kind, -1) AS kind, COUNT(*) AS n
    FROM a LEFT JOIN b ON a.stay_id = b.stay_id AND a.day_us = b.day_us AND a.string = b.string
                       AND a.active IS NOT DISTINCT FROM b.active
    GROUP BY ALL""",
)
def null_safe_join(spark, sf):
    v, us = F.col("value"), clock.micros("ts")
    rows = tables.table(spark, sf, "events").select(
        F.col("user_id").alias("stay_id"),
        (us - F.pmod(us, F.lit(clock.DAY_US))).alias("day_us"),
        F.col("event_type").alias("string"),
        F.when(v > 100, True).when(v > 20, False).alias("active"),
        v,
    )
    typed = rows.filter(v > 10).withColumn("kind", F.floor(v) % 3)
    out = joins.counted_null_safe_join(rows, typed, ["stay_id", "day_us", "string", "active"], "kind")
    return out.select(
        "stay_id",
        "day_us",
        "string",
        big(F.coalesce(F.col("active").cast("int"), F.lit(-1))).alias("active"),
        big(F.coalesce("kind", F.lit(-1))).alias("kind"),
        "n",
    )


@query(
    "pair_measurements",
    f"""
    SELECT a.stay_id, COUNT(*) AS n_pairs, ROUND(median(a.value), 6) AS m1_valuenum, ROUND(median(b.value), 6) AS m2_valuenum
    FROM (SELECT * FROM f_off1 WHERE {IN_WINDOW}) a JOIN (SELECT * FROM f_off2 WHERE {IN_WINDOW}) b USING (stay_id)
    GROUP BY a.stay_id""",
)
def pair_measurements(spark, sf):
    m1, m2 = _offsets(spark, sf)
    out = cohort.pair_measurements(m1, m2, ["stay_id"], "value", WINDOW, "off_us")
    return out.select(
        "stay_id", "n_pairs", r6("m1_valuenum").alias("m1_valuenum"), r6("m2_valuenum").alias("m2_valuenum")
    )


# --- aggregates --------------------------------------------------------------------------


@query(
    "cohort_collapse",
    f"""
    SELECT e.stay_id, ROUND(median(e.value), 6) AS m1_valuenum, ROUND(coalesce(median(d.height), -1), 6) AS height,
           ROUND(coalesce(arg_min(i.score, (e.off_us, e.event_id, i.start_ts)) FILTER (WHERE i.score IS NOT NULL), -1), 6) AS first_score,
           MAX(CAST(coalesce(e.off_us + {24 * HOUR_US} >= e.death_us, FALSE) AS BIGINT)) AS label
    FROM f_off1 e LEFT JOIN f_demo d USING (stay_id)
    LEFT JOIN f_intervals i ON e.stay_id = i.stay_id AND e.ts >= i.start_ts AND e.ts < i.end_ts
    GROUP BY e.stay_id""",
)
def cohort_collapse(spark, sf):
    m1, _ = _offsets(spark, sf)
    people = tables.demographics(spark, sf).select("stay_id", "height")
    events = joins.with_dimension(micro_events(m1), people, ["stay_id"])
    events = intervals.interval_join(
        events, micro_intervals(tables.intervals(spark, sf)), ["stay_id"], "ts_us", "start", "end"
    )
    events = events.withColumn("label", big(clock.dies_within(F.col("off_us"), F.col("death_us"), 24 * HOUR_US)))
    out = cohort.collapse(
        events,
        ["stay_id"],
        {"value": "median", "height": "median", "score": "first", "label": "max"},
        order=["off_us", "event_id", "start"],
        rename={"value": "m1_valuenum", "score": "first_score"},
    )
    return out.select(
        "stay_id",
        r6("m1_valuenum").alias("m1_valuenum"),
        r6(F.coalesce("height", F.lit(-1.0))).alias("height"),
        r6(F.coalesce("first_score", F.lit(-1.0))).alias("first_score"),
        "label",
    )


@query(
    "group_median",
    """
    SELECT l_suppkey, ROUND(median(l_quantity), 6) AS quantity, ROUND(median(l_extendedprice), 6) AS price
    FROM lineitem GROUP BY l_suppkey""",
)
def group_median(spark, sf):
    lines = tables.table(spark, sf, "lineitem")
    out = quantiles.group_medians(lines, ["l_suppkey"], {"l_quantity": "quantity", "l_extendedprice": "price"})
    return out.select("l_suppkey", r6("quantity").alias("quantity"), r6("price").alias("price"))


@query(
    "dedupe_time_max",
    """
    SELECT user_id AS stay_id, epoch_us(date_trunc('hour', ts)) AS hour_us, ROUND(MAX(value), 6) AS value,
           MAX(event_type) AS event_type
    FROM events GROUP BY ALL""",
)
def dedupe_time_max(spark, sf):
    us = clock.micros("ts")
    rows = tables.table(spark, sf, "events").select(
        F.col("user_id").alias("stay_id"), (us - F.pmod(us, F.lit(HOUR_US))).alias("hour_us"), "value", "event_type"
    )
    out = episodes.highest_per_time(rows, ["stay_id"], "hour_us", ["value", "event_type"])
    return out.withColumn("value", r6("value"))


@query("group_max", "SELECT stay_id, ROUND(MAX(score), 6) AS weight FROM f_intervals GROUP BY stay_id")
def group_max(spark, sf):
    out = cohort.collapse(
        tables.intervals(spark, sf), ["stay_id"], {"score": "max"}, order=[], rename={"score": "weight"}
    )
    return out.withColumn("weight", r6("weight"))


_STEPS = {
    "all": "TRUE",
    "vital": "event_type IN ('view', 'click', 'purchase')",
    "plausible": "value BETWEEN 30 AND 300",
    "second half": "ts >= TIMESTAMP '2024-01-16 00:00:00'",
}


def _attrition_sql() -> str:
    parts, test = [], "TRUE"
    for i, (name, step) in enumerate(_STEPS.items()):
        test = f"{test} AND {step}"
        parts.append(
            f"SELECT CAST({i} AS BIGINT) AS step_no, '{name}' AS step, COUNT(*) AS n_rows, "
            f"COUNT(DISTINCT user_id) AS n_keys FROM events WHERE {test}"
        )
    return " UNION ALL ".join(parts)


@query("attrition_table", _attrition_sql())
def attrition_table(spark, sf):
    events = tables.table(spark, sf, "events")
    steps = {
        "all": F.lit(True),
        "vital": F.col("event_type").isin("view", "click", "purchase"),
        "plausible": V.in_range("value", 30, 300),
        "second half": F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"),
    }
    return profile.attrition(events, "user_id", steps).withColumn("step_no", big("step_no"))


@query("distinct_values", "SELECT DISTINCT event_type FROM events")
def distinct_values(spark, sf):
    return tables.table(spark, sf, "events").select("event_type").distinct()


@query("value_counts", "SELECT c_mktsegment AS ethnicity, COUNT(*) AS n FROM customer GROUP BY ALL")
def value_counts(spark, sf):
    people = tables.table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "ethnicity")
    return profile.value_counts(people, "ethnicity")


@query(
    "label_distribution",
    f"""
    SELECT label, COUNT(*) AS n FROM (
      SELECT stay_id, arg_min(CAST(coalesce(off_us + {72 * HOUR_US} >= death_us, FALSE) AS BIGINT), (off_us, event_id)) AS label
      FROM f_off1 GROUP BY stay_id) GROUP BY label""",
)
def label_distribution(spark, sf):
    m1, _ = _offsets(spark, sf)
    m1 = m1.withColumn("label", big(clock.dies_within(F.col("off_us"), F.col("death_us"), 72 * HOUR_US)))
    return profile.label_distribution(m1, "stay_id", "label", ["off_us", "event_id"])


def _describe_sql(column: str) -> str:
    return f"""
    SELECT '{column}' AS measure, COUNT({column}) AS n, ROUND(AVG({column}), 6) AS mean, ROUND(stddev_samp({column}), 6) AS std,
           ROUND(MIN({column}), 6) AS min, ROUND(quantile_cont({column}, 0.25), 6) AS p25, ROUND(median({column}), 6) AS p50,
           ROUND(quantile_cont({column}, 0.75), 6) AS p75, ROUND(MAX({column}), 6) AS max
    FROM f_demo"""


@query("describe_columns", " UNION ALL ".join(_describe_sql(c) for c in ("height", "weight")))
def describe_columns(spark, sf):
    out = profile.describe(tables.demographics(spark, sf), ["height", "weight"])
    numbers = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return out.select("measure", "n", *[r6(c).alias(c) for c in numbers])


@query(
    "null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS measure, COUNT(*) - COUNT({c}) AS n_null FROM f_demo" for c in ("gender", "height", "weight")
    ),
)
def null_counts(spark, sf):
    return profile.null_counts(tables.demographics(spark, sf), ["gender", "height", "weight"])


_LIMITS = {"age": 65, "height": 150, "weight": 70}


@query(
    "split_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS measure, COUNT(*) FILTER (WHERE {c} < {v}) AS n_below, COUNT(*) FILTER (WHERE {c} >= {v}) AS n_from "
        "FROM (SELECT *, TRY_CAST(age_text AS DOUBLE) AS age FROM f_demo)"
        for c, v in _LIMITS.items()
    ),
)
def split_counts(spark, sf):
    people = tables.demographics(spark, sf).withColumn("age", V.number("age_text"))
    return profile.split_counts(people, _LIMITS)


@query(
    "fanout_check",
    """
    SELECT 'before' AS moment, COUNT(DISTINCT (stay_id, ts)) AS n_groups, COUNT(*) AS n_rows FROM f_m1
    UNION ALL
    SELECT 'after', COUNT(DISTINCT (e.stay_id, e.ts)), COUNT(*)
    FROM f_m1 e LEFT JOIN f_intervals i ON e.stay_id = i.stay_id AND e.ts >= i.start_ts AND e.ts < i.end_ts""",
)
def fanout_check(spark, sf):
    events = micro_events(tables.m1_events(spark, sf))
    joined = intervals.interval_join(
        events, micro_intervals(tables.intervals(spark, sf)), ["stay_id"], "ts_us", "start", "end"
    )
    parts = {"before": events, "after": joined}
    return pooled.tagged_union(
        {k: profile.group_count(df, "stay_id", "ts_us") for k, df in parts.items()}, "moment"
    )


@query(
    "multi_row_entities",
    "SELECT patient_id, COUNT(*) AS n FROM f_stays GROUP BY patient_id HAVING COUNT(*) > 1",
)
def multi_row_entities(spark, sf):
    return profile.multi_row_keys(tables.stays(spark, sf), "patient_id")


_CURVE = """
    SELECT hour, n_expired, n_survival, ROUND(ln(1 + n_expired), 6) AS log_n_expired, ROUND(ln(1 + n_survival), 6) AS log_n_survival,
           ROUND(CASE WHEN n_expired + n_survival > 0 THEN n_expired::DOUBLE / (n_expired + n_survival) END, 6) AS expired_rate,
           ROUND(CASE WHEN n_expired + n_survival > 0 THEN n_survival::DOUBLE / (n_expired + n_survival) END, 6) AS survival_rate
    FROM c"""


def _curve(df):
    return df.select(
        "hour",
        "n_expired",
        "n_survival",
        *[r6(c).alias(c) for c in ("log_n_expired", "log_n_survival", "expired_rate", "survival_rate")],
    )


@query(
    "survival_by_hour",
    f"""
    WITH c AS (
      SELECT h.hour, COUNT(DISTINCT e.stay_id) FILTER (WHERE e.death_us IS NOT NULL) AS n_expired,
             COUNT(DISTINCT e.stay_id) FILTER (WHERE e.stay_id IS NOT NULL AND e.death_us IS NULL) AS n_survival
      FROM (SELECT unnest(range(0, 97)) AS hour) h
      LEFT JOIN f_off1 e ON e.off_us >= h.hour * {HOUR_US} AND e.off_us < (h.hour + 1) * {HOUR_US}
      GROUP BY h.hour) {_CURVE}""",
)
def survival_by_hour(spark, sf):
    m1, _ = _offsets(spark, sf)
    m1 = m1.withColumn("expired", F.col("death_us").isNotNull().cast("int"))
    return _curve(survival.events_by_hour(m1, "stay_id", "off_us", "expired", HOUR_US))


@query(
    "survival_at_risk",
    f"""
    WITH s AS (SELECT stay_id, death_ts IS NOT NULL AS died, (epoch_us(t1) - epoch_us(t0)) / 8 AS length_us FROM f_stays),
    c AS (
      SELECT h.hour, COUNT(*) FILTER (WHERE s.died) AS n_expired, COUNT(*) FILTER (WHERE NOT s.died) AS n_survival
      FROM (SELECT unnest(range(0, 97)) AS hour) h LEFT JOIN s ON s.length_us >= (h.hour + 1) * {HOUR_US}
      GROUP BY h.hour) {_CURVE}""",
)
def survival_at_risk(spark, sf):
    # an eighth of the given month, so that stays end within the curve
    stays = tables.stays(spark, sf).select(
        "stay_id",
        F.col("death_ts").isNotNull().cast("int").alias("expired"),
        (clock.elapsed_us("t0", "t1") / 8).alias("length_us"),
    )
    return _curve(survival.at_risk(stays, "stay_id", "length_us", "expired", HOUR_US))


# --- windows -----------------------------------------------------------------------------


def _ticks(spark, sf):
    from staytide.functions.radix import time_chunk

    return (
        tables.ticks(spark, sf)
        .withColumn("ts_us", clock.micros("ts"))
        .withColumn("chunk", time_chunk("ts_us", HOUR_US))
    )


@query(
    "lag_within_key",
    """
    SELECT event_id, stay_id, coalesce(lag(epoch_us(ts)) OVER (PARTITION BY stay_id ORDER BY ts, event_id), -1) AS time_before
    FROM f_ticks""",
)
def lag_within_key(spark, sf):
    out = prefix.lag_in_group(_ticks(spark, sf), ["stay_id"], "chunk", ["ts_us", "event_id"], "ts_us", "time_before")
    return out.select("event_id", "stay_id", F.coalesce("time_before", F.lit(-1)).alias("time_before"))


@query(
    "cumulative_sum",
    """
    SELECT event_id, stay_id, CAST(SUM(typ) OVER (PARTITION BY stay_id ORDER BY ts, event_id) AS BIGINT) AS total
    FROM f_ticks""",
)
def cumulative_sum(spark, sf):
    out = prefix.sums_before(_ticks(spark, sf), ["stay_id"], "chunk", ["ts_us", "event_id"], {"earlier": "typ"})
    return out.select("event_id", "stay_id", (F.col("earlier") + F.col("typ")).alias("total"))


@query(
    "sessionize_episodes",
    """
    WITH d AS (SELECT stay_id, epoch_us(ts) // 60000000 AS minute, MAX(typ) AS typ, MAX(CAST(active AS INT)) AS active
               FROM f_ticks GROUP BY ALL),
    l AS (SELECT *, lag(minute) OVER (PARTITION BY stay_id ORDER BY minute) AS before FROM d),
    n AS (SELECT *, SUM(CASE WHEN before IS NULL OR minute - before > 1440 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY stay_id ORDER BY minute) AS episode FROM l),
    e AS (SELECT stay_id, CAST(episode AS BIGINT) AS episode, MIN(minute) AS first_tick, MAX(minute) AS last_tick, COUNT(*) AS n_ticks,
                 CAST(MAX(typ) AS BIGINT) AS typ, MAX(active) AS active FROM n GROUP BY stay_id, episode)
    SELECT e.stay_id, episode, first_tick AS vent_start, n_ticks, typ,
           CASE WHEN active = 1 AND last_tick + 60 < epoch_us(s.t1) // 60000000 THEN epoch_us(s.t1) // 60000000
                ELSE last_tick + 60 END AS vent_end
    FROM e JOIN f_stays s USING (stay_id)""",
)
def sessionize_episodes(spark, sf):
    minute = F.floor(clock.micros("ts") / 60_000_000)
    ticks = tables.ticks(spark, sf).withColumn("minute", minute)
    ticks = episodes.highest_per_time(ticks, ["stay_id"], "minute", ["typ", "active"])
    found = episodes.episodes(ticks, ["stay_id"], "minute", 1440, ["typ", "active"], chunk_width=60)
    stays = tables.stays(spark, sf).select("stay_id", F.floor(clock.micros("t1") / 60_000_000).alias("discharge"))
    end = episodes.episode_end(F.col("last_tick"), 60, F.col("active"), F.col("discharge"))
    return found.join(stays, "stay_id").select(
        "stay_id",
        "episode",
        F.col("first_tick").alias("vent_start"),
        "n_ticks",
        big("typ").alias("typ"),
        end.alias("vent_end"),
    )


@query(
    "growing_episodes",
    """
    WITH d AS (SELECT stay_id, epoch_us(ts) // 60000000 AS minute, MAX(typ) AS typ FROM f_ticks GROUP BY ALL),
    l AS (SELECT *, lag(minute) OVER (PARTITION BY stay_id ORDER BY minute) AS before FROM d),
    n AS (SELECT *, SUM(CASE WHEN before IS NULL OR minute - before > 1440 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY stay_id ORDER BY minute) AS episode FROM l)
    SELECT stay_id, CAST(episode AS BIGINT) AS episode, MIN(minute) AS first_tick, MAX(minute) AS last_tick, COUNT(*) AS n_ticks, CAST(MAX(typ) AS BIGINT) AS typ
    FROM n GROUP BY stay_id, episode""",
)
def growing_episodes(spark, sf):
    """Episodes from three batches of ticks, one after the other; each touches the stays that it has ticks of."""
    minute = F.floor(clock.micros("ts") / 60_000_000)
    ticks = episodes.highest_per_time(tables.ticks(spark, sf).withColumn("minute", minute), ["stay_id"], "minute", ["typ"])
    ticks = materialize(ticks.withColumn("batch", F.col("minute") % 3), "tick-batches")
    stored = None
    for i in range(3):
        new = ticks.filter(F.col("batch") == i).drop("batch")
        if stored is None:
            stored = materialize(episodes.episodes(new, ["stay_id"], "minute", 1440, ["typ"], chunk_width=60), "episodes")
            continue
        changed = materialize(episodes.grown(stored, new, ["stay_id"], "minute", 1440, ["typ"], chunk_width=60), "grown")
        stored = materialize(episodes.with_growth(stored, changed, ["stay_id"]), "episodes")
    return stored.select("stay_id", "episode", "first_tick", "last_tick", "n_ticks", big("typ").alias("typ"))


@query(
    "dedupe_first",
    """
    SELECT stay_id, event_id, ROUND(value, 6) AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY ts, event_id) AS rn FROM f_m2) WHERE rn = 1""",
)
def dedupe_first(spark, sf):
    out = folds.first_per_key(tables.m2_events(spark, sf), ["stay_id"], ["ts", "event_id"])
    return out.select("stay_id", "event_id", r6("value").alias("value"))


@query(
    "batch_slice",
    """
    SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)
    WHERE rn >= 3000 AND rn < 4500""",
)
def batch_slice(spark, sf):
    batch, size = 2, 1500
    rows = tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return folds.row_range(rows, "o_orderkey", batch * size, (batch + 1) * size)


# --- set operations ----------------------------------------------------------------------


@query(
    "key_intersection",
    f"SELECT stay_id FROM f_off1 WHERE {IN_WINDOW} INTERSECT SELECT stay_id FROM f_off2 WHERE {IN_WINDOW}",
)
def key_intersection(spark, sf):
    m1, m2 = (df.filter(clock.window_test("off_us", *WINDOW)) for df in _offsets(spark, sf))
    return joins.shared_keys(m1, m2, "stay_id")


@query(
    "union_sources",
    """
    WITH o AS (SELECT o_orderkey AS stay_id, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS data_source,
                      CASE WHEN o_custkey % 2 = 1 OR o_orderkey % 3 > 0 THEN CAST(20 + o_orderkey % 60 AS DOUBLE) END AS age,
                      CASE WHEN o_orderkey % 7 > 0 THEN CAST(30 + o_orderkey % 160 AS DOUBLE) END AS height,
                      CAST(o_orderstatus = 'F' AS BIGINT) AS death FROM orders)
    SELECT stay_id, data_source, coalesce(age, 64) AS age, height, death,
           CASE WHEN data_source = 'A' THEN -1 ELSE stay_id % 5 END AS region FROM o WHERE height > 50""",
)
def union_sources(spark, sf):
    k = F.col("o_orderkey")
    orders = tables.table(spark, sf, "orders").select(
        k.alias("stay_id"),
        (F.col("o_custkey") % 2).alias("side"),
        F.when((F.col("o_custkey") % 2 == 1) | (k % 3 > 0), (20 + k % 60).cast("double")).alias("age"),
        F.when(k % 7 > 0, (30 + k % 160).cast("double")).alias("height"),
        big(F.col("o_orderstatus") == "F").alias("death_in_24_hours"),
    )
    first = orders.filter(F.col("side") == 0).drop("side")
    second = orders.filter(F.col("side") == 1).drop("side").withColumn("region", F.col("stay_id") % 5)
    out = pooled.pooled_cohort({"A": first, "B": second}, "death_in_24_hours")
    return out.withColumn("region", F.coalesce("region", F.lit(-1)))


_POOLED_UNIT = 12 * HOUR_US
_POOLED_WINDOWS = [((m - 12) * _POOLED_UNIT, m * _POOLED_UNIT) for m in POOLED_MOMENTS]


@query(
    "pooled_moments",
    f"""
    WITH w AS (SELECT unnest({list(POOLED_MOMENTS)}) AS mop),
    m AS (SELECT stay_id, mop, median(value) AS m1_valuenum FROM f_off1 JOIN w
          ON off_us >= (mop - 12) * {_POOLED_UNIT} AND off_us < mop * {_POOLED_UNIT} GROUP BY ALL),
    p AS (SELECT c_custkey AS stay_id, CASE WHEN c_custkey % 9 <> 4 THEN CAST(18 + c_custkey % 70 AS DOUBLE) END AS age,
                 CASE WHEN c_custkey % 4 <> 1 THEN CAST(30 + c_custkey % 160 AS DOUBLE) END AS height, CAST(c_custkey % 3 = 0 AS BIGINT) AS death FROM customer)
    SELECT CAST(mop AS BIGINT) AS mop, stay_id, CASE WHEN stay_id % 2 = 0 THEN 'A' ELSE 'B' END AS data_source, coalesce(age, 64) AS age, height, death,
           ROUND(m1_valuenum, 6) AS m1_valuenum
    FROM m JOIN p USING (stay_id) WHERE height > 50""",
)
def pooled_moments(spark, sf):
    """The pooled table of both sources at the four moments of prediction."""
    k = F.col("c_custkey")
    people = tables.table(spark, sf, "customer").select(
        k.alias("stay_id"),
        F.when(k % 9 != 4, (18 + k % 70).cast("double")).alias("age"),
        F.when(k % 4 != 1, (30 + k % 160).cast("double")).alias("height"),
        big(k % 3 == 0).alias("death_in_24_hours"),
    )
    medians = panes.window_medians(_offsets(spark, sf)[0], ["stay_id"], ["value"], "off_us", _POOLED_WINDOWS)
    rows = materialize(medians.join(people, "stay_id").withColumnRenamed("value", "m1_valuenum"), "moments")
    frames = {
        m: {name: rows.filter((F.col("window") == i) & (F.col("stay_id") % 2 == side)).drop("window") for side, name in enumerate("AB")}
        for i, m in enumerate(POOLED_MOMENTS)
    }
    out = pooled.pooled_by_moment(frames, "death_in_24_hours")
    return out.select(big("mop").alias("mop"), "stay_id", "data_source", "age", "height", "death", r6("m1_valuenum").alias("m1_valuenum"))
