"""Queries: the jobs on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from staytide.functions import clock, recode
from staytide.operators import joins, select
from staytide.plans import jobs
from staytide.plans.basics import (
    CATEGORY_SQL,
    OW,
    SEGMENTS,
    WINDOW,
    _SEGMENT_SQL,
    big,
    categories,
    micro_events,
    micro_intervals,
    r6,
    therapy_sql,
)
from staytide.plans.registry import query
from staytide.schemas import BODY, BODY_AVAILABLE, COMORBIDITY, FEATURES, HORIZON_HOURS, HOUR_US, ORGAN_SCORES, RACE, VENTILATION
from staytide.session import materialize
from staytide.sources import tables

MINUTE = 60_000_000

# --- ventilation episodes ----------------------------------------------------------------

_TEXTS = ["Set VT", "CPAP mask", "vent settings", "Nasal Cannula", "PS", "LPM O2", "hyperventilation"]
_TEXT_SQL = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS)) + " END"


def _charted(spark, sf, stays):
    """Charted texts, oxygen flows and oxygen shares in minutes from admission, out of the events."""
    e = tables.table(spark, sf, "events").withColumnRenamed("user_id", "stay_id")
    e = tables.with_offset(e, stays).withColumn("minute", F.floor(F.col("off_us") / MINUTE))
    text = F.array(*[F.lit(t) for t in _TEXTS], F.lit(None))[(F.col("event_id") % 8).cast("int")]
    texts = e.filter(F.col("event_type") == "signup").select(
        "stay_id", "minute", text.alias("text"), F.when(F.col("event_id") % 3 == 0, F.col("value") > 60).alias("active")
    )
    flows = e.filter(F.col("event_type") == "error").select("stay_id", "minute", F.col("value").alias("flow"))
    shares = e.filter(F.col("event_type") == "purchase").select(
        "stay_id", "minute", (F.col("value") / 10).alias("share")
    )
    ends = stays.select("stay_id", F.floor(clock.elapsed_us("t0", "t1") / MINUTE).alias("discharge"))
    return texts, flows, shares, ends


def _job_episodes(spark, sf, stays):
    texts, flows, shares, ends = _charted(spark, sf, stays)
    ticks = jobs.therapy_ticks(texts, flows, shares, "stay_id")
    return jobs.therapy_episodes(ticks, ends, "stay_id", "discharge")


_EPISODES_SQL = f"""
    e AS (SELECT v.*, v.user_id AS stay_id, (epoch_us(v.ts) - epoch_us(s.t0)) // {MINUTE} AS minute
          FROM events v JOIN f_stays s ON v.user_id = s.stay_id),
    x AS (SELECT stay_id, minute, coalesce(CASE WHEN event_id % 3 = 0 THEN value > 60 END, FALSE) AS active,
                 {therapy_sql(f"coalesce(lower({_TEXT_SQL}), '')")} AS types FROM e WHERE event_type = 'signup'),
    t AS (SELECT stay_id, minute, list_max(types) AS typ, active, CAST(list_contains(types, -1) AS INT) AS supp FROM x WHERE len(types) > 0
          UNION ALL
          SELECT stay_id, minute, -1, FALSE, 1 FROM e WHERE event_type = 'error' AND value > 0 AND value <= 100
          UNION ALL
          SELECT stay_id, minute, CASE WHEN (v > 0.22 AND v <= 1) OR v > 22 THEN -1 ELSE 0 END, FALSE,
                 CASE WHEN (v > 0.22 AND v <= 1) OR v > 22 THEN 1 ELSE 0 END
          FROM (SELECT *, value / 10 AS v FROM e WHERE event_type = 'purchase')
          WHERE v < 0.2 OR (v > 0.22 AND v < 20) OR v > 22),
    d AS (SELECT stay_id, minute, MAX(typ) AS typ, bool_or(active) AS active, MAX(supp) AS supp FROM t GROUP BY ALL),
    l AS (SELECT *, lag(minute) OVER (PARTITION BY stay_id ORDER BY minute) AS before FROM d),
    n AS (SELECT *, SUM(CASE WHEN before IS NULL OR minute - before > 1440 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY stay_id ORDER BY minute) AS ventnum FROM l),
    g AS (SELECT stay_id, CAST(ventnum AS BIGINT) AS ventnum, MIN(minute) AS vent_start, MAX(minute) AS last_tick,
                 CAST(MAX(typ) AS BIGINT) AS oxygen_therapy_type, CAST(MAX(supp) AS BIGINT) AS supp_oxygen, bool_or(active) AS active
          FROM n GROUP BY stay_id, ventnum),
    vents AS (SELECT g.stay_id, ventnum, vent_start, CASE WHEN active AND last_tick + 60 < m THEN m ELSE last_tick + 60 END AS vent_end,
                 oxygen_therapy_type, supp_oxygen, active AS activeupondischarge
          FROM g JOIN (SELECT stay_id, (epoch_us(t1) - epoch_us(t0)) // {MINUTE} AS m FROM f_stays) s USING (stay_id))"""


@query("job_episodes", f"WITH {_EPISODES_SQL.strip()} SELECT * FROM vents")
def job_episodes(spark, sf):
    out = _job_episodes(spark, sf, tables.stays(spark, sf))
    return out.withColumns({c: big(c) for c in ("oxygen_therapy_type", "supp_oxygen")})


# --- stays -------------------------------------------------------------------------------


def _comorbidity(spark, sf):
    """Ready-made flags for three of four stays, out of the customers."""
    k = F.col("c_custkey")
    flags = {c: ((k + i * i) % 9 == 0).cast("int") for i, c in enumerate(COMORBIDITY[:-1])}
    people = tables.table(spark, sf, "customer").filter(k % 4 != 3)
    out = people.select(k.alias("stay_id"), *[c.alias(n) for n, c in flags.items()])
    return out.withColumn("CCI", sum((F.col(c) for c in COMORBIDITY[1:-1]), F.col(COMORBIDITY[0])))


_FLAGS_SQL = ", ".join(f"CAST((c_custkey + {i * i}) % 9 = 0 AS INT) AS {c}" for i, c in enumerate(COMORBIDITY[:-1]))
_COMORBIDITY_SQL = f"""
    comorbid AS (SELECT *, {' + '.join(COMORBIDITY[:-1])} AS CCI FROM
           (SELECT c_custkey AS stay_id, {_FLAGS_SQL} FROM customer WHERE c_custkey % 4 <> 3))"""
_COMORBIDITY_OUT = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in COMORBIDITY)
_RACE_SQL = ", ".join(f"CAST(ethnicity = '{a}' AS BIGINT) AS {b}" for a, b in recode.RACE_COLUMNS.items())
_BMI = "weight / (height / 100.0::DOUBLE * (height / 100.0::DOUBLE))"


def _raw_stays(spark, sf, stays):
    """Stays with their hospital stay, status and unclean demographics."""
    people = tables.demographics(spark, sf).withColumnRenamed("age_text", "age")
    return stays.select("stay_id", "patient_id", "status").join(people, "stay_id")


def _clean_stays(spark, sf, stays):
    charted = tables.m1_events(spark, sf).filter(F.col("value") > 150)
    return jobs.clean_stays(
        _raw_stays(spark, sf, stays), charted, _comorbidity(spark, sf), "stay_id", "patient_id", ethnicity=SEGMENTS
    )


_CLEAN_SQL = f"""
    r AS (SELECT s.stay_id, s.patient_id, s.status, d.* EXCLUDE (stay_id) FROM f_stays s JOIN f_demo d USING (stay_id)),
    p AS (SELECT * FROM r WHERE patient_id IN (SELECT patient_id FROM r WHERE stay_id IN (SELECT stay_id FROM f_m1 WHERE value > 150))),
    a AS (SELECT stay_id, patient_id, status, TRY_CAST(age_text AS DOUBLE) AS age, CAST(gender = 'Male' AS BIGINT) AS gender,
                 {_SEGMENT_SQL} AS ethnicity, height, weight, {_BMI} AS bmi
          FROM p WHERE TRY_CAST(age_text AS DOUBLE) >= 18 AND gender IN ('Male', 'Female')),
    m AS (SELECT median(height) AS h, median(weight) AS w, median(bmi) AS b FROM a),
    f AS (SELECT stay_id, patient_id, status, age, gender, {_RACE_SQL}, coalesce(height, h) AS height, coalesce(weight, w) AS weight,
                 coalesce(bmi, b) AS bmi, CAST(height IS NOT NULL AS DOUBLE) AS height_avail,
                 CAST(weight IS NOT NULL AS DOUBLE) AS weight_avail, CAST(bmi IS NOT NULL AS DOUBLE) AS bmi_avail FROM a CROSS JOIN m),
    k AS (SELECT * FROM f WHERE height > 100 AND weight > 30),
    u AS (SELECT * FROM k WHERE patient_id NOT IN (SELECT patient_id FROM k WHERE status IS NULL)),
    {_COMORBIDITY_SQL.strip()},
    clean AS (SELECT u.*, {_COMORBIDITY_OUT} FROM u LEFT JOIN comorbid USING (stay_id))"""
_ROUND_BODY = ", ".join(f"ROUND({c}, 6) AS {c}" for c in BODY)


@query("job_stays", f"WITH {_CLEAN_SQL.strip()} SELECT * REPLACE ({_ROUND_BODY}) FROM clean")
def job_stays(spark, sf):
    out = _clean_stays(spark, sf, tables.stays(spark, sf))
    whole = ["gender", *RACE, *COMORBIDITY]
    return out.withColumns({**{c: big(c) for c in whole}, **{c: r6(c) for c in BODY}})


# --- events ------------------------------------------------------------------------------


def _scores(df, start, end):
    """Intervals with organ scores, out of one score."""
    parts = {c: (F.floor("score") % (i + 2)).cast("double") for i, c in enumerate(ORGAN_SCORES[:-1])}
    out = df.select("stay_id", start.alias("start"), end.alias("end"), *[c.alias(n) for n, c in parts.items()])
    return out.withColumn("sofa_total", sum((F.col(c) for c in ORGAN_SCORES[1:-1]), F.col(ORGAN_SCORES[0])))


_SCORE_PARTS = ", ".join(
    f"CAST(CAST(FLOOR(score) AS BIGINT) % {i + 2} AS DOUBLE) AS {c}" for i, c in enumerate(ORGAN_SCORES[:-1])
)
_SCORE_OUT = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ORGAN_SCORES)
_SCORE_TOTAL = " + ".join(ORGAN_SCORES[:-1]) + " AS sofa_total"


def _vent_out(missing: str) -> str:
    named = {**{c: n for c, n in recode.VENTILATION_COLUMNS.items()}}
    return ", ".join(
        f"CAST(coalesce(category = '{c}', FALSE){' OR category IS NULL' if n == missing else ''} AS BIGINT) AS {n}"
        for c, n in named.items()
    )


@query(
    "job_events_offsets",
    f"""
    WITH {_EPISODES_SQL.strip()}, {_CLEAN_SQL.strip()},
    mv AS (SELECT stay_id, vent_start, vent_end, CASE WHEN oxygen_therapy_type <= 1 THEN 'oxygen_therapy' WHEN oxygen_therapy_type = 2 THEN 'unknown'
              WHEN oxygen_therapy_type = 3 THEN 'non_invasive' WHEN oxygen_therapy_type = 4 THEN 'invasive' ELSE 'none' END AS category FROM vents),
    sc AS (SELECT *, {_SCORE_TOTAL} FROM (SELECT i.stay_id, (epoch_us(start_ts) - epoch_us(t0)) // {MINUTE} AS s_start,
              (epoch_us(start_ts) - epoch_us(t0)) // {MINUTE} + 1440 AS s_end, {_SCORE_PARTS} FROM f_intervals i JOIN f_stays USING (stay_id))),
    hr AS (SELECT event_id, stay_id, off_us // {MINUTE} AS minute, value FROM f_off1),
    j AS (SELECT hr.*, mv.category, {', '.join('sc.' + c for c in ORGAN_SCORES)} FROM hr
          LEFT JOIN mv ON hr.stay_id = mv.stay_id AND hr.minute >= mv.vent_start AND hr.minute < mv.vent_end
          LEFT JOIN sc ON hr.stay_id = sc.stay_id AND hr.minute >= sc.s_start AND hr.minute < sc.s_end)
    SELECT j.event_id, j.stay_id, j.minute, ROUND(j.value, 6) AS value, {_vent_out('mv_none')}, {_SCORE_OUT}, clean.age, clean.CCI,
           {', '.join(f"CAST(coalesce(clean.status, '') <> 'Alive' AND j.minute + {60 * h} >= dis.m AS BIGINT) AS death_in_{h}_hours" for h in HORIZON_HOURS)}
    FROM j JOIN clean USING (stay_id)
    JOIN (SELECT stay_id, (epoch_us(t1) - epoch_us(t0)) // {MINUTE} AS m FROM f_stays) dis USING (stay_id)""",
)
def job_events_offsets(spark, sf):
    stays = materialize(
        tables.stays(spark, sf).withColumn(
            "discharge", F.floor(clock.elapsed_us("t0", "t1") / MINUTE)
        ),
        "admitted",
    )
    events = tables.with_offset(tables.m1_events(spark, sf), stays).select(
        "event_id", "stay_id", F.floor(F.col("off_us") / MINUTE).alias("minute"), "value"
    )
    # episodes and clean stays are tables of their own, written by the jobs before this one
    ventilation = jobs.episode_categories(materialize(_job_episodes(spark, sf, stays), "episodes"), "stay_id")
    begun = tables.intervals(spark, sf).join(stays.select("stay_id", "t0"), "stay_id")
    start = F.floor(clock.elapsed_us("t0", "start_ts") / MINUTE)
    clean = _clean_stays(spark, sf, stays).join(stays.select("stay_id", "discharge"), "stay_id")
    out = jobs.enrich_minute_events(
        events,
        ventilation,
        _scores(begun, start, start + 1440),
        materialize(clean, "clean-stays"),
        "stay_id",
        "minute",
        "discharge",
    )
    whole = [*VENTILATION, "CCI", *[f"death_in_{h}_hours" for h in HORIZON_HOURS]]
    return out.select(
        "event_id", "stay_id", "minute", r6("value").alias("value"), *ORGAN_SCORES, "age", *[big(c).alias(c) for c in whole]
    )


def _admitted(spark, sf):
    """Stays with times of admission and death and all attributes, some unknown; written once."""
    people = tables.demographics(spark, sf).select(
        "stay_id",
        recode.recode("gender", recode.GENDER_BY_WORD).alias("gender"),
        F.col("age_text").try_cast("double").alias("age"),
        "height",
        *[
            c.alias(n)
            for n, c in recode.one_hot(
                recode.recode("ethnicity", SEGMENTS, keep_others=True), recode.RACE_COLUMNS
            ).items()
        ],
    )
    stays = tables.stays(spark, sf).select(
        "stay_id", clock.micros("t0").alias("admitted"), clock.micros("death_ts").alias("died")
    )
    full = joins.with_dimension(stays.join(people, "stay_id"), _comorbidity(spark, sf), ["stay_id"])
    return materialize(full, "admitted")


def _enriched(spark, sf, stays, admissions):
    ticks = micro_intervals(tables.intervals(spark, sf))
    weights = ticks.select("stay_id", "start", "end", (50 + F.col("score") / 10).alias("weight"))
    longer = tables.ticks(spark, sf).select(
        "stay_id", clock.micros("ts").alias("t"), (F.col("event_id") % 97).cast("double").alias("score")
    )
    scores = _scores(longer, F.col("t"), F.col("t") + 48 * HOUR_US)
    events = micro_events(tables.m1_events(spark, sf)).drop("ts")
    return jobs.enrich_timestamp_events(
        events, stays, weights, categories(spark, sf), scores, admissions, "stay_id", "ts_us"
    )


_ENRICHED_SQL = f"""
    {_COMORBIDITY_SQL.strip()},
    st AS (SELECT s.stay_id, epoch_us(s.t0) AS admitted, epoch_us(s.death_ts) AS died, CASE gender WHEN 'Male' THEN 1 WHEN 'Female' THEN 0 END AS gender,
                  TRY_CAST(age_text AS DOUBLE) AS age, height, {_SEGMENT_SQL} AS ethnicity, c.* EXCLUDE (stay_id)
           FROM f_stays s JOIN f_demo USING (stay_id) LEFT JOIN comorbid c USING (stay_id)),
    w AS (SELECT e.event_id, e.value, epoch_us(e.ts) AS ts_us, st.*, 50 + i.score / 10 AS weight
          FROM f_m1 e JOIN st USING (stay_id) JOIN f_intervals i ON e.stay_id = i.stay_id AND e.ts >= i.start_ts AND e.ts <= i.end_ts),
    wb AS (SELECT *, {_BMI} AS bmi FROM w),
    wm AS (SELECT median(height) AS h, median(weight) AS w, median(bmi) AS b FROM wb),
    body AS (SELECT wb.* REPLACE (coalesce(height, h) AS height, coalesce(weight, w) AS weight, coalesce(bmi, b) AS bmi),
                 CAST(height IS NOT NULL AS DOUBLE) AS height_avail, CAST(weight IS NOT NULL AS DOUBLE) AS weight_avail,
                 CAST(bmi IS NOT NULL AS DOUBLE) AS bmi_avail FROM wb CROSS JOIN wm),
    mv AS (SELECT stay_id, epoch_us(start_ts) AS v_start, epoch_us(end_ts) AS v_end, {CATEGORY_SQL} AS category FROM f_intervals),
    sc AS (SELECT *, {_SCORE_TOTAL} FROM (SELECT stay_id, t AS s_start, t + {48 * HOUR_US} AS s_end, {_SCORE_PARTS}
              FROM (SELECT stay_id, epoch_us(ts) AS t, CAST(event_id % 97 AS DOUBLE) AS score FROM f_ticks))),
    j AS (SELECT body.*, mv.category, sc.s_start, {', '.join('sc.' + c for c in ORGAN_SCORES)} FROM body
          LEFT JOIN mv ON body.stay_id = mv.stay_id AND ts_us >= v_start AND ts_us < v_end
          LEFT JOIN sc ON body.stay_id = sc.stay_id AND ts_us >= s_start AND ts_us < s_end),
    enriched AS (SELECT event_id, stay_id, value, ts_us, ts_us - admitted AS off_us, died, gender, age, height, weight, bmi, height_avail, weight_avail, bmi_avail,
           {_COMORBIDITY_OUT}, {_SCORE_OUT}, {_vent_out('mv_unknown')}, {_RACE_SQL},
           {', '.join(f"CAST(coalesce(ts_us + {h * HOUR_US} >= died, FALSE) AS BIGINT) AS death_in_{h}_hours" for h in HORIZON_HOURS)}
          FROM j)"""

_WHOLE = ["gender", *COMORBIDITY, *VENTILATION, *RACE]
_LABELS = [f"death_in_{h}_hours" for h in HORIZON_HOURS]


@query(
    "job_events_timestamps",
    f"""WITH {_ENRICHED_SQL.strip()}
    SELECT * EXCLUDE (died, ts_us, value) REPLACE ({_ROUND_BODY}, CAST(coalesce(gender, -1) AS BIGINT) AS gender, coalesce(age, -1) AS age),
           ROUND(value, 6) AS value FROM enriched""",
)
def job_events_timestamps(spark, sf):
    full = _admitted(spark, sf)
    admissions = full.select("stay_id", "died", *RACE)
    out = _enriched(spark, sf, full.drop("died", *RACE), admissions).drop("died", "ts_us", "admitted")
    return out.withColumns(
        {
            **{c: r6(c) for c in [*BODY, "value"]},
            "age": F.coalesce("age", F.lit(-1.0)),
            **{c: big(c) for c in [*COMORBIDITY, *VENTILATION, *RACE, *_LABELS]},
            "gender": big(F.coalesce("gender", F.lit(-1))),
        }
    )


@query(
    "job_events_simple",
    """
    SELECT o.o_orderkey, o.o_custkey AS stay_id, ROUND(o.o_totalprice, 6) AS value, coalesce(epoch_us(o.o_orderdate) - epoch_us(s.t0), 0) AS off_us,
           CAST(s.death_ts IS NOT NULL AS BIGINT) AS death_status
    FROM orders o LEFT JOIN f_stays s ON o.o_custkey = s.stay_id WHERE lower(o_orderpriority) LIKE '%urgent%'""",
)
def job_events_simple(spark, sf):
    events = tables.table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("stay_id"),
        F.col("o_totalprice").alias("value"),
        clock.micros("o_orderdate").alias("ordered"),
        "o_orderpriority",
    )
    people = tables.stays(spark, sf).select(
        "stay_id", clock.micros("t0").alias("arrived"), clock.micros("death_ts").alias("deceased")
    )
    out = jobs.enrich_named_events(events, "o_orderpriority", "Urgent", people, ["stay_id"], "ordered")
    return out.select(
        "o_orderkey",
        "stay_id",
        r6("value").alias("value"),
        F.coalesce("off_us", F.lit(0)).alias("off_us"),
        big(F.coalesce("death_status", F.lit(0))).alias("death_status"),
    )


# --- cohorts -----------------------------------------------------------------------------


def _cohort(spark, sf):
    full = _admitted(spark, sf)
    times = full.select("stay_id", "admitted", "height"), full.select("stay_id", "died")
    # the enriched events are written once, as the aggregates read them twice
    m1 = _enriched(spark, sf, *times).filter(clock.window_test("off_us", *WINDOW))
    label = f"death_in_{OW}_hours"
    m1 = materialize(m1.select("event_id", "stay_id", "off_us", "value", *jobs.EVENT_FEATURES, label), "m1-events")
    m2 = jobs.second_measure_events(
        micro_events(tables.m2_events(spark, sf)).drop("ts"), *times, "stay_id", "ts_us"
    )
    return jobs.assemble_cohort(
        m1.withColumnRenamed(label, "died_soon"),
        m2,
        full.select("stay_id", big(F.col("died").isNotNull()).alias("dead24")),
        "stay_id",
        "off_us",
        "value",
        "dead24",
        WINDOW,
        {**jobs.EVENT_FEATURES, "died_soon": "max"},
        order=["off_us", "event_id"],
        attributes=select.fill_zero(full.select("stay_id", *jobs.STAY_FEATURES), COMORBIDITY),
    )


def _cohort_out(df, *more):
    middle = ["m1_valuenum", "m2_valuenum", "age", *BODY]
    return df.select(
        "stay_id",
        *[r6(F.coalesce(c, F.lit(-1.0))).alias(c) for c in middle],
        *BODY_AVAILABLE,
        *[big(F.coalesce(c, F.lit(-1))).alias(c) for c in ("gender", "mortality", *more)],
        *[big(c).alias(c) for c in (*COMORBIDITY, *VENTILATION, *RACE)],
        *ORGAN_SCORES,
        big("died_soon").alias("died_soon"),
    )


_FIRST_SQL = ", ".join(
    f"arg_min({c}, (off_us, event_id, {c})) AS {c}"
    for c in [*BODY_AVAILABLE, *COMORBIDITY, *ORGAN_SCORES, *VENTILATION, *RACE]
)
_COHORT_SQL = f"""
    {_ENRICHED_SQL.strip()},
    a AS (SELECT stay_id, ROUND(median(value), 6) AS m1_valuenum, ROUND(coalesce(median(age), -1), 6) AS age, ROUND(median(height), 6) AS height,
                 ROUND(median(weight), 6) AS weight, ROUND(median(bmi), 6) AS bmi, CAST(coalesce(MIN(gender), -1) AS BIGINT) AS gender,
                 {_FIRST_SQL}, MAX(death_in_{OW}_hours) AS died_soon
          FROM enriched WHERE off_us >= {WINDOW[0]} AND off_us < {WINDOW[1]} GROUP BY stay_id),
    b AS (SELECT stay_id, ROUND(median(value), 6) AS m2_valuenum FROM f_off2 WHERE off_us >= {WINDOW[0]} AND off_us < {WINDOW[1]} GROUP BY stay_id),
    cohort AS (SELECT a.*, b.m2_valuenum, CAST(s.death_ts IS NOT NULL AS BIGINT) AS mortality
               FROM a JOIN b USING (stay_id) JOIN f_stays s USING (stay_id))"""


@query("job_cohort_eval", f"WITH {_COHORT_SQL.strip()} SELECT * FROM cohort")
def job_cohort_eval(spark, sf):
    return _cohort_out(_cohort(spark, sf))


@query(
    "job_cohort_folds",
    f"""WITH {_COHORT_SQL.strip()}
    SELECT *, (row_number() OVER (PARTITION BY mortality ORDER BY md5(concat(stay_id, '|42')), stay_id) - 1) % 5 AS fold FROM cohort""",
)
def job_cohort_folds(spark, sf):
    rows = materialize(_cohort(spark, sf), "cohort")
    return _cohort_out(jobs.cohort_with_folds(rows, "stay_id"), "fold")


@query(
    "cohort_features",
    f"""WITH {_COHORT_SQL.strip()}
    SELECT stay_id, {', '.join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)}, mortality FROM cohort""",
)
def cohort_features(spark, sf):
    """The feature matrix itself: all features in the order of the models."""
    features = [r6(F.coalesce(F.col(c).cast("double"), F.lit(-1.0))).alias(c) for c in FEATURES]
    return _cohort(spark, sf).select("stay_id", *features, "mortality")
