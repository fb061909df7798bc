"""The jobs: inputs to episodes, cleaned stays, enriched events, cohorts and pooled tables.

All inputs are DataFrames and all times whole numbers, in microseconds or minutes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.functions import clock, recode, therapy
from staytide.functions import values as V
from staytide.operators import cohort, episodes, folds, intervals, joins, profile, select
from staytide.schemas import (
    BODY,
    BODY_AVAILABLE,
    COLLAPSE,
    COMORBIDITY,
    DEMOGRAPHICS,
    HORIZON_HOURS,
    HOUR_US,
    ORGAN_SCORES,
    RACE,
    VENTILATION,
)
from staytide.session import materialize

EPISODE_GAP_MIN = 24 * 60
EPISODE_TAIL_MIN = 60


def therapy_ticks(texts: DataFrame, flows: DataFrame, shares: DataFrame, key: str) -> DataFrame:
    """Charted texts (minute, text, active), oxygen flows (minute, flow) and oxygen shares
    (minute, share) as therapy ticks: (key, minute, type, active, supplemental).

    A text of several types counts with the highest, and as supplemental if one of them is -1.
    """
    kinds = F.col("_types")
    from_text = (
        therapy.with_therapy_types(texts, "text", "_types")
        .filter(F.size(kinds) > 0)
        .select(
            key,
            "minute",
            F.array_max(kinds).alias("type"),
            F.coalesce("active", F.lit(False)).alias("active"),
            F.array_contains(kinds, -1).cast("int").alias("supplemental"),
        )
    )

    def measured(df: DataFrame, kind: Column) -> DataFrame:
        return (
            df.withColumn("type", kind)
            .filter(F.col("type").isNotNull())
            .select(
                key,
                "minute",
                "type",
                F.lit(False).alias("active"),
                (F.col("type") == -1).cast("int").alias("supplemental"),
            )
        )

    every = (
        from_text.unionByName(measured(flows, therapy.oxygen_flow_type("flow")))
        .unionByName(measured(shares, therapy.oxygen_share_type("share")))
        .filter(F.col("minute") >= therapy.EARLIEST_MINUTE)
    )
    return episodes.highest_per_time(every, [key], "minute", ["type", "active", "supplemental"])


def therapy_episodes(ticks: DataFrame, stays: DataFrame, key: str, discharge: str) -> DataFrame:
    """Ventilation episodes with their end; `discharge` is the minute a stay ends."""
    found = episodes.episodes(
        ticks, [key], "minute", EPISODE_GAP_MIN, ["type", "active", "supplemental"], chunk_width=60
    )
    ended = found.join(stays.select(key, discharge), key, "left")
    return ended.select(
        key,
        F.col("episode").alias("ventnum"),
        F.col("first_tick").alias("vent_start"),
        episodes.episode_end(
            F.col("last_tick"), EPISODE_TAIL_MIN, F.col("active"), F.col(discharge)
        ).alias("vent_end"),
        F.col("type").alias("oxygen_therapy_type"),
        F.col("supplemental").alias("supp_oxygen"),
        F.col("active").alias("activeupondischarge"),
    )


def with_body(df: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """Adds body-mass index and availability flags, then fills what is missing with medians.

    The medians are those of `df`, or of `over`, which has height and weight too.
    """
    bmi = V.body_mass_index("height", "weight")
    df = df.withColumn("bmi", bmi).withColumns({f"{c}_avail": V.available(c) for c in BODY})
    return profile.fill_median(df, BODY, None if over is None else over.withColumn("bmi", bmi))


def clean_stays(
    stays: DataFrame,
    charted: DataFrame,
    comorbidity: DataFrame,
    key: str,
    parent: str,
    ethnicity: Mapping[str, str] = recode.ETHNICITY,
) -> DataFrame:
    """Adult stays with known outcome and charted measures, recoded, completed and with comorbidities.

    The chosen stays are written once, as the medians and the check of parents read them again.
    """
    kept = joins.keep_listed_parents(stays, charted, key, parent)
    kept = select.adults(kept, "age", "gender")
    kept = kept.withColumns(
        {
            "gender": recode.recode("gender", recode.GENDER_BY_WORD),
            "ethnicity": recode.recode("ethnicity", ethnicity, keep_others=True),
        }
    )
    kept = kept.withColumns(recode.one_hot("ethnicity", recode.RACE_COLUMNS)).drop("ethnicity")
    kept = with_body(materialize(kept, "stays"))
    kept = kept.filter((F.col("height") > 100) & (F.col("weight") > 30))
    kept = joins.drop_parents(kept, kept.filter(F.col("status").isNull()), parent)
    return select.fill_zero(joins.with_dimension(kept, comorbidity, [key]), COMORBIDITY)


def with_states(
    events: DataFrame,
    ventilation: DataFrame,
    scores: DataFrame,
    key: str,
    time: str,
    missing_ventilation: str,
) -> DataFrame:
    """Events with the ventilation and organ scores of the moment.

    Both inputs have start and end; ventilation has a category. Events without interval stay.
    """
    out = intervals.interval_join(events, ventilation, [key], time, "start", "end").drop("start", "end")
    out = intervals.interval_join(out, scores, [key], time, "start", "end").drop("start", "end")
    out = out.withColumns(
        recode.one_hot("category", recode.VENTILATION_COLUMNS, missing=missing_ventilation)
    )
    return select.fill_zero(out.drop("category"), ORGAN_SCORES)


def episode_categories(
    ventilation_episodes: DataFrame, key: str, legacy_labels: bool = False
) -> DataFrame:
    """Episodes as intervals with a ventilation category, for `with_states`.

    With `legacy_labels` invasive and other ventilation get labels that no one-hot column knows,
    as in data made before the labels were put right.
    """
    classes = recode.LEGACY_CLASSES if legacy_labels else recode.THERAPY_CLASSES
    return ventilation_episodes.select(
        key,
        F.col("vent_start").alias("start"),
        F.col("vent_end").alias("end"),
        recode.threshold_class("oxygen_therapy_type", classes).alias("category"),
    )


def enrich_minute_events(
    events: DataFrame,
    ventilation: DataFrame,
    scores: DataFrame,
    stays: DataFrame,
    key: str,
    offset: str,
    discharge: str,
    how: str = "inner",
) -> DataFrame:
    """Events in minutes with states, stay attributes and outcome labels.

    The time of death is the discharge, unless the stay's status is "Alive". `how` joins the
    stays: the second measure keeps events of stays that were cleaned away ("left").
    """
    out = with_states(events, ventilation, scores, key, offset, "mv_none")
    out = joins.with_dimension(out, stays, [key], how)
    labels = clock.horizon_labels(
        offset, discharge, HORIZON_HOURS, unit_per_hour=60, alive=F.col("status") == "Alive"
    )
    return out.withColumns(labels)


def enrich_timestamp_events(
    events: DataFrame,
    stays: DataFrame,
    weights: DataFrame,
    ventilation: DataFrame,
    scores: DataFrame,
    admissions: DataFrame,
    key: str,
    time: str,
) -> DataFrame:
    """Events with stay attributes, the weight of the moment, states and outcome labels.

    `time` and all starts and ends are microseconds. `stays` has `admitted`, height and further
    attributes, `admissions` has `died` and further ones. For a cohort leave the further ones out:
    they are the same on all events of a stay, and join its one row in the end.

    Only what the interval joins and the window need goes with the events through them; a filter
    on `off_us` moves in front of them. Medians are those of all events with a weight, before
    overlapping states repeat an event.
    """
    early = [key, "admitted", "height"]
    placed = joins.with_dimension(events, stays.select(early), [key]).withColumn(
        "off_us", F.col(time) - F.col("admitted")
    )
    weighed = intervals.interval_join(
        placed, weights, [key], time, "start", "end", how="inner", closed=True
    ).drop("start", "end")
    out = with_body(
        with_states(weighed, ventilation, scores, key, time, "mv_unknown"),
        over=weighed.select("height", "weight"),
    )
    late = [c for c in stays.columns if c not in early]
    if late:
        out = joins.with_dimension(out, stays.select(key, *late), [key])
        out = select.fill_zero(out, [c for c in COMORBIDITY if c in late])
    out = joins.with_dimension(out, admissions, [key], "inner")
    return out.withColumns(clock.horizon_labels(time, "died", HORIZON_HOURS))


def second_measure_events(events: DataFrame, stays: DataFrame, admissions: DataFrame, key: str, time: str):
    """Events of the second measure: stay attributes and offset, but no states or labels."""
    out = joins.with_dimension(events, stays, [key]).withColumn("off_us", F.col(time) - F.col("admitted"))
    return joins.with_dimension(out, admissions, [key], "inner")


def enrich_named_events(
    events: DataFrame, name: str, part: str, people: DataFrame, keys: Sequence[str], time: str
) -> DataFrame:
    """Events whose name holds a text, with a person's attributes, offset and death status.

    `people` has `arrived` and `deceased` in microseconds.
    """
    status = people.withColumn("death_status", F.col("deceased").isNotNull().cast("int"))
    out = joins.with_dimension(select.by_name(events, name, part), status, keys)
    return out.withColumn("off_us", F.col(time) - F.col("arrived"))


def assemble_cohort(
    m1: DataFrame,
    m2: DataFrame,
    cohort_list: DataFrame,
    key: str,
    offset: str,
    value: str,
    label: str,
    window: tuple[int, int],
    spec: Mapping[str, str],
    order: Sequence[str],
    attributes: DataFrame | None = None,
) -> DataFrame:
    """One feature row per listed stay that has both measures in the window.

    `spec` tells how each attribute on the events of m1 becomes one value. Both measures shrink
    to one row per stay in the same pass; stays without one of them fall out. `attributes` has
    one row per stay and joins last, so it does not travel with the events.
    """
    inside = clock.window_test(offset, *window)
    first = m1.filter(inside).select(key, offset, value, *{*spec, *order} - {key, offset, value})
    second = m2.filter(inside).select(key, offset, value)
    listed = joins.keep_listed(cohort.side_by_side(first, second, value), cohort_list, key)
    rows = cohort.collapse(
        listed, [key], {"m1_valuenum": "median", "m2_valuenum": "median", **spec}, order
    ).dropna(subset=["m1_valuenum", "m2_valuenum"])
    if attributes is not None:
        rows = joins.with_dimension(rows, attributes, [key])
    return rows.join(cohort_list.select(key, F.col(label).alias("mortality")), key)


def cohort_with_folds(cohort_rows: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return folds.stratified_folds(cohort_rows, key, "mortality", k, seed)


# features that change from event to event, and how they shrink to one value
EVENT_FEATURES = {c: COLLAPSE[c] for c in [*BODY, *BODY_AVAILABLE, *ORGAN_SCORES, *VENTILATION]}
# features that are the same for the whole stay
STAY_FEATURES = [*DEMOGRAPHICS, *COMORBIDITY, *RACE]

CLINICAL_WINDOW = clock.window_before(moment=18, length=12)
POOLED_MOMENTS = (12, 18, 24, 30)


def strata_counts(
    m1: DataFrame,
    m2: DataFrame,
    key: str,
    offset: str,
    death_offset: str,
    label: str,
    moment: int,
    length: int,
    outcome: int,
    order: Sequence[str],
    unit: int = HOUR_US,
) -> DataFrame:
    """Stays with both measures in the window, by time of death and label: (stratum, label, n)."""
    inside = clock.window_test(offset, *clock.window_before(moment, length, unit))
    first = (
        m1.filter(inside)
        .groupBy(key)
        .agg(cohort.first_known(label, order).alias("label"), F.max(death_offset).alias("_died"))
    )
    both = joins.keep_listed(first, m2.filter(inside), key)
    stratum = clock.outcome_stratum("_died", moment, outcome, unit)
    return both.groupBy(stratum.alias("stratum"), "label").agg(F.count(F.lit(1)).alias("n"))
