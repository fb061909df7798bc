"""Queries: sources and sinks, filters, projections, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StructField,
    StructType,
    TimestampNTZType,
)

from staytide.functions import clock, recode, therapy
from staytide.functions import values as V
from staytide.operators import cohort, intervals, profile, quantiles, select
from staytide.plans.registry import query, risk_sql
from staytide.schemas import HORIZON_HOURS, HOUR_US
from staytide.session import shared_dir
from staytide.sources import csvio, tables

# Window on the given events: twelve days before day 18.
PW, MOP, OW = 288, 432, 240
WINDOW = clock.window_before(MOP, PW)
IN_WINDOW = f"off_us >= {WINDOW[0]} AND off_us < {WINDOW[1]}"


def r6(c):
    return V.rounded(c)


def big(c):
    return V.as_col(c).cast("bigint")


# --- sources and sinks -------------------------------------------------------------------


@query("scan_project", "SELECT event_id, user_id, event_type, ROUND(value, 6) AS value FROM events")
def scan_project(spark, sf):
    return tables.table(spark, sf, "events").select("event_id", "user_id", "event_type", r6("value").alias("value"))


@query(
    "csv_scan",
    "SELECT o_orderkey, o_custkey, o_orderpriority, ROUND(o_totalprice, 6) AS o_totalprice FROM orders",
)
def csv_scan(spark, sf):
    orders = tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    path = shared_dir(spark, "orders-csv")
    orders.write.option("header", True).csv(path)
    read = csvio.read_csv(spark, path, orders.schema)
    return read.withColumn("o_totalprice", r6("o_totalprice"))


@query(
    "coerce_timestamps",
    """
    SELECT event_id,
           CASE WHEN event_id % 7 = 3 THEN -1 ELSE epoch_us(date_trunc('second', ts)) END AS ts_us,
           CASE WHEN event_id % 5 = 2 THEN -1
                ELSE ((event_id % 40) * 86400 + (event_id % 24) * 3600 + (event_id % 60) * 60 + 30) * 1000000
                     + 250000 END AS time_diff_us,
           CASE WHEN event_id % 11 = 0 THEN -1.0 ELSE ROUND(value, 6) END AS value
    FROM events""",
)
def coerce_timestamps(spark, sf):
    e = F.col("event_id")
    text = tables.table(spark, sf, "events").select(
        e,
        F.when(e % 7 == 3, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("charttime"),
        F.when(e % 5 == 2, "later")
        .otherwise(F.format_string("%d days %02d:%02d:30.250000", e % 40, e % 24, e % 60))
        .alias("time_diff"),
        F.when(e % 11 == 0, float("nan")).otherwise(F.col("value")).alias("valuenum"),
    )
    path = shared_dir(spark, "events-csv")
    text.write.option("header", True).csv(path)
    schema = StructType(
        [
            StructField("event_id", LongType()),
            StructField("charttime", TimestampNTZType()),
            StructField("time_diff", LongType()),
            StructField("valuenum", DoubleType()),
        ]
    )
    read = csvio.read_events(
        spark, path, schema, timestamps=["charttime"], durations=["time_diff"], numbers=["valuenum"]
    )
    return read.select(
        "event_id",
        F.coalesce(clock.micros("charttime"), F.lit(-1)).alias("ts_us"),
        F.coalesce("time_diff", F.lit(-1)).alias("time_diff_us"),
        F.coalesce(r6("valuenum"), F.lit(-1.0)).alias("value"),
    )


@query(
    "length_of_stay",
    """
    SELECT stay_id, epoch_us(t1) - epoch_us(t0) AS length_us,
           ROUND((epoch_us(t1) - epoch_us(t0)) / 3600000000.0::DOUBLE, 6) AS hours
    FROM f_stays""",
)
def length_of_stay(spark, sf):
    stays = csvio.with_length(tables.stays(spark, sf), "t0", "t1")
    return stays.select("stay_id", "length_us", r6(F.col("length_us") / HOUR_US).alias("hours"))


@query(
    "partitioned_sink_roundtrip",
    """
    SELECT CAST(o_orderkey % 2 * 6 + 6 AS BIGINT) AS pw, CAST(o_custkey % 3 * 6 + 12 AS BIGINT) AS mop,
           CAST(24 AS BIGINT) AS ow, CAST(o_orderkey % 5 AS BIGINT) AS fold,
           COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
    FROM orders GROUP BY ALL""",
)
def partitioned_sink_roundtrip(spark, sf):
    rows = tables.table(spark, sf, "orders").select(
        "o_orderkey",
        "o_totalprice",
        (F.col("o_orderkey") % 2 * 6 + 6).alias("pw"),
        (F.col("o_custkey") % 3 * 6 + 12).alias("mop"),
        F.lit(24).cast("bigint").alias("ow"),
        (F.col("o_orderkey") % 5).alias("fold"),
    )
    path = shared_dir(spark, "cohorts")
    csvio.write_partitioned(rows, path, ["pw", "mop", "ow", "fold"])
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("pw", "mop", "ow", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "merge_batches",
    """
    WITH batches AS (
      SELECT o_orderkey AS case_id, o_totalprice AS optimal, CAST(o_orderkey % 4 AS INT) AS batch FROM orders
      UNION ALL
      SELECT o_orderkey, o_totalprice + 1, 3 - CAST(o_orderkey % 4 AS INT) FROM orders WHERE o_orderkey % 10 = 0),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY batch, optimal) AS rn FROM batches)
    SELECT case_id, CAST(batch AS BIGINT) AS batch, ROUND(optimal, 6) AS optimal FROM ranked WHERE rn = 1""",
)
def merge_batches(spark, sf):
    from staytide.operators.folds import first_per_key

    k = F.col("o_orderkey")
    orders = tables.table(spark, sf, "orders")
    once = orders.select(k.alias("case_id"), F.col("o_totalprice").alias("optimal"), (k % 4).cast("int").alias("batch"))
    again = orders.filter(k % 10 == 0).select(
        k.alias("case_id"), (F.col("o_totalprice") + 1).alias("optimal"), (3 - k % 4).cast("int").alias("batch")
    )
    root = shared_dir(spark, "batches")
    every = once.unionByName(again)
    for i in range(4):
        every.filter(F.col("batch") == i).drop("batch").write.option("header", True).csv(f"{root}/batch_{i}")
    schema = StructType([StructField("case_id", LongType()), StructField("optimal", DoubleType())])
    merged = csvio.read_batches(spark, root, schema)
    return first_per_key(merged, ["case_id"], ["batch", "optimal"]).select(
        "case_id", big("batch").alias("batch"), r6("optimal").alias("optimal")
    )


@query(
    "sql_view_query",
    """
    SELECT coalesce(s.status, 'unknown') AS status, COUNT(*) AS n_events, COUNT(DISTINCT e.stay_id) AS n_stays,
           ROUND(AVG(e.value), 6) AS mean_value
    FROM f_m1 e JOIN f_stays s USING (stay_id) GROUP BY ALL""",
)
def sql_view_query(spark, sf):
    return spark.sql(
        """
        SELECT coalesce(s.status, 'unknown') AS status, COUNT(*) AS n_events, COUNT(DISTINCT e.stay_id) AS n_stays,
               ROUND(AVG(e.value), 6) AS mean_value
        FROM {events} e JOIN {stays} s ON e.stay_id = s.stay_id
        GROUP BY coalesce(s.status, 'unknown')""",
        events=tables.m1_events(spark, sf),
        stays=tables.stays(spark, sf),
    )


# --- filters and projections -------------------------------------------------------------


@query(
    "rename_drop",
    "SELECT o_orderkey AS case_id, o_custkey AS stay_id, ROUND(o_totalprice, 6) AS m1_valuenum FROM orders",
)
def rename_drop(spark, sf):
    return (
        tables.table(spark, sf, "orders")
        .drop("o_orderstatus", "o_orderdate", "o_orderpriority")
        .withColumnsRenamed({"o_orderkey": "case_id", "o_custkey": "stay_id", "o_totalprice": "m1_valuenum"})
        .withColumn("m1_valuenum", r6("m1_valuenum"))
    )


@query("filter_code_list", "SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'purchase')")
def filter_code_list(spark, sf):
    return select.by_code(tables.table(spark, sf, "events"), "event_type", ["click", "purchase"]).select(
        "event_id", "user_id"
    )


@query("filter_range", "SELECT event_id, ROUND(value, 6) AS value FROM events WHERE value BETWEEN 30 AND 300")
def filter_range(spark, sf):
    kept = select.plausible(tables.table(spark, sf, "events"), "value", 30, 300)
    return kept.select("event_id", r6("value").alias("value"))


@query(
    "filter_numeric_text",
    r"""SELECT stay_id, CAST(age_text AS DOUBLE) AS age FROM
        (SELECT * FROM f_demo WHERE regexp_matches(age_text, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'))""",
)
def filter_numeric_text(spark, sf):
    return select.numeric(tables.demographics(spark, sf), "age_text", "age").select("stay_id", "age")


@query("filter_not_null", "SELECT stay_id, ROUND(weight, 6) AS weight FROM f_demo WHERE weight IS NOT NULL AND height IS NOT NULL")
def filter_not_null(spark, sf):
    kept = select.without_missing(tables.demographics(spark, sf), "weight", "height")
    return kept.select("stay_id", r6("weight").alias("weight"))


@query(
    "filter_regex_any",
    """
    SELECT doc_id, regexp_matches(text, 'tion|heon|eaux') AS any_part,
           contains(text, 'ent') AND NOT contains(text, 'ment') AS guarded
    FROM documents
    WHERE regexp_matches(text, 'tion|heon|eaux') OR (contains(text, 'ent') AND NOT contains(text, 'ment'))""",
)
def filter_regex_any(spark, sf):
    any_part = therapy.any_of("text", ["tion", "heon", "eaux"])
    guarded = therapy.holds_without("text", "ent", "ment")
    docs = tables.table(spark, sf, "documents")
    return docs.filter(any_part | guarded).select("doc_id", any_part.alias("any_part"), guarded.alias("guarded"))


@query("filter_icontains", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'there')")
def filter_icontains(spark, sf):
    return select.by_name(tables.table(spark, sf, "documents"), "text", "THERE").select("doc_id", "n_chars")


@query(
    "cohort_filter",
    """
    SELECT stay_id, TRY_CAST(age_text AS DOUBLE) AS age, gender FROM f_demo
    WHERE TRY_CAST(age_text AS DOUBLE) >= 40 AND gender IN ('Female', 'Male')""",
)
def cohort_filter(spark, sf):
    kept = select.adults(tables.demographics(spark, sf), "age_text", "gender", min_age=40)
    return kept.select("stay_id", F.col("age_text").alias("age"), "gender")


def _offsets(spark, sf):
    """Both measures with their offset since admission, and the offset of death."""
    stays = tables.stays(spark, sf).withColumn("death_us", clock.elapsed_us("t0", "death_ts"))
    return (
        tables.with_offset(tables.m1_events(spark, sf), stays, "death_us"),
        tables.with_offset(tables.m2_events(spark, sf), stays, "death_us"),
    )


_FORWARD = clock.window_after(144, 288)


@query(
    "cohort_value_band",
    f"""
    SELECT a.stay_id, ROUND(a.m1, 6) AS m1_valuenum, ROUND(b.m2, 6) AS m2_valuenum FROM
      (SELECT stay_id, median(value) AS m1 FROM f_off1 WHERE off_us >= {_FORWARD[0]} AND off_us < {_FORWARD[1]} GROUP BY stay_id) a
      JOIN (SELECT stay_id, median(value) AS m2 FROM f_off2 WHERE off_us >= {_FORWARD[0]} AND off_us < {_FORWARD[1]} GROUP BY stay_id) b
      USING (stay_id)
    WHERE a.m1 BETWEEN 20 AND 60 AND b.m2 BETWEEN 45 AND 90""",
)
def cohort_value_band(spark, sf):
    m1, m2 = _offsets(spark, sf)
    pairs = cohort.pair_measurements(m1, m2, ["stay_id"], "value", _FORWARD, "off_us")
    found = select.in_band(pairs, {"m1_valuenum": (20, 60), "m2_valuenum": (45, 90)})
    return found.select("stay_id", r6("m1_valuenum").alias("m1_valuenum"), r6("m2_valuenum").alias("m2_valuenum"))


@query("window_slice", f"SELECT event_id, stay_id, off_us FROM f_off1 WHERE {IN_WINDOW}")
def window_slice(spark, sf):
    m1, _ = _offsets(spark, sf)
    return m1.filter(clock.window_test("off_us", *WINDOW)).select("event_id", "stay_id", "off_us")


@query(
    "window_slice_forward",
    f"SELECT event_id, stay_id, off_us FROM f_off2 WHERE off_us >= {_FORWARD[0]} AND off_us < {_FORWARD[1]}",
)
def window_slice_forward(spark, sf):
    _, m2 = _offsets(spark, sf)
    return m2.filter(clock.window_test("off_us", *_FORWARD)).select("event_id", "stay_id", "off_us")


@query(
    "fill_zero_group",
    "SELECT stay_id, ROUND(coalesce(height, 0), 6) AS height, ROUND(coalesce(weight, 0), 6) AS weight FROM f_demo",
)
def fill_zero_group(spark, sf):
    filled = select.fill_zero(tables.demographics(spark, sf), ["height", "weight"])
    return filled.select("stay_id", r6("height").alias("height"), r6("weight").alias("weight"))


# --- scalar functions --------------------------------------------------------------------

SEGMENTS = {"AUTOMOBILE": "WHITE", "BUILDING": "BLACK", "FURNITURE": "LATINO", "MACHINERY": "OTHER"}
_SEGMENT_SQL = (
    "CASE ethnicity " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SEGMENTS.items()) + " ELSE ethnicity END"
)


@query(
    "recode_categories",
    f"""
    SELECT stay_id, CAST(CASE gender WHEN 'Male' THEN 1 WHEN 'Female' THEN 0 ELSE -1 END AS BIGINT) AS gender,
           {_SEGMENT_SQL} AS ethnicity
    FROM f_demo""",
)
def recode_categories(spark, sf):
    return tables.demographics(spark, sf).select(
        "stay_id",
        big(F.coalesce(recode.recode("gender", recode.GENDER_BY_WORD), F.lit(-1))).alias("gender"),
        recode.recode("ethnicity", SEGMENTS, keep_others=True).alias("ethnicity"),
    )


_PART_RULES = [("ring", "WHITE"), ("small", "BLACK"), ("bolt", "LATINO"), ("red", "OTHER"), ("gear", "OTHER")]


@query(
    "recode_first_match",
    "SELECT p_partkey, CASE "
    + " ".join(f"WHEN contains(p_name, '{a}') THEN '{b}'" for a, b in _PART_RULES)
    + " ELSE p_name END AS race FROM part",
)
def recode_first_match(spark, sf):
    return tables.table(spark, sf, "part").select(
        "p_partkey", recode.recode_first_match("p_name", _PART_RULES).alias("race")
    )


_ONE_HOT = {"AUTOMOBILE": "race_w", "BUILDING": "race_b", "FURNITURE": "race_l", "MACHINERY": "race_o"}


@query(
    "one_hot",
    "SELECT stay_id, "
    + ", ".join(f"CAST(ethnicity = '{a}' AS BIGINT) AS {b}" for a, b in _ONE_HOT.items())
    + " FROM f_demo",
)
def one_hot(spark, sf):
    columns = recode.one_hot("ethnicity", _ONE_HOT)
    return tables.demographics(spark, sf).select("stay_id", *[big(c).alias(n) for n, c in columns.items()])


def micro_events(df):
    """Events with their time in microseconds since 1970."""
    return df.withColumn("ts_us", clock.micros("ts"))


def micro_intervals(df):
    return df.select(
        "stay_id", clock.micros("start_ts").alias("start"), clock.micros("end_ts").alias("end"), "score"
    )


_CATEGORY = ["invasive", "non_invasive", "oxygen_therapy", "none"]


def categories(spark, sf):
    """Intervals with a ventilation category."""
    names = F.array(*[F.lit(c) for c in _CATEGORY])
    return micro_intervals(tables.intervals(spark, sf)).select(
        "stay_id", "start", "end", names[F.floor("score").cast("int") % 4].alias("category")
    )


CATEGORY_SQL = (
    "CASE CAST(FLOOR(score) AS INT) % 4 "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATEGORY))
    + " END"
)
VENT_SQL = ", ".join(
    f"CAST(coalesce(category = '{c}', FALSE) AS BIGINT) AS {recode.VENTILATION_COLUMNS[c]}" for c in _CATEGORY
)


@query(
    "one_hot_missing_bucket",
    f"""
    SELECT event_id, {VENT_SQL}, CAST(category IS NULL AS BIGINT) AS mv_unknown FROM
      (SELECT e.event_id, {CATEGORY_SQL} AS category
       FROM f_m1 e LEFT JOIN f_intervals i ON e.stay_id = i.stay_id AND e.ts >= i.start_ts AND e.ts < i.end_ts)""",
)
def one_hot_missing_bucket(spark, sf):
    joined = intervals.interval_join(
        micro_events(tables.m1_events(spark, sf)), categories(spark, sf), ["stay_id"], "ts_us", "start", "end"
    )
    columns = recode.one_hot("category", recode.VENTILATION_COLUMNS, missing="mv_unknown")
    return joined.select("event_id", *[big(c).alias(n) for n, c in columns.items()])


@query(
    "bmi",
    """
    SELECT stay_id, ROUND(coalesce(weight / (height / 100.0::DOUBLE * (height / 100.0::DOUBLE)), -1), 6) AS bmi
    FROM f_demo""",
)
def bmi(spark, sf):
    value = V.body_mass_index("height", "weight")
    return tables.demographics(spark, sf).select("stay_id", r6(F.coalesce(value, F.lit(-1.0))).alias("bmi"))


@query(
    "availability_flags",
    """
    SELECT stay_id, CAST(height IS NOT NULL AS DOUBLE) AS height_avail, CAST(weight IS NOT NULL AS DOUBLE) AS weight_avail,
           CAST(height IS NOT NULL AND weight IS NOT NULL AS DOUBLE) AS bmi_avail
    FROM f_demo""",
)
def availability_flags(spark, sf):
    people = tables.demographics(spark, sf).withColumn("bmi", V.body_mass_index("height", "weight"))
    return people.select("stay_id", *[V.available(c).alias(f"{c}_avail") for c in ("height", "weight", "bmi")])


@query(
    "impute_median",
    """
    WITH b AS (SELECT stay_id, height, weight, weight / (height / 100.0::DOUBLE * (height / 100.0::DOUBLE)) AS bmi FROM f_demo),
    m AS (SELECT median(height) AS h, median(weight) AS w, median(bmi) AS b FROM b)
    SELECT stay_id, ROUND(coalesce(height, h), 6) AS height, ROUND(coalesce(weight, w), 6) AS weight,
           ROUND(coalesce(bmi, m.b), 6) AS bmi
    FROM b CROSS JOIN m""",
)
def impute_median(spark, sf):
    people = tables.demographics(spark, sf).withColumn("bmi", V.body_mass_index("height", "weight"))
    filled = profile.fill_median(people, ["height", "weight", "bmi"])
    return filled.select("stay_id", *[r6(c).alias(c) for c in ("height", "weight", "bmi")])


@query("elapsed_offset", "SELECT event_id, stay_id, off_us FROM f_off2")
def elapsed_offset(spark, sf):
    _, m2 = _offsets(spark, sf)
    return m2.select("event_id", "stay_id", "off_us")


@query(
    "horizon_labels",
    "SELECT event_id, "
    + ", ".join(
        f"CAST(coalesce(off_us + {h * HOUR_US} >= death_us, FALSE) AS BIGINT) AS death_in_{h}_hours" for h in HORIZON_HOURS
    )
    + " FROM f_off1",
)
def horizon_labels(spark, sf):
    m1, _ = _offsets(spark, sf)
    labels = clock.horizon_labels("off_us", "death_us", HORIZON_HOURS)
    return m1.select("event_id", *[big(c).alias(n) for n, c in labels.items()])


@query(
    "horizon_labels_status",
    "SELECT e.event_id, "
    + ", ".join(
        f"CAST(coalesce(s.status, '') <> 'Alive' AND epoch_us(e.ts) + {h * HOUR_US} >= epoch_us(s.t1) AS BIGINT) AS death_in_{h}_hours"
        for h in HORIZON_HOURS
    )
    + " FROM f_m1 e JOIN f_stays s USING (stay_id)",
)
def horizon_labels_status(spark, sf):
    stays = tables.stays(spark, sf).withColumn("length", clock.elapsed_us("t0", "t1"))
    events = tables.with_offset(tables.m1_events(spark, sf), stays, "length", "status")
    labels = clock.horizon_labels("off_us", "length", HORIZON_HOURS, alive=F.col("status") == "Alive")
    return events.select("event_id", *[big(c).alias(n) for n, c in labels.items()])


@query("status_from_null", "SELECT stay_id, CAST(death_ts IS NOT NULL AS BIGINT) AS death_status FROM f_stays")
def status_from_null(spark, sf):
    return tables.stays(spark, sf).select("stay_id", big(F.col("death_ts").isNotNull()).alias("death_status"))


@query(
    "interval_from_tick",
    "SELECT event_id, epoch_us(ts) AS start_us, epoch_us(ts + INTERVAL '1' HOUR) AS end_us FROM f_ticks",
)
def interval_from_tick(spark, sf):
    from staytide.operators.episodes import tick_intervals

    ticks = tables.ticks(spark, sf).withColumn("start_us", clock.micros("ts"))
    return tick_intervals(ticks, "start_us", HOUR_US, "end_us").select("event_id", "start_us", "end_us")


@query(
    "threshold_classes",
    """
    SELECT event_id, CASE WHEN typ <= 1 THEN 'oxygen_therapy' WHEN typ = 2 THEN 'unknown'
                          WHEN typ = 3 THEN 'non_invasive' WHEN typ = 4 THEN 'invasive' ELSE 'none' END AS mv
    FROM f_ticks""",
)
def threshold_classes(spark, sf):
    return tables.ticks(spark, sf).select("event_id", recode.threshold_class("typ", recode.THERAPY_CLASSES).alias("mv"))


@query(
    "ensemble_ci",
    f"""
    WITH p AS (SELECT stay_id, {', '.join(f'{risk_sql(k)} AS p{k}' for k in range(5))} FROM f_medians),
    s AS (SELECT stay_id, (p0 + p1 + p2 + p3 + p4) / 5 AS a,
                 1.959963984540054::DOUBLE * (SELECT stddev_samp(x) FROM unnest([p0, p1, p2, p3, p4]) t(x)) / sqrt(5) AS m FROM p)
    SELECT stay_id, ROUND(a, 6) AS average_pred, ROUND(a - m, 6) AS lower_bound, ROUND(a + m, 6) AS upper_bound,
           ROUND(2 * m, 6) AS ci_interval
    FROM s""",
)
def ensemble_ci(spark, sf):
    from staytide.operators.targets import with_mean_interval

    cases = case_medians(spark, sf)
    scored = with_mean_interval(tables.surface(cases), tables.PREDS)
    return scored.select(
        "stay_id", *[r6(c).alias(c) for c in ("average_pred", "lower_bound", "upper_bound", "ci_interval")]
    )


def case_medians(spark, sf):
    """One row per stay with the medians of both measures."""
    events = cohort.side_by_side(
        tables.m1_events(spark, sf).select("stay_id", "value"),
        tables.m2_events(spark, sf).select("stay_id", "value"),
        "value",
    )
    return quantiles.group_medians(events, ["stay_id"], ["m1_valuenum", "m2_valuenum"]).dropna()


def _like(column: str, rule: therapy.TextRule) -> str:
    def quoted(t: str) -> str:
        return "'" + t.replace("'", "''") + "'"

    tests = []
    if rule.exact:
        tests.append(f"{column} IN ({', '.join(quoted(t) for t in rule.exact)})")
    tests += [f"contains({column}, {quoted(t)})" for t in rule.holds]
    tests += [f"(contains({column}, {quoted(a)}) AND NOT contains({column}, {quoted(b)}))" for a, b in rule.guarded]
    return "(" + " OR ".join(tests) + ")"


def therapy_sql(column: str) -> str:
    """Array of the types of a lower-case text, in SQL."""
    cases = ", ".join(f"CASE WHEN {_like(column, r)} THEN {r.kind} END" for r in therapy.THERAPY_RULES)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query(
    "classify_text_rules",
    f"""
    WITH t AS (SELECT doc_id, {therapy_sql('lower(text)')} AS types FROM documents)
    SELECT doc_id, array_to_string(types, ',') AS types, CAST(coalesce(list_max(types), -9) AS BIGINT) AS oxygen_therapy_type,
           CAST(list_contains(types, -1) AS BIGINT) AS supp_oxygen
    FROM t""",
)
def classify_text_rules(spark, sf):
    docs = therapy.with_therapy_types(tables.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return docs.select(
        "doc_id",
        F.array_join(F.col("types").cast("array<string>"), ",").alias("types"),
        big(F.coalesce(F.array_max("types"), F.lit(-9))).alias("oxygen_therapy_type"),
        big(F.array_contains("types", -1)).alias("supp_oxygen"),
    )


@query(
    "fio2_rule",
    """
    SELECT event_id, CAST(CASE WHEN v < 0.2 THEN 0 WHEN v > 0.22 AND v <= 1 THEN -1 WHEN v > 1 AND v < 20 THEN 0
                               WHEN v > 22 THEN -1 ELSE -9 END AS BIGINT) AS oxygen_therapy_type
    FROM (SELECT event_id, value / 10 AS v FROM events)""",
)
def fio2_rule(spark, sf):
    share = F.col("value") / 10
    return tables.table(spark, sf, "events").select(
        "event_id", big(F.coalesce(therapy.oxygen_share_type(share), F.lit(-9))).alias("oxygen_therapy_type")
    )


@query(
    "outcome_strata",
    f"""
    WITH a AS (SELECT stay_id, arg_min(CAST(coalesce(off_us + {OW * HOUR_US} >= death_us, FALSE) AS BIGINT), (off_us, event_id)) AS label,
                      MAX(death_us) AS d FROM f_off1 WHERE {IN_WINDOW} GROUP BY stay_id),
    b AS (SELECT DISTINCT stay_id FROM f_off2 WHERE {IN_WINDOW})
    SELECT CASE WHEN d IS NULL THEN 'none' WHEN d < {MOP * HOUR_US} THEN 'before'
                WHEN d < {(MOP + OW) * HOUR_US} THEN 'within' ELSE 'after' END AS stratum, label, COUNT(*) AS n
    FROM a SEMI JOIN b USING (stay_id) GROUP BY ALL""",
)
def outcome_strata(spark, sf):
    from staytide.plans.jobs import strata_counts

    m1, m2 = _offsets(spark, sf)
    m1 = m1.withColumn("label", big(clock.dies_within(F.col("off_us"), F.col("death_us"), OW * HOUR_US)))
    return strata_counts(
        m1, m2, "stay_id", "off_us", "death_us", "label", MOP, PW, OW, order=["off_us", "event_id"]
    )
