"""Files in and out, pooled sources, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from staytide.schemas import FEATURES, INPUT_SCHEMAS, SOURCES
from staytide.session import materialize, shared_dir
from staytide.operators import select
from staytide.sources import csvio, pooled, tables
from staytide.streaming import alerts
from tests.conftest import rows


def test_schemas():
    assert len(FEATURES) == len(set(FEATURES)) == 44
    assert INPUT_SCHEMAS["chartevents"].names[-1] == "valuenum"
    assert len(INPUT_SCHEMAS["unit_comorbidity"]) == 19


def test_event_loader(spark, tmp_path):
    text = (
        "stay_id,charttime,time_diff,valuenum\n"
        "1,2024-01-02 03:04:05,0 days 01:00:00,80.5\n"
        "1,never,soon,NaN\n"
        "2,,,\n"
    )
    (tmp_path / "events.csv").write_text(text)
    schema = INPUT_SCHEMAS["chartevents"]
    schema = type(schema)([f for f in schema if f.name in ("stay_id", "charttime", "valuenum")])
    schema = type(schema)([schema["stay_id"], schema["charttime"], tables_field("time_diff"), schema["valuenum"]])
    df = csvio.read_events(
        spark, str(tmp_path / "events.csv"), schema, timestamps=["charttime"], durations=["time_diff"], numbers=["valuenum"]
    )
    assert dict(df.dtypes)["charttime"] == "timestamp_ntz"
    assert rows(df) == [
        (1, None, None, None),
        (1, dt.datetime(2024, 1, 2, 3, 4, 5), 3_600_000_000, 80.5),
        (2, None, None, None),
    ]


def tables_field(name):
    from pyspark.sql.types import LongType, StructField

    return StructField(name, LongType())


def test_stay_loader(spark, tmp_path):
    (tmp_path / "stays.csv").write_text(
        "subject_id,hadm_id,stay_id,intime,outtime,los\n1,2,3,2024-01-01 00:00:00,2024-01-01 12:00:00,0.5\n"
    )
    df = csvio.read_stays(spark, str(tmp_path / "stays.csv"), INPUT_SCHEMAS["icustays"], "intime", "outtime")
    assert df.first().length_us == 12 * 3_600_000_000


def test_partitioned_sink(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("fold"), F.lit(18).alias("mop"))
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        csvio.write_partitioned(df, path, ["mop", "fold"], fmt)
        reader = spark.read.schema(df.schema).option("header", True)
        back = reader.format(fmt).load(path)
        assert rows(back.filter("fold = 1").select("id")) == [(i,) for i in range(1, 100, 3)]
        assert back.count() == 100


def test_batches_keep_their_number(spark, tmp_path):
    for i in (2, 10):
        spark.createDataFrame([(i, float(i))], "case_id LONG, x DOUBLE").write.option("header", True).csv(
            str(tmp_path / f"batch_{i}")
        )
    schema = spark.createDataFrame([], "case_id LONG, x DOUBLE").schema
    assert rows(csvio.read_batches(spark, str(tmp_path), schema)) == [(2, 2.0, 2), (10, 10.0, 10)]


def test_source_descriptions(spark):
    data = [("Heart Rate", 80.0), ("Heart Rate", 301.0), ("Invasive BP Systolic", 20.0), ("Invasive BP Systolic", 120.0)]
    df = spark.createDataFrame(data, "nursingchartcelltypevalname STRING, nursingchartvalue DOUBLE")
    s = SOURCES["minutes"]
    assert rows(select.measurement(df, s.code, s.value, s.m1)) == [("Heart Rate", 80.0)]
    assert rows(select.measurement(df, s.code, s.value, s.m2)) == [("Invasive BP Systolic", 120.0)]
    named = spark.createDataFrame([("Apical HEART Rate", 1.0), ("SpO2", 2.0)], "Event STRING, Result DOUBLE")
    s = SOURCES["named"]
    assert rows(select.measurement(named, s.code, s.value, s.m1)) == [("Apical HEART Rate", 1.0)]


def test_pooled_cohort(spark):
    a = spark.createDataFrame([(1, None, 170.0, 1), (2, 30.0, 50.0, 0)], "stay_id INT, age DOUBLE, height DOUBLE, d INT")
    b = spark.createDataFrame([(3, 40.0, None, 0), (4, 41.0, 51.0, 1)], "stay_id INT, age DOUBLE, height DOUBLE, d INT")
    out = pooled.pooled_cohort({"A": a, "B": b}, "d").select("stay_id", "age", "height", "death", "data_source")
    assert rows(out) == [(1, 64.0, 170.0, 1, "A"), (4, 41.0, 51.0, 1, "B")]


def test_pooled_moments(spark):
    a = spark.createDataFrame([(1, None, 170.0, 1)], "stay_id INT, age DOUBLE, height DOUBLE, d INT")
    out = pooled.pooled_by_moment({12: {"A": a, "B": a}, 18: {"A": a}}, "d").select("mop", "data_source", "death")
    assert rows(out) == [(12, "A", 1), (12, "B", 1), (18, "A", 1)]


def test_shared_folder(spark):
    one, two = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert one != two
    df = spark.range(5).withColumn("part", F.col("id") % 2)
    assert rows(materialize(df, "m", "part").select("id", "part")) == rows(df)


def test_stream_of_late_and_early_events(spark, tmp_path):
    schema = "stay_id LONG, ts TIMESTAMP, value DOUBLE"
    path = str(tmp_path / "in")

    def add(*data):
        at = [(k, dt.datetime(2024, 1, 1, h, m), v) for k, h, m, v in data]
        spark.createDataFrame(at, schema).coalesce(1).write.mode("append").parquet(path)

    goals = spark.createDataFrame([(1, 80.0), (2, 80.0)], "stay_id LONG, target DOUBLE")

    def run():
        stream = alerts.event_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)
        out = alerts.alerts(stream, goals, "stay_id", "ts", "value", "target", "1 hour", 20, delay="30 minutes")
        return alerts.drain(out, "late")

    add((1, 0, 10, 120.0), (1, 0, 50, 100.0), (2, 0, 20, 85.0), (1, 1, 10, 81.0))
    add((1, 3, 0, 10.0))
    got = [(r.stay_id, r.window_start.hour, r.mean_value, r.deviation) for r in run().collect()]
    # the window from 3 on is still open, the one from 1 on is near enough to the target
    assert got == [(1, 0, 110.0, 30.0)]
    batch = alerts.alerts(spark.read.parquet(path), goals, "stay_id", "ts", "value", "target", "1 hour", 20)
    assert sorted((r.stay_id, r.window_start.hour) for r in batch.collect()) == [(1, 0), (1, 3)]


class FakeSession:
    """A cluster session with or without the setting."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    def __init__(self, **settings):
        self.conf = settings


def test_shared_folder_comes_from_the_session():
    path = shared_dir(FakeSession(**{"spark.checkpoint.dir": "hdfs://store/shared/"}), "cohort")
    assert path.startswith("hdfs://store/shared/cohort-")
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession(), "cohort")


def test_tables_view_counts(spark, sf):
    assert tables.stays(spark, sf).count() == 15
    assert tables.order_features(spark, sf).count() > 1000
