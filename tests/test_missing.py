"""Missing features, scores and predictions; CSV by name; streams that go on; chunks of close keys."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from staytide.operators import folds, learners, matching, metrics, search, targets
from staytide.sources import csvio
from staytide.streaming import alerts

SETTINGS = {"boosted": {"rounds": 3, "learning_rate": 0.3}, "forest": {"trees": 5}, "svc": {"maxIter": 5}, "logistic": {"maxIter": 10}}


@pytest.fixture(scope="module")
def gappy(spark):
    """A label that follows a, with NULLs and NaNs in every feature and one feature never known."""
    rows = []
    for i in range(300):
        a = float(i % 60)
        rows.append(
            (
                i,
                i % 5,
                None if i % 7 == 0 else a,
                float("nan") if i % 11 == 0 else (i * 37 % 50) / 10,
                None if i % 2 else i,
                None,
                int(a > 30),
            )
        )
    schema = "id long, fold int, a double, b double, c long, d double, label int"
    return spark.createDataFrame(rows, schema).cache()


@pytest.mark.parametrize("learner", sorted(SETTINGS))
def test_learners_take_gaps(gappy, learner, tmp_path):
    features = ["a", "b", "c", "d"]
    models = learners.train_folds(gappy, features, "label", k=2, learner=learner, **SETTINGS[learner])
    scored = learners.predict(models[0], gappy)
    assert scored.filter(F.col("score").isNull() | F.isnan("score")).count() == 0
    assert metrics.roc_auc(scored.filter("a IS NOT NULL"), [], "score", "label").first()["auc"] > 0.85
    learners.save_models(models[:1], str(tmp_path), learner, 1, 2, 3)
    loaded = learners.load_models(gappy.sparkSession, str(tmp_path), learner, 1, 2, 3, k=1)
    again = {r.id: r.score for r in learners.predict(loaded[0], gappy).collect()}
    assert all(r.score == again[r.id] for r in scored.collect())


def test_fills_come_from_the_training_rows(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0), (None, 1), (float("nan"), 0)], "x double, label int")
    assert learners.missing_fills(df, ["x"]) == {"x": 2.0}
    assert learners.missing_fills(df, ["x"], constant=-1) == {"x": -1.0}
    assert learners.missing_fills(df.filter("isnan(x) OR x IS NULL"), ["x"]) == {"x": 0.0}
    out = learners.filled({"x": 2.5}).transform(df).orderBy("_gap_x", "_fill_x").collect()
    assert [(r["_fill_x"], r["_gap_x"]) for r in out] == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (2.5, 1.0), (2.5, 1.0)]


def test_grid_search_with_gaps(gappy):
    rows = search.nested_search(gappy, ["a", "b", "c"], "label", learning_rates=(0.1, 0.3), rounds=(1, 2), k=2).collect()
    assert len(rows) == 8 and sum(r.best for r in rows) == 2 and all(0.5 < r.auc <= 1 for r in rows)


def test_missing_scores_are_left_out(spark):
    rows = [(0.9, 1), (0.1, 0), (None, 1), (float("nan"), 0), (0.5, 1), (0.5, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    r = metrics.fold_metrics(df, [], "s", "y").first()
    assert (r.n_pos, r.n_neg, r.auc, r.balanced_accuracy) == (2, 2, 3.5 / 4, 0.75)
    assert metrics.fold_metrics(df, [], "s", "y", cut=0.4).first().balanced_accuracy == 0.75
    assert metrics.missing_scores(df, [], "s").first().n_missing == 2


def test_fold_metrics_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 0.9, 1), (None, 0.1, 0), (1, 0.2, 1)], "g int, s double, y int")
    got = {r.g: (r.auc, r.balanced_accuracy) for r in metrics.fold_metrics(df, ["g"], "s", "y").collect()}
    assert got == {None: (1.0, 1.0), 1: (None, None)}


def test_predictions_that_are_missing(spark):
    cases = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "case int, kind int")

    def score(df):
        risk = F.abs(F.col("m1_valuenum") - 70) / 1000.0 + F.abs(F.col("m2_valuenum") - 100) / 1000.0
        return df.withColumn("p", F.when(F.col("kind") == 0, risk).when(F.col("kind") == 1, F.lit(float("nan"))))

    got = {r.case: (r.optimal_m1, r.optimal_m2) for r in targets.optimal_targets(cases, "case", score, ["p"]).collect()}
    assert got[2] == got[3] == (None, None)
    assert math.isclose(got[1][0], 70, abs_tol=0.5) and math.isclose(got[1][1], 100, abs_tol=0.5)


def test_matching_without_scores(spark):
    rows = [(1, 1, 0.5), (2, 1, None), (3, 0, 0.4), (4, 0, None), (5, 1, float("nan"))]
    df = spark.createDataFrame(rows, "k int, t int, propensity double")
    got = {r.k: r.control for r in matching.match_nearest(df, "k", "t").collect()}
    assert got == {1: 3, 2: None, 5: None}


def test_csv_by_name(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.createDataFrame([("x", 1.5, 7, "z")], "extra string, valuenum double, stay_id long, other string").write.option("header", True).csv(path)
    schema = StructType([StructField("stay_id", LongType()), StructField("valuenum", DoubleType())])
    assert csvio.read_csv(spark, path, schema).collect() == [(7, 1.5)]
    with pytest.raises(ValueError, match="itemid"):
        csvio.read_csv(spark, path, StructType([*schema.fields, StructField("itemid", StringType())]))


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    spark.range(3).write.parquet(source)
    stream = lambda: alerts.event_stream(spark, source, spark.range(0).schema)
    assert alerts.drain(stream(), "s", folder).count() == 3
    spark.range(3, 5).write.mode("append").parquet(source)
    assert sorted(r.id for r in alerts.drain(stream(), "s", folder).collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("start, step", [(10**12, 1), (1_700_000_000_000_000, 1_296_000)])
def test_close_keys_spread(spark, start, step):
    df = spark.range(200_000).select((F.col("id") * step + start).alias("k"))
    chunks = df.select(folds._spread(df, "k").alias("c")).groupBy("c").count()
    n, most = chunks.agg(F.count("c"), F.max("count")).first()
    assert n > 500 and most <= 2000
    assert [r.k for r in folds.row_range(df, "k", 5, 8).orderBy("k").collect()] == [start + i * step for i in (5, 6, 7)]
