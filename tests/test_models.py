"""Learners on a planted signal: loose bounds, exact where exactness is due."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staytide.operators import folds, learners, matching, metrics, resample, search, targets
from staytide.session import materialize, shared_dir

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(11)
    data = []
    for i in range(600):
        a, b, c = (rnd.gauss(0, 1) for _ in range(3))
        data.append((i, a, b, c, int(a - b + rnd.gauss(0, 0.7) > 0.8)))
    df = spark.createDataFrame(data, "id LONG, a DOUBLE, b DOUBLE, c DOUBLE, y INT")
    return materialize(folds.stratified_folds(df, "id", "y"), "planted")


@pytest.mark.parametrize(
    "learner, settings",
    [
        ("boosted", {"rounds": 10, "learning_rate": 0.3}),
        ("forest", {"trees": 20}),
        ("svc", {"maxIter": 20}),
        ("logistic", {"maxIter": 20}),
    ],
)
def test_out_of_fold_auc(planted, learner, settings):
    models = learners.train_folds(planted, FEATURES, "y", learner=learner, **settings)
    scored = learners.out_of_fold(models, planted)
    assert scored.count() == planted.count()
    table = metrics.fold_metrics(scored, ["fold"], "score", "y").collect()
    assert len(table) == 5 and all(r.auc > 0.8 for r in table)


def test_unknown_learner():
    with pytest.raises(ValueError):
        learners.build("nearest", FEATURES, "y")


def test_predictions_and_saved_models(spark, planted):
    models = learners.train_folds(planted, FEATURES, "y", k=2, learner="forest", trees=5)
    table = learners.prediction_table(models, planted, "id", "y")
    assert table.count() == 2 * planted.count()
    tests = table.filter("subset = 'test'").groupBy("model_fold").count().collect()
    want = {r.fold: r["count"] for r in planted.filter("fold < 2").groupBy("fold").count().collect()}
    assert {r.model_fold: r["count"] for r in tests} == want
    root = shared_dir(spark, "models")
    learners.save_models(models, root, "forest", 12, 18, 24)
    loaded = learners.load_models(spark, root, "forest", 12, 18, 24, k=2)
    both = learners.scorer(loaded, "l")(learners.scorer(models, "m")(planted))
    assert both.filter("l0 <> m0 OR l1 <> m1").count() == 0


def test_stages_equal_separate_fits(spark, planted):
    """A run read off after 2 and 5 of its 5 rounds scores as models of 2 and 5 rounds do, gaps included."""
    rows = planted.withColumns({"_weight": F.lit(1.0), "a": F.when(F.col("id") % 7 != 3, F.col("a"))}).filter("fold < 3")
    raw = rows.select(*FEATURES, F.col("fold").cast("int"), F.col("y").alias("label"))
    settings = {"learning_rate": 0.3, "min_child": 3}
    longest = search.staged(learners.fit("boosted", rows, FEATURES, "y", rounds=5, **settings), FEATURES, [2, 5], spark)
    got = longest.probabilities(np.array([[np.nan if x is None else x for x in r[: len(FEATURES)]] for r in raw.collect()], float))
    for i, n in enumerate((2, 5)):
        model = learners.fit("boosted", rows, FEATURES, "y", rounds=n, **settings)
        want = [r.score for r in learners.predict(model, rows).select("score").collect()]
        assert np.allclose(got[:, i], want, atol=1e-12)


def test_search_within_each_outer_fold(planted):
    table = search.nested_search(planted, FEATURES, "y", learning_rates=(0.001, 0.5), rounds=(10, 1), k=3)
    got = table.collect()
    assert sorted((r.outer, r.learning_rate, r.rounds) for r in got) == [(o, r, n) for o in range(3) for r in (0.001, 0.5) for n in (1, 10)]
    for outer in range(3):
        own = [r for r in got if r.outer == outer]
        best = [r for r in own if r.best]
        assert len(best) == 1 and best[0].auc == max(r.auc for r in own) and best[0].rounds == 10
    # by hand: outer fold 0 at rate 0.5 with 10 rounds
    aucs = []
    for inner in (1, 2):
        train = planted.filter(~F.col("fold").isin(0, inner)).withColumn("_weight", F.lit(1.0))
        model = learners.fit("boosted", train, FEATURES, "y", learning_rate=0.5, rounds=10)
        aucs.append(metrics.roc_auc(learners.predict(model, planted.filter(F.col("fold") == inner)), [], "score", "y").first().auc)
    mine = next(r.auc for r in got if (r.outer, r.learning_rate, r.rounds) == (0, 0.5, 10))
    assert abs(mine - sum(aucs) / 2) < 1e-9


def test_rows_without_a_score(spark):
    """They are left out of both rates, by the curve and by the balanced accuracy."""
    rows = [(0.2, 1), (0.9, 1), (None, 1), (float("nan"), 1), (0.1, 0), (0.95, 0), (float("nan"), 0)]
    df = spark.createDataFrame(rows, "score double, y int")
    assert {r.threshold: (r.fpr, r.tpr) for r in metrics.roc_curve(df, [], "score", "y").collect()}[0.9] == (0.5, 0.5)
    assert metrics.balanced_accuracy(df, [], "score", "y").first()[0] == 0.5


def test_resampling_inside_the_training_fold(spark, planted):
    rows = planted.select("id", F.array(*FEATURES).alias("vec"), "y", "fold")

    def balance(train):
        made = resample.oversample(train, "id", "vec", "y")
        return made.select(*[F.col("vec")[i].alias(c) for i, c in enumerate(FEATURES)], "y")

    models = learners.train_folds(rows, FEATURES, "y", k=1, learner="logistic", resample=balance, maxIter=20)
    test = rows.filter("fold = 0").select("id", *[F.col("vec")[i].alias(c) for i, c in enumerate(FEATURES)], "y")
    assert metrics.roc_auc(learners.predict(models[0], test), [], "score", "y").first().auc > 0.8


def test_targets_lower_the_risk(spark, planted):
    cases = planted.filter("id < 20").select(
        "id", (95 + 10 * F.col("a")).alias("m1_valuenum"), (130 + 10 * F.col("b")).alias("m2_valuenum"), "y"
    )
    train = planted.select(
        (95 + 10 * F.col("a")).alias("m1_valuenum"), (130 + 10 * F.col("b")).alias("m2_valuenum"), "y", "fold"
    )
    models = learners.train_folds(train, ["m1_valuenum", "m2_valuenum"], "y", learner="logistic", maxIter=20)
    preds = [f"pred_{i}" for i in range(5)]
    report = targets.target_report(cases, "id", "y", learners.scorer(models), preds).collect()
    assert len(report) == 20
    assert all(r.optimal_risk <= r.actual_risk for r in report)
    assert all(40 <= r.optimal_hr <= 150 and 60 <= r.optimal_bp <= 200 for r in report)
    mean = targets.target_report(cases, "id", "y", learners.scorer(models), preds, risk_model="mean")
    assert mean.count() == 20
    with pytest.raises(ValueError):
        targets.counterfactual_risk(cases, learners.scorer(models), preds, risk_model="first")


def test_matching_balances_the_covariate(planted):
    df = planted.withColumn("treated", (F.col("a") + 0.3 * F.col("c") > 0.5).cast("int"))
    scored = materialize(matching.propensity(df, ["b", "c"], "treated"), "scored")
    pairs = matching.match_nearest(scored, "id", "treated")
    assert pairs.count() == scored.filter("treated = 1").count()
    out = matching.matched_outcomes(scored, pairs, "id", "y").first()
    assert out.treated_rate > out.control_rate
