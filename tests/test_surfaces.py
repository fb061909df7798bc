"""Targets from the surfaces of models equal those of the unfolded, scored grid."""

import math

import pytest
from pyspark.sql import functions as F

from staytide.operators import learners, surfaces, targets
from staytide.session import materialize

M1, M2, K = (40, 75), (60, 101), 30


@pytest.fixture(scope="module")
def cases(spark):
    x = F.col("id")
    rows = spark.range(400).select(
        x.alias("case"),
        (40 + (x * 37) % 60).cast("double").alias("m1_valuenum"),
        (60 + (x * 53) % 70).cast("double").alias("m2_valuenum"),
        F.when(x % 7 != 3, (x % 11).cast("double")).alias("age"),
        F.when(x % 5 == 1, float("nan")).otherwise((x * x % 13).cast("double")).alias("score"),
        (x % 3).cast("int").alias("fold"),
    )
    far = F.abs(F.col("m1_valuenum") - 55 - F.coalesce("age", F.lit(0))) + F.abs(F.col("m2_valuenum") - 85)
    return materialize(rows.withColumn("died", (F.pmod(F.hash("case"), F.lit(60)) < far).cast("int")), "surface-cases")


FEATURES = ["m1_valuenum", "age", "m2_valuenum", "score"]


def unfolded(cases, models):
    preds = [f"pred_{i}" for i in range(len(models))]
    grid = targets.with_grid(cases, "case", M1, M2)
    scored = targets.with_average(learners.scorer(models)(grid), preds)
    return targets.grid_target_points(scored, "case", K, M1, M2)


def same(a, b):
    left, right = ({r[0]: r for r in df.collect()} for df in (a, b))
    assert left.keys() == right.keys()
    for key, r in left.items():
        assert (r[1] is None) == (right[key][1] is None), key
        if r[1] is not None:
            assert math.isclose(r[1], right[key][1], abs_tol=1e-9) and math.isclose(r[2], right[key][2], abs_tol=1e-9), (r, right[key])


@pytest.mark.parametrize(
    "learner, settings",
    [("forest", {"trees": 7}), ("boosted", {"rounds": 6, "learning_rate": 0.2}), ("logistic", {"maxIter": 5}), ("svc", {"maxIter": 5})],
)
def test_equal_to_the_unfolded_grid(cases, learner, settings):
    models = learners.train_folds(cases, FEATURES, "died", k=3, learner=learner, **settings)
    some = cases.filter("case < 60")
    found = surfaces.search(some, "case", models, M1, M2, K, targets.TIE_DIGITS)
    same(found, unfolded(some, models))
    assert found.count() == 60


def test_models_of_both_kinds_unfold(cases):
    two = [learners.fit(n, cases, FEATURES, "died", **s) for n, s in (("forest", {"trees": 2}), ("logistic", {"maxIter": 2}))]
    some = cases.filter("case < 5")
    assert surfaces.search(some, "case", two, M1, M2, K, 9) is None
    same(targets.model_targets(some, "case", two, K, M1, M2), unfolded(some, two))


def test_ties_and_flat_surfaces(cases):
    """A constant surface: the first points by m1 and m2; and more points wanted than the grid has."""
    flat = cases.withColumn("died", (F.col("case") % 2).cast("int")).withColumns({f: F.lit(1.0) for f in FEATURES})
    for learner, settings in (("forest", {"trees": 2}), ("logistic", {"maxIter": 2})):
        models = [learners.fit(learner, flat, FEATURES, "died", **settings)]
        some = cases.filter("case < 3")
        same(targets.model_targets(some, "case", models, K, M1, M2), unfolded(some, models))
        points = 36 * 42
        rows = surfaces.search(some, "case", models, M1, M2, points + 5, 9).collect()
        assert [(r[1], r[2]) for r in rows] == [(57.5, 80.5)] * 3
