"""Grouped logistic models against one fit per group."""

import numpy as np
from pyspark.sql import functions as F

from staytide.operators import grouped, metrics
from staytide.plans import modelling


def test_same_as_one_by_one(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(3):
        for i in range(200):
            a, b = rng.normal(size=2)
            p = 1 / (1 + np.exp(-(g - 1 + (g + 1) * a - b)))
            rows.append((g, i % 5, float(a) if i % 13 else None, float(b), int(rng.random() < p)))
    df = spark.createDataFrame(rows, "g int, fold int, a double, b double, y int").cache()
    models, scale = grouped.fit_logistic(df, ["g"], ["a", "b"], "y", steps=12)
    got = {(r.g, r.model_fold): r["_w"] for r in models.collect()}
    assert len(got) == 15
    for (g, f), w in got.items():
        own = [r for r in rows if r[0] == g and r[1] != f]
        x = np.array([[1.0, *[((v - scale[c][0]) / scale[c][1] if v is not None else 0.0) for c, v in (("a", r[2]), ("b", r[3]))]] for r in own])
        p = 1 / (1 + np.exp(-x @ np.array(w)))
        gradient = x.T @ (np.array([r[4] for r in own]) - p) - np.array([0, 1, 1]) * np.array(w)
        assert np.abs(gradient).max() < 1e-2
    scored = grouped.predict_logistic(df, models, scale, ["g"], ["a", "b"]).filter("fold = model_fold")
    aucs = [r.auc for r in metrics.roc_auc(scored, ["g"], "pred_prob", "y").collect()]
    assert len(aucs) == 3 and min(aucs) > 0.7


def test_sweep_is_whole(spark, sf):
    found = modelling._sweep_scores(spark, sf).collect()
    assert len({(r.pw, r.mop, r.ow) for r in found}) == len(found)
    assert all((r.auc is None) == (not r.n_pos or not r.n_neg) for r in found)


def test_groups_without_rows(spark):
    df = spark.createDataFrame([], "g int, fold int, a double, y int")
    models, _ = grouped.fit_logistic(df, ["g"], ["a"], "y", steps=2)
    assert models.count() == 0
