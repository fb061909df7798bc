"""As-of joins against a plain search, with a key that holds most rows, and the temporal ensemble."""

import math
import random


from staytide.operators import grouped
from staytide.operators.asof import asof_join
from staytide.session import materialize
from staytide.streaming.ensemble import ensemble_scores, logistic_weights


def test_asof_join(spark):
    rnd = random.Random(6)
    key = lambda: rnd.choice(["hot"] * 7 + ["a", "b", None])
    left = [(i, key(), rnd.choice([rnd.randrange(-50, 1000)] * 9 + [None])) for i in range(2000)]
    right = [(key(), rnd.choice([rnd.randrange(0, 900, 30)] * 9 + [None]), rnd.randrange(5)) for _ in range(60)] + [("c", 5, 1)]
    a = spark.createDataFrame([(*r, "x") for r in left], "id long, k string, t long, _row string").drop("_row").repartition(4)
    b = spark.createDataFrame(right, "k string, at long, m int")
    want = {}
    for i, k, t in left:
        met = [(at, m) for kk, at, m in right if None not in (k, t, at) and kk == k and at <= t]
        want[i] = max(met)[1] if met else None
    for width in (1, 7, 100, 10_000):
        got = asof_join(a, b, ["k"], "t", "at", ["m"], width)
        assert {r.id: r.m for r in got.collect()} == want and got.count() == len(left)


def test_each_case_by_the_model_of_its_moment(spark):
    """Models fitted per moment; each case's score is that of its moment's weights."""
    rnd = random.Random(2)
    rows = [(i, i % 2, rnd.choice([6, 12, 24]), rnd.gauss(0, 1), i % 5) for i in range(1500)]
    rows = [(*r[:4], int(r[3] * (1 if r[2] < 20 else -1) + rnd.gauss(0, 0.5) > 0), r[4]) for r in rows]
    df = materialize(spark.createDataFrame(rows, "id long, site int, mop int, x double, y int, fold int"), "moments")
    fitted, scale = grouped.fit_logistic(df, ["site", "mop"], ["x"], "y")
    models = fitted.filter("model_fold = 0").select("site", "mop", logistic_weights(fitted, scale, ["x"]).alias("weights"))
    weights = {(r.site, r.mop): r.weights for r in models.collect()}
    assert weights[0, 6][1] > 1 and weights[0, 24][1] < -1
    cases = spark.createDataFrame([(i, i % 2, rnd.randrange(0, 40 * 60), rnd.gauss(0, 1)) for i in range(500)] + [(900, 0, 700, None)], "id long, site int, t long, x double")
    got = {r.id: r for r in ensemble_scores(cases, models, ["site"], "t", "mop", ["x"], 60).collect()}
    for r in cases.collect():
        reached = [m for m in (6, 12, 24) if m * 60 <= r.t]
        assert got[r.id].mop == (max(reached) if reached else None)
        if not reached or r.x is None:
            assert got[r.id].pred_prob is None
        else:
            w = weights[r.site, max(reached)]
            assert math.isclose(got[r.id].pred_prob, 1 / (1 + math.exp(-(w[0] + w[1] * r.x))), rel_tol=1e-9)
