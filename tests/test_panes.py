"""Medians and maxima of overlapping windows against lists, with a key that holds most rows."""

import random
import statistics

from staytide.operators import panes

WINDOWS = [(0, 10), (5, 10), (0, 3), (7, 30), (10, 11), (2, 29), (40, 50), (5, 10)]


def data():
    rnd = random.Random(4)
    rows = []
    for _ in range(3000):
        k = rnd.choice(["hot"] * 9 + ["a", "b", None])
        v = rnd.choice([rnd.gauss(100, 30), float(rnd.randrange(5)), 0.0, -0.0, -2.5, None, float("nan"), 1e12 + rnd.random()])
        rows.append((k, rnd.choice([rnd.randrange(-3, 32), None]), v, rnd.choice([None, 1.0, 2.0, rnd.random()]), rnd.choice([0, 1, None])))
    return [*rows, ("lone", 45, 3.0, None, None), ("empty", 45, None, None, 1)]


def known(rows, k, i, lo, hi):
    return [r[i] for r in rows if r[0] == k and r[1] is not None and lo <= r[1] < hi and r[i] is not None and r[i] == r[i]]


def test_medians_of_all_windows(spark):
    rows = data()
    df = spark.createDataFrame(rows, "k string, t long, a double, b double, y int").repartition(5)
    got = {(r.k, r.window): (r.a, r.b) for r in panes.window_medians(df, ["k"], ["a", "b"], "t", WINDOWS).collect()}
    want = {}
    for k in ("hot", "a", "b", "lone", "empty"):
        for w, (lo, hi) in enumerate(WINDOWS):
            pair = [known(rows, k, i, lo, hi) for i in (2, 3)]
            if any(pair):
                want[k, w] = tuple(statistics.median(x) if x else None for x in pair)
    assert got.keys() == want.keys()
    for key, pair in want.items():
        for x, y in zip(got[key], pair):
            assert x == y or abs(x - y) <= 1e-12 * abs(y), key
    assert panes.window_medians(df.limit(0), ["k"], ["a"], "t", WINDOWS).count() == 0


def test_maxima_of_all_windows(spark):
    rows = data()
    df = spark.createDataFrame(rows, "k string, t long, a double, b double, y int")
    got = {(r.k, r.window): r.y for r in panes.window_maxima(df, ["k"], ["y"], "t", WINDOWS).collect()}
    want = {}
    for k in ("hot", "a", "b", "lone", "empty"):
        for w, (lo, hi) in enumerate(WINDOWS):
            if any(r[0] == k and r[1] is not None and lo <= r[1] < hi for r in rows):
                want[k, w] = max(known(rows, k, 4, lo, hi), default=None)
    assert got == want


def test_rows_of_the_shuffle_do_not_follow_the_windows(spark):
    """Twenty windows over the same panes: as many counted rows as events at most, and the same number of shuffles."""
    df = spark.range(5000).selectExpr("id % 7 AS k", "id % 24 AS t", "cast(id % 50 AS double) AS v")
    few, many = [(0, 24)] + [(i, i + 1) for i in range(24)], [(i, j) for i in range(24) for j in range(i + 1, 25)][:120]
    plans = []
    for windows in (few, many):
        edges = panes.edges_of(windows)
        assert panes.pane_counts(df, ["k"], ["v"], "t", edges).count() <= 5000
        plans.append(panes.window_medians(df, ["k"], ["v"], "t", windows)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
    assert plans[0] == plans[1]
