"""Matching without replacement against the greedy rule taken literally."""

import random

import pytest
from pyspark.sql import functions as F

from staytide.operators import matching


def greedy(rows, order, caliper):
    """rows: (key, treated, score); the smallest free pair first."""
    t = [(k, s) for k, x, s in rows if x == 1 and s is not None and s == s]
    c = [(k, s) for k, x, s in rows if x == 0 and s is not None and s == s]
    pairs = sorted((abs(a - b), a, b, order[i], order[j], i, j) for i, a in t for j, b in c if abs(a - b) <= caliper)
    used, out = set(), []
    for gap, _, _, _, _, i, j in pairs:
        if i not in used and j not in used:
            used |= {i, j}
            out.append((i, j, gap))
    return sorted(out)


@pytest.mark.parametrize("seed, spread, caliper", [(1, 400, 3.0), (2, 40, 0.0), (3, 60, 1.0), (4, 10_000, 1e9), (5, 300, 5.0)])
def test_equal_to_greed(spark, seed, spread, caliper):
    rnd = random.Random(seed)
    score = lambda: rnd.choice([float(rnd.randrange(spread)), rnd.random() * spread, 7.0])
    rows = [(i, int(rnd.random() < 0.4), score()) for i in range(260)] + [(900, 1, None), (901, 0, float("nan")), (902, None, 3.0)]
    df = spark.createDataFrame(rows, "id long, t int, s double").repartition(3)
    order = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    got = sorted((r.id, r.control, r.gap) for r in matching.match_without_replacement(df, "id", "t", caliper, "s").collect())
    assert got == greedy(rows, order, caliper) and got
    assert len({r[1] for r in got}) == len(got)
    assert matching.match_without_replacement(df.filter("t = 1"), "id", "t", caliper, "s").collect() == []
