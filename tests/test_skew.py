"""One key holds most rows: results stay whole, and chunks spread it."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from staytide.functions.radix import number_chunk, text_chunk, time_chunk
from staytide.operators import folds, intervals, matching, metrics, prefix, quantiles, resample
from tests.conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(7)
    data = [(1, i, rnd.gauss(100, 40)) for i in range(4000)] + [
        (k, i, float(rnd.randrange(5))) for k in range(2, 30) for i in range(rnd.randrange(1, 40))
    ]
    return data, spark.createDataFrame(data, "k INT, t LONG, v DOUBLE")


def test_chunks_keep_the_order(spark):
    rnd = random.Random(1)
    values = sorted(
        [rnd.uniform(-1, 1) * 10 ** rnd.randrange(-12, 12) for _ in range(3000)]
        + [2.0**e for e in range(-60, 60)]
        + [float(np.nextafter(2.0**e, 0)) for e in range(-60, 60)]
        + [0.0, -0.0, float("inf"), float("-inf"), 5e-324, 1.7e308]
    )
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE")
    chunks = [r[1] for r in sorted((r.i, r.c) for r in df.select("i", number_chunk("v").alias("c")).collect())]
    assert chunks == sorted(chunks)
    times = spark.createDataFrame([(t,) for t in range(-200, 200)], "t LONG").select(time_chunk("t", 60)).collect()
    assert [r[0] for r in times] == [t // 60 for t in range(-200, 200)]


def test_hot_group_is_spread(hot):
    _, df = hot
    sizes = df.filter("k = 1").groupBy(number_chunk("v")).count().agg(F.max("count")).first()[0]
    assert sizes < 4000 / 50


def test_exact_quantiles(hot):
    data, df = hot
    groups = {}
    for k, _, v in data:
        groups.setdefault(k, []).append(v)
    got = {r.k: (r.n, r.q0, r.q1) for r in quantiles.group_quantiles(df, ["k"], ["v"], [0.5, 0.9]).collect()}
    for k, vs in groups.items():
        assert got[k][0] == len(vs)
        assert got[k][1] == pytest.approx(statistics.median(vs), abs=1e-12)
        assert got[k][2] == pytest.approx(float(np.quantile(vs, 0.9)), abs=1e-9)
    assert got.keys() == groups.keys()
    medians = {r.k: r.v for r in quantiles.group_medians(df, ["k"], ["v"]).collect()}
    assert all(medians[k] == pytest.approx(statistics.median(vs), abs=1e-12) for k, vs in groups.items())


def test_running_sum_and_lag(hot):
    _, df = hot
    placed = df.withColumn("c", time_chunk("t", 100))
    w = Window.partitionBy("k").orderBy("t")
    plain = df.select(
        "k", "t", F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lag("t").over(w)
    )
    sums = prefix.sums_before(placed, ["k"], "c", ["t"], {"s": "t"}).select("k", "t", "s")
    lags = prefix.lag_in_group(placed, ["k"], "c", ["t"], "t", "b").select("k", "t", "b")
    assert rows(sums.join(lags, ["k", "t"])) == rows(plain)


def test_ranks_over_all_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 100003).alias("key"))
    placed = df.withColumn("c", number_chunk("key"))
    ranked = prefix.row_ranks(placed, [], "c", ["key"], "r").select("key", "r").collect()
    order = {k: i for i, k in enumerate(sorted(r.key for r in ranked))}
    assert all(order[r.key] == r.r for r in ranked)
    sliced = [r.key for r in folds.row_range(df, "key", 100, 110).collect()]
    assert sorted(sliced) == sorted(order)[100:110]


def test_interval_join_of_a_hot_key(spark):
    rnd = random.Random(3)
    events = spark.createDataFrame([(1 if i % 3 else 2, rnd.randrange(10**6)) for i in range(3000)], "k INT, t LONG")
    spans = [(1, s := rnd.randrange(10**6), s + rnd.randrange(1, 5000), i) for i in range(400)]
    spans = spark.createDataFrame(spans, "k INT, s LONG, e LONG, x INT")
    out = intervals.interval_join(events, spans, ["k"], "t", "s", "e").select("k", "t", "x")
    other = spans.withColumnRenamed("k", "k2")
    plain = events.join(
        other, (F.col("k") == F.col("k2")) & (F.col("t") >= F.col("s")) & (F.col("t") < F.col("e")), "left"
    ).select("k", "t", "x")
    assert rows(out) == rows(plain)


def _auc(pairs):
    pos, neg = ([s for s, y in pairs if y == v] for v in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_many_ties(spark):
    rnd = random.Random(5)
    pairs = [(0.5 if i % 3 == 0 else round(rnd.random(), 2), rnd.randrange(2)) for i in range(1500)]
    df = spark.createDataFrame(pairs, "s DOUBLE, y INT")
    got = metrics.roc_auc(df, [], "s", "y").first().auc
    assert got == pytest.approx(_auc(pairs), abs=1e-12)
    mirrored = metrics.roc_auc(df.withColumn("s", -F.col("s")), [], "s", "y").first().auc
    assert mirrored == pytest.approx(1 - got, abs=1e-12)
    curve = metrics.roc_curve(df, [], "s", "y").orderBy("threshold").collect()
    assert (curve[0].fpr, curve[0].tpr) == (1.0, 1.0)
    assert all(a.fpr >= b.fpr and a.tpr >= b.tpr for a, b in zip(curve, curve[1:]))


def test_folds_partition_the_rows(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 < 3).cast("int").alias("y"))
    out = folds.stratified_folds(df, "id", "y")
    assert out.select("id").distinct().count() == 1003
    for y in (0, 1):
        sizes = [r["count"] for r in out.filter(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert rows(out) == rows(folds.stratified_folds(df.repartition(7), "id", "y"))
    chunks = df.select(text_chunk(F.md5(F.col("id").cast("string"))).alias("c")).distinct().count()
    assert chunks > 500


def _points(spark, n, d, seed):
    rnd = np.random.default_rng(seed)
    vecs = rnd.normal(size=(n, d))
    vecs[: n // 3] = vecs[0]  # a third are copies
    return vecs, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id LONG, vec ARRAY<DOUBLE>")


@pytest.mark.parametrize("block", [2048, 16])
def test_neighbors_against_brute_force(spark, block):
    vecs, df = _points(spark, 120, 4, 2)
    got = {}
    for r in resample.nearest_neighbors(df, "id", "vec", 5, block_rows=block).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor))
    for i, v in enumerate(vecs):
        d = ((vecs - v) ** 2).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(len(vecs)), d)) if j != i][:5]
        assert [n for _, n in sorted(got[i])] == want


def test_neighbors_of_few_rows(spark):
    _, df = _points(spark, 3, 2, 1)
    assert resample.nearest_neighbors(df, "id", "vec", 5).count() == 6


def test_oversampling(spark):
    rnd = np.random.default_rng(4)
    data = [(i, [float(x) for x in rnd.normal(size=3)], int(i < 17)) for i in range(100)]
    df = spark.createDataFrame(data, "id LONG, vec ARRAY<DOUBLE>, y INT")
    out = resample.oversample(df, "id", "vec", "y")
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 83, 1: 83}
    vecs = {i: np.array(v) for i, v, _ in data}
    near = {}
    for r in resample.nearest_neighbors(df.filter("y = 1"), "id", "vec").collect():
        near.setdefault(r.id, set()).add(r.neighbor)
    made = out.filter(F.col("base").isNotNull()).collect()
    per_base = [sum(r.base == b for r in made) for b in range(17)]
    assert max(per_base) - min(per_base) <= 1
    for r in made:
        assert r.neighbor in near[r.base]
        a, b, x = vecs[r.base], vecs[r.neighbor], np.array(r.vec)
        place = np.dot(x - a, b - a) / np.dot(b - a, b - a)
        assert 0 <= place < 1 and np.allclose(a + place * (b - a), x)
    again = resample.oversample(df.repartition(5), "id", "vec", "y")
    assert rows(again.filter("base IS NOT NULL")) == rows(out.filter("base IS NOT NULL"))


def test_nearest_controls(spark):
    rnd = random.Random(9)
    data = [(i, int(rnd.random() < 0.6), round(rnd.random(), 2) if i % 3 else 0.5) for i in range(800)]
    df = spark.createDataFrame(data, "id LONG, treated INT, s DOUBLE")
    got = {r.id: (r.control, r.gap) for r in matching.match_nearest(df, "id", "treated", "s").collect()}
    controls = [(s, i) for i, t, s in data if not t]
    treated = [(i, s) for i, t, s in data if t]
    assert got.keys() == {i for i, _ in treated}
    for i, s in treated:
        # nearest score, then lower score, then lower key
        want = min(controls, key=lambda c: (abs(c[0] - s) if c[0] != s else 0.0, c[0], c[1]))
        assert got[i][1] == pytest.approx(abs(want[0] - s), abs=1e-12)
        assert got[i][0] == want[1] or abs(abs(want[0] - s) - got[i][1]) < 1e-12


def test_neighbors_across_many_blocks(spark):
    """64 dimensions, where no pair of blocks can be left out; copies and ties included."""
    import numpy as np

    from staytide.operators import resample

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64)).round(1)
    x[50:60] = x[50]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in resample.nearest_neighbors(df, "id", "vec", k=5, block_rows=30).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbor))
    for i, row in enumerate(x):
        d = ((x - row) ** 2).sum(axis=1)
        want = sorted((d[j], j) for j in range(len(x)) if j != i)[:5]
        assert [n for _, n in sorted(got[i])] == [j for _, j in want]
