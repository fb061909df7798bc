"""Batch runs that stop and go on, and episodes that grow batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from staytide.operators import episodes
from staytide.session import materialize, shared_dir
from staytide.sources import batches

SCHEMA = "id long, twice long"


def test_a_stopped_run_goes_on(spark):
    root, computed = shared_dir(spark, "batches"), []

    def compute(i, stop=None):
        if i == stop:
            raise RuntimeError("stopped")
        computed.append(i)
        return spark.range(10 * i, 10 * i + 10).select("id", (F.col("id") * 2).alias("twice"))

    assert batches.read_committed(spark, root, SCHEMA).count() == 0
    with pytest.raises(RuntimeError):
        batches.run_batches(spark, root, range(5), lambda i: compute(i, stop=2))
    assert {r.batch for r in batches.read_committed(spark, root, SCHEMA).collect()} == {0, 1}
    # a folder without a line in the manifest, as a run leaves that stops between the two
    compute(2).write.parquet(f"{root}/batch_2-{'0' * 32}")
    assert batches.run_batches(spark, root, range(5), compute) == [2, 3, 4]
    assert batches.run_batches(spark, root, range(5), compute) == []
    assert computed == [0, 1, 2, 2, 3, 4]
    got = sorted(tuple(r) for r in batches.read_committed(spark, root, SCHEMA).collect())
    assert got == [(i, 2 * i, i // 10) for i in range(50)]
    # another run that publishes a batch again changes nothing
    batches.publish(spark, root, 1, spark.createDataFrame([(1, 1)], SCHEMA))
    assert sorted(tuple(r) for r in batches.read_committed(spark, root, SCHEMA).collect()) == got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_of_the_ticks_gives_the_same_episodes(spark, seed):
    rnd = random.Random(seed)
    ticks = [(k, t, rnd.random()) for k in ["hot"] * 1 + ["a", "b", "c"] for t in sorted(rnd.sample(range(4000), 400 if k == "hot" else 60))]
    df = materialize(spark.createDataFrame(ticks, "k string, t long, v double"), "ticks")
    whole = episodes.episodes(df, ["k"], "t", 30, ["v"], chunk_width=10)
    part = {t[:2]: rnd.randrange(3) for t in ticks}
    stored = whole.limit(0)
    for i in range(3):
        new = spark.createDataFrame([t for t in ticks if part[t[:2]] == i and (t[0] != "c" or i == 1)], df.schema)
        if i == 1:
            new = new.unionByName(spark.createDataFrame([t for t in ticks if t[0] == "c" and part[t[:2]] != 1], df.schema))
        changed = materialize(episodes.grown(stored, new, ["k"], "t", 30, ["v"], chunk_width=10), "grown")
        assert (i == 1) == (changed.filter("k = 'c'").count() > 0)
        stored = materialize(episodes.with_growth(stored, changed, ["k"]), "stored")
    rows = lambda d: sorted(tuple(r) for r in d.select("k", "episode", "first_tick", "last_tick", "n_ticks", "v").collect())
    assert rows(stored) == rows(whole)
