"""Near vectors against all pairs, with large groups and odd rows."""

import numpy as np

from staytide.llm import itq

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    n = len(rows)
    ok = [
        i
        for i, (v, x, lab) in enumerate(rows)
        if v is not None and lab is not None and x and all(e is not None and np.isfinite(np.float32(e)) for e in x) and any(np.float32(e) != 0 for e in x)
    ]
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    vec = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    for a in range(len(ok)):
        for b in range(a):
            i, j = ok[a], ok[b]
            x, y = vec[i], vec[j]
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i in ok:
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    comp = [low[find(i)] if i in vec else rows[i][0] for i in range(n)]
    return sorted(((rows[i][0], links[i], comp[i], rows[i][0] == comp[i]) for i in range(n)), key=str)


def result(df, **kwargs):
    return sorted((tuple(r) for r in itq.near_vectors(df, **kwargs).collect()), key=str)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 32))
    rows = []
    for k in range(260):
        x = base[k % 40] + rng.normal(size=32) * (0.06 if k % 3 else 0.02)
        rows.append((k, [float(e) for e in x], k % 40 % 3))
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(30)]
    rows += [(2000, [2 * e for e in rows[3][1]], rows[3][2]), (2001, rows[3][1], None), (2002, None, 1), (2003, [0.0] * 32, 1)]
    rows += [(2004, [float("nan")] * 32, 1), (2005, [None] * 32, 1), (2006, [1.0, 2.0], 1), (2007, [1.0, 2.001], 1), (None, rows[3][1], 0), (2008, [], 1)]
    rows += [(7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = result(df), brute(rows)
    linked = sum(r[1] for r in want)
    assert sum(r[1] for r in got) >= 0.98 * linked
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    # blocks of a few rows find the same
    assert result(df, block=4) == got


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in df.collect()]
    want = {}
    for lab in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == lab]
        x = np.array([r[1] for r in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for r, n in zip(own, (x @ x.T >= 0.98).sum(1) - 1):
            want[r[0]] = int(n)
    got = {r[0]: r[1] for r in result(df.withColumn("n_links", df["label"]))}
    assert sum(got.values()) >= 0.99 * sum(want.values())
    assert all(got[k] <= want[k] for k in want)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_very_large_and_small_components(spark):
    """Components of 1e200 and 1e-200 have lengths too; directions alone count."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(i, (base * f).tolist(), "a") for i, f in enumerate((1.0, 1e200, 1e-200, 1e305, -1e200))]
    rows += [(100 + i, (x * 10.0 ** rng.integers(-150, 150)).tolist(), "a") for i, x in enumerate(rng.normal(size=(400, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_vectors(df).collect()}
    assert [got[i] for i in range(5)] == [(3, 0)] * 4 + [(0, 4)]
    assert all(got[i] == (0, i) for i in got if i >= 100)
