"""Runs against a brute force over all periods, on random, periodic and long texts, and the contract's digests."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from staytide.llm import periodic

EMPTY = hashlib.sha256(b"").hexdigest()


def plain_runs(w, least=24, repeats=3):
    """Every period in turn: stretches of equal words q apart, unless a divisor of q is a period of the stretch too."""
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q) and (i, j + q) not in found:
                found[i, j + q] = q
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def numbers(docs):
    names = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    return np.array([names[w] for d in docs for w in d], np.int64), np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)


def check(docs):
    got = periodic.runs_in(*numbers(docs))
    want = [(i, *r) for i, d in enumerate(docs) for r in sorted(plain_runs(d), key=lambda r: (r[0], r[2]))]
    assert [tuple(r) for r in got.tolist()] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abc", min_size=1, max_size=40), st.integers(1, 12)), max_size=6), min_size=1, max_size=4))
def test_runs_against_all_periods(docs):
    check([[c for t, n in d for c in t * n] for d in docs])


def test_random_and_overlapping_runs():
    rng = random.Random(5)
    for size in (2, 3, 8):
        docs = []
        for _ in range(30):
            d = []
            while len(d) < rng.randrange(400):
                unit = [str(rng.randrange(size)) for _ in range(rng.choice([1, 2, 5, 8, 9, 15, 16, 17, 31, 32, 33, 50]))]
                d += (unit * rng.randrange(1, 6))[: rng.randrange(1, 150)]
            docs.append(d)
        check(docs)
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    check([list(fibonacci[-1])])


def test_bounds_of_a_run():
    for q in (1, 7, 8, 9, 16, 17, 40):
        unit = [f"u{i}" for i in range(q)]
        least = max(24, 3 * q)
        for n in (least - 1, least, least + 1):
            d = ["x"] + (unit * 40)[:n] + ["y"]
            assert plain_runs(d) == ([(1, n, q)] if n >= least else [])
            check([d, d])
    # a run does not go on into the next document
    check([["a"] * 20, ["a"] * 20, [], ["a"] * 24])


def plain(doc_id, text):
    """The contract, row by row."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept))


def test_query_on_a_whole_table(spark, sf):
    from staytide.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect())
    assert got == sorted(plain(r.doc_id, r.text) for r in rows)
    assert sum(r[1] for r in got) > 10


def test_edges(spark):
    tied = " ".join(["a b"] * 12 + ["z"] + ["c d"] * 12)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "word"), (None, "k " * 30), (None, None), (5, tied), (5, tied), (6, "  　é " * 20), (11, "x\ny\tz " * 10), (13, "Ab ab " * 24)]
    df = spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, text string, runs string")
    docs = periodic.exercised(df)
    got = sorted((tuple(r) for r in periodic.digests(periodic.runs_of(docs)).collect()), key=str)
    assert got == sorted((plain(*r) for r in rows), key=str)
    by_id = {r[0]: r for r in got}
    assert by_id[5][2:5] == (0, 24, 2) and by_id[2][1:] == (0, None, None, None, None, EMPTY, EMPTY)
    assert periodic.digests(periodic.runs_of(periodic.exercised(df.limit(0)))).count() == 0


def test_a_very_long_text_takes_time_in_proportion(spark):
    import time

    words = " ".join(f"w{i % 70_001}" for i in range(600_000))
    df = spark.createDataFrame([(1, words), (2, "same " * 600_000)], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in periodic.runs_of(df).collect()}
    assert time.time() - began < 30
    assert [tuple(r) for r in rows[1].runs] == [(0, 600_000, 70_001)]
    assert [tuple(r) for r in rows[2].runs] == [(0, 600_000, 1)]
    assert rows[2].collapsed_sha256 == hashlib.sha256(b"same").hexdigest()
