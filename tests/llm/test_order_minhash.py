"""Near-duplicates against all pairs of texts, and components against union-find."""

import random

import pytest

from staytide.llm import order_minhash as om
from staytide.llm.components import components


def labelled(text):
    words = (text or "").lower().split()
    seen, out = {}, []
    for k in range(max(1, len(words) - 4) if words else 0):
        s = tuple(words[k : k + 5])
        seen[s] = seen.get(s, 0) + 1
        out.append((s, seen[s]))
    return out


def similarity(a, b):
    """Longest common subsequence of the labelled shingles, by the plain table."""
    a, b = labelled(a), labelled(b)
    if not a or not b:
        return float(len(a) == len(b))
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / (len(a) + len(b) - row[-1])


def brute(docs):
    parent = {i: i for i, _ in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, t in docs:
        for j, u in docs:
            if i < j and (labelled(t) == labelled(u) or similarity(t, u) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in docs}


def _docs():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = []
    for k in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 150]))]
        docs.append(list(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(copy)
        docs.append(base[len(base) // 2 :] + base[: len(base) // 2])
    docs += [["The", "SAME"], ["the", "same"], [], [], ["rep"] * 40, ["rep"] * 41]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_against_all_pairs(spark):
    docs = _docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.group_id for r in om.near_duplicates(df).collect()}
    assert got == brute(docs)


def test_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"t{i}" for i in range(300)]
    docs = []
    for k in range(400):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{k}"
        docs.append((k, " ".join(copy)))
    docs += [(1000 + k, " ".join(f"o{k}q{i}" for i in range(100))) for k in range(50)]
    rows = om.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r.kept for r in rows) == 51 and all(r.group_id == 0 for r in rows if r.doc_id < 400)


def test_order_matters():
    import numpy as np

    a = np.arange(100, dtype=np.uint64)
    assert om._aligned(a, a, 0.8) == 1.0
    assert om._aligned(a, np.roll(a, 50), 0.8) == 0.0
    swapped = a.copy()
    swapped[[3, 4]] = swapped[[4, 3]]
    assert om._aligned(a, swapped, 0.8) == 99 / 101
    assert om._aligned(a, a[:70], 0.8) == 0.0 and om._aligned(a, a[:85], 0.8) == 0.85


def test_edges(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (2, None, "z"), (3, "", "z"), (4, "A b c d e f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, group_id string")
    got = {(r.doc_id, r.group_id) for r in om.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 1)}
    kept = om.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2]
    assert om.near_duplicates(df.limit(0)).count() == 0 and om.keep_first(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)]
    links += [(500, 500 + i) for i in range(1, 60)] + [(None, 3), (4, None), (700, 700), (0, 1)]
    parent = {x: x for pair in links if None not in pair and pair[0] != pair[1] for x in pair}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a in parent and b in parent:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def _links(docs):
    """Links of each text by all pairs, with distinct texts."""
    sets = [(i, labelled(t), set(labelled(t))) for i, t in docs]
    links = dict.fromkeys((i for i, _ in docs), 0)
    for at, (i, a, x) in enumerate(sets):
        for j, b, y in sets[at + 1 :]:
            common = len(x & y)
            if common / (len(a) + len(b) - common) < 0.8:
                continue
            # the same order in both: the common ones are the subsequence
            same = [s for s in a if s in y] == [s for s in b if s in x]
            if same or similarity(" ".join(w for w in dict(docs)[i].split()), dict(docs)[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
    return links


@pytest.mark.parametrize("split", [8192, 30])
def test_links_of_a_large_group(spark, monkeypatch, split):
    monkeypatch.setattr(om, "SPLIT_MEMBERS", split)
    rng = random.Random(3)
    base = [f"t{i}" for i in range(200)]
    docs = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(copy)))
    got = {r.doc_id: r.n_links for r in om.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = _links(docs)
    wrong = sum(abs(got[i] - want[i]) for i in want)
    assert wrong <= 0.001 * sum(want.values())


@pytest.mark.parametrize("split", [8192, 30])
def test_links_of_texts_that_share_a_passage(spark, monkeypatch, split):
    monkeypatch.setattr(om, "SPLIT_MEMBERS", split)
    # blocks of a few rows, so that cells of two blocks are met too
    monkeypatch.setattr(om, "BLOCK_ROWS", 40)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(170)]
    docs = []
    for k in range(0, 240, 2):
        own = [f"o{k}x{i}" for i in range(30)]
        copy = list(own)
        copy[rng.randrange(5, 25)] = "changed"
        docs += [(k, " ".join(passage + own)), (k + 1, " ".join(passage + copy))]
    rows = om.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.n_links for r in rows} == dict.fromkeys(range(240), 1)
    assert all(r.group_id == r.doc_id // 2 * 2 for r in rows)
