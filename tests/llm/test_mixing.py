"""Targets by plain water-filling, the schedule's evenness, and what documents give."""

from collections import defaultdict

from staytide.llm import mixing


def plain_targets(totals):
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(totals.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * totals[s]]
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        for s in full:
            target[s] = 2.0 * totals[s]
            left -= target[s]
            free.remove(s)
    return target


def check(rows, block=None):
    totals = defaultdict(int)
    for r in rows:
        totals[r.source] += r.size
    want = plain_targets(totals)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == totals[r.source]
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    for s in totals:
        assert abs(taken[s] - want[s]) <= 1


def frame(spark, counts):
    rows = [(i * 31 + k, s, n) for i, (s, n_docs, n) in enumerate(counts) for k in range(n_docs)]
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


def test_targets_are_met(spark):
    df = frame(spark, [("a", 400, 50), ("b", 3, 7), ("c", 20, 900), (None, 30, 11), ("d", 1, 1), ("e", 5, 0), ("f", 200, 3)])
    for block in (1, 64, 2048):
        rows = mixing.taken_per_document(df, block).collect()
        assert len(rows) == df.count()
        check(rows)


def test_slots_of_a_source_come_evenly(spark):
    df = frame(spark, [("a", 300, 100), ("b", 300, 100), ("c", 300, 100)])
    sources = mixing.targets(df)
    slots = mixing.schedule(sources, 50).collect()
    share = {r.m_rank: r.m_quota for r in sources.collect()}
    total = sum(share.values())
    slots.sort(key=lambda r: r.m_slot)
    seen = defaultdict(int)
    for n, r in enumerate(slots, 1):
        seen[r.m_rank] += 1
        assert all(abs(seen[s] - n * share[s] / total) < 4 for s in share)


def test_whole_mixture(spark):
    """The pieces of a slot lie end to end in its block."""
    df = frame(spark, [("a", 40, 13), ("b", 7, 100)])
    by_slot = defaultdict(list)
    for r in mixing.mixture(df, 32).filter("m_words > 0").collect():
        by_slot[(r.m_slot, r.m_epoch)].append((r.m_piece_from, r.m_piece_from + r.m_words, r.m_take))
    for held in by_slot.values():
        at = 0
        for begin, end, take in sorted(held):
            assert begin == at
            at = end
        assert at == take


def test_edges(spark):
    rows = [(1, "a b", "s", "x"), (1, "a b", "s", "x"), (None, None, None, None), (2, "", "s", "x"), (2, "", "s", "x"), (3, "w " * 5000, "t", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.taken_per_document(mixing.sized(df)).collect()
    assert len(out) == len(rows)
    check(out)
    again = mixing.taken_per_document(mixing.sized(df)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.taken_per_document(mixing.sized(df.limit(0))).count() == 0
