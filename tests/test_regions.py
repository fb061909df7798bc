"""Connected regions against a flood fill, and overlaps against sets of points."""

import random

from staytide.operators import regions


def flood(points):
    left, out = set(points), []
    while left:
        todo, seen = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                seen.add(p)
                todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
        out.append(seen)
    return sorted(out, key=min)


def test_regions_and_overlaps(spark):
    rnd = random.Random(5)
    inside = {}
    for case in range(4):
        for mop in (6, 12, 24):
            share = (0.3, 0.5, 0.6, 0.9)[case]
            inside[case, mop] = {(a, b) for a in range(40, 70) for b in range(60, 95) if rnd.random() < share}
    inside[9, 12] = {(50, 60)}
    rows = [(c, m, a, b, 0.04 if (a, b) in s else 0.06) for (c, m), s in inside.items() for a in range(40, 70) for b in range(60, 95)]
    df = spark.createDataFrame(rows, "case long, mop int, m1_valuenum int, m2_valuenum int, average_pred double").repartition(5)
    found = regions.safe_regions(df, ["case", "mop"], 0.05)
    got = {(r.case, r.mop, r.region): r for r in found.collect()}
    want = {(c, m, k): s for (c, m), p in inside.items() for k, s in enumerate(flood(p))}
    assert got.keys() == want.keys()
    for key, s in want.items():
        r = got[key]
        assert {(x.m1, y) for x in r.runs for y in range(x.low, x.high + 1)} == s and r.n_points == len(s)
        assert (r.m1_low, r.m1_high) == (min(a for a, _ in s), max(a for a, _ in s))
        assert (r.m2_low, r.m2_high) == (min(b for _, b in s), max(b for _, b in s))
    largest = {k: max(flood(p), key=len) for k, p in inside.items()}
    for r in regions.overlaps(found, ["case"], "mop").collect():
        own, later = largest[r.case, r.mop], [m for m in (6, 12, 24) if m > r.mop and (r.case, m) in largest]
        assert r.n_points == len(own)
        assert (r.next_points, r.shared) == ((len(largest[r.case, later[0]]), len(own & largest[r.case, later[0]])) if later else (None, None))
    assert regions.safe_regions(df, ["case", "mop"], 0.0).count() == 0
