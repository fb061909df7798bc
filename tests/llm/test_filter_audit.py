"""The audit against filters applied one document at a time in every order, and defined results of odd rows."""

import re
from itertools import permutations

import pytest

from staytide.llm import filter_audit


def plain(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))

    def fails(i, text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > firsts[text],
        }

    out = []
    for part in {s or "" for _, _, s in docs}:
        own = [(i, fails(i, t)) for i, t, s in docs if (s or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                out.append(
                    (
                        part,
                        "".join(order),
                        step,
                        len(left),
                        len(gone),
                        sum(d[1][f] for d in own) - len(gone),
                        sum(d[1][f] and sum(d[1].values()) == 1 for d in own),
                        sum(i in good for i, _ in gone),
                        sum(i in toxic for i, _ in gone),
                    )
                )
    total = {}
    for r in out:
        total[r[0], r[1][r[2] - 1]] = total.get((r[0], r[1][r[2] - 1]), 0) + r[4]
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


LONG = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"),
    (2, LONG, "a"),
    (3, LONG, "b"),
    (4, LONG + " #", "a"),
    (5, " ".join(["the"] * 80), "a"),
    (6, LONG.upper(), "b"),
    (7, None, "a"),
    (8, "", None),
    (9, " \t\x0b", ""),
    (10, "É" * 200 + " AB", "b"),
    (None, LONG, "a"),
    (None, None, None),
    (None, None, None),
    (11, LONG, "a"),
    (11, LONG, "a"),  # a repeated row
    (12, "one", "a"),
    (12, "two $", "b"),  # one id, two texts
    (13, LONG + " " + "x " * 50_000, "a"),
]
LABELS = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (4, None, 1), (5, 1, None), (6, 0, 0), (8, 1, 1), (11, 1, 1), (12, 1, 0), (None, 1, 1), (99, 1, 1)]


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 0, "y") for r in docs], "doc_id long, text string, source string, key string, docs int, failed string")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_all_orders(spark):
    got = filter_audit.audit_documents(*frames(spark, DOCS, LABELS))
    assert sorted(tuple(r) for r in got.collect()) == plain(DOCS, LABELS)


@pytest.mark.parametrize("docs", [[], DOCS[:1]])
def test_few_documents(spark, docs):
    got = filter_audit.audit_documents(*frames(spark, docs, []))
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, [])


def test_other_filters(spark):
    """The audit takes any named filters' tables."""
    rows = spark.createDataFrame([(str(i), "p", 1, i % 2, 0) for i in range(12)], "key string, part string, docs long, good long, toxic long")
    tables = {"X": rows.filter("key % 3 = 0").select("key"), "Y": rows.filter("key % 2 = 0").select("key")}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost) for r in filter_audit.audit(rows, tables).collect()}
    assert got == {("XY", 1): (8, 4, 0, 2, 2), ("XY", 2): (4, 4, 2, 4, 0), ("YX", 1): (6, 6, 0, 4, 0), ("YX", 2): (4, 2, 2, 2, 2)}
