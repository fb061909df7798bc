"""Quality statistics against plain Python, and rules on planted signals."""

import re
from collections import Counter

from staytide.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    n, r = len(words), len(repeated)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_whole_table(spark, sf):
    from staytide.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_quality_rules"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


TEXTS = [None, "", " \n\t ", "a", "a b c a b c", "x\x0by\x0cz\r\nw", "é 😀 #*$ %&|<> é", "l\nl\n\nl \n l\n", "a a a a a", "w " * 60, "\n".join(["one two three"] * 30)]
TEXTS += ["a b a b a", "a b c d a b c", " ".join(str(i) for i in range(30_000)) + " 1 2 3", "    x"]


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    got = {r.doc_id: (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.base_failed) for r in quality.judge(df, []).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_rules_find_planted_conjunctions(spark):
    rows = []
    for i in range(3000):
        a, b = (i * 7919 % 1000) / 1000, (i * 104729 % 997) / 997
        rows.append((a, b, int((a > 0.8 and b <= 0.5) or b > 0.9)))
    df = spark.createDataFrame(rows, "a double, b double, y int")
    rules = quality.learn_rules(df, "y", ["a", "b"], bins=40)
    assert rules and len(rules) <= 6
    judged = df.withColumn("keep", quality.verdict(rules)).collect()
    wrong = sum(r["keep"] == bool(r["y"]) for r in judged)
    assert wrong <= 0.03 * len(judged)
    assert sum(r["y"] == 0 and not r["keep"] for r in judged) <= 0.01 * len(judged)
    assert "CASE WHEN" in str(quality.verdict(rules))


def test_without_labels_of_both_classes(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0), (None, None)], "a double, y int")
    assert quality.learn_rules(df, "y", ["a"]) == []
    assert quality.learn_rules(df.limit(0), "y", ["a"]) == []


def test_keep_returns_the_columns(spark):
    good = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, good, "k"), (1, good, "k"), (2, None, "k"), (None, good, None)], "doc_id long, text string, kept string")
    out = quality.keep(df, [])
    assert out.columns == df.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 1]
    assert quality.keep(df.limit(0), []).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = quality.learn_from_labels(docs, labels.filter("doc_id % 3 > 0"))
    rows = quality.judge(docs.join(labels.filter("doc_id % 3 = 0"), "doc_id"), learned).select("quality", "base_failed", "kept").collect()
    clear = [r for r in rows if not r.base_failed]
    assert sum(r.kept and r.quality == 0 for r in clear) <= 0.05 * sum(r.quality == 0 for r in clear) + 1
    assert sum(not r.kept and r.quality == 1 for r in clear) <= 0.01 * sum(r.quality == 1 for r in clear)
