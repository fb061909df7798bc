"""Deobfuscation of disguised words, and held-out accuracy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from staytide.llm import toxicity as tx

CLEAN = "the idiot said that a stupid person was not a moron but the loser of the game in the long run and all of it"


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(i, CLEAN) for i in range(50)], "doc_id long, text string")
    return tx.character_model(df)


@pytest.mark.parametrize(
    "word, plain",
    [("1d10t", "idiot"), ("id!ot", "idiot"), ("$tup1d", "stupid"), ("mo-r.on", "moron"), ("l0$3r", "loser"), ("stuuuupid", "stupid"), ("idiooooot", "idiot"), ("game", "game")],
)
def test_decode(model, word, plain):
    assert tx.decode(word, model) == plain


def test_words(model):
    read = tx.Reader(model)
    got = read.words("You 1D10T! such a s t u p i d l.o.s.e.r, the 'game' *** 12 a a a a m_o_r_o_n")
    assert {"idiot", "game", "loser", "moron", "you"} <= got and "12" not in got
    assert "stupid" in read.words("such s t u p i d words")
    assert read.words("") == set() == read.words(" *** 1 2")


@pytest.mark.parametrize("word, plain", [("stuppid", "stupid"), ("iddiot", "idiot"), ("1ddiot", "idiot"), ("100ser", "loser")])
def test_decode_of_a_letter_twice(model, word, plain):
    assert plain in tx.Reader(model).words(word)


def test_letters_apart_are_several_words(model):
    read = tx.Reader(model)
    assert "stupid" in read.words("such a s t u p i d person")
    assert "stupid" in read.words("such a\ts\tt\tu\tp\ti\td person") and "idiot" in read.words("i\nd\ni\no\nt")
    assert "idiot" in read.words("t h e i d i o t")
    assert "stupid" in read.words("-" * 200 + "ab s t u p i d")


def test_signs_alone(model):
    read = tx.Reader(model)
    assert read.words("1$ 455 $#!7") & {"ass", "as"} and len(read.words("$#!7")) == 1
    assert read.words("*** 888 12 --") == set()


def test_held_out(spark):
    from staytide.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = QUERIES["op2_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    wrong = ((s >= 0.5) != (y == 1)).mean()
    assert wrong < 0.03  # labelled texts of which only junk is left stay unknown
    order = np.argsort(s)
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.96


def test_edges(spark):
    rows = [(1, "bad idiot word", 7), (1, "bad idiot word", 7), (2, "fine words here", None), (None, None, 0), (3, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (2, None), (2, 5)], "doc_id long, label int")
    model = tx.character_model(df)
    clf = tx.learn(df, labels, F.lit(True), model)
    assert len(tx.score(df, model, clf).collect()) == 5
    none = tx.learn(df, labels.limit(0), F.lit(True), model)
    assert {round(r.score, 6) for r in tx.score(df, model, none).collect()} == {0.0}
    assert tx.score(df.limit(0), tx.character_model(df.limit(0)), clf).count() == 0


def spellings(word, model, single, spaced):
    """Cost of every spelling that the channel allows, each way of reading the word taken in turn."""
    steps = [(c, 1) for c in word] if spaced else [(k, len(list(g))) for k, g in itertools.groupby(word)]
    costs = {}

    def go(i, a, b, cost, text):
        if i == len(steps):
            key = (spaced and b == tx._END, text)
            costs[key] = min(costs.get(key, np.inf), cost - model[a, b, tx._END])
            return
        c, n = steps[i]
        letters = [(c, 0.0)] if c.isalpha() else [(x, tx.SUBSTITUTE) for x in tx.STANDS_FOR.get(c, "")]
        if not c.isalpha() and (not letters or c.isdigit()):
            letters.append((c, tx.FOREIGN))
        if c in tx.SEPARATORS:
            go(i + 1, a, b, cost + tx.DROP, text)
        for x, price in letters:
            s = tx.symbol(x)
            one = cost + price - model[a, b, s]
            if n != 2 or single:
                go(i + 1, b, s, one + (tx.SINGLE if n == 2 else 0.0), text + x)
            if spaced:
                go(i + 1, s, tx._END, one - model[b, s, tx._END] + tx.BOUNDARY, text + x + " ")
            if n > 1:
                go(i + 1, s, s, one - model[b, s, s] + (tx.DOUBLE if n > 2 else 0.0), text + x + x)

    go(0, tx._OTHER, tx._END, 0.0, "")
    # a last word that is ended twice counts only if there is no other
    whole = {t: c for (twice, t), c in costs.items() if not twice}
    return whole or {t: c for (_, t), c in costs.items()}


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("spaced", [True, False])
def test_decode_finds_the_cheapest_of_all_spellings(model, single, spaced):
    rng = np.random.default_rng(3)
    words = ["1d10t", "stuppid", "a$$", "m0-r_n", "l0$$er", "aab", "---", "7"]
    words += ["".join(rng.choice(list("stuidaoe1!0$-*46"), rng.integers(1, 7))) for _ in range(150)]
    for word in words:
        costs = spellings(word, model, single, spaced)
        found = tx.decode(word, model, single, spaced)
        near = {t.strip() if spaced else t: c for t, c in sorted(costs.items(), key=lambda x: -x[1])}
        assert near[found.strip() if spaced else found] <= min(costs.values()) + 1e-9, word
