"""Scores against plain counting, the seating against its expectation, and the model against the unigrams."""

import math
import pickle
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from staytide.llm import pitman_yor as py

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(docs):
    def toks(t):
        return [w.lower() for w in WORD.findall((t or "").encode())] + [None]

    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter(w for i, t in docs if not held[i] for w in toks(t))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in docs:
        ws = toks(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        out[i] = (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, base)
    return out


def scored(df, **kwargs):
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    return py.score_documents(df, train, **kwargs).collect()


def agree(rows, want):
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score <= 0 and math.isfinite(r.score)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = scored(df)
    docs = [tuple(r) for r in df.collect()]
    assert len(rows) == len(docs)
    agree(rows, brute(docs))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_many_buckets_with_hot_words(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.score for r in scored(df)}
    monkeypatch.setattr(py, "TOKENS_PER_BUCKET", 8000)
    rows = scored(df)
    agree(rows, brute([tuple(r) for r in df.collect()]))
    # other random numbers, the same model
    assert abs(sum(r.score for r in rows) / sum(whole.values()) - 1) < 0.01


def test_edges(spark):
    df = spark.createDataFrame([(1, "A b a"), (1, "A b a"), (None, None), (2, ""), (15, "x")], "doc_id long, text string")
    rows = scored(df)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (1, 4), (1, 4), (2, 1), (15, 2)]
    assert scored(df.limit(0)) == []


@pytest.mark.parametrize("tokens", [4_000_000, 6000])
def test_probabilities_sum_to_one_after_sweeps(spark, sf, monkeypatch, tokens):
    """In each state of a whole run: the parent's, and those after many contexts, over all known words and the unknown one."""
    monkeypatch.setattr(py, "TOKENS_PER_BUCKET", tokens)
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    occurrences, m = py.learn(df, F.col("doc_id") % 7 != 2)
    buckets = [py.Bucket(r.asDict(), m) for r in occurrences.filter("bucket >= 0").collect()]
    assert len(m.states) == py.BURN_IN + py.SAMPLES and (tokens > 10_000 or (len(buckets) > 5 and len(m.hot)))
    d2, c1 = m.discounts[1], py.CONCENTRATION[1]
    walks = [b.sweeps() for b in buckets]
    for state in m.states:
        parent, seen, below = {}, np.zeros(m.contexts), np.zeros(m.contexts)
        for b, (tables, word_tables, seats) in zip(buckets, map(next, walks)):
            p = b.parent_probability(word_tables, seats, state)
            known = b.whole(b.of_words(b.count), m.hot_counts) > 0
            parent.update(zip(b.words[known].tolist(), p[known].tolist()))
            trained = b.count > 0
            chance = b.probability(tables, p, state)
            np.add.at(seen, b.context[trained], chance[trained])
            np.add.at(below, b.context[trained], p[b.owner[trained]])
        unknown = buckets[0].parent_probability(np.zeros(1), np.zeros(1), state)[0]
        assert len(parent) == m.vocabulary
        assert math.isclose(sum(parent.values()) + unknown, 1.0, abs_tol=1e-9)
        back = (c1 + d2 * state.context_tables) / (c1 + m.context_counts)
        assert np.allclose(seen + back * (1 - below), 1.0, atol=1e-9)


def bigram(docs, held):
    """Log10 of an interpolated bigram: half the share after the word before, half the smoothed unigram."""
    def toks(t):
        return [w.lower() for w in WORD.findall((t or "").encode())] + [None]

    one, two, before = Counter(), Counter(), Counter()
    for i, t in docs:
        if not held[i]:
            ws = [b"<s>", *toks(t)]
            one.update(ws[1:])
            two.update(zip(ws, ws[1:]))
            before.update(ws[:-1])
    n, v = sum(one.values()), len(one)
    total = 0.0
    for i, t in docs:
        if held[i]:
            ws = [b"<s>", *toks(t)]
            total += sum(math.log10(0.5 * two[a, b] / max(before[a], 1) + 0.5 * (one[b] + 1) / (n + v + 1)) for a, b in zip(ws, ws[1:]))
    return total


def test_better_than_an_interpolated_bigram(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = scored(df)
    held = {r.doc_id: r.held_out for r in rows}
    assert sum(r.score for r in rows if r.held_out) > bigram([tuple(r) for r in df.collect()], held)


def test_seating_matches_one_by_one():
    rng = np.random.default_rng(3)
    customers = np.full(4000, 40)
    got = py.seat(customers, np.full(4000, 0.7), 0.6, rng)
    plain = []
    for _ in range(4000):
        t = 1
        for n in range(1, 40):
            t += rng.random() < 0.7 / (0.7 + n - 0.6 * t)
        plain.append(t)
    assert abs(got.mean() - np.mean(plain)) < 0.1
    assert (py.seat(np.array([0, 1, 5]), np.ones(3), 0.5, rng) <= [0, 1, 5]).all()


def peak(run):
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def one_bucket(n_docs=600, n_words=400):
    """The dealt rows of one bucket, from several parts, and the words of their documents."""
    rng = np.random.default_rng(5)
    docs = [[f"w{w}" for w in (rng.zipf(1.3, n_words) % 20_000).tolist()] for _ in range(n_docs)]
    batches = []
    for first in range(0, n_docs, n_docs // 6):
        ids = list(range(first, min(first + n_docs // 6, n_docs)))
        batches.append(pa.record_batch({"doc_id": ids, "text": [" ".join(docs[i]) for i in ids], "train": [i % 7 != 2 for i in ids]}))
    dealt = pa.Table.from_batches(py._deal(1, np.zeros(0, py.U64), 20)(iter(batches)))
    return dealt.filter(pc.equal(dealt["bucket"], 0)), docs


def test_a_bucket_is_gathered_in_little_memory():
    dealt, docs = one_bucket()
    row = py._bucket(dealt).to_pylist()[0]
    assert peak(lambda: py._bucket(dealt)) < 50 * row["n"]
    pairs = Counter((a, b) for i, d in enumerate(docs) if i % 7 != 2 for a, b in zip(["", *d], [*d, ""]))
    everywhere = {(a, b) for d in docs for a, b in zip(["", *d], [*d, ""])}
    assert abs(row["n_pairs"] / len(everywhere) - 1) < 0.05  # some contexts share a number
    counts = py.unpack_planes(row["counts"], row["n_pairs"], np.uint32)
    assert counts.sum() == sum(pairs.values())
    assert py.unpack_planes(row["times"], row["n"], np.uint32).sum() == sum(len(d) + 1 for d in docs)
    assert py.unpack_planes(row["members"], row["n_pairs"], np.uint32).sum() == row["n"]


def test_no_seating_is_drawn_that_nothing_reads(monkeypatch):
    bucket = py._bucket(one_bucket(60, 50)[0])
    model = py.Model(1, np.zeros(0, py.U64), 1 << 20, vocabulary=1000, train_tokens=2500, context_counts=np.ones(1 << 20, np.int32))
    none = np.zeros(0, np.int64)
    model.states = [py.State(np.ones(1 << 20, np.int32), 2000, 1000, none, none) for _ in range(4)]
    seat, drawn = py.seat, []
    monkeypatch.setattr(py, "seat", lambda customers, *rest: drawn.append(customers) or seat(customers, *rest))
    list(py._score(model, 2)(iter(bucket.to_batches())))
    # of the pairs and of the parent, in each state after the first
    assert len(drawn) == 2 * (len(model.states) - 1)
    # a lone customer, or none, takes no random number: seats drawn for the others alone are the same
    customers = np.array([1, 70, 0, 5, 1, 5, 2, 900])
    both = [seat(c, np.full(len(c), 0.7), 0.6, np.random.default_rng(1)) for c in (customers, customers[customers > 1])]
    assert (both[0][customers > 1] == both[1]).all() and both[0].tolist()[:3:2] == [1, 0]


def test_a_text_part_is_hashed_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 5000, 2000).tolist()) for _ in range(300)] + ["", None]
    part = pa.record_batch({"text": texts})
    pieces = py.tokens(part, 20)
    size = sum(len(t or "") for t in texts)
    assert peak(lambda: py.tokens(part, 20)) < 20 * size
    monkeypatch.setattr(py, "_HASHED_BYTES", 1 << 40)
    for a, b in zip(pieces, py.tokens(part, 20)):
        assert (a == b).all()
    assert np.bincount(pieces[2]).tolist() == [2001] * 300 + [1, 1]


def test_a_bucket_is_let_go_before_the_next():
    bucket = py._bucket(one_bucket()[0]).to_batches()[0]
    none = np.zeros(0, np.int64)
    model = py.Model(1, np.zeros(0, py.U64), 1 << 20, vocabulary=1000, train_tokens=2500, context_counts=np.ones(1 << 20, np.int32))
    model.states = [py.State(np.ones(1 << 20, np.int32), 2000, 1000, none, none) for _ in range(4)]

    def score(times):
        for _ in py._score(model, 2)(iter([bucket] * times)):
            pass

    score(1)
    assert peak(lambda: score(3)) < 1.15 * peak(lambda: score(1))


def test_a_model_is_sent_with_compressed_vectors():
    rng, hot = np.random.default_rng(8), np.array([5, 9])
    counts = rng.poisson(40, 1 << 17).astype(np.int32)
    model = py.Model(3, hot.astype(py.U64), 1 << 17, context_counts=counts, states=[py.State(counts // 2, 7, 5, hot, hot)])
    sent = pickle.dumps(model)
    assert len(sent) < counts.nbytes
    got = pickle.loads(sent)
    assert (got.context_counts == counts).all() and (got.states[0].context_tables == counts // 2).all()
    assert got.context_counts.dtype == np.int32 and (got.buckets, got.states[0].tables) == (3, 7) and (got.hot == hot).all()
