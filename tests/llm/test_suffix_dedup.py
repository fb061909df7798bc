"""Removal of repeated strings against a brute-force dictionary of windows."""

import hashlib

import numpy as np
import pyarrow as pa

from staytide.llm import suffix_dedup as sd


def brute(docs):
    """docs: (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, sha)}"""
    first = {}
    data = {i: (t or "").encode() for i, t in docs}
    for i in sorted(data):
        b = data[i]
        for s in range(len(b) - 99):
            first.setdefault(b[s : s + 100], (i, s))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (i, s):
                gone[s : s + 100] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.without_repeats(df).collect()}


def _texts():
    rng = np.random.default_rng(5)

    def noise(n):
        return "".join(rng.choice(list("abcde é"), n))

    passage, other = noise(400), noise(101)
    docs = [noise(50) + passage + noise(70), noise(300), passage, passage[5:250] + noise(3) + passage[100:300]]
    docs += [other + noise(k) + other for k in (0, 1, 99, 100)]
    docs += ["a" * 99, "a" * 100, "a" * 350, "ab" * 200, "", None, noise(99), other[:100], passage + passage]
    docs += [noise(20) + other + passage for _ in range(20)]
    return list(enumerate(docs))


def test_against_brute_force(spark):
    docs = _texts()
    rng = np.random.default_rng(2)
    shuffled = [docs[i] for i in rng.permutation(len(docs))]
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)
    assert result(df) == brute(docs)


def test_shards_in_pieces(spark, monkeypatch):
    docs = _texts()
    flat = b"".join((t or "").encode().ljust(1) for _, t in docs if len((t or "").encode()) >= 100)
    whole = np.frombuffer(flat, np.uint8)
    at = np.arange(0, len(whole) - 184, 60)
    ids, sizes = np.arange(len(at)), np.full(len(at), 184)
    one = sd.Shard(ids, at * 0, sizes, sd._gather(whole, at, sizes))
    half = len(at) // 2
    two = [sd.Shard(ids[s], at[s] * 0, sizes[s], sd._gather(whole, at[s], sizes[s])) for s in (slice(0, half), slice(half, None))]
    sd.merge(two)
    joined = sorted(sum((list(zip(*(c.to_pylist() for c in s.repeated().columns))) for s in two), []))
    assert joined == sorted(zip(*(c.to_pylist() for c in one.repeated().columns)))


def test_edges(spark):
    text = "x y z " * 40
    df = spark.createDataFrame([(1, text, 1), (1, text, 2), (None, text, 3), (2, None, 4), (3, "", 5)], "doc_id long, text string, id int")
    got = result(df)
    want = brute([(1, text), (10**9, text)])
    assert got == {1: want[1], None: want[10**9], 2: brute([(2, "")])[2], 3: brute([(3, "")])[3]}
    assert sd.without_repeats(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert result(df) == brute([tuple(r) for r in df.collect()])


def test_rows_that_share_an_id(spark):
    """Shared ids and several NULL ids with texts of different lengths: each row is judged as a document of its own."""
    rng = np.random.default_rng(9)
    words = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = words(300)
    texts = [(7, words(500) + passage), (7, passage + words(20)), (7, "short"), (None, passage), (None, words(150)), (None, None), (None, words(80) + passage), (3, passage), (3, passage), (9, "")]
    texts += [(None, words(200) + passage[:150]) for _ in range(30)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, key int").repartition(4)
    order = sorted(set(texts), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = brute([(i, t) for i, (_, t) in enumerate(order)])
    by_row = {r: want[i] for i, r in enumerate(order)}
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.without_repeats(df).collect())
    assert got == sorted((t[0] or -1, *by_row[t]) for t in texts)
    assert sum(r[2] for r in got) > 1000


def _batch(texts):
    ids = pa.array(np.arange(len(texts)))
    return pa.record_batch([ids, pa.array(texts)], ["doc_id", "text"])


def _runs(texts):
    found = sd._repeated_grams(pa.Table.from_batches(sd._grams(1)(iter([_batch(texts)]))))
    return list(zip(*(c.to_pylist() for c in found.select(["id", "gram", "first", "last"]).columns)))


def test_common_phrases_alone_send_nothing():
    """Texts that share 50 bytes share grams, but no window; those that share a window keep the run that holds it."""
    rng = np.random.default_rng(4)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    phrase, passage = noise(50), noise(100)
    texts = [noise(60) + phrase + noise(60) for _ in range(50)]
    grams = [r for b in sd._grams(1)(iter([_batch(texts)])) for r in sd.unpack_planes(b.column(2)[0].as_py(), b.column(1)[0].as_py(), np.uint64)]
    assert len(set(grams)) < len(grams)
    assert _runs(texts) == []
    for front in (0, 1, 41, 42, 200):
        own = [noise(front) + passage + noise(k) for k in (0, 30)]
        held = {i for i, _, first, last in _runs(texts + own) if first <= front <= last}
        assert held == {50, 51}


def _part(texts):
    """A part as the snippets are taken from, with the runs of its texts."""
    per_doc = [[{"gram": g, "first": a, "last": z} for i, g, a, z in _runs(texts) if i == k] for k in range(len(texts))]
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
    return _batch(texts).append_column("runs", pa.array(per_doc, kind))


def test_snippets_alone_with_their_gram_are_not_sorted(monkeypatch):
    """Equal texts from several parts leave one snippet of each gram; where the context differs, only those at its edges are sorted."""
    rng = np.random.default_rng(6)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    sorted_, shard = [], sd.Shard
    monkeypatch.setattr(sd, "Shard", lambda *a: sorted_.append(len(a[0])) or shard(*a))
    passage = noise(3000)

    def found(texts):
        part = _part(texts)
        rows = [r for i in range(len(texts)) for b in sd._snippets(1, 1)(iter([part.slice(i, 1)])) for r in b.to_pylist()]
        spans = sd._lot_repeats(pa.Table.from_pylist(rows)).to_pylist()
        return {(r["id"], p) for r in spans for p in range(r["from"], r["to"])}

    assert found([passage, passage, passage]) == {(i, p) for i in (1, 2) for p in range(3000)}
    assert not sorted_
    assert found([noise(80) + passage + noise(90), noise(120) + passage + noise(90)]) >= {(1, p) for p in range(120, 3120)}
    assert 0 < sum(sorted_) < 20


def test_a_part_sends_a_row_per_lot(spark, monkeypatch):
    docs = _texts()
    texts = [t or "" for _, t in docs]
    part = _part(texts)
    one, many = ([b.to_pylist() for b in sd._snippets(s, n)(iter([part]))][0] for s, n in ((1, 1), (1000, 100)))
    assert len(one) == 1 and len(many) <= 10 and sum(r["n"] for r in many) == one[0]["n"]
    # the lots find what one shard finds, and the whole job the same with many small shards
    spans = lambda rows: sorted((r["id"], r["from"], r["to"]) for row in rows for r in sd._lot_repeats(pa.Table.from_pylist([row])).to_pylist())
    covered = lambda rows: {(i, p) for i, a, z in spans(rows) for p in range(a, z)}
    assert covered(many) == covered(one) != set()
    monkeypatch.setattr(sd, "BYTES_PER_SHARD", 300)
    monkeypatch.setattr(sd, "LOTS", 4)
    assert result(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs)
