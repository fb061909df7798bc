"""Packing: ids as the tokenizers library gives them, every piece in one place, and few sequences."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staytide.llm import packing


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder()


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n\nb c", "a \n b", "a\n b", "a \nb", "it's 12 o'clock\tnow", " x  y z",
    "Üß éé 😀 d", "a\r\nb", "don't  stop", "x" * 300, "a b" * 50, "\x00 a \x85 b", "a 　 b c", "  a b",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(reference, encoder, text):
    assert encoder(text) == np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


ADDED = [
    "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b", "x  <|endoftext|>\n\n y", "<|endoftext|><|endoftext|> <|endoftext|", "<|END|>",
    " <|endoftext|> a  b\t<|endoftext|>",
]


@pytest.mark.parametrize("text", ADDED)
def test_ids_of_added_tokens(reference, encoder, text):
    assert encoder(text) == np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab'  \n\t 1.é ")), max_size=12))
def test_ids_of_any_text(reference, encoder, text):
    assert encoder(text) == np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check(rows, sequence):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        held.sort()
        at = 0
        for offset, length in held:
            assert offset == at
            at += length
        assert at <= sequence
    return len(by_sequence)


def test_whole_table(spark, sf, reference):
    from staytide.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = QUERIES["op1_pack_sequences"](spark, sf).collect()
    total = sum(r.length for r in rows)
    n = check(rows, 2048)
    assert n <= 1.03 * -(-total // 2048) + 1
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    for d in docs:
        ids = reference.encode(d.text or "", add_special_tokens=False).ids + [0]
        k = begin = 0
        size = (len(ids) - 1) % 2048 + 1
        while begin < len(ids):
            r = pieces.pop((d.doc_id, k))
            assert (r.start, r.length) == (begin, size)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[begin : begin + size], "<u4").tobytes())
            begin, k, size = begin + size, k + 1, 2048
    assert not pieces


def test_edges(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (2, "", None), (3, "word " * 9000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.packed(df).collect()
    check(out, 2048)
    assert sum(r.length for r in out) == 1 + 1 + 3 + 1 + len(packing.Encoder()("word " * 9000)) // 4 + 1
    assert packing.packed(df.limit(0)).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for size in (10, 300, 20_000):
        histogram = np.bincount(np.minimum(rng.lognormal(5.5, 1.1, size).astype(int) + 1, 2048), minlength=2049)
        groups = packing.plan(histogram)
        used = np.zeros(2049, int)
        for lengths, n in groups:
            assert sum(lengths) <= 2048
            for length in lengths:
                used[length] += n
        assert (used == histogram).all()
        need = -(-(np.arange(2049) * histogram).sum() // 2048)
        assert sum(n for _, n in groups) <= 1.02 * need + 1
