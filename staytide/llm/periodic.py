"""Periodic runs of words by seed and extend along diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least `min_words` words and
`min_repeats` periods, which no neighbouring word extends.

A run of period q holds the same words on the diagonal i -> i + q for all but its last q words, so grams of a guaranteed length match
there: 16 words for periods up to 16, and for longer ones the power of two from q on. Grams of each such length are
indexed by hash; each occurrence meets the next one in its document, and no other: a gram of at least q words of such a run comes
again after q words, not before. The pairs (lag, place) of all diagonals are sorted; a table of the furthest place covered by
each lag leaves out the seeds that an earlier seed's extension has reached, so an extension is made once. Grams
that occur once are no seeds, nor are longer grams that begin there: of ordinary text next to nothing goes on to the second length.
Runs found are compared word by word, so that equal hashes of different grams cannot make one.

Work and memory follow the words of a part of the batch, n log n at worst; a text is never cut, and the longest one bounds the memory.

Defined results: NULL, empty and blank texts have no words, no runs, and the digest of nothing. Repeated rows each get a
row. Words are runs of characters other than space and tab to carriage return, compared case-sensitively. Other columns
pass by: only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staytide.llm.textarrays import U64, Words, column, mix64, parts, powers, text_bytes
from staytide.llm.words import words_of

MIN_WORDS, MIN_REPEATS = 24, 3
RUN_SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_sha256 string"


def seed_lengths(longest: int, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int]]:
    """(k, lowest period) by scale: runs of periods from there to k match on their diagonal for k words at least.

    Such a run has max(min_words - q, (min_repeats - 1) * q) matching words, which is k or more for q from k/2 on (or 1 at the first
    scale) up to k. That takes three repeats.
    """
    if min_repeats < 3:
        raise ValueError("runs of fewer than three periods have no gram of a period's length for certain")
    first = min(max(min_words - q, (min_repeats - 1) * q) for q in range(1, min_words + 1))
    k, low, out = 1 << (first.bit_length() - 1), 1, []
    while low * min_repeats <= longest:
        out.append((k, low))
        low, k = k + 1, 2 * k
    return out


def _gram_hashes(total: np.ndarray, down: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return mix64((total[at + k] - total[at]) * down[at])


def runs_in(ids: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (doc, start, length, period), sorted; `ids`: numbers of the words, `first`: where each document begins, and the end."""
    n, sizes = len(ids), np.diff(first)
    none = np.empty((0, 4), np.int64)
    if not n:
        return none
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(mix64(ids.astype(U64) + U64(1)) * up[:n], out=total[1:])
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    last = first[1:][doc_of]
    at, found = np.arange(n), []
    for k, low in seed_lengths(int(sizes.max()), min_words, min_repeats):
        at = at[at + k <= last[at]]
        grams = _gram_hashes(total, down, at, k)
        order = np.argsort(grams ^ mix64(doc_of[at].astype(U64)), kind="stable")  # places stay in order
        at, grams = at[order], grams[order]
        same = (grams[1:] == grams[:-1]) & (doc_of[at[1:]] == doc_of[at[:-1]])
        here, lag = at[:-1][same], (at[1:] - at[:-1])[same]
        # a gram that occurs once begins no longer one that occurs twice
        twice = np.zeros(len(at), bool)
        twice[:-1] |= same
        twice[1:] |= same
        at = np.sort(at[twice])
        fits = (lag >= low) & (lag <= k)
        if fits.any():
            found.append(_extended(here[fits], lag[fits], k))
        if not len(at):
            break
    if not found:
        return none
    start, lag, end = np.concatenate(found, 1)
    length = end + lag - start
    long = length >= np.maximum(min_words, min_repeats * lag)
    start, length, lag = start[long], length[long], lag[long]
    exact = [np.array_equal(ids[s : s + m - q], ids[s + q : s + m]) for s, m, q in zip(start.tolist(), length.tolist(), lag.tolist())]
    if not all(exact):
        raise ArithmeticError("two different grams have one hash")
    doc = doc_of[start]
    out = np.stack([doc, start - first[doc], length, lag], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _extended(at: np.ndarray, lag: np.ndarray, k: int) -> np.ndarray:
    """start, lag and end of the matching stretches that the seeds lie in.

    In the order of lag and place, a seed begins an extension unless the furthest place covered by its lag has come to it. An extension
    goes on while the next word's gram matches too, and ends with the last gram.
    """
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(fresh)
    covered = np.append(begin[1:], len(at)) - 1  # the last seed of each extension
    return np.stack([at[begin], lag[begin], at[covered] + k])


def _word_ids(words: Words, flat: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, by their bytes."""
    sizes = words.end - words.start
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    inside = np.zeros(len(flat) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    data = flat[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return array.dictionary_encode().indices.to_numpy().astype(np.int64)


def _collapsed(words: Words, flat: np.ndarray, runs: np.ndarray) -> list[str]:
    """SHA-256 of each document's kept words joined by one space; a run's words after its first period are dropped."""
    n, n_docs = len(words.start), len(words.first) - 1
    begin = words.first[runs[:, 0]] + runs[:, 1]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin + runs[:, 3], 1)
    np.add.at(change, begin + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    # each kept word with the byte before it, which holds the space; a document's first word has none
    data = np.empty(len(flat) + 1, np.uint8)
    data[1:] = flat
    opens = words.doc[kept[1:]] == words.doc[kept[:-1]]
    leads = words.start[kept] + 1
    leads[1:] -= opens
    data[leads[1:][opens]] = 0x20
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, leads, 1)
    np.add.at(inside, words.end[kept] + 1, -1)
    joined = data[np.cumsum(inside[:-1]) > 0].tobytes()
    sizes = np.bincount(words.doc[kept], words.end[kept] + 1 - leads, n_docs).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [hashlib.sha256(joined[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]


def _run_batches(min_words: int, min_repeats: int):
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            flat, at = text_bytes(column(part, "text"))
            words = Words(flat, at, lower=False)
            runs = runs_in(_word_ids(words, flat), words.first, min_words, min_repeats)
            bounds = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(bounds), values).cast(kind)
            counts = pa.array(np.diff(words.first), pa.int64())
            yield pa.record_batch([column(part, "doc_id"), counts, lists, pa.array(_collapsed(words, flat, runs))], ["doc_id", "n_words", "runs", "collapsed_sha256"])

    return run


def runs_of(docs: DataFrame, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed_sha256 of each row."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_run_batches(min_words, min_repeats), RUN_SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """The run of greatest length in periods (smallest start, then period, among equal ones), and digests of all runs."""
    # equal ratios give equal doubles, and texts of less than 2**26 words cannot bring different ratios to one double
    ahead = "b.length / b.period > a.length / a.period OR (b.length / b.period = a.length / a.period AND (b.start, b.period) < (a.start, a.period))"
    best = F.expr(f"aggregate(runs, runs[0], (a, b) -> IF({ahead}, b, a))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    n = F.size("runs")
    one = found.withColumn("best", F.when(n > 0, best)).withColumn("n_runs", n.cast("bigint"))
    return one.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def exercised(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by the CRC of their id, repeat a stretch of their words to the end: doc_id, text.

    With h the CRC-32 of the decimal id, those with h % 10 = 0 and n > 0 words have, from word a = g % n on (g = h div 10), the words from a
    on over and over with period 1 + (n - a) div (3 + g % 8). A NULL id has no number, and its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words_of("text"))).withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    placed = words.withColumn("a", F.expr("IF(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(w, (x, i) -> IF(i < a, x, w[CAST(a + (i - a) % p AS INT)])), ' ')")
    return placed.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))
