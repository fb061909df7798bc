"""Packing documents into sequences: patterns of few documents, fitted to the histogram of lengths.

Documents become token ids and an end mark; longer ones are cut. What is packed is the histogram of piece lengths, whose
size depends on the sequence length alone. Patterns are sets of one to three lengths that fill a
sequence; non-negative least squares finds how often to use each so that the lengths used come close to the histogram.
The counts are rounded, never beyond what is there, and the residual lengths are packed best-fit, longest
first. Pieces then find their places by rank: the k-th piece of a length takes the k-th place that the
patterns hold for that length. Ranks go over chunks, so no task holds all pieces of a length.

Token ids are those of the byte-level BPE file of the public tokenizers. Words seen before are looked up, and others go
through the same vocabulary's merge ranks. The file's added tokens (an end-of-text mark) are found in the text first, and what is
between them is encoded. A test holds all of it against the `tokenizers` library.

Defined results: NULL and empty texts are the end mark alone; rows with a NULL id and repeated rows are
packed like any other. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staytide.llm.textarrays import column
from staytide.session import materialize

SEQUENCE_TOKENS = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
# Words that a task remembers the ids of.
REMEMBERED_WORDS = 300_000
# The second length of a pattern of three is a multiple of this.
TRIPLE_STEP = 64
RANK_CHUNKS = 256

PIECES_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Token ids of a text, as the bytes of little-endian unsigned 32-bit numbers.

    A space in front of a word always begins a new piece of the vocabulary's pattern, so a text
    splits there, and the ids of its parts follow each other. Runs of white space are left to the library. Added tokens of
    the tokenizer's file split the text before that.
    """

    def __init__(self, vocabulary: str = VOCABULARY, remember: int = REMEMBERED_WORDS):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("text", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode = bpe.encode_ordinary
        with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
            added = {t["content"]: t for t in json.load(f).get("added_tokens", [])}
        self._added = {c: np.array([t["id"]], "<u4").tobytes() for c, t in added.items()}
        # longer ones first; some take the white space beside them
        marks = [
            (r"\s*" if added[c].get("lstrip") else "") + f"({re.escape(c)})" + (r"\s*" if added[c].get("rstrip") else "")
            for c in sorted(added, key=lambda c: (-len(c), c))
        ]
        self._marks = re.compile("|".join(marks)) if marks else None
        self._known: dict[str, bytes] = {}
        self._remember = remember

    def _ids(self, text: str) -> bytes:
        return np.asarray(self._encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self._marks is None or not any(c in text for c in self._added):
            return self._plain(text)
        out, at = [], 0
        for found in self._marks.finditer(text):
            out += [self._plain(text[at : found.start()]), self._added[found.group(found.lastindex)]]
            at = found.end()
        return b"".join(out) + self._plain(text[at:])

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        words = text.split(" ")
        if "" in words[1:] or "\t" in text or "\r" in text or not text.isprintable() and _odd_space(text):
            return self._ids(text)
        known, out = self._known, []
        for i, word in enumerate(words):
            part = " " + word if i else word
            ids = known.get(part)
            if ids is None:
                ids = self._ids(part)
                if len(known) < self._remember:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)


def _odd_space(text: str) -> bool:
    """Whether the text holds white space other than single spaces and line feeds, or both side by side."""
    return " \n" in text or "\n " in text or any(c.isspace() and c not in " \n" for c in set(text))


def _cut(sequence: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text")):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                # the first piece takes what is over, all others are full
                begin, piece, size = 0, 0, (n - 1) % sequence + 1
                while begin < n:
                    for out, value in zip(rows, (doc_id, piece, begin, size, zlib.crc32(ids[4 * begin : 4 * (begin + size)]))):
                        out.append(value)
                    begin, piece, size = begin + size, piece + 1, sequence
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, sequence: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32."""
    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return some.mapInArrow(_cut(sequence, end_id), PIECES_SCHEMA)


def patterns(sequence: int, step: int = TRIPLE_STEP) -> np.ndarray:
    """Sets of one, two and three lengths that sum to the sequence, falling, padded with zeros."""
    one = np.array([[sequence, 0, 0]])
    b = np.arange(1, sequence // 2 + 1)
    two = np.stack([sequence - b, b, np.zeros_like(b)], 1)
    second = np.arange(step, sequence // 2 + 1, step)
    third = np.arange(1, sequence // 3 + 1)
    s, t = (x.ravel() for x in np.meshgrid(second, third, indexing="ij"))
    three = np.stack([sequence - s - t, s, t], 1)
    three = three[(three[:, 0] >= three[:, 1]) & (three[:, 1] >= three[:, 2])]
    return np.concatenate([one, two, three])


def fit_counts(histogram: np.ndarray, sets: np.ndarray, rounds: int = 300) -> np.ndarray:
    """How often to use each set: non-negative least squares by accelerated projected gradients.

    The error of a length weighs by the length, since long pieces are harder to place later.
    """
    size = len(histogram)
    weight = np.sqrt(np.arange(size) / size)
    weight[0] = 0.0
    target = weight * histogram

    def used(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(sets[:, j], x, size) for j in range(sets.shape[1]))

    def back(error: np.ndarray) -> np.ndarray:
        e = weight * error
        return sum(e[sets[:, j]] for j in range(sets.shape[1]))

    # the largest eigenvalue, by power iteration
    v = np.ones(len(sets))
    for _ in range(30):
        v = back(used(v))
        scale = np.linalg.norm(v)
        v /= scale
    step = 1.0 / (1.05 * scale)
    x = y = np.zeros(len(sets))
    t = 1.0
    for _ in range(rounds):
        ahead = np.maximum(y - step * back(used(y) - target), 0.0)
        t_ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = ahead + (t - 1) / t_ahead * (ahead - x)
        x, t = ahead, t_ahead
    return x


def plan(histogram: np.ndarray, step: int = TRIPLE_STEP) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many): every piece of the histogram is in exactly one. Index: length."""
    sequence = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[sequence]:
        out.append(((sequence,), int(left[sequence])))
        left[sequence] = 0
    if not left.any():
        return out
    sets = patterns(sequence, step)[1:]
    sets = sets[((sets == 0) | (left[sets] > 0)).all(1)]
    if len(sets):
        times = fit_counts(left, sets)
        for k in np.argsort(-times, kind="stable").tolist():
            if times[k] < 0.05:
                break
            lengths = tuple(int(n) for n in sets[k] if n)
            there = min(left[n] // lengths.count(n) for n in lengths)
            n = int(min(there, np.ceil(times[k] - 0.25)))
            if n > 0:
                out.append((lengths, n))
                for length in lengths:
                    left[length] -= n
    return out + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit, longest first, of a whole histogram: sequences in the same state are handled together."""
    sequence = len(left) - 1
    open_by_space: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    spaces = np.zeros(sequence + 1, np.int64)  # open sequences by what still fits
    for length in range(sequence, 0, -1):
        todo = int(left[length])
        while todo:
            room = np.flatnonzero(spaces[length:])
            if len(room):
                space = int(room[0]) + length
                held, n = open_by_space[space].pop()
                take = min(todo, n)
                if n > take:
                    open_by_space[space].append((held, n - take))
            else:
                space, held = sequence, ()
                take = max(1, todo // (sequence // length))
            spaces[space] -= take if held else 0
            open_by_space[space - length].append((held + (length,), take))
            spaces[space - length] += take
            todo -= take
    return [group for groups in open_by_space.values() for group in groups]


def places(groups: list[tuple[tuple[int, ...], int]], sequence: int) -> dict[str, np.ndarray]:
    """The places of the plan by (length, rank): runs of `many` places of one length in sequences that follow each other."""
    runs = []
    first_sequence = 0
    for lengths, n in groups:
        at = 0
        for length in lengths:
            runs.append((length, n, first_sequence, at))
            at += length
        first_sequence += n
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    begins = np.cumsum(table[:, 1]) - table[:, 1]
    before = np.zeros(sequence + 2, np.int64)
    np.add.at(before, table[:, 0] + 1, table[:, 1])
    return {"begin": begins, "sequence": table[:, 2], "offset": table[:, 3], "before": np.cumsum(before)}


def _placed(where: dict[str, np.ndarray]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            at = where["before"][rows["length"].to_numpy()] + rows["p_rank"].to_numpy()
            k = np.searchsorted(where["begin"], at, "right") - 1
            rows["sequence_id"] = where["sequence"][k] + at - where["begin"][k]
            rows["offset"] = where["offset"][k]
            yield rows.drop(columns="p_rank")

    return run


def pack(cut: DataFrame, sequence: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces. The driver sees the histogram: one row per length."""
    cut = materialize(
        cut.withColumn("p_chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_CHUNKS)).cast("int")), "pieces"
    )
    per_chunk = materialize(cut.groupBy("length", "p_chunk").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(sequence + 1, np.int64)
    for row in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    where = places(plan(histogram), sequence)
    earlier = Window.partitionBy("length").orderBy("p_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.select("length", "p_chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("p_before"))
    own = F.row_number().over(Window.partitionBy("length", "p_chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("p_own", own).join(starts, ["length", "p_chunk"]).withColumn("p_rank", F.col("p_own") + F.col("p_before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "p_rank").mapInPandas(_placed(where), PIECES_SCHEMA + ", sequence_id bigint, offset bigint")


def packed(docs: DataFrame, sequence: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(docs, sequence, end_id), sequence)
