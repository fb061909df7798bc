"""Toxicity of texts after noisy-channel deobfuscation.

A character trigram model is counted over all texts. A token with signs of disguise (digits or symbols between
letters, letters set apart one by one, letters repeated) becomes a lattice: each character stands for itself or for letters
it may replace, separators may vanish, a run may be one or two letters; letters set apart may also be several words. Viterbi
finds the most likely spelling under the channel and the model. A run of two counts as it stands, too. Other tokens are their own spelling.

The restored words, and their beginnings of four to six letters, are a text's features. Those that tell labelled classes apart
are chosen by chi-square, and a logistic regression weighs them. It learns from a bounded sample of the labelled rows;
the character model covers all rows.

Defined results: NULL and empty texts have no features and get the score of the intercept; rows without a usable
label are not learned from; with one class only, all scores are near that class, without any label 0. Repeated rows score alike.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.textarrays import LOWER, column, parts, text_bytes
from staytide.session import materialize

LABELLED_ROWS = 30_000
FEATURES = 2048
LEAST_ROWS = 4
# Letters that a sign may stand for, besides itself: fixed values.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¥": "y",
    "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SEPARATORS = frozenset(" .-_*~'`,/\\+|^")
EDGES = ".,;:!?\"'()[]{}<>«»„“”‚‘’…*#$%&|@~^_=+-/\\`"
# Costs in nats of the channel.
SUBSTITUTE, DROP, DOUBLE, SINGLE, BOUNDARY, FOREIGN = 0.4, 0.3, 1.2, 0.4, 0.3, 4.0
REMEMBERED_WORDS = 200_000
# Text symbols of the character model: a-z, a word's end, any other byte.
_END, _OTHER, _SIZE = 26, 27, 28
_CODE = np.full(256, _OTHER, np.int64)
_CODE[97:123] = np.arange(26)
_CODE[[0x20, *range(0x09, 0x0E)]] = _END
_APART = re.compile(r"(?<!\S)[^\s._*~/|-](?:[\s._*~/|-]{1,3}[^\s._*~/|-](?!\w)){2,}(?!\S)")
_RUN = re.compile(r"([^\W\d_])\1")


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE**3, np.int64)
    for part in parts(batches, "text", 8 << 20):
        flat, _ = text_bytes(column(part, "text"))
        code = _CODE[LOWER[flat]]
        # runs of white space and symbols count once; texts of a part follow each other
        if len(code) > 2:
            code = code[np.append(True, (code[1:] != code[:-1]) | (code[1:] < _END))]
            total += np.bincount((code[:-2] * _SIZE + code[1:-1]) * _SIZE + code[2:], minlength=_SIZE**3)
    yield pa.record_batch([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["key", "counts"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_py(), np.int64) for v in table["counts"])
    return pa.table({"key": table["key"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over the symbols, from the trigrams of all texts. The driver sees 28 ** 3 numbers."""
    sums = docs.select("text").mapInArrow(_trigrams, "key int, counts binary").groupBy("key").applyInArrow(_added, "key int, counts binary")
    found = sums.collect()
    counts = np.frombuffer(found[0]["counts"], np.int64).reshape(_SIZE, _SIZE, _SIZE).astype(float) if found else np.zeros((_SIZE,) * 3)
    pair = counts.sum(0)
    single = pair.sum(0)
    p1 = (single + 1) / (single.sum() + _SIZE)
    p2 = (pair + 20 * p1) / (pair.sum(1, keepdims=True) + 20)
    p3 = (counts + 20 * p2) / (counts.sum(2, keepdims=True) + 20)
    return np.log(p3)


def symbol(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else _OTHER


def suspicious(word: str) -> bool:
    """Whether a word may be in disguise: signs between its letters, or a letter twice in a row."""
    return any(c.isalpha() for c in word) and (not word.isalpha() or _RUN.search(word) is not None)


def signs_alone(word: str) -> bool:
    """Whether a word has no letter but may be one: different signs that stand for letters."""
    return len(word) > 2 and len(set(word)) > 1 and all(c in STANDS_FOR for c in word)


def decode(word: str, model: np.ndarray, single: bool = True, spaced: bool = False) -> str:
    """The most likely spelling of a word in lower case, by Viterbi over (last two symbols).

    A run of two may be one letter if `single`. If `spaced`, each character is a letter of its own and words may end after any.
    """
    # runs of one character are one step of the lattice
    steps: list[tuple[str, int]] = []
    for c in word:
        if steps and steps[-1][0] == c and not spaced:
            steps[-1] = (c, steps[-1][1] + 1)
        else:
            steps.append((c, 1))
    best: dict[tuple[int, int], tuple[float, tuple]] = {(_OTHER, _END): (0.0, ())}

    def put(states: dict, key: tuple[int, int], cost: float, path: tuple) -> None:
        if key not in states or cost < states[key][0]:
            states[key] = (cost, path)

    for c, n in steps:
        ahead: dict[tuple[int, int], tuple[float, tuple]] = {}
        is_letter = c.isalpha()
        options = [(c, 0.0)] if is_letter else [(x, SUBSTITUTE) for x in STANDS_FOR.get(c, "")]
        if not is_letter and (not options or c.isdigit()):
            options.append((c, FOREIGN))
        for (a, b), (cost, path) in best.items():
            if c in SEPARATORS:
                put(ahead, (a, b), cost + DROP, path)
            for letter, price in options:
                s = symbol(letter)
                one = cost + price - model[a, b, s]
                # three times or more is mostly one letter, sometimes two; twice mostly two, sometimes one
                if n != 2 or single:
                    put(ahead, (b, s), one + (SINGLE if n == 2 else 0.0), (path, letter))
                if spaced:
                    put(ahead, (s, _END), one - model[b, s, _END] + BOUNDARY, ((path, letter), " "))
                if n > 1:
                    put(ahead, (s, s), one - model[b, s, s] + (DOUBLE if n > 2 else 0.0), ((path, letter), letter))
        best = ahead
    if spaced:  # the last word ends once
        best = {k: v for k, v in best.items() if k[1] != _END} or best
    (a, b), (_, path) = min(best.items(), key=lambda x: (x[1][0] - model[x[0][0], x[0][1], _END], x[0]))
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


class Reader:
    """Restored words of texts; spellings are remembered up to a number of words."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self._known: dict[str, tuple[str, ...]] = {}

    def _restored(self, word: str, spaced: bool = False) -> tuple[str, ...]:
        key = " " + word if spaced else word
        out = self._known.get(key)
        if out is None:
            if spaced:
                out = tuple(decode(word, self.model, spaced=True).split())
            else:
                out = (decode(word, self.model),)
                if any(a == b for a, b in zip(word, word[1:])):
                    out += (decode(word, self.model, single=False),)
            if len(self._known) < REMEMBERED_WORDS:
                self._known[key] = out
        return out

    def words(self, text: str) -> set[str]:
        text = text.lower()
        out = set()
        for token in set(text.split()):
            if token.isalpha():
                if _RUN.search(token):
                    out.update(self._restored(token))
                out.add(token)
                continue
            word = token.strip(EDGES)
            if word.isalpha():
                out.add(word)
                if _RUN.search(word):
                    out.update(self._restored(word))
                # a sign at an edge may be a letter too
                if token[0] in STANDS_FOR or token[-1] in "$3":
                    out.update(self._restored(token.strip(".,;:?\"'()-")))
            elif suspicious(word):
                out.update(self._restored(word))
            elif signs_alone(bare := token.strip(".,;:?\"'()-")):
                out.update(self._restored(bare))
        for found in _APART.finditer(text):
            letters = "".join(c for c in found.group() if c not in SEPARATORS and not c.isspace())
            if len(set(letters)) > 1 and any(c.isalpha() for c in letters):
                out.update(self._restored(letters))
                out.update(self._restored(letters, spaced=True))
        out.discard("")
        return out

    def features(self, text: str) -> set[str]:
        words = self.words(text)
        out = {"=" + w for w in words}
        for n in (4, 5, 6):
            out.update(["^" + w[:n] for w in words if len(w) >= n])
        return out


def _labelled_features(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model)
        for part in parts(batches, "text"):
            lists = [sorted(read.features(t.as_py() or "")) for t in column(part, "text")]
            yield pa.record_batch([column(part, "doc_id"), column(part, "label"), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "label", "features"])

    return run


@dataclass
class Classifier:
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -50.0


def logistic_regression(rows: Sequence[Sequence[int]], labels: np.ndarray, size: int, ridge: float = 0.002, rounds: int = 1000) -> np.ndarray:
    """Weights of binary features, the intercept last, by accelerated gradients on the mean loss with a ridge."""
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    at = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(owner) else np.empty(0, np.int64)
    penalty = np.append(np.full(size, ridge / max(n, 1) * 50), 0.0)
    most = max((len(r) for r in rows), default=0) + 1
    step = 1.0 / (0.25 * most + penalty.max())
    w = ahead = np.zeros(size + 1)
    w[-1] = ahead[-1] = np.log((labels.mean() + 1e-9) / (1 - labels.mean() + 1e-9))
    t = 1.0
    for _ in range(rounds):
        z = np.bincount(owner, ahead[at], n) + ahead[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels
        gradient = np.append(np.bincount(at, error[owner], size), error.sum()) / n + penalty * ahead
        new = ahead - step * gradient
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def learn(docs: DataFrame, labels: DataFrame, usable: Column, model: np.ndarray, rows: int = LABELLED_ROWS, size: int = FEATURES) -> Classifier:
    """A classifier from at most `rows` labelled documents for which `usable` holds, the first by a hash of the id."""
    h = F.xxhash64(F.col("doc_id").cast("bigint"))
    some = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & usable)
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))
        .orderBy(h, "doc_id", "label")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    known = materialize(texts.select("doc_id", "label", "text").mapInArrow(_labelled_features(model), "doc_id bigint, label int, features array<string>"), "toxic-features")
    totals = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    n, p = totals["n"], totals["p"]
    if not 0 < p < n:
        return Classifier(intercept=50.0 if n and p == n else -50.0)
    seen = known.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("k"))
    a, k = F.col("a").cast("double"), F.col("k").cast("double")
    # chi-square of the 2 x 2 table
    chi = F.pow(a * n - k * p, F.lit(2.0)) / (k * p * (n - k + 1e-9) * (n - p)) * n
    # cues of toxic texts only: a text is not less toxic for a harmless word
    chosen = seen.filter((F.col("k") >= LEAST_ROWS) & (a * n > k * p)).withColumn("chi", chi).orderBy(F.col("chi").desc(), "feature").limit(size)
    names = sorted(r["feature"] for r in chosen.select("feature").collect())
    index = {f: i for i, f in enumerate(names)}
    wanted = F.array(*[F.lit(f) for f in names]) if names else F.array().cast("array<string>")
    bits = known.select("label", F.array_intersect("features", wanted).alias("features")).collect()
    # identical rows in a fixed order, so that sums do not depend on the order they arrive in
    bits = sorted((r["label"], sorted(index[f] for f in r["features"])) for r in bits)
    w = logistic_regression([r for _, r in bits], np.array([y for y, _ in bits], float), len(names))
    return Classifier({f: float(x) for f, x in zip(names, w)}, float(w[-1]))


def _scores(model: np.ndarray, classifier: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model)
        weights, intercept = classifier.weights, classifier.intercept
        for part in parts(batches, "text"):
            sums = [sum(sorted(weights[f] for f in read.features(t.as_py() or "") & weights.keys())) for t in column(part, "text")]
            score = 1 / (1 + np.exp(-np.clip(np.array(sums, float) + intercept, -60, 60)))
            yield pa.record_batch([column(part, "doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: np.ndarray, classifier: Classifier) -> DataFrame:
    """doc_id and score of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_scores(model, classifier), "doc_id bigint, score double")
