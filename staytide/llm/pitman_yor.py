"""A hierarchical Pitman-Yor model of words, its seating sampled by Gibbs, and the scores of documents under it.

Each context is a restaurant whose dishes are words; a context is the word before, hashed into restaurants whose number grows with
the text, so that the rare ones share theirs. All of them have the unigram restaurant as parent, which has the even distribution over the
training vocabulary and one unknown word as its base. A restaurant's customers are its words' occurrences; its
tables are customers of the parent.

The sampler takes all customers of one dish out of a restaurant and seats them anew, one by one, at an old table or a
new one, given the tables of the last sweep elsewhere. A state is a seating of the contexts and, drawn for it, one of the
parent; scores use that very draw, so the probabilities of all words and the unknown one sum to one. They are averaged over
the states after the burn-in, which drops the start and a sweep.

On Spark: occurrences (word, context, document) are dealt into buckets by word, those of hot words by word and context, as
compressed columns. A bucket holds all that its words need; what buckets must know of each other is two vectors over the
contexts, the counts of the hot words, and a few totals, which go out with each sweep. Sweeps read the counts alone;
a later sweep repeats the earlier ones of its bucket with the same random numbers, so no seating is stored.

Defined results: NULL and empty texts are the end token alone; a NULL id counts as an empty one for the split;
repeated rows are documents of their own. Without training documents every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.textarrays import U64, Words, column, mix64, pack_planes, parts, text_bytes, unpack_planes
from staytide.session import materialize

# Bits of a restaurant's number, least and most, and the words of text that it has on average between these.
CONTEXT_BITS, WORDS_PER_CONTEXT = (17, 26), 1024
BURN_IN, SAMPLES = 2, 2
TOKENS_PER_BUCKET = 4_000_000
# Words of a larger share than this are hot, or than an eighth of a bucket.
LEAST_HOT_SHARE = 1e-5
CONCENTRATION = (1.0, 1.0)  # of the unigram restaurant, of the contexts
END = int(mix64(np.array([1], U64))[0])
START = int(mix64(np.array([2], U64))[0])
_CHUNK = 8192
_HASHED_BYTES = 1 << 19  # of text at a time: hashing takes some 40 times their size


def context_bits(size: int) -> int:
    """Bits of a context's number for so many bytes of text."""
    least, most = CONTEXT_BITS
    return min(max((size // 6 // WORDS_PER_CONTEXT).bit_length(), least), most)


def _words(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and their number per row."""
    words = Words(*text_bytes(column(piece, "text")))
    return words.hash, np.diff(words.first)


def tokens(part: pa.RecordBatch, bits: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: hash of the word or the end, its context, its row; documents one after the other."""
    hashes, n_words = zip(*(_words(piece) for piece in parts(iter([part]), "text", _HASHED_BYTES)))
    n_words = np.concatenate(n_words)
    row = np.repeat(np.arange(part.num_rows), n_words + 1)
    token = np.full(len(row), END, U64)
    ends = np.cumsum(n_words + 1) - 1
    is_word = np.ones(len(row), bool)
    is_word[ends] = False
    token[is_word] = np.concatenate(hashes)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.append(0, ends[:-1] + 1)] = START
    return token, (mix64(before) & U64((1 << bits) - 1)).astype(np.int64), row


def _frequent(share: float):
    """(word, n) of the words above the share in some part, and (NULL, n) with all tokens, of training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            token, _, row = tokens(part)
            train = column(part, "train").to_numpy(zero_copy_only=False)
            word, n = np.unique(token[train[row]], return_counts=True)
            often = n >= share * max(len(token), 1)
            total = int(n.sum())
            yield pa.record_batch(
                [pa.array([None, *word[often].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[often].tolist()], pa.int64())],
                ["word", "n"],
            )

    return run


OCCURRENCES = "bucket bigint, part bigint, n int, n_words int, words binary, sizes binary, contexts binary, rows binary, times binary"


def _deal(buckets: int, hot: np.ndarray, context_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = context.partitionId() << 24 if context else 0
        for k, part in enumerate(parts(batches, "text")):
            token, before, row = tokens(part, context_bits)
            train = column(part, "train").to_numpy(zero_copy_only=False)
            n_tokens = np.bincount(row, minlength=part.num_rows)
            row = row * 2 + train[row]  # the last bit says whether the row trains
            word, code = np.unique(token, return_inverse=True)
            # one number per occurrence, whose order is that of word, context and row
            row_bits = (2 * part.num_rows).bit_length()
            packed = np.sort((code.astype(np.int64) << (context_bits + row_bits)) | (before << row_bits) | row)
            fresh = np.append(True, packed[1:] != packed[:-1])
            times = np.diff(np.append(np.flatnonzero(fresh), len(packed)))
            packed = packed[fresh]
            row = packed & ((1 << row_bits) - 1)
            before = (packed >> row_bits) & ((1 << context_bits) - 1)
            code = packed >> (context_bits + row_bits)
            own = word[code]
            is_hot = np.isin(word, hot)[code]
            key = np.where(is_hot, mix64(own + before.astype(U64) * U64(0x9E3779B97F4A7C15)), own)
            bucket = (key % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint32), kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            part_id = number + k
            out = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                o = order[cuts[b] : cuts[b + 1]]
                first = np.append(True, code[o][1:] != code[o][:-1])
                sizes = np.diff(np.append(np.flatnonzero(first), len(o)))
                out.append(
                    (
                        b,
                        part_id,
                        len(o),
                        len(sizes),
                        pack_planes(own[o][first]),
                        pack_planes(sizes.astype(np.uint32)),
                        pack_planes(before[o].astype(np.uint32)),
                        pack_planes(row[o].astype(np.uint32)),
                        pack_planes(times[o].astype(np.uint32)),
                    )
                )
            ids = column(part, "doc_id").cast(pa.int64())
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            facts = pa.table({"id": ids.fill_null(0), "known": known, "train": train, "n": n_tokens})
            columns = [facts[c].to_numpy().astype(np.int64) for c in facts.column_names]
            out.append((-1 - part_id, part_id, len(ids), 4, np.stack(columns).tobytes(), b"", b"", b"", b""))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], _NAMES)

    return run


_NAMES = [x.split()[0] for x in OCCURRENCES.split(", ")]
_KINDS = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in OCCURRENCES.split(", ")]
BUCKETS = (
    "bucket bigint, n_words int, n_pairs int, n int, words binary, sizes binary, contexts binary, counts binary, "
    "members binary, parts binary, part_sizes binary, rows binary, times binary"
)


def _unpacked(blobs: pa.ChunkedArray, sizes: np.ndarray, kind) -> np.ndarray:
    """The packed numbers of all parts as one array."""
    out = np.empty(int(sizes.sum()), kind)
    ends = np.cumsum(sizes).tolist()
    for blob, n, end in zip(blobs, sizes.tolist(), ends):
        out[end - n : end] = unpack_planes(blob.as_py(), n, kind)
    return out


def _bucket(table: pa.Table) -> pa.Table:
    """All occurrences of a bucket as one row: words, their contexts with training counts, and their documents.

    One column at a time is unpacked and put in order, so that a bucket never lies whole and unpacked in a task.
    """
    bucket = table["bucket"][0].as_py()
    names = [x.split()[0] for x in BUCKETS.split(", ")]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in BUCKETS.split(", ")]
    if bucket < 0:
        values = (bucket, 4, 0, table["n"][0].as_py(), table["words"][0].as_py(), *[b""] * 8)
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names)
    of_part, words_of_part = table["n"].to_numpy(), table["n_words"].to_numpy()
    n = int(of_part.sum())
    words, code = np.unique(_unpacked(table["words"], words_of_part, U64), return_inverse=True)
    pair = np.repeat(code << CONTEXT_BITS[1], _unpacked(table["sizes"], words_of_part, np.uint32))
    del code
    pair += _unpacked(table["contexts"], of_part, np.uint32)
    order = np.argsort(pair, kind="stable").astype(np.uint32)
    pair = pair[order]
    at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])).astype(np.uint32)
    pair = pair[at]
    sizes = np.bincount(pair >> CONTEXT_BITS[1], minlength=len(words)).astype(np.uint32)
    contexts = pack_planes((pair & ((1 << CONTEXT_BITS[1]) - 1)).astype(np.uint32))
    del pair
    row = _unpacked(table["rows"], of_part, np.uint32)[order]
    rows = pack_planes(row >> 1)
    times = _unpacked(table["times"], of_part, np.uint32)[order]
    row &= 1
    row *= times
    counts = pack_planes(np.add.reduceat(row, at).astype(np.uint32))
    del row
    packed_times = pack_planes(times)
    del times
    values = (
        bucket,
        len(words),
        len(at),
        n,
        pack_planes(words),
        pack_planes(sizes),
        contexts,
        counts,
        pack_planes(np.diff(np.append(at, np.uint32(n)))),
        table["part"].to_numpy().astype(np.int64).tobytes(),
        pack_planes(np.repeat(np.arange(len(of_part), dtype=np.uint32), of_part)[order]),
        rows,
        packed_times,
    )
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names)


class _Sent:
    """Goes to the tasks with its vectors over the contexts compressed, as the sent bytes stay in a worker's memory beside the model."""

    def __getstate__(self) -> dict:
        vectors = {k: v for k, v in vars(self).items() if k.startswith("context_")}
        return vars(self) | {k: (pack_planes(v), len(v), v.dtype) for k, v in vectors.items()}

    def __setstate__(self, sent: dict) -> None:
        vars(self).update({k: unpack_planes(*v) if k.startswith("context_") else v for k, v in sent.items()})


@dataclass
class State(_Sent):
    """What buckets must know of each other's seating: tables by context, and the parent's customers and tables."""

    context_tables: np.ndarray
    tables: int  # of all contexts: the customers of the unigram restaurant
    parent_tables: int
    hot_tables: np.ndarray
    hot_parent: np.ndarray  # the hot words' tables in the parent


@dataclass
class Model(_Sent):
    buckets: int
    hot: np.ndarray
    contexts: int
    discounts: tuple[float, float] = (0.8, 0.8)
    vocabulary: int = 0
    train_tokens: int = 0
    context_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    hot_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    states: list[State] = field(default_factory=list)

    def parent_seating(self, customers: np.ndarray, k: int, seed: list[int]) -> np.ndarray:
        """Tables of the parent for the words' customers in state k: one per word at the start, else a draw given the state before."""
        if k == 0:
            return (customers > 0).astype(np.int64)
        before = max(self.states[k - 1].parent_tables, 1)
        opening = (CONCENTRATION[0] + self.discounts[0] * before) / (self.vocabulary + 1)
        return seat(customers, np.full(len(customers), opening), self.discounts[0], np.random.default_rng([k, *seed]))


def seat(customers: np.ndarray, new_table: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that the customers of one dish take, one restaurant per entry, seated one by one.

    The n-th customer opens a table with weight `new_table` against n - discount * tables for the old ones.
    From the 64th on, a 32nd of those seated come at a time, all with the chance of the first of them.
    """
    tables = (customers > 0).astype(np.int64)
    order = np.flatnonzero(customers > 1)  # one customer alone has nothing to choose
    order = order[np.argsort(-customers[order], kind="stable")]
    c, a = customers[order], new_table[order]
    t, fewest_first = tables[order], -c
    n = 1
    while True:
        live = int(np.searchsorted(fewest_first, -n, "left"))  # entries with more than n customers
        if not live:
            break
        chance = a[:live] / (a[:live] + n - discount * t[:live])
        if n < 64:
            t[:live] += rng.random(live) < chance
            n += 1
        else:
            many = np.minimum(n // 32, c[:live] - n)
            t[:live] += rng.binomial(many, chance)
            n += n // 32
    tables[order] = t
    return tables


class Bucket:
    """Words of one bucket, their contexts and training counts."""

    def __init__(self, row: dict, model: Model):
        self.model = model
        self.bucket, k, n = row["bucket"], row["n_words"], row["n_pairs"]
        self.words = unpack_planes(row["words"], k, U64)
        self.owner = np.repeat(np.arange(k, dtype=np.int32), unpack_planes(row["sizes"], k, np.uint32))
        self.context = unpack_planes(row["contexts"], n, np.uint32).astype(np.int32)
        self.count = unpack_planes(row["counts"], n, np.uint32).astype(np.int64)
        self.many = np.flatnonzero(self.count > 1).astype(np.int32)  # pairs whose number of tables is drawn
        at = np.minimum(np.searchsorted(model.hot, self.words), max(len(model.hot) - 1, 0))
        self.is_hot = model.hot[at] == self.words if len(model.hot) else np.zeros(k, bool)
        self.hot_at = at[self.is_hot]

    def whole(self, per_word: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Word totals, with those of hot words, of which a bucket has a share only, from the shared state."""
        out = per_word.copy()
        out[self.is_hot] = hot[self.hot_at]
        return out

    def of_words(self, per_pair: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, per_pair, len(self.words)).astype(np.int64)

    def parent_tables(self, word_tables: np.ndarray, k: int) -> np.ndarray:
        """Of the bucket's cold words in state k."""
        cold = ~self.is_hot
        parent = np.zeros(len(self.words), np.int64)
        parent[cold] = self.model.parent_seating(word_tables[cold], k, [1, self.bucket])
        return parent

    def sweeps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tables per pair, customers and tables of each word in the parent, in each known state; `last` is the seating after them."""
        m = self.model
        pair_tables = (self.count > 0).astype(np.int64)
        d2 = m.discounts[1]
        for k, state in enumerate(m.states):
            own = self.of_words(pair_tables)
            word_tables = self.whole(own, state.hot_tables)
            parent = self.whole(self.parent_tables(own, k), state.hot_parent)
            yield pair_tables, word_tables, parent
            p = self.parent_probability(word_tables, parent, state)
            many = self.many
            weight = (CONCENTRATION[1] + d2 * state.context_tables[self.context[many]]) * p[self.owner[many]]
            pair_tables = pair_tables.copy()
            pair_tables[many] = seat(self.count[many], weight, d2, np.random.default_rng([k, 3, self.bucket]))
        self.last = pair_tables

    def parent_probability(self, word_tables: np.ndarray, parent: np.ndarray, state: State) -> np.ndarray:
        m, d1 = self.model, self.model.discounts[0]
        rest = (CONCENTRATION[0] + d1 * state.parent_tables) / (m.vocabulary + 1)
        return (np.maximum(word_tables - d1 * parent, 0) + rest) / (CONCENTRATION[0] + state.tables)

    def probability(self, pair_tables: np.ndarray, p: np.ndarray, state: State) -> np.ndarray:
        """Of each pair: the word after its context."""
        d2, c = self.model.discounts[1], self.model.context_counts[self.context]
        back = (CONCENTRATION[1] + d2 * state.context_tables[self.context]) * p[self.owner]
        return (np.maximum(self.count - d2 * pair_tables, 0) + back) / (CONCENTRATION[1] + c)


def _vectors(key_values: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([k for k, _ in key_values], pa.int64()), pa.array([pack_planes(np.asarray(v, np.int64)) for _, v in key_values], pa.binary())],
        ["key", "vector"],
    )


def _added(table: pa.Table) -> pa.Table:
    import zstandard

    total = 0
    for v in table["vector"]:
        packed = v.as_py()
        total = total + unpack_planes(packed, zstandard.frame_content_size(packed) // 8, np.int64)
    return pa.table({"key": table["key"][:1], "vector": pa.array([total.tobytes()], pa.binary())})


_TOTALS, _HOT_COUNTS, _HOT_TABLES, _COUNTS, _TABLES = 1, 2, 3, 1 << 20, 1 << 21


def _in_chunks(base: int, vector: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(base + i // _CHUNK, vector[i : i + _CHUNK]) for i in range(0, len(vector), _CHUNK)]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time: a row is a whole bucket."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _sweep(model: Model):
    """Totals of a bucket after the sweeps so far; with no state yet, the counts and one table per pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield _vectors(_sums_of(row, model))

    return run


def _sums_of(row: dict, model: Model) -> list[tuple[int, np.ndarray]]:
    b = Bucket(row, model)
    for _ in b.sweeps():
        pass
    tables = b.last
    word_tables, word_counts = b.of_words(tables), b.of_words(b.count)
    cold = ~b.is_hot
    parent = b.parent_tables(word_tables, len(model.states))
    hot_tables = np.bincount(b.hot_at, word_tables[b.is_hot], len(model.hot))
    hot_counts = np.bincount(b.hot_at, word_counts[b.is_hot], len(model.hot))
    totals = [
        tables.sum(),
        parent[cold].sum(),
        (word_counts[cold] > 0).sum(),
        b.count.sum(),
        *[(b.count == k).sum() for k in (1, 2)],
        *[(word_tables[cold] == k).sum() for k in (1, 2)],
    ]
    out = [(_TOTALS, np.array(totals)), (_HOT_TABLES, hot_tables)]
    out += _in_chunks(_TABLES, np.bincount(b.context, tables, model.contexts))
    if not model.states:
        out += [(_HOT_COUNTS, hot_counts), *_in_chunks(_COUNTS, np.bincount(b.context, b.count, model.contexts))]
    return out


def _totals(occurrences: DataFrame, model: Model) -> dict[int, np.ndarray]:
    """The sums over buckets. Their size depends on the number of contexts and hot words alone."""
    counts = occurrences.filter("bucket >= 0").select("bucket", "n_words", "n_pairs", "words", "sizes", "contexts", "counts")
    sums = counts.mapInArrow(_sweep(model), "key bigint, vector binary").groupBy("key").applyInArrow(_added, "key bigint, vector binary")
    return {r["key"]: np.frombuffer(r["vector"], np.int64) for r in sums.collect()}


def _joined(found: dict[int, np.ndarray], base: int, contexts: int) -> np.ndarray:
    if not any(base <= k < base + contexts // _CHUNK for k in found):
        return np.zeros(contexts, np.int32)
    whole = np.concatenate([found.get(base + i, np.zeros(_CHUNK, np.int64)) for i in range(contexts // _CHUNK)])
    return whole.astype(np.int32) if whole.max() < 1 << 31 else whole


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5


def fit(occurrences: DataFrame, model: Model, sweeps: int = BURN_IN + SAMPLES) -> Model:
    """Counts, discounts from the counts of counts, and the states of the sweeps."""
    for k in range(sweeps):
        found = _totals(occurrences, model)
        totals = found.get(_TOTALS, np.zeros(8, np.int64))
        none = np.zeros(len(model.hot), np.int64)
        hot_tables = found.get(_HOT_TABLES, none)
        if k == 0:
            model.hot_counts = found.get(_HOT_COUNTS, none)
            model.context_counts = _joined(found, _COUNTS, model.contexts)
            model.vocabulary = int(totals[2] + (model.hot_counts > 0).sum())
            model.train_tokens = int(totals[3])
            model.discounts = (_discount(*totals[6:8].tolist()), _discount(*totals[4:6].tolist()))
        hot_parent = model.parent_seating(hot_tables, k, [2])
        tables = _joined(found, _TABLES, model.contexts)
        model.states.append(State(tables, int(totals[0]), int(totals[1] + hot_parent.sum()), hot_tables, hot_parent))
    return model


SCORES = "part bigint, n int, sums binary"


def _score(model: Model, burn_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            for row in _rows(batch):
                out = [(-1 - row["bucket"], -row["n"], row["words"])] if row["bucket"] < 0 else _scores_of(row, model, burn_in)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "n", "sums"])

    return run


def _scores_of(row: dict, model: Model, burn_in: int) -> list[tuple[int, int, bytes]]:
    """Per part: its number of documents that have words of this bucket, and what these words add to each."""
    b = Bucket(row, model)
    chance, samples = np.zeros(len(b.owner)), 0
    # the range comes first: it ends before the sweep after the last state, which nothing reads
    for k, (tables, word_tables, parent) in zip(range(len(model.states)), b.sweeps()):
        if k >= burn_in:
            p = b.parent_probability(word_tables, parent, model.states[k])
            chance += b.probability(tables, p, model.states[k])
            samples += 1
    del tables
    log_chance = np.log10(chance / samples)
    del chance
    count = b.whole(b.of_words(b.count), model.hot_counts)
    log_count = np.log10(count + 1.0)
    owner = b.owner
    del b
    n, part_ids = row["n"], np.frombuffer(row["parts"], np.int64)
    part = unpack_planes(row["part_sizes"], n, np.uint32)
    cuts = np.append(0, np.cumsum(np.bincount(part, minlength=len(part_ids))))
    # by part and place: sorted as one number, which takes less memory than a stable order
    order = part.astype(np.int64) << 32
    del part
    order |= np.arange(n, dtype=np.uint32)
    order.sort()
    order = order.astype(np.uint32)
    pair = np.repeat(np.arange(len(owner), dtype=np.int32), unpack_planes(row["members"], row["n_pairs"], np.uint32))
    doc, times = unpack_planes(row["rows"], n, np.uint32), unpack_planes(row["times"], n, np.uint32)
    out = []
    for i, part_id in enumerate(part_ids.tolist()):
        o = order[cuts[i] : cuts[i + 1]]
        own, who, often = pair[o], doc[o], times[o]
        word = owner[own]
        sums = np.stack([np.bincount(who, often * x) for x in (log_chance[own], log_count[word], (count[word] > 0).astype(float))])
        here = np.flatnonzero(np.bincount(who))  # only the documents that have words of this bucket
        out.append((part_id, len(here), here.astype(np.int32).tobytes() + sums[:, here].tobytes()))
    return out


def _scored(train_tokens: int, vocabulary: int):
    def run(table: pa.Table) -> pa.Table:
        got = list(zip(table["n"].to_pylist(), table["sums"].to_pylist()))
        ids, known, train, n_tokens = next(np.frombuffer(s, np.int64).reshape(4, -1) for n, s in got if n < 0)
        total = np.zeros((3, len(ids)))
        for n, s in got:
            if n > 0:
                total[:, np.frombuffer(s, np.int32, n)] += np.frombuffer(s[4 * n :]).reshape(3, n)
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=known == 0),
                "held_out": train == 0,
                "n_tokens": n_tokens,
                "n_known": np.rint(total[2]).astype(np.int64),
                "train_tokens": np.full(len(ids), train_tokens),
                "base_score": total[1] - n_tokens * np.log10(train_tokens + vocabulary + 1.0),
                "score": total[0],
            }
        )

    return run


def learn(docs: DataFrame, train: Column, sweeps: int = BURN_IN + SAMPLES) -> tuple[DataFrame, Model]:
    """All occurrences by bucket, as a written table, and the model of the documents where `train` holds."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = int(size / 6 / TOKENS_PER_BUCKET) + 1
    share = max(1 / (8 * buckets), LEAST_HOT_SHARE)
    often = rows.mapInArrow(_frequent(share), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    often = materialize(often, "frequent-words")
    n = often.filter("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = [r["word"] for r in often.filter(F.col("word").isNotNull() & (F.col("n") >= share * n / 2)).select("word").collect()]
    bits = context_bits(size)
    model = Model(buckets, np.sort(np.array(hot, np.int64).view(U64)), 1 << bits)
    dealt = rows.mapInArrow(_deal(buckets, model.hot, bits), OCCURRENCES).groupBy("bucket").applyInArrow(_bucket, BUCKETS)
    occurrences = materialize(dealt, "occurrences")
    return occurrences, fit(occurrences, model, sweeps)


def score_documents(docs: DataFrame, train: Column, sweeps: tuple[int, int] = (BURN_IN, SAMPLES)) -> DataFrame:
    """Scores of all documents under the model of those where `train` holds. Columns as in the query."""
    occurrences, model = learn(docs, train, sum(sweeps))
    partial = occurrences.mapInArrow(_score(model, sweeps[0]), SCORES)
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return partial.groupBy("part").applyInArrow(_scored(model.train_tokens, model.vocabulary), schema)
