"""Near-duplicate documents by Order MinHash, checked by banded alignment.

A document's shingles (five words) are labelled with their occurrence, so that the second equal shingle differs
from the first. A sketch takes the few labelled shingles of smallest hash and keeps them in the order of the text; documents
with many shingles in the same order agree in many sketches. All documents that share a sketch are compared, if enough
of their sketches agree: pair by pair in a small bucket; in a large one blocks meet block by block, which sends counts of links, never the pairs,
and a very large one is split by a second sketch before. A pair belongs to the first sketches in which it agrees, so it counts once.
A pair is a link if the alignment of the two shingle sequences, within the band that the threshold allows, matches at least
0.8 of all shingles: matched / (n_a + n_b - matched).

Two documents with the same words in the same order are one class; only the class's first id goes on. Then
links join classes into groups, whose first id stays.

Defined results: words compare without regard to the case of A-Z. NULL and empty texts have no words, and
are alike; a text of fewer than five words has one shingle of all its words. Rows with a NULL id are kept and
belong to no group. Repeated rows of one id are one document. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staytide.llm.components import components
from staytide.llm.textarrays import U64, Words, column, mix64, parts, text_bytes
from staytide.session import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SKETCHES = 12
SKETCH_SIZE = 2
# Sketches of two documents that must agree before they are compared: at similarity 0.8 about
# 0.64 of them agree, so fewer than two of twelve do once in 10,000 times.
SHARED_SKETCHES = 2
# Members of a bucket up to which its pairs are rows, and up to which it is not split by a second sketch; what a block
# of a larger one holds at most on average.
PAIR_MEMBERS, SPLIT_MEMBERS = 12, 8192
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1_000_000
# Shingles that the documents sent to one task hold, about.
TASK_SHINGLES = 3_000_000
_SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))

SKETCH_SCHEMA = "doc_id bigint, n_shingles bigint, content binary, sketches array<bigint>"


def occurrence_labelled(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shingle hashes in which the k-th equal one of a document differs from the others."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((shingles, owner))
    s, o = shingles[order], owner[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    nth = np.empty(len(s), U64)
    nth[order] = (np.arange(len(s)) - run_start).astype(U64)
    return np.where(nth == 0, shingles, mix64(shingles + nth * U64(0x9E3779B97F4A7C15)))


def sketch(labelled: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SKETCHES numbers per document that has shingles (rows in order of those documents)."""
    has = np.diff(at) > 0
    starts, sizes = at[:-1][has], np.diff(at)[has]
    out = np.empty((len(starts), SKETCHES), np.int64)
    if not len(starts):
        return out
    group = np.repeat(np.arange(len(starts)), sizes)
    for k, seed in enumerate(_SEEDS):
        h = (labelled ^ seed) * U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(32)
        picked_at, picked = [], []
        for _ in range(SKETCH_SIZE):
            low = np.minimum.reduceat(h, starts)
            hit = np.flatnonzero(h == low[group])
            where = np.full(len(starts), -1, np.int64)
            where[group[hit][::-1]] = hit[::-1]  # the first of equal ones
            picked_at.append(where)
            picked.append(labelled[where])
            h[where] = np.iinfo(np.uint64).max
        places, values = np.stack(picked_at, 1), np.stack(picked, 1)
        ordered = np.take_along_axis(values, np.argsort(places, axis=1, kind="stable"), 1)
        value = np.full(len(starts), seed, U64)
        for j in range(SKETCH_SIZE):
            value = mix64(value * U64(0x9E3779B97F4A7C15) + ordered[:, j])
        out[:, k] = value.view(np.int64)
    return out


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for part in parts(batches, "text"):
        words = Words(*text_bytes(column(part, "text")))
        shingles, at = words.shingles(SHINGLE_WORDS)
        sketches = sketch(occurrence_labelled(shingles, at), at)
        rows = np.cumsum(np.diff(at) > 0) - 1
        content = [hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=16).digest() for a, b in zip(words.first[:-1], words.first[1:])]
        lists = [sketches[r] if n else [] for r, n in zip(rows, np.diff(at))]
        yield pa.record_batch(
            [
                column(part, "doc_id").cast(pa.int64()),
                pa.array(np.diff(at), pa.int64()),
                pa.array(content, pa.binary()),
                pa.array(lists, pa.list_(pa.int64())),
            ],
            ["doc_id", "n_shingles", "content", "sketches"],
        )


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, content (a 128-bit hash of the words) and sketches of every document with an id."""
    some = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return some.mapInArrow(_sketch_batches, SKETCH_SCHEMA)


def buckets(classes: DataFrame) -> DataFrame:
    """doc_id, k, value, and size and held (members and their shingles) of the bucket, of documents that meet another one in enough buckets."""
    slim = classes.select("doc_id", "n_shingles", F.posexplode("sketches").alias("k", "value"))
    sizes = slim.groupBy("k", "value").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("held")).filter("size > 1")
    met = materialize(slim.drop("n_shingles").join(sizes, ["k", "value"]), "met")
    enough = met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARED_SKETCHES)
    return met.join(enough.hint("merge"), "doc_id", "left_semi")


def small_pairs(met: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a < b) that first agree in a bucket of at most PAIR_MEMBERS, agree often enough, and are of like length."""
    members = met.filter(F.col("size") <= PAIR_MEMBERS).select("doc_id", "k", "value").join(classes, "doc_id")
    held = members.groupBy("k", "value").agg(F.collect_list(F.struct("doc_id", "n_shingles", "sketches")).alias("m"))
    pairs = held.select(
        "k", F.expr("explode(flatten(transform(m, x -> transform(filter(m, y -> x.doc_id < y.doc_id), y -> struct(x, y)))))").alias("p")
    ).select("k", "p.x", "p.y")
    agree = "zip_with(x.sketches, y.sketches, (s, t) -> s = t)"
    return pairs.filter(
        f"least(x.n_shingles, y.n_shingles) >= {similarity} * greatest(x.n_shingles, y.n_shingles) "
        f"AND array_position({agree}, true) = k + 1 AND size(filter({agree}, e -> e)) >= {SHARED_SKETCHES}"
    ).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def block_cells(met: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The large buckets as cells of two blocks: cell, side (0: a block with itself), doc_id, k, second, n_shingles, sketches.

    A cell's pairs are those that first agree in `k`. A bucket beyond SPLIT_MEMBERS is split by each later sketch, and a cell's
    pairs next agree in `second` (-1: not split). Documents without such a pair in the cell are left out, so that
    a document is sent once per bucket and block, and its text only to where it has company.
    """
    large = met.filter(F.col("size") > PAIR_MEMBERS)
    whole = large.filter(F.col("size") <= SPLIT_MEMBERS).select(
        "doc_id", "k", "value", F.lit(-1).alias("second"), F.lit(0).cast("bigint").alias("next"), "size", "held"
    )
    huge = large.filter(F.col("size") > SPLIT_MEMBERS).select("doc_id", "k", "value").join(classes, "doc_id")
    joined = huge.select("doc_id", "n_shingles", "k", "value", F.posexplode("sketches").alias("second", "next")).filter("second > k")
    by = ["k", "value", "second", "next"]
    sizes = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("held")).filter("size > 1")
    split = whole.unionByName(joined.drop("n_shingles").join(sizes, by).select(*whole.columns))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")
    split = split.withColumn("blocks", F.least(blocks, F.col("size").cast("int")))
    split = split.withColumn("own", F.pmod(F.xxhash64("doc_id", *by), F.col("blocks")).cast("int"))
    met_by = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met_by.select(
        "doc_id",
        "k",
        "second",
        F.xxhash64(*by, F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).alias("side"),
    )
    return _dealt(cells.join(classes, "doc_id"), "near-rows").mapInArrow(_with_company(similarity), CELL_SCHEMA)


CELL_SCHEMA = "cell bigint, side int, doc_id bigint, k int, second int, n_shingles bigint, sketches array<bigint>"


def _dealt(cells: DataFrame, label: str, held: int | None = None) -> DataFrame:
    """The rows of a cell in one task, one after the other, sides in order."""
    if held is None:
        cells = materialize(cells, label)
        held = cells.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
        held //= 10  # sketches alone
    tasks = int(held // TASK_SHINGLES) + cells.sparkSession.sparkContext.defaultParallelism
    return cells.repartition(tasks, "cell").sortWithinPartitions("cell", "side", "doc_id")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows cell by cell."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = column(batch, "cell").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            if kept and column(kept[0], "cell")[0].as_py() != keys[begin]:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(begin, end - begin))
    if kept:
        yield pa.Table.from_batches(kept)


class _Cell:
    """The documents of a cell, each once per side, and the pairs that are its own."""

    def __init__(self, table: pa.Table, similarity: float):
        side, ids = table["side"].to_numpy(), table["doc_id"].to_numpy()
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (side[1:] != side[:-1])
        self.rows = np.flatnonzero(fresh)
        self.side, self.ids, self.n = side[fresh], ids[fresh], table["n_shingles"].to_numpy()[fresh]
        sketches = table["sketches"].combine_chunks()
        self._sketches = sketches.flatten().to_numpy().reshape(-1, SKETCHES)[fresh]
        self._k, self._second = table["k"][0].as_py(), table["second"][0].as_py()
        self._similarity = similarity
        self._crossed = int(np.searchsorted(self.side, 1)) if self.side[0] else 0

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """A row, and the later rows that may be similar to it."""
        n, k, second = len(self.ids), self._k, self._second
        for i in range(self._crossed or n):
            begin = self._crossed or i + 1
            equal = self._sketches[begin:] == self._sketches[i]
            sizes = self.n[begin:]
            if second < 0:
                fit = equal[:, k] & ~equal[:, :k].any(1) & (equal.sum(1) >= SHARED_SKETCHES)
            else:
                fit = equal[:, k] & equal[:, second] & (equal[:, :second].sum(1) == 1)
            fit &= np.minimum(sizes, self.n[i]) >= self._similarity * np.maximum(sizes, self.n[i])
            found = np.flatnonzero(fit)
            if len(found):
                yield i, begin + found


def _with_company(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CELL_SCHEMA.split(", ")]
        for table in _whole_cells(batches):
            cell = _Cell(table, similarity)
            meets = np.zeros(len(cell.ids), bool)
            for i, others in cell.pairs():
                meets[i] = True
                meets[others] = True
            if meets.any():
                yield from table.select(names).take(pa.array(cell.rows[meets])).combine_chunks().to_batches()

    return run


def _aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Similarity of two sequences of distinct numbers by their longest common subsequence within the band.

    Numbers are distinct, so the subsequence is a longest increasing run of places. A match further off the diagonal than
    the band cannot be part of an alignment that reaches the threshold.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    least = int(np.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))
    if min(n, m) < least:
        return 0.0
    order = np.argsort(b, kind="stable")
    spot = np.minimum(np.searchsorted(b, a, sorter=order), m - 1)
    place = order[spot]
    own = np.arange(n)
    found = (b[place] == a) & (own - place <= n - least) & (place - own <= m - least)
    place = place[found]
    if len(place) < least:
        return 0.0
    if (np.diff(place) > 0).all():
        matched = len(place)
    else:
        from bisect import bisect_left

        tails: list[int] = []
        for p in place.tolist():
            i = bisect_left(tails, p)
            tails[i : i + 1] = [p]
        matched = len(tails)
    return matched / (n + m - matched)


def _labelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    shingles, at = Words(*text_bytes(texts)).shingles(SHINGLE_WORDS)
    return occurrence_labelled(shingles, at), at


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                a, at_a = _labelled(column(part, "text_a"))
                b, at_b = _labelled(column(part, "text_b"))
                sims = np.array([_aligned(a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]], similarity) for i in range(part.num_rows)])
                linked = pa.array(sims >= similarity)
                pairs = pa.record_batch([column(part, "a"), column(part, "b"), pa.array(sims, pa.float64())], ["a", "b", "similarity"])
                yield pairs.filter(linked)

    return run


def _linked(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cell = _Cell(table, similarity)
            shingles, at = _shingles_of(table["text"].take(pa.array(cell.rows)))
            links, root = links_of(cell, shingles, at, similarity)
            has = np.flatnonzero(links)
            yield pa.record_batch([pa.array(cell.ids[has]), pa.array(cell.ids[root[has]]), pa.array(links[has])], ["a", "b", "n"])

    return run


def _shingles_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    found, sizes = [], []
    for batch in pa.table({"text": texts}).to_batches():
        for part in parts(iter([batch]), "text", 1 << 20):
            shingles, at = _labelled(column(part, "text"))
            found.append(shingles)
            sizes.append(np.diff(at))
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def links_of(cell: _Cell, shingles: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row with others of the cell, and the first row of those it hangs together with.

    A row's common shingles with all its candidates are counted at once; only pairs with enough of them that are not all
    in the same order are aligned one by one.
    """
    distinct, number = np.unique(shingles, return_inverse=True)
    place = np.full(len(distinct), -1, np.int64)
    links, root = np.zeros(len(cell.ids), np.int64), np.arange(len(cell.ids))
    sizes = np.diff(at)
    for i, others in cell.pairs():
        own = number[at[i] : at[i + 1]]
        place[own] = np.arange(len(own))
        n, m = len(own), sizes[others]
        begins = np.cumsum(m) - m
        owner = np.repeat(np.arange(len(others)), m)
        spot = place[number[np.arange(len(owner)) + (at[others] - begins)[owner]]]
        place[own] = -1
        hit = spot >= 0
        spot, owner = spot[hit], owner[hit]
        common = np.bincount(owner, minlength=len(others))
        back = (spot[1:] <= spot[:-1]) & (owner[1:] == owner[:-1])
        mixed = np.bincount(owner[1:][back], minlength=len(others)) > 0
        # common shingles bound the matched ones from above
        similar = common / (n + m - common) >= similarity
        for j in np.flatnonzero(similar & mixed).tolist():
            o = others[j]
            similar[j] = _aligned(shingles[at[i] : at[i + 1]], shingles[at[o] : at[o + 1]], similarity) >= similarity
        linked = others[similar]
        if len(linked):
            links[i] += len(linked)
            links[linked] += 1
            roots = np.unique(root[np.append(linked, i)])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    return links, root


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of the pairs whose texts align well enough. `texts` has one row per id."""
    left = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(similarity), "a bigint, b bigint, similarity double")


def near_links(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, n) rows: `a` has n further links, and hangs together with `b`. `classes`: doc_id, n_shingles, sketches."""
    met = materialize(buckets(classes), "near-buckets")
    pairs = materialize(small_pairs(met, classes, similarity), "near-pairs")
    cells = materialize(block_cells(met, classes, similarity), "near-cells")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(cells.select("doc_id"))
    # no size bounds the wanted ids, so they are not broadcast, however few
    texts = materialize(docs.join(ids.distinct().hint("merge"), "doc_id", "left_semi").select("doc_id", "text"), "near-texts")
    found = materialize(verified(pairs, texts, similarity).select("a", "b").distinct(), "near-found")
    one = F.lit(1).cast("bigint").alias("n")
    few = found.select("a", "b", one).unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), one))
    held = cells.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    many = _dealt(cells.join(texts, "doc_id"), "near-cells", held).mapInArrow(_linked(similarity), "a bigint, b bigint, n bigint")
    return materialize(few.unionByName(many), "near-links")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document id: doc_id, class_id (its exact class), n_links (of the class), group_id and kept."""
    sketches = materialize(sketched(docs), "sketches")
    single = sketches.groupBy("doc_id").agg(F.min_by(F.struct("n_shingles", "content", "sketches"), "content").alias("s")).select("doc_id", "s.*")
    # the first id of each text, by an aggregate: a text may make up a third of all rows
    firsts = single.groupBy("content").agg(
        F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketches").alias("sketches")
    )
    classes = materialize(firsts, "classes")
    reps = classes.select(F.col("class_id").alias("doc_id"), "n_shingles", "sketches")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    links = near_links(texts, reps, similarity)
    groups = components(links)
    degree = links.groupBy("a").agg(F.sum("n").alias("n_links"))
    told = (
        classes.select("content", "class_id")
        .join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
        .join(degree.withColumnRenamed("a", "class_id"), "class_id", "left")
        .select("content", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    )
    return single.select("doc_id", "content").join(told, "content").select(
        "doc_id", "class_id", "n_links", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept")
    )


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near-duplicates: the first of each group, one row of it, and rows with a NULL id."""
    kept = near_duplicates(docs, similarity).filter("kept").select("doc_id")
    # the user's columns as one struct, so none can clash; the window goes by the join's key, so texts are shuffled once
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(*docs.columns).alias("row"))
    joined = rows.filter(F.col("doc_id").isNotNull()).join(kept.hint("merge"), "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("row.text")))
    first = joined.withColumn("place", place).filter("place = 1").select("row.*")
    return first.unionByName(docs.filter(F.col("doc_id").isNull()))
