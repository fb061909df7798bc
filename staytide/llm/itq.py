"""Near-duplicate vectors by iterative quantisation.

A rotation is learned that makes the signs of the centred vectors' coordinates as good a code as can be: in turn the
codes are taken from the rotated vectors and the rotation from the codes (orthogonal Procrustes). Each bit is cut at its
median, so codes are balanced. The code's 16-bit pieces are the keys of as many Hamming tables; vectors that share a
piece and the label are compared by the cosine of the original vectors in double precision. Two rotations
give eight tables.

Equal vectors of one label are one class, compared once. A bucket too large for one task is cut into blocks, and each pair of blocks is a
task of its own. A task sends a number of links and one link towards its smallest relative per
vector, never the pairs; a pair that shares several pieces counts in the first table alone.

The rotation is fitted on at most `FIT_ROWS` vectors, the first by a hash of the id; every vector is
indexed. Vectors of another length than most of the sample's have one code per label and length, and are
all compared.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite components, and those without label or
id, link with nothing; their component is their own id. Repeated rows are vectors of their own. Other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staytide.llm.components import components
from staytide.llm.textarrays import column
from staytide.session import materialize

THRESHOLD = 0.98
FIT_ROWS = 20_000
PIECE_BITS = 16
PIECES_PER_ROTATION = 4
ROTATIONS = 2
ROUNDS = 40
BLOCK_ROWS = 2048
ROWS_PER_TASK = 100_000


def learn_rotation(sample: np.ndarray, bits: int, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(projection, cuts): bit k of x is (x @ projection)[k] > cuts[k]. Rows of the sample have length 1."""
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    rng = np.random.default_rng(seed)
    columns = []
    while sum(c.shape[1] for c in columns) < bits:
        k = min(bits - sum(c.shape[1] for c in columns), sample.shape[1])
        reduced = centred @ axes[:, -k:]
        turn = np.linalg.qr(rng.normal(size=(k, k)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(reduced.T @ np.where(reduced @ turn > 0, 1.0, -1.0))
            turn = u @ vt
        columns.append(axes[:, -k:] @ turn)
    projection = np.concatenate(columns, 1)
    return projection, np.median(sample @ projection, 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1. A power of two goes first, which is exact, so that no square is too large or too small."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    scaled = np.ldexp(vectors, -power)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def piece_codes(vectors: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The 16-bit pieces of each vector's codes, all tables side by side."""
    weights = 1 << np.arange(PIECE_BITS)
    out = []
    for projection, cuts in models:
        bits = vectors @ projection > cuts
        out.append((bits.reshape(len(vectors), -1, PIECE_BITS) * weights).sum(2))
    return np.concatenate(out, 1).astype(np.int32)


def _matrix(vectors: pa.Array) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(vectors), -1)


def _encode(models: list, length: int):
    tables = ROTATIONS * PIECES_PER_ROTATION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(column(batch, "embedding").offsets.to_numpy())
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                usual = np.flatnonzero(lengths[begin : begin + 4096] == length)
                codes = np.full((part.num_rows, tables), -1, np.int32)
                if len(usual) and models:
                    x = _matrix(column(part, "embedding").take(pa.array(usual)))
                    codes[usual] = piece_codes(unit(x), models)
                lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype=np.int32), codes.ravel())
                yield pa.record_batch([*part.columns, lists], [*part.schema.names, "codes"])

    return run


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[k] with b[k]: every member of a set has its smallest label."""
    while True:
        live = label[a] != label[b]
        a, b = a[live], b[live]
        if not len(a):
            return label
        low = np.minimum(label[a], label[b])
        top = np.maximum(label[a], label[b])
        np.minimum.at(label, top, low)
        label = label[label]
        while (label[label] != label).any():
            label = label[label]


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Links of the blocks in a task: (vec_id, n_links, root) per vector that has any."""
        n = table.num_rows
        table = table.combine_chunks()
        get = lambda name: table[name].to_numpy()
        order = np.lexsort((get("vec_id"), get("side"), get("key")))
        key, side, ids, copies, piece = (get(c)[order] for c in ("key", "side", "vec_id", "copies", "piece"))
        lists = table["embedding"].combine_chunks()
        codes = np.stack(table["codes"].combine_chunks().take(pa.array(order)).to_numpy(zero_copy_only=False))
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), n)
        found: tuple[list, list, list] = ([], [], [])
        for begin, end in zip(cuts[:-1], cuts[1:]):
            left = begin + np.flatnonzero(side[begin:end] <= 0)  # side 0: both sides of the pair
            right = begin + np.flatnonzero(side[begin:end] != -1)
            same = side[begin] == 0
            if end - begin < 2 or not len(left) or not len(right):
                continue
            x = unit(_matrix(lists.take(pa.array(order[begin:end]))))
            links = np.zeros(end - begin, np.int64)
            label = np.arange(end - begin)
            for at in range(0, len(left), 512):
                own = left[at : at + 512] - begin
                i, j = np.nonzero(x[own] @ x[right - begin].T >= threshold)
                i, j = own[i], right[j] - begin
                if same:
                    i, j = i[i < j], j[i < j]
                # a pair belongs to the first table in which it shares the piece
                earlier = np.zeros(len(i), bool)
                for t in range(int(piece[begin])):
                    earlier |= codes[begin + i, t] == codes[begin + j, t]
                i, j = i[~earlier], j[~earlier]
                np.add.at(links, i, copies[begin + j])
                np.add.at(links, j, copies[begin + i])
                label = _unite(label, i, j)
            has = np.flatnonzero(links)
            found[0].append(ids[begin + has])
            found[1].append(links[has])
            found[2].append(ids[begin + label[has]])
        none = [np.empty(0, np.int64)]
        return pa.table({c: np.concatenate(v or none) for c, v in zip(("vec_id", "n_links", "root"), found)})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    sound = F.expr(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND "
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x != 0)"
    )
    usable = rows.withColumn("usable", F.coalesce(sound, F.lit(False)))
    classes = materialize(
        usable.filter("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "vector-classes"
    )
    sample = [r["embedding"] for r in classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").collect()]
    models, length = [], 0
    if sample:
        length = Counter(map(len, sample)).most_common(1)[0][0]
        usual = unit(np.array([x for x in sample if len(x) == length]))
        models = [learn_rotation(usual, PIECES_PER_ROTATION * PIECE_BITS, seed) for seed in range(ROTATIONS)]
    fields = "label string, embedding array<double>, vec_id bigint, copies bigint, codes array<int>"
    coded = classes.withColumn("label", F.col("label").cast("string")).mapInArrow(_encode(models, length), fields)
    coded = materialize(coded, "vector-codes")
    # bit patterns of the bucket: label, length, table, piece; only those with company go on
    pieces = coded.select("vec_id", "label", F.size("embedding").alias("length"), F.posexplode("codes").alias("piece", "code"))
    bucket = ["label", "length", "piece", "code"]
    sizes = pieces.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = pieces.join(sizes, bucket)
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("vec_id", "piece"), blocks).cast("int")
    # block pairs (low, high): side -1 is the low block, 1 the high one, 0 a block with itself
    paired = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    keyed = paired.select(
        "vec_id",
        "piece",
        F.xxhash64(*bucket, low, high).alias("key"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).alias("side"),
    )
    # rows as they are sent: one for each block that a row's block meets
    n = met.agg(F.coalesce(F.sum(blocks), F.lit(0)).alias("n")).first()["n"]
    tasks = int(n) // ROWS_PER_TASK + 1
    ready = keyed.join(coded.select("vec_id", "embedding", "copies", "codes"), "vec_id").withColumn("task", F.pmod("key", F.lit(tasks * 8)))
    found = ready.groupBy("task").applyInArrow(_compare(threshold), "vec_id bigint, n_links bigint, root bigint")
    found = materialize(found, "vector-links")
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_near"))
    told = (
        classes.join(degree, "vec_id", "left")
        .join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            F.col("label").alias("c_label"),
            F.col("embedding").alias("c_embedding"),
            (F.coalesce("n_near", F.lit(0).cast("bigint")) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
    )
    joined = usable.join(told, F.col("usable") & (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
