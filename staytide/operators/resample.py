"""Oversampling of a small class by points between near neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staytide.functions.radix import number_chunk, text_chunk
from staytide.operators.prefix import row_ranks, sums_before
from staytide.session import materialize

BLOCK_ROWS = 20_000
ROWS_AT_ONCE = 128


def _distance_to(center: Column, vec: str) -> Column:
    squares = F.transform(F.arrays_zip(F.col(vec).alias("a"), center.alias("b")), lambda p: (p["a"] - p["b"]) ** 2)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def _blocks(df: DataFrame, key: str, vec: str, size: int) -> DataFrame:
    """(key, vec, dist, block): blocks of exactly `size` rows, ordered by distance from the mean vector."""
    means = (
        df.select(F.posexplode(vec).alias("pos", "x"))
        .groupBy("pos")
        .agg(F.avg("x").alias("x"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("m"))
        .select(F.col("m.x").alias("m"))
    )
    # the mean vector is one row
    placed = (
        df.crossJoin(F.broadcast(means))
        .withColumn("dist", _distance_to(F.col("m"), vec))
        .withColumn("_chunk", number_chunk("dist"))
        .drop("m")
    )
    ranked = row_ranks(placed, [], "_chunk", ["dist", key], "_rank")
    return ranked.select(key, vec, "dist", F.floor(F.col("_rank") / size).alias("block"))


def _matrix(rows: pd.DataFrame, vec: str) -> np.ndarray:
    return np.stack(rows[vec].to_numpy()).astype("float64")


def _nearest(left: pd.DataFrame, right: pd.DataFrame, key: str, vec: str, k: int) -> pd.DataFrame:
    """The k nearest right rows of each left row, itself left out. Both sides are one block at most.

    Products of matrices say which rows may be among the k; their distances are sums of squared
    differences, so copies lie at distance 0 exactly, and ties are ties.
    """
    if left.empty or right.empty:
        return pd.DataFrame({key: [], "neighbor": [], "distance2": []})
    a, b = _matrix(left, vec), _matrix(right, vec)
    own, ids = left[key].to_numpy(), right[key].to_numpy()
    b2 = (b * b).sum(axis=1)
    found = []
    for begin in range(0, len(a), ROWS_AT_ONCE):
        rows = a[begin : begin + ROWS_AT_ONCE]
        a2 = (rows * rows).sum(axis=1)
        rough = a2[:, None] + b2 - 2 * (rows @ b.T)
        rough[own[begin : begin + ROWS_AT_ONCE, None] == ids] = np.inf
        bound = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        error = 1e-12 * (a2 + b2.max())
        i, j = np.nonzero((rough <= (bound + error)[:, None]) & np.isfinite(rough))
        d = ((rows[i] - b[j]) ** 2).sum(axis=1)
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        near = place < k
        found.append((own[begin + i[near]], ids[j[near]], d[near]))
    keys, neighbors, distances = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({key: keys, "neighbor": neighbors, "distance2": distances})


def _nearest_both(left: pd.DataFrame, right: pd.DataFrame, key: str, vec: str, k: int) -> pd.DataFrame:
    return pd.concat([_nearest(left, right, key, vec, k), _nearest(right, left, key, vec, k)])


def _count_upto(points: DataFrame, queries: DataFrame, including: bool) -> DataFrame:
    """(block, n): how many points lie below the value of each query row, or at most at it."""
    value = points.columns[0]
    block, asked = queries.columns
    points = points.select(
        F.col(value).alias("_v"), F.lit(0 if including else 1).alias("_side"), F.lit(1).cast("bigint").alias("_one")
    )
    queries = queries.select(
        F.col(asked).alias("_v"), F.lit(1 if including else 0).alias("_side"), F.lit(0).cast("bigint").alias("_one"), block
    )
    line = points.unionByName(queries, allowMissingColumns=True).withColumn("_chunk", number_chunk("_v"))
    counted = sums_before(line, [], "_chunk", ["_v", "_side"], {"n": "_one"})
    return counted.filter(F.col(block).isNotNull()).select(block, "n")


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy("distance2", "neighbor")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_neighbors(
    df: DataFrame, key: str, vec: str, k: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact k nearest other rows: (key, neighbor, distance2, rank). Ties go to the lower key.

    Rows lie in blocks of bounded size, ordered by distance from the mean vector. Neighbours
    within the own block bound how far the true ones can be. By the triangle inequality only
    blocks whose distance range is that near can hold a closer row; the other pairs of blocks
    are left out before any vector moves. A pair of blocks is one task, which yields k rows per row of
    both, never all pairs of rows. In many dimensions no pair can be left out: each row is then
    copied once per block, n / block_rows times, so blocks are as large as a task's memory allows.
    """
    schema = f"{key} BIGINT, neighbor BIGINT, distance2 DOUBLE"
    blocks = materialize(
        _blocks(df.select(F.col(key).cast("bigint"), F.col(vec).cast("array<double>")), key, vec, block_rows),
        "blocks",
    )

    own = blocks.groupBy("block").applyInPandas(lambda pdf: _nearest(pdf, pdf, key, vec, k), schema)
    own = materialize(own, "own-neighbors")

    # how far the k-th neighbour can be; with fewer than k found so far there is no bound
    reach = own.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("distance2").alias("d2")).select(
        key, F.when(F.col("n") == k, F.sqrt("d2")).alias("reach")
    )
    # a little wider than the bound, as sums of rounded squares are not exact
    slack = F.col("reach") * (1 + 1e-9) + 1e-12
    spans = (
        blocks.join(reach, key, "left")
        .groupBy("block")
        .agg(
            F.min("dist").alias("low"),
            F.max("dist").alias("high"),
            F.min(F.col("dist") - F.coalesce(slack, F.lit(float("inf")))).alias("from_low"),
            F.max(F.col("dist") + F.coalesce(slack, F.lit(float("inf")))).alias("to_high"),
        )
    )
    spans = materialize(spans, "block-spans")
    # blocks follow each other in distance, so the near ones are a run of block numbers
    first = _count_upto(spans.select("high"), spans.select("block", "from_low"), including=False)
    end = _count_upto(spans.select("low"), spans.select("block", "to_high"), including=True)
    pairs = (
        first.withColumnRenamed("n", "_first")
        .join(end.withColumnRenamed("n", "_end"), "block")
        .select("block", F.explode(F.sequence(F.col("_first"), F.col("_end") - 1)).alias("other"))
        .filter(F.col("other") != F.col("block"))
        .select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .distinct()
    )
    left = blocks.withColumnRenamed("block", "low").join(pairs, "low").select("low", "high", key, vec)
    right = blocks.withColumnRenamed("block", "high").join(pairs, "high").select("low", "high", key, vec)
    right = right.toDF("low", "high", key, vec)
    across = (
        left.groupBy("low", "high")
        .cogroup(right.groupBy("low", "high"))
        .applyInPandas(lambda a, b: _nearest_both(a, b, key, vec, k), schema)
    )
    return _ranked(own.unionByName(across), key, k)


def oversample(
    df: DataFrame,
    key: str,
    vec: str,
    label: str,
    k: int = 5,
    seed: int = 42,
    minority: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows and synthetic rows of the small class, until both classes are equal in number.

    A synthetic row lies on the line from a row to one of its k nearest neighbours of the same
    class. Row, neighbour and place on the line follow from hashes, so a lost task gives the
    same rows again. Synthetic rows have a NULL key and name their parents.
    """
    real = df.select(
        F.col(key).cast("bigint").alias(key),
        F.col(vec).cast("array<double>").alias(vec),
        F.col(label).cast("int").alias(label),
        F.lit(None).cast("bigint").alias("base"),
        F.lit(None).cast("bigint").alias("neighbor"),
    )
    small = real.filter(F.col(label) == minority).select(key, vec)
    near = nearest_neighbors(small, key, vec, k, block_rows).select(key, "neighbor", "rank")
    wanted = df.agg(
        F.greatest(F.count_if(F.col(label) != minority) - F.count_if(F.col(label) == minority), F.lit(0))
    ).scalar()
    n_small = df.agg(F.count_if(F.col(label) == minority)).scalar()

    # deal the wanted number out evenly, in the order of a hash
    hashed = small.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))))
    dealt = row_ranks(hashed.withColumn("_chunk", text_chunk("_hash")), [], "_chunk", ["_hash", key], "_rank")
    share = F.floor(wanted / n_small) + (F.col("_rank") < wanted % n_small).cast("bigint")
    copies = (
        dealt.withColumn("_copies", share)
        .filter(F.col("_copies") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    )
    degree = near.groupBy(key).agg(F.max("rank").alias("_degree"))
    chosen = copies.join(degree, key).withColumns(
        {
            "rank": (F.pmod(F.xxhash64(key, "_copy", F.lit(seed)), F.col("_degree")) + 1).cast("int"),
            "_place": F.pmod(F.xxhash64("_copy", key, F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30),
        }
    )
    ends = small.select(F.col(key).alias("neighbor"), F.col(vec).alias("_end"))
    made = (
        chosen.join(near, [key, "rank"])
        .join(ends, "neighbor")
        .select(
            F.lit(None).cast("bigint").alias(key),
            F.zip_with(vec, "_end", lambda a, b: a + (b - a) * F.col("_place")).alias(vec),
            F.lit(minority).alias(label),
            F.col(key).alias("base"),
            "neighbor",
        )
    )
    return real.unionByName(made)


