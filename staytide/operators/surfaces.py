"""Risk surfaces of trained models over the two measures, and their lowest grid points, case by case without unfolding the grid.

For a case, all inputs of a model but the two measures are fixed. A tree then is constant on rectangles between its cut points,
so a sum of trees is constant on the cells between all cut points: each leaf that the case can reach adds
its value at the corners of its rectangle, and two running sums give every cell. The k lowest points are counted off the lowest cells.

A logistic model (or calibrated support vectors) rises or falls in each measure alone, so a block of grid points lies between the
values at two of its corners. Blocks that cannot hold one of the k lowest points of the mean are left out,
and only the points of the others are computed.

Models are compiled on the driver from their own parameters, whose size is the models', and go to the tasks once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    LinearSVCModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.feature import StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staytide.session import shared_dir

# Side of a block of grid points, and cells of node and case that a step holds.
BLOCK = 8
NODE_CELLS = 4_000_000
GRID_CELLS = 8_000_000


@dataclass
class Trees:
    """All trees of a model as flat arrays; `value` is what a leaf adds to the sum, `boosted` tells what the sum means."""

    feature: np.ndarray
    threshold: np.ndarray
    parent: np.ndarray
    is_left: np.ndarray
    value: np.ndarray
    is_leaf: np.ndarray
    tree: np.ndarray
    levels: list[np.ndarray]
    boosted: bool

    def probability(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * total)) if self.boosted else total


@dataclass
class Linear:
    """The logit as intercept + weights * inputs."""

    intercept: float
    weights: np.ndarray


def _assembler(model: PipelineModel) -> VectorAssembler:
    return next(s for s in model.stages if isinstance(s, VectorAssembler))


def tree_table(model: GBTClassificationModel | RandomForestClassificationModel, spark) -> Trees:
    """The nodes of a model as Spark saves them; rows by tree and node number."""
    path = shared_dir(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas().sort_values(["treeID", "id"])
    boosted = isinstance(model, GBTClassificationModel)
    tree, own = nodes["treeID"].to_numpy(np.int64), nodes["id"].to_numpy(np.int64)
    first = np.searchsorted(tree, np.arange(model.getNumTrees))
    place = first[tree] + own
    if not np.array_equal(place, np.arange(len(nodes))):
        raise ValueError("nodes of the saved model are not numbered through")
    left, right = nodes["leftChild"].to_numpy(np.int64), nodes["rightChild"].to_numpy(np.int64)
    is_leaf = left < 0
    parent, is_left = np.full(len(nodes), -1), np.zeros(len(nodes), bool)
    inner = np.flatnonzero(~is_leaf)
    for child, side in ((left, True), (right, False)):
        at = first[tree[inner]] + child[inner]
        parent[at], is_left[at] = inner, side
    splits = nodes["split"].tolist()
    if any(s["numCategories"] > 0 for s in splits):
        raise ValueError("only splits of numbers have a surface")
    feature = np.array([s["featureIndex"] for s in splits], np.int64)
    threshold = np.array([s["leftCategoriesOrThreshold"][0] if len(s["leftCategoriesOrThreshold"]) else np.nan for s in splits])
    if boosted:
        value = nodes["prediction"].to_numpy(float) * np.array(model.treeWeights)[tree]
    else:
        stats = np.stack(nodes["impurityStats"].tolist())
        share = np.divide(stats[:, 1], stats.sum(1), out=np.zeros(len(stats)), where=stats.sum(1) > 0)
        value = share / model.getNumTrees
    levels, level = [], np.flatnonzero(parent < 0)
    while len(level):
        levels.append(level)
        level = np.flatnonzero(np.isin(parent, level))
    return Trees(feature, threshold, parent, is_left, value, is_leaf, tree, levels, boosted)


def compiled(model: PipelineModel, spark) -> Trees | Linear | None:
    """What a pipeline of `learners.build` computes from its assembled inputs; None for any other model."""
    last = model.stages[-1]
    if isinstance(last, (GBTClassificationModel, RandomForestClassificationModel)):
        return tree_table(last, spark)
    if not isinstance(last, LogisticRegressionModel):
        return None
    scale = next((s for s in model.stages if isinstance(s, StandardScalerModel)), None)
    svc = next((s for s in model.stages if isinstance(s, LinearSVCModel)), None)
    if scale is None:
        return None
    weights, intercept = last.coefficients.toArray(), last.intercept
    if svc is not None:
        slope = weights[1] - weights[0]
        weights, intercept = slope * svc.coefficients.toArray(), intercept + slope * svc.intercept
    std, mean = scale.std.toArray(), scale.mean.toArray()
    weights = np.divide(weights, std, out=np.zeros_like(weights), where=std > 0)
    return Linear(float(intercept - weights @ mean), weights)


def reached(trees: Trees, inputs: np.ndarray, free: Sequence[int]) -> np.ndarray:
    """Which nodes each case can come to if the free inputs may take any value: (cases, nodes)."""
    open_ = np.ones((len(inputs), len(trees.feature)), bool)
    for level in trees.levels[1:]:
        up = trees.parent[level]
        feature = trees.feature[up]
        passes = (inputs[:, feature] <= trees.threshold[up]) == trees.is_left[level]
        passes[:, np.isin(feature, free)] = True
        open_[:, level] = open_[:, up] & passes
    return open_


def rectangles(trees: Trees, free: Sequence[int], lows: Sequence[int], sizes: Sequence[int]) -> np.ndarray:
    """Per node the grid places it covers: (nodes, 4) as begin and end of the first measure, then of the second."""
    box = np.tile(np.array([0, sizes[0], 0, sizes[1]]), (len(trees.feature), 1))
    for level in trees.levels[1:]:
        up = trees.parent[level]
        box[level] = box[up]
        for i, f in enumerate(free):
            own = trees.feature[up] == f
            at, cut = level[own], np.floor(trees.threshold[up[own]]) - lows[i] + 1
            cut = np.clip(cut, 0, sizes[i]).astype(np.int64)
            below = trees.is_left[at]
            box[at[below], 2 * i + 1] = np.minimum(box[at[below], 2 * i + 1], cut[below])
            box[at[~below], 2 * i] = np.maximum(box[at[~below], 2 * i], cut[~below])
    return box


class TreeCells:
    """Cells of the mean of several tree models."""

    def __init__(self, models: Sequence[Trees], free: Sequence[Sequence[int]], lows: Sequence[int], sizes: Sequence[int]):
        self.models, self.free, self.lows, self.sizes = models, free, lows, sizes
        boxes = [rectangles(m, f, lows, sizes) for m, f in zip(models, free)]
        used = [m.is_leaf & (b[:, 0] < b[:, 1]) & (b[:, 2] < b[:, 3]) for m, b in zip(models, boxes)]
        self.leaves = [np.flatnonzero(u) for u in used]
        self.cuts = [
            np.unique(np.concatenate([[0, sizes[i]], *[b[n][:, 2 * i : 2 * i + 2].ravel() for b, n in zip(boxes, self.leaves)]]))
            for i in (0, 1)
        ]
        self.shape = tuple(len(c) for c in self.cuts)  # one more row and column than cells, for the corners beyond
        self.corners = []
        for b, n in zip(boxes, self.leaves):
            ends = [np.searchsorted(self.cuts[i // 2], b[n][:, i]) for i in range(4)]
            places = np.concatenate([ends[i] * self.shape[1] + ends[j] for i in (0, 1) for j in (2, 3)])
            order = np.argsort(places, kind="stable")
            starts = np.flatnonzero(np.diff(places[order], prepend=-1))
            sign = np.repeat([1.0, -1.0, -1.0, 1.0], len(n))
            self.corners.append((order % max(1, len(n)), sign[order], starts, places[order][starts]))

    def step(self) -> int:
        nodes = max(len(m.feature) for m in self.models)
        return max(1, min(NODE_CELLS // (4 * nodes), GRID_CELLS // (self.shape[0] * self.shape[1]), 512))

    def means(self, inputs: Sequence[np.ndarray]) -> np.ndarray:
        """Mean probability of each cell: (cases, cells of m1, cells of m2)."""
        total = 0.0
        for m, free, leaves, (leaf, sign, starts, places), x in zip(self.models, self.free, self.leaves, self.corners, inputs):
            weight = reached(m, x, free)[:, leaves] * m.value[leaves]
            grid = np.zeros((len(x), self.shape[0] * self.shape[1]))
            if len(leaves):
                grid[:, places] = np.add.reduceat(weight[:, leaf] * sign, starts, axis=1)
            grid = grid.reshape(len(x), *self.shape).cumsum(1).cumsum(2)[:, :-1, :-1]
            total = total + m.probability(grid)
        return total / len(self.models)

    def lowest(self, inputs: Sequence[np.ndarray], k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean place of the k lowest points per case, NaN without any."""
        level = np.floor(self.means(inputs) * 10.0**digits + 0.5)
        flat = level.reshape(len(level), -1)
        size = np.outer(np.diff(self.cuts[0]), np.diff(self.cuts[1])).ravel()
        few = min(k, flat.shape[1])
        # every cell has a point, so the k lowest cells hold the level of the last point wanted
        near = np.argpartition(flat, few - 1, axis=1)[:, :few]
        out = np.full((2, len(flat)), np.nan)
        mid = [(c[:-1] + c[1:] - 1) / 2 for c in self.cuts]
        for i in range(len(flat)):
            order = near[i][np.argsort(flat[i, near[i]], kind="stable")]
            held = np.cumsum(size[order])
            last = flat[i, order[min(np.searchsorted(held, k), few - 1)]]
            if np.isnan(last):
                continue
            below = order[flat[i, order] < last]
            rows, columns = np.divmod(below, len(mid[1]))
            n, s1, s2 = size[below].sum(), (size[below] * mid[0][rows]).sum(), (size[below] * mid[1][columns]).sum()
            more = self._first_of(level[i] == last, k - n)
            out[:, i] = (s1 + more[1]) / (n + more[0]), (s2 + more[2]) / (n + more[0])
        return out[0], out[1]

    def _first_of(self, equal: np.ndarray, wanted: int) -> tuple[int, float, float]:
        """Number and sums of places of the first `wanted` points, by m1 and then m2, of the marked cells."""
        n = s1 = s2 = 0.0
        first, second = self.cuts
        width = np.diff(second)
        for r in np.flatnonzero(equal.any(1)):
            columns = np.flatnonzero(equal[r])
            a, per_row = first[r], width[columns].sum()
            row_sum = (width[columns] * (second[columns] + second[columns + 1] - 1) / 2).sum()
            rows = int(min(first[r + 1] - a, (wanted - n) // per_row))
            n, s1, s2 = n + rows * per_row, s1 + per_row * rows * (2 * a + rows - 1) / 2, s2 + rows * row_sum
            left = int(wanted - n)
            if rows < first[r + 1] - a and left:
                places = np.concatenate([np.arange(second[c], second[c + 1]) for c in columns])[:left]
                n, s1, s2 = n + len(places), s1 + len(places) * (a + rows), s2 + places.sum()
            if n >= wanted:
                break
        return int(n), s1, s2


class LinearBlocks:
    """Blocks of the mean of several logistic models."""

    def __init__(self, models: Sequence[Linear], free: Sequence[Sequence[int]], lows: Sequence[int], sizes: Sequence[int]):
        self.sizes = sizes
        self.intercepts, self.rest = [], []
        grids = [np.arange(n) + low for n, low in zip(sizes, lows)]
        starts = [np.arange(0, n, BLOCK) for n in sizes]
        ends = [np.minimum(s + BLOCK, n) for s, n in zip(starts, sizes)]
        self.parts = [[m.weights[f[i]] * grids[i] for i in (0, 1)] for m, f in zip(models, free)]
        bound = lambda p, pick: [pick(p[i][starts[i]], p[i][ends[i] - 1]) for i in (0, 1)]
        self.low, self.high = ([np.add.outer(*bound(p, pick)).ravel() for p in self.parts] for pick in (np.minimum, np.maximum))
        self.held = np.outer(ends[0] - starts[0], ends[1] - starts[1]).ravel()
        corners = np.stack(np.meshgrid(*starts, indexing="ij"), -1).reshape(-1, 2)
        inner = np.stack(np.meshgrid(np.arange(BLOCK), np.arange(BLOCK), indexing="ij"), -1).reshape(-1, 2)
        self.points = corners[:, None, :] + inner[None]  # (blocks, points of a block, 2)
        self.real = (self.points < np.array(sizes)).all(2)
        for m, f in zip(models, free):
            rest = m.weights.copy()
            rest[list(f)] = 0.0
            self.rest.append(rest)
            self.intercepts.append(m.intercept)

    def step(self) -> int:
        return 128

    def lowest(self, inputs: Sequence[np.ndarray], k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean place of the k lowest points per case, NaN for a case with an unknown input."""
        scale, wide, points = 10.0**digits, self.sizes[1], self.sizes[0] * self.sizes[1]
        base = np.stack([b + x @ w for b, x, w in zip(self.intercepts, inputs, self.rest)])  # (models, cases)
        mean = lambda parts: sum(1 / (1 + np.exp(-(c[:, None] + p))) for c, p in zip(base, parts)) / len(parts)
        out = np.full((2, base.shape[1]), np.nan)
        known = np.flatnonzero(np.isfinite(base).all(0))
        base = base[:, known]
        if not len(known):
            return out[0], out[1]
        low, high = mean(self.low), mean(self.high)
        order = np.argsort(high, axis=1)
        enough = (np.cumsum(self.held[order], axis=1) < min(k, points)).sum(1)
        limit = np.take_along_axis(high, np.take_along_axis(order, enough[:, None], 1), 1)
        # twice the digits' unit more, for values that round to the same level
        case, block = np.nonzero(low <= limit + 2 / scale)
        m1, m2 = self.points[block, :, 0], self.points[block, :, 1]
        inside = self.real[block]
        m1, m2 = np.where(inside, m1, 0), np.where(inside, m2, 0)
        value = sum(1 / (1 + np.exp(-(c[case][:, None] + p[0][m1] + p[1][m2]))) for c, p in zip(base, self.parts)) / len(self.parts)
        code = np.floor(value * scale + 0.5).astype(np.int64) * points + m1 * wide + m2
        code[~inside] = np.iinfo(np.int64).max
        bounds = np.searchsorted(case, np.arange(len(known) + 1))
        for i, at in enumerate(known):
            own = code[bounds[i] : bounds[i + 1]].ravel()
            best = np.partition(own, min(k, len(own)) - 1)[: min(k, points)] % points
            out[:, at] = (best // wide).mean(), (best % wide).mean()
        return out[0], out[1]


def search(
    cases: DataFrame,
    key: str,
    models: Sequence[PipelineModel],
    m1: tuple[int, int],
    m2: tuple[int, int],
    k: int,
    digits: int,
    names: tuple[str, str] = ("m1_valuenum", "m2_valuenum"),
) -> DataFrame | None:
    """(key, optimal_m1, optimal_m2): the mean of the k grid points of lowest mean prediction; ties go to the lower m1, then m2.

    None if the models are not all trees, or all logistic, over both measures: their grid must be unfolded.
    """
    spark = cases.sparkSession
    inputs = [_assembler(m).getInputCols() for m in models]
    spots = [[next((i for i, c in enumerate(cols) if c in (n, f"_fill_{n}")), None) for n in names] for cols in inputs]
    if not models or any(s is None for spot in spots for s in spot):
        return None
    found = [compiled(m, spark) for m in models]
    kinds = {type(f) for f in found}
    if kinds not in ({Trees}, {Linear}):
        return None
    lows, sizes = (m1[0], m2[0]), (m1[1] - m1[0] + 1, m2[1] - m2[0] + 1)
    surface = (TreeCells if kinds == {Trees} else LinearBlocks)(found, spots, lows, sizes)
    shared = spark.sparkContext.broadcast(surface)  # of the size of the models

    rows = cases.withColumns({n: F.lit(float(low)) for n, low in zip(names, lows)})
    for i, model in enumerate(models):
        columns = rows.columns
        for stage in model.stages:
            rows = stage.transform(rows)
            if isinstance(stage, VectorAssembler):
                rows = rows.select(*columns, vector_to_array(stage.getOutputCol()).alias(f"_v{i}"))
                break

    n_models = len(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, cells.step()):
                part = batch.slice(at, cells.step())
                wide = [part.column(i + 1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for i in range(n_models)]
                targets = [pa.array(t + low, pa.float64(), from_pandas=True) for t, low in zip(cells.lowest(wide, k, digits), lows)]
                yield pa.record_batch([part.column(0), *targets], ["key", "optimal_m1", "optimal_m2"])

    kind = cases.schema[key].dataType.simpleString()
    slim = rows.select(F.col(key).alias("key"), *[f"_v{i}" for i in range(len(models))])
    tasks = 4 * spark.sparkContext.defaultParallelism + 1
    return slim.repartition(tasks, "key").mapInArrow(run, f"key {kind}, optimal_m1 double, optimal_m2 double").withColumnRenamed("key", key)
