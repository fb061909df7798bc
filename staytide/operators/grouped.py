"""Logistic models of many groups at once: one aggregate per step for all windows and folds, no loop over them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_one(features: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(f"_x{i}") for i in range(len(features))]]


def _scaled(df: DataFrame, features: Sequence[str], scale: dict) -> DataFrame:
    """Adds _x0, _x1, ...: features by mean and deviation of the training rows, 0 (the mean) for a gap."""
    known = {f: F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features}
    return df.withColumns(
        {
            f"_x{i}": F.coalesce((known[f] - scale[f][0]) / (scale[f][1] or 1.0), F.lit(0.0))
            for i, f in enumerate(features)
        }
    )


def _score(features: Sequence[str]) -> Column:
    total = sum((F.col("_w")[i] * x for i, x in enumerate(_with_one(features))), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def fit_logistic(
    df: DataFrame,
    groups: Sequence[str],
    features: Sequence[str],
    label: str,
    k: int = 5,
    ridge: float = 1.0,
    steps: int = 8,
) -> tuple[DataFrame, dict]:
    """A model per group and fold, trained on the group's other folds: rows (groups, model_fold, _w), and the scaling.

    Newton's steps with a ridge. Each one is an aggregate that is combined before the shuffle; the driver sees
    a gradient and a matrix per group and fold, and sends back the weights. `df` is read once per step, so it
    should be a written table. Rows without a label are left out.
    """
    known = df.filter(F.col(label).isNotNull())
    stats = [(F.nanvl(F.col(f).cast("double"), F.lit(None)), f) for f in features]
    row = known.agg(*[g for c, f in stats for g in (F.avg(c).alias(f"m_{f}"), F.stddev_pop(c).alias(f"s_{f}"))]).first()
    scale = {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] or 0.0) for f in features}
    every = F.explode(F.array(*[F.lit(i) for i in range(k)]))
    rows = _scaled(known, features, scale).withColumn("model_fold", every).filter(F.col("fold") != F.col("model_fold"))
    n = len(features) + 1
    names = [*groups, "model_fold"]
    weights: dict[tuple, np.ndarray] = {}
    for _ in range(steps):
        table = _table(df, names, weights, n)
        start = F.array(*[F.lit(0.0)] * n)
        joined = rows.withColumn("_w", start) if table is None else rows.join(F.broadcast(table), names)
        x, p = _with_one(features), _score(features)
        sums = [F.sum(xi * (F.col(label) - p)).alias(f"g{i}") for i, xi in enumerate(x)]
        sums += [F.sum(x[i] * x[j] * p * (1 - p)).alias(f"h{i}_{j}") for i in range(n) for j in range(i + 1)]
        for r in joined.groupBy(*names).agg(*sums).collect():
            key = tuple(r[c] for c in names)
            w = weights.get(key, np.zeros(n))
            matrix = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)])
            shrink = ridge * np.diag([0.0] + [1.0] * (n - 1)) + 1e-6 * np.eye(n)
            step = np.linalg.solve(matrix + shrink, np.array([r[f"g{i}"] for i in range(n)]) - shrink @ w)
            weights[key] = np.clip(w + step, -20, 20)
    return _table(df, names, weights, n, keep_empty=True), scale


def _table(df: DataFrame, names: Sequence[str], weights: dict, n: int, keep_empty: bool = False) -> DataFrame | None:
    if not weights and not keep_empty:
        return None
    kinds = [f"`{c}` {'int' if c == 'model_fold' else df.schema[c].dataType.simpleString()}" for c in names]
    rows = [(*key, [float(x) for x in w]) for key, w in weights.items()]
    return df.sparkSession.createDataFrame(rows, f"{', '.join(kinds)}, _w array<double>")


def predict_logistic(
    df: DataFrame, models: DataFrame, scale: dict, groups: Sequence[str], features: Sequence[str], out: str = "pred_prob"
) -> DataFrame:
    """Every row under each model of its group: adds model_fold and the probability. One row per group and fold is broadcast."""
    joined = _scaled(df, features, scale).join(F.broadcast(models), list(groups))
    return joined.withColumn(out, _score(features)).drop("_w", *[f"_x{i}" for i in range(len(features))])
