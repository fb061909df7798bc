"""Safe zones as connected regions of the grid, and how those of one moment overlap those of the next."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staytide.operators.targets import TIE_DIGITS

REGION = "region int, n_points bigint, m1_low int, m1_high int, m2_low int, m2_high int, runs array<struct<m1: int, low: int, high: int>>"


def labelled_runs(m1: np.ndarray, m2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (m1, low, high) of the points, and each one's region: the number of its first run. Points touch by a side."""
    order = np.lexsort((m2, m1))
    a, b = m1[order], m2[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(a)) - 1
    runs = np.stack([a[first], b[first], b[last]], 1)
    root = list(range(len(runs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    starts = {int(v): int(i) for v, i in zip(*np.unique(runs[:, 0], return_index=True))}
    rows = runs.tolist()
    for i, (row, low, high) in enumerate(rows):
        j = starts.get(row - 1)
        # the runs of the row before, in order, as far as they reach
        while j is not None and j < len(rows) and rows[j][0] == row - 1 and rows[j][1] <= high:
            if rows[j][2] >= low:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
            j += 1
    return runs, np.array([find(i) for i in range(len(runs))], np.int64)


def safe_regions(scored: DataFrame, by: Sequence[str], limit: float) -> DataFrame:
    """(by, region, n_points, bounds, runs): each connected region of grid points whose mean risk is within the limit.

    Regions are numbered from 0 by their first point (m1, then m2). A group holds no more points than the grid has; the points
    of a case lie together already, so nothing is shuffled for it.
    """
    inside = scored.filter(F.round("average_pred", TIE_DIGITS) <= limit).select(*by, F.col("m1_valuenum").cast("int").alias("m1"), F.col("m2_valuenum").cast("int").alias("m2"))
    names = list(by)
    kinds = [f"`{c}` {inside.schema[c].dataType.simpleString()}" for c in by]
    run_kind = pa.list_(pa.struct([("m1", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]))

    def label(table: pa.Table) -> pa.Table:
        runs, region = labelled_runs(table["m1"].to_numpy(), table["m2"].to_numpy())
        out: list[tuple] = []
        for k, root in enumerate(np.unique(region)):
            own = runs[region == root]
            n = int((own[:, 2] - own[:, 1] + 1).sum())
            spans = [{"m1": r[0], "low": r[1], "high": r[2]} for r in own.tolist()]
            out.append((k, n, own[:, 0].min(), own[:, 0].max(), own[:, 1].min(), own[:, 2].max(), spans))
        types = [pa.int32(), pa.int64(), *[pa.int32()] * 4, run_kind]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        keys = [pa.array([table[c][0].as_py()] * len(out), table.schema.field(c).type) for c in names]
        return pa.table([*keys, *columns], [*names, "region", "n_points", "m1_low", "m1_high", "m2_low", "m2_high", "runs"])

    return inside.groupBy(*by).applyInArrow(label, f"{', '.join(kinds)}, {REGION}")


def overlaps(regions: DataFrame, keys: Sequence[str], moment: str) -> DataFrame:
    """(keys, moment, n_points, next_points, shared): the largest region of each moment and that of the next one; NULL after the last.

    Of equally large regions the first counts. A case has a row per moment.
    """
    rest = F.struct(F.col("n_points"), -F.col("region"))
    largest = regions.groupBy(*keys, moment).agg(F.max_by(F.struct("n_points", "runs"), rest).alias("r")).select(*keys, moment, "r.*")
    order = Window.partitionBy(*keys).orderBy(moment)
    placed = largest.withColumns({"next_points": F.lead("n_points").over(order), "next_runs": F.lead("runs").over(order)})
    common = F.expr(
        "aggregate(runs, 0L, (n, a) -> n + aggregate(filter(next_runs, b -> b.m1 = a.m1), 0L, "
        "(k, b) -> k + greatest(least(a.high, b.high) - greatest(a.low, b.low) + 1, 0)))"
    )
    return placed.select(*keys, moment, "n_points", "next_points", F.when(F.col("next_points").isNotNull(), common).alias("shared"))
