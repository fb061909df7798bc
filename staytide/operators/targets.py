"""Search of a value grid for each case's point of lowest predicted risk."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staytide.functions.values import mean_interval, null_if_nan
from staytide.operators import learners, surfaces

# Grid of both measures, ends included, and points averaged to a target.
M1_GRID = (40, 150)
M2_GRID = (60, 200)
TARGET_POINTS = 100

# Predictions that agree to this many digits count as equal.
TIE_DIGITS = 9

Scorer = Callable[[DataFrame], DataFrame]


def with_grid(
    cases: DataFrame,
    key: str,
    m1: tuple[int, int] = M1_GRID,
    m2: tuple[int, int] = M2_GRID,
    tasks: int | None = None,
) -> DataFrame:
    """Every case with every grid point, as m1_valuenum and m2_valuenum.

    Cases are spread by key while they are few rows, and each one unfolds in place. Its points
    then already lie together for the ranking, and the grid rows are never shuffled. `tasks` is best
    about a hundredth of the number of cases: Spark's aggregate of arrays hashes up to 128 of them.
    """
    tasks = tasks or 8 * cases.sparkSession.sparkContext.defaultParallelism
    # one more, so the number differs from the session's shuffle partitions: Spark would take
    # such a shuffle for its own, and merge its small-looking partitions into a few tasks
    points = cases.drop("m1_valuenum", "m2_valuenum").repartition(tasks + 1, key)
    return points.withColumn("m1_valuenum", F.explode(F.sequence(F.lit(m1[0]), F.lit(m1[1])))).withColumn(
        "m2_valuenum", F.explode(F.sequence(F.lit(m2[0]), F.lit(m2[1])))
    )


def with_mean_interval(df: DataFrame, preds: Sequence[str], confidence: float = 0.95) -> DataFrame:
    return df.withColumns(mean_interval(preds, confidence))


def with_average(df: DataFrame, preds: Sequence[str]) -> DataFrame:
    """Mean prediction alone, which is all that the ranking needs."""
    return df.withColumn("average_pred", mean_interval(preds)["average_pred"])


def lowest_points(scored: DataFrame, key: str, k: int = TARGET_POINTS) -> DataFrame:
    """The k points of lowest mean prediction per case; ties go to the lower m1, then m2.

    For points of any kind. Spark limits each partition to k rows per case before it shuffles.
    """
    order = Window.partitionBy(key).orderBy(
        F.round("average_pred", TIE_DIGITS), "m1_valuenum", "m2_valuenum"
    )
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def target_points(scored: DataFrame, key: str, k: int = TARGET_POINTS) -> DataFrame:
    """Target of each case: the mean of its k lowest points, of any kind."""
    return (
        lowest_points(scored, key, k)
        .groupBy(key)
        .agg(F.avg("m1_valuenum").alias("optimal_m1"), F.avg("m2_valuenum").alias("optimal_m2"))
    )


def grid_target_points(
    scored: DataFrame,
    key: str,
    k: int = TARGET_POINTS,
    m1: tuple[int, int] = M1_GRID,
    m2: tuple[int, int] = M2_GRID,
) -> DataFrame:
    """As `target_points`, for the whole numbers of a grid and predictions from 0 to 1.

    Prediction and point become one number that sorts like the three of them. A case then is an
    array of as many numbers as the grid has points, which is far cheaper to sort than rows.
    Points without a prediction (NULL or NaN) are no candidates; a case without any has NULL targets.
    """
    wide = m2[1] - m2[0] + 1
    points = (m1[1] - m1[0] + 1) * wide
    level = F.floor(null_if_nan("average_pred") * 10.0**TIE_DIGITS + 0.5)
    place = (F.col("m1_valuenum") - m1[0]) * wide + (F.col("m2_valuenum") - m2[0])
    codes = scored.select(key, (level * points + place).alias("_code"))
    lowest = codes.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("_code")), 1, k).alias("_codes"))

    def mean(of) -> Column:
        total = F.aggregate("_codes", F.lit(0).cast("bigint"), lambda acc, c: acc + of(F.pmod(c, F.lit(points))))
        return F.try_divide(total.cast("double"), F.size("_codes"))

    return lowest.select(
        key,
        (mean(lambda place: F.floor(place / wide)) + m1[0]).alias("optimal_m1"),
        (mean(lambda place: F.pmod(place, F.lit(wide))) + m2[0]).alias("optimal_m2"),
    )


def optimal_targets(
    cases: DataFrame, key: str, score: Scorer, preds: Sequence[str], k: int = TARGET_POINTS
) -> DataFrame:
    """Targets of all cases. `score` adds the prediction columns named in `preds`."""
    return grid_target_points(with_average(score(with_grid(cases, key)), preds), key, k)


def model_targets(
    cases: DataFrame,
    key: str,
    models: Sequence,
    k: int = TARGET_POINTS,
    m1: tuple[int, int] = M1_GRID,
    m2: tuple[int, int] = M2_GRID,
) -> DataFrame:
    """Targets of all cases under trained pipelines, from their surfaces; one row per row of `cases`.

    The grid is unfolded only for models whose surface is not known (see `surfaces.search`).
    """
    found = surfaces.search(cases, key, models, m1, m2, k, TIE_DIGITS)
    if found is not None:
        return found
    preds = [f"pred_{i}" for i in range(len(models))]
    scored = with_average(learners.scorer(models)(with_grid(cases, key, m1, m2)), preds)
    return grid_target_points(scored, key, k, m1, m2)


def _risk_at(df: DataFrame, m1: str, m2: str, score: Scorer, preds: Sequence[str], how: str, out: str):
    """Adds the risk at the point (m1, m2): by the last model, or the mean of all."""
    kept = df.columns
    placed = df.withColumnsRenamed(
        {c: f"_kept_{c}" for c in ("m1_valuenum", "m2_valuenum") if c in kept}
    )
    m1, m2 = (f"_kept_{c}" if c in ("m1_valuenum", "m2_valuenum") else c for c in (m1, m2))
    scored = score(placed.withColumns({"m1_valuenum": F.col(m1), "m2_valuenum": F.col(m2)}))
    risk: Column = F.col(preds[-1]) if how == "last" else mean_interval(preds)["average_pred"]
    back = [
        F.col(f"_kept_{c}").alias(c) if c in ("m1_valuenum", "m2_valuenum") else F.col(c) for c in kept
    ]
    return scored.select(*back, risk.alias(out))


def counterfactual_risk(
    cases: DataFrame, score: Scorer, preds: Sequence[str], risk_model: str = "last"
) -> DataFrame:
    """Adds actual_risk at (m1_valuenum, m2_valuenum) and optimal_risk at (optimal_m1, optimal_m2)."""
    if risk_model not in ("last", "mean"):
        raise ValueError(f"risk_model must be 'last' or 'mean', not {risk_model!r}")
    actual = _risk_at(cases, "m1_valuenum", "m2_valuenum", score, preds, risk_model, "actual_risk")
    return _risk_at(actual, "optimal_m1", "optimal_m2", score, preds, risk_model, "optimal_risk")


def target_report(
    cases: DataFrame,
    key: str,
    outcome: str,
    score: Scorer,
    preds: Sequence[str],
    k: int = TARGET_POINTS,
    risk_model: str = "last",
    targets: DataFrame | None = None,
) -> DataFrame:
    """(case_id, hr, bp, optimal_hr, optimal_bp, actual_risk, optimal_risk, mortality).

    `targets` (key, optimal_m1, optimal_m2) may be given; else the grid is unfolded and scored.
    """
    if targets is None:
        targets = optimal_targets(cases, key, score, preds, k)
    risks = counterfactual_risk(cases.join(targets, key), score, preds, risk_model)
    return risks.select(
        F.col(key).alias("case_id"),
        F.col("m1_valuenum").alias("hr"),
        F.col("m2_valuenum").alias("bp"),
        F.col("optimal_m1").alias("optimal_hr"),
        F.col("optimal_m2").alias("optimal_bp"),
        "actual_risk",
        "optimal_risk",
        F.col(outcome).alias("mortality"),
    )


def safe_zones(scored: DataFrame, by: Sequence[str], limit: float) -> DataFrame:
    """Extent of the grid region whose mean risk stays within a limit."""
    inside = scored.filter(F.round("average_pred", TIE_DIGITS) <= limit)
    return inside.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("m1_valuenum").alias("m1_low"),
        F.max("m1_valuenum").alias("m1_high"),
        F.min("m2_valuenum").alias("m2_low"),
        F.max("m2_valuenum").alias("m2_high"),
    )
