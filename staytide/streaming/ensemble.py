"""The temporal ensemble: each case is scored by the cohort model of the last moment of prediction that it has reached."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.functions.values import as_col
from staytide.operators.asof import asof_join


def latest_moment(offset: Column | str, moments: Sequence[int], unit: int) -> Column:
    """The last moment of prediction that has been reached, in hours; NULL before the first one."""
    options = F.array(*[F.lit(m) for m in sorted(moments)])
    return F.array_max(F.filter(options, lambda m: m * F.lit(unit) <= as_col(offset)))


def ensemble_scores(
    cases: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    offset: str,
    moment: str,
    features: Sequence[str],
    unit: int,
    out: str = "pred_prob",
) -> DataFrame:
    """Cases with `moment` and the probability of that moment's logistic model; NULL before the first moment, or with a gap in the features.

    `models` has the keys (a source, say), the moment in units since admission, and `weights`: intercept and a weight per
    feature, on the features' own scale. The models' table is joined by time, and goes with the rows as their own weights.
    """
    timed = models.select(*keys, moment, "weights", (F.col(moment) * unit).cast("bigint").alias("_from"))
    found = asof_join(cases, timed, keys, offset, "_from", [moment, "weights"], unit)
    total = F.col("weights")[0]
    for i, f in enumerate(features):
        total = total + F.col("weights")[i + 1] * F.nanvl(F.col(f).cast("double"), F.lit(None))
    return found.withColumn(out, 1 / (1 + F.exp(-total))).drop("weights")


def logistic_weights(models: DataFrame, scale: dict[str, tuple[float, float]], features: Sequence[str], weights: str = "_w") -> Column:
    """Weights of `grouped.fit_logistic`, which are on scaled features, on the features' own scale."""
    slopes = [F.col(weights)[i + 1] / (scale[f][1] or 1.0) for i, f in enumerate(features)]
    intercept = F.col(weights)[0]
    for f, slope in zip(features, slopes):
        intercept = intercept - slope * scale[f][0]
    return F.array(intercept, *slopes)
