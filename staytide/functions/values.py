"""Missing values, numeric text, body measures, rates and ensemble intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers as text. Spark alone would also take '1.0d'; this pattern keeps such text out.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: Column | str) -> Column:
    """NaN sorts above every number in Spark, so a missing value must be NULL."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def is_number(c: Column | str) -> Column:
    return as_col(c).rlike(NUMBER)


def number(c: Column | str) -> Column:
    """Text as a double; text that is no number becomes NULL."""
    return F.when(is_number(c), as_col(c).try_cast("double"))


def in_range(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Plausible values, both ends included; a missing value is never plausible."""
    c = as_col(c)
    test = c.isNotNull() & ~F.isnan(c)
    if low is not None:
        test = test & (c >= low)
    if high is not None:
        test = test & (c <= high)
    return test


def body_mass_index(height_cm: Column | str, weight_kg: Column | str) -> Column:
    metres = as_col(height_cm) / 100
    return F.try_divide(as_col(weight_kg), metres * metres)


def available(c: Column | str) -> Column:
    return as_col(c).isNotNull().cast("double")


def rate(part: Column | str, whole: Column | str) -> Column:
    """Share of a whole; NULL where the whole is zero."""
    return F.try_divide(as_col(part).cast("double"), as_col(whole).cast("double"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(as_col(c).cast("double"), digits)


def mean_interval(preds: Sequence[Column | str], confidence: float = 0.95) -> dict[str, Column]:
    """Row-wise mean of several predictions with its normal confidence interval.

    The spread is the sample deviation; all of it is column arithmetic, so nothing is shuffled.
    """
    cols = [as_col(p) for p in preds]
    n = len(cols)
    mean = sum(cols[1:], cols[0]) / n
    squares = [(c - mean) * (c - mean) for c in cols]
    deviation = F.sqrt(sum(squares[1:], squares[0]) / (n - 1))
    margin = NormalDist().inv_cdf((1 + confidence) / 2) / math.sqrt(n) * deviation
    return {
        "average_pred": mean,
        "lower_bound": mean - margin,
        "upper_bound": mean + margin,
        "ci_interval": 2 * margin,
    }
