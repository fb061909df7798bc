"""Deaths and survivors per hour after admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staytide.functions.values import rate

LAST_HOUR = 96


def _with_rates(counts: DataFrame) -> DataFrame:
    total = F.col("n_expired") + F.col("n_survival")
    return counts.select(
        "hour",
        "n_expired",
        "n_survival",
        F.log1p("n_expired").alias("log_n_expired"),
        F.log1p("n_survival").alias("log_n_survival"),
        rate("n_expired", total).alias("expired_rate"),
        rate("n_survival", total).alias("survival_rate"),
    )


def _per_hour(counts: DataFrame, last_hour: int) -> DataFrame:
    """All hours from 0 on; hours without rows get zeros."""
    hours = counts.sparkSession.range(last_hour + 1).select(F.col("id").alias("hour"))
    return hours.join(counts, "hour", "left").fillna(0, ["n_expired", "n_survival"])


def events_by_hour(
    events: DataFrame, key: str, offset: str, expired: str, hour: int, last_hour: int = LAST_HOUR
) -> DataFrame:
    """Stays with an event in hour t = [t, t+1), split by outcome."""
    counts = (
        events.filter((F.col(offset) >= 0) & (F.col(offset) < (last_hour + 1) * hour))
        .select(key, F.floor(F.col(offset) / hour).alias("hour"), expired)
        .distinct()
        .groupBy("hour")
        .agg(
            F.count_if(F.col(expired) == 1).alias("n_expired"),
            F.count_if(F.col(expired) == 0).alias("n_survival"),
        )
    )
    return _with_rates(_per_hour(counts, last_hour))


def at_risk(
    stays: DataFrame, key: str, length: str, expired: str, hour: int, last_hour: int = LAST_HOUR
) -> DataFrame:
    """Stays that last through hour t, that is at least t+1 hours, split by outcome.

    Stays are counted once by their whole hours; the curve is the running sum of those few
    counts from the last hour down.
    """
    lasted = (
        stays.filter(F.col(length) >= hour)
        .groupBy(key)
        .agg(F.max(length).alias("_length"), F.max(expired).alias("_expired"))
        .select(F.least(F.floor(F.col("_length") / hour) - 1, F.lit(last_hour)).alias("hour"), "_expired")
        .groupBy("hour")
        .agg(
            F.count_if(F.col("_expired") == 1).alias("n_expired"),
            F.count_if(F.col("_expired") == 0).alias("n_survival"),
        )
    )
    later = Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, 0)
    curve = _per_hour(lasted, last_hour).select(
        "hour",
        F.sum("n_expired").over(later).alias("n_expired"),
        F.sum("n_survival").over(later).alias("n_survival"),
    )
    return _with_rates(curve)
