"""Exact ranking metrics. Equal scores are counted first; no task sorts all scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.functions.radix import number_chunk
from staytide.operators.prefix import sums_before


def _known(score: str) -> Column:
    return F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))


def _score_table(df: DataFrame, by: Sequence[str], score: str, label: str, times: str | None = None) -> DataFrame:
    """Classes per distinct score. Rows without a score (NULL or NaN) are left out: see `missing_scores`.

    A row stands for `times` equal ones, if that is given.
    """

    def n(test: Column) -> Column:
        return F.sum(F.when(test, F.col(times)).otherwise(0)) if times else F.count_if(test)

    counts = (
        df.filter(_known(score))
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(n(F.col(label) == 1).alias("pos"), n(F.col(label) == 0).alias("neg"))
        .withColumn("_chunk", number_chunk("score"))
    )
    return sums_before(counts, by, "_chunk", ["score"], {"pos_below": "pos", "neg_below": "neg"})


def roc_auc(df: DataFrame, by: Sequence[str], score: str, label: str, times: str | None = None) -> DataFrame:
    """Area under the ROC curve: (by, n_pos, n_neg, auc). Ties count half; one class alone gives NULL. A row counts `times`."""
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return (
        _score_table(df, by, score, label, times)
        .groupBy(*by)
        .agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("_won"))
        .select(
            *by,
            "n_pos",
            "n_neg",
            F.try_divide(F.col("_won"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"),
        )
    )


def missing_scores(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """(by, n_missing): rows without a score, which the metrics leave out."""
    missing = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    return df.groupBy(*by).agg(F.count_if(missing).alias("n_missing"))


def roc_curve(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """One row per distinct score, taken as threshold: (by, threshold, fpr, tpr). Rates are those of rows with a score."""
    table = _score_table(df, by, score, label)
    totals = (
        df.filter(_known(score))
        .groupBy(*by)
        .agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
        .withColumnsRenamed({c: f"_key_{c}" for c in by})
    )
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    joined = table.join(totals, same) if by else table.crossJoin(F.broadcast(totals))
    return joined.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide((F.col("_n") - F.col("neg_below")).cast("double"), F.col("_n")).alias("fpr"),
        F.try_divide((F.col("_p") - F.col("pos_below")).cast("double"), F.col("_p")).alias("tpr"),
    )


def balanced_accuracy(df: DataFrame, by: Sequence[str], score: str, label: str, cut: float = 0.5) -> DataFrame:
    """Mean of the two classes' recall; a score above the cut predicts class 1. Rows without a score are left out."""
    hit = (F.when(_known(score), F.col(score)) > cut).cast("double")
    return (
        df.groupBy(*by)
        .agg(
            F.avg(F.when(F.col(label) == 1, hit)).alias("_tpr"),
            F.avg(F.when(F.col(label) == 0, 1 - hit)).alias("_tnr"),
        )
        .select(*by, ((F.col("_tpr") + F.col("_tnr")) / 2).alias("balanced_accuracy"))
    )


def fold_metrics(
    df: DataFrame, by: Sequence[str], score: str, label: str, cut: float = 0.5
) -> DataFrame:
    """AUC and balanced accuracy of every fold (or other group, say (pw, mop, ow, fold)), in one pass."""
    above = F.col("score") > cut
    tpr = F.try_divide(F.sum(F.when(above, F.col("pos")).otherwise(0)), F.sum("pos"))
    tnr = F.try_divide(F.sum(F.when(above, 0).otherwise(F.col("neg"))), F.sum("neg"))
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return (
        _score_table(df, by, score, label)
        .groupBy(*by)
        .agg(
            F.sum("pos").alias("n_pos"),
            F.sum("neg").alias("n_neg"),
            F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
            ((tpr + tnr) / 2).alias("balanced_accuracy"),
        )
    )
