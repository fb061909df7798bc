"""Adherence to targets, and matched comparison groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staytide.functions.radix import number_chunk
from staytide.functions.values import null_if_nan
from staytide.operators.learners import fit, predict
from staytide.operators.prefix import row_ranks
from staytide.session import materialize

# Targets of current practice.
FIXED_M1 = 80
FIXED_M2 = 120


def distance(m1: Column, m2: Column, to_m1: Column, to_m2: Column) -> Column:
    return F.sqrt((m1 - to_m1) ** 2 + (m2 - to_m2) ** 2)


def with_adherence(df: DataFrame, tolerance: float) -> DataFrame:
    """Adds 0/1 columns: within a distance of the case's own target, and of the fixed target."""
    m1, m2 = F.col("m1_valuenum"), F.col("m2_valuenum")
    own = distance(m1, m2, F.col("optimal_m1"), F.col("optimal_m2"))
    fixed = distance(m1, m2, F.lit(FIXED_M1), F.lit(FIXED_M2))
    return df.withColumns(
        {
            "keeps_dynamic": (own <= tolerance).cast("int"),
            "keeps_fixed": (fixed <= tolerance).cast("int"),
        }
    )


def propensity(df: DataFrame, covariates: Sequence[str], treated: str) -> DataFrame:
    """Adds `propensity`, the fitted probability of treatment."""
    return predict(fit("logistic", df, covariates, treated), df, "propensity")


def match_nearest(df: DataFrame, key: str, treated: str, score: str = "propensity") -> DataFrame:
    """Each treated row with the control of nearest score: (key, control, gap).

    Controls may serve several rows; ties go to the lower score, then the lower key. A control without score
    serves none, and a treated row without score, or without any control, has a NULL control. Distinct
    scores are sorted by chunk, and the nearest control below and above is carried along them,
    so neither all scores nor all pairs meet in one task.
    """
    rows = df.select(
        F.col(key), F.col(treated).cast("int").alias("_treated"), null_if_nan(F.col(score).cast("double")).alias("_score")
    )
    scores = (
        rows.filter(F.col("_score").isNotNull())
        .groupBy("_score")
        .agg(F.min(F.when(F.col("_treated") == 0, F.col(key))).alias("_lowest"), F.max("_treated").alias("_asks"))
        .withColumn("_chunk", number_chunk("_score"))
        .withColumn("_here", F.when(F.col("_lowest").isNotNull(), F.struct("_score", "_lowest")))
    )
    # frames that end at the current row cost one pass; upwards and downwards each
    so_far = (Window.unboundedPreceding, 0)
    earlier = (Window.unboundedPreceding, -1)
    ends = scores.groupBy("_chunk").agg(F.min("_here").alias("_low"), F.max("_here").alias("_high"))
    carried = ends.select(
        F.col("_chunk"),
        F.last("_high", True).over(Window.orderBy("_chunk").rowsBetween(*earlier)).alias("_chunk_below"),
        F.last("_low", True).over(Window.orderBy(F.desc("_chunk")).rowsBetween(*earlier)).alias("_chunk_above"),
    )
    chunk = Window.partitionBy("_chunk")
    near = (
        scores.select(
            "*",
            F.last("_here", True).over(chunk.orderBy("_score").rowsBetween(*so_far)).alias("_below"),
            F.last("_here", True).over(chunk.orderBy(F.desc("_score")).rowsBetween(*so_far)).alias("_above"),
        )
        .filter(F.col("_asks") == 1)
        .join(carried, "_chunk")
        .select(
            "_score",
            F.coalesce("_below", "_chunk_below").alias("_below"),
            F.coalesce("_above", "_chunk_above").alias("_above"),
        )
    )
    down = F.col("_score") - F.col("_below._score")
    up = F.col("_above._score") - F.col("_score")
    take_below = F.col("_above").isNull() | (down <= up)
    chosen = near.select(
        "_score",
        F.when(take_below, F.col("_below._lowest")).otherwise(F.col("_above._lowest")).alias("control"),
        F.when(take_below, down).otherwise(up).alias("gap"),
    )
    return rows.filter(F.col("_treated") == 1).join(chosen, "_score", "left").select(key, "control", "gap")


def _carried(scores: DataFrame, name: str, test: Column, down: bool) -> tuple[Column, Column, Column]:
    """For the nearest score that passes a test, below (or above) a row: within the chunk, at a chunk's end, and over earlier chunks."""
    order = (lambda c: F.col(c)) if down else (lambda c: F.desc(c))
    value = F.when(test, F.col("_score"))
    own = F.last(value, True).over(Window.partitionBy("_chunk").orderBy(order("_score")).rowsBetween(Window.unboundedPreceding, -1))
    end = (F.max if down else F.min)(value).alias(f"_end_{name}")
    over = F.last(f"_end_{name}", True).over(Window.orderBy(order("_chunk")).rowsBetween(Window.unboundedPreceding, -1))
    return own.alias(f"_own_{name}"), end, over.alias(f"_far_{name}")


def _wanted(free: DataFrame, caliper: float) -> DataFrame:
    """Each free score with the nearest one of the other side within the caliper, `_partner`; the lower one of two as near."""
    placed = free.withColumn("_chunk", number_chunk("_score"))
    sides = {f"{side}_{way}": (F.col("_treated") == t, way == "down") for side, t in (("t", 1), ("c", 0)) for way in ("down", "up")}
    parts = {n: _carried(placed, n, *test) for n, test in sides.items()}
    ends = placed.groupBy("_chunk").agg(*[p[1] for p in parts.values()])
    far = ends.select("_chunk", *[p[2] for p in parts.values()])
    near = placed.select("*", *[p[0] for p in parts.values()]).join(far, "_chunk")

    def other(way: str) -> Column:
        t, c = (F.coalesce(f"_own_{s}_{way}", f"_far_{s}_{way}") for s in ("t", "c"))
        return F.when(F.col("_treated") == 1, c).otherwise(t)

    down, up = F.col("_score") - F.col("_below"), F.col("_above") - F.col("_score")
    nearest = F.when(F.col("_above").isNull() | (down <= up), F.col("_below")).otherwise(F.col("_above"))
    chosen = near.withColumns({"_below": other("down"), "_above": other("up")}).withColumn("_partner", nearest)
    return chosen.select(*free.columns, "_partner").filter(F.abs(F.col("_partner") - F.col("_score")) <= caliper)


def match_without_replacement(df: DataFrame, key: str, treated: str, caliper: float, score: str = "propensity") -> DataFrame:
    """(key, control, gap): treated rows with a control of their own, no further off than the caliper.

    The pairs are those of the greedy rule: of all free pairs the one of the smallest gap, then lowest treated score, then lowest
    control score goes first; rows of one score go in the order of a hash of their key. Rows without a score, and
    treated rows that are left over, are not returned.

    Equal scores of both sides pair off first. Then, in rounds, each distinct score asks for the nearest free one of the
    other side, and those that ask for each other pair off, as many rows as both have: such a pair is the smallest of either,
    so greed takes it too. Scores that nobody is near drop out. Scores are sorted by chunk, and rounds go on with what
    is left, written to the shared folder.
    """
    value = null_if_nan(F.col(score).cast("double"))
    rows = df.select(F.col(key), F.col(treated).cast("int").alias("_treated"), value.alias("_score"), F.xxhash64(key).alias("_hash"))
    rows = rows.filter(F.col("_score").isNotNull() & F.col("_treated").isin(0, 1))
    # a score may be that of a third of all rows: they are ranked by chunks of their hashes
    ranked = materialize(row_ranks(rows.withColumn("_chunk", F.shiftright("_hash", 52)), ["_score", "_treated"], "_chunk", ["_hash", key], "_rank"), "ranked")
    counts = ranked.groupBy("_score").agg(F.count_if(F.col("_treated") == 1).alias("_t"), F.count_if(F.col("_treated") == 0).alias("_c"))
    both = F.least("_t", "_c")
    zero = F.lit(0).cast("bigint")
    pairs = [counts.filter(both > 0).select(F.col("_score").alias("_ts"), F.col("_score").alias("_cs"), both.alias("_n"), zero.alias("_tf"), zero.alias("_cf"))]
    left = F.greatest("_t", "_c") - both
    free = counts.filter(left > 0).select("_score", (F.col("_t") > F.col("_c")).cast("int").alias("_treated"), left.alias("_left"), both.alias("_from"))
    while True:
        wanted = materialize(_wanted(free, caliper), "wanted")
        asks, asked = wanted.filter("_treated = 1"), wanted.filter("_treated = 0")
        c = asked.select(*[F.col(x).alias(f"_other{x}") for x in ("_score", "_partner", "_left", "_from")])
        mutual = asks.join(c, (F.col("_partner") == F.col("_other_score")) & (F.col("_other_partner") == F.col("_score")))
        n = F.least("_left", "_other_left")
        new = materialize(
            mutual.select(F.col("_score").alias("_ts"), F.col("_other_score").alias("_cs"), n.alias("_n"), F.col("_from").alias("_tf"), F.col("_other_from").alias("_cf")),
            "matched",
        )
        if new.isEmpty():
            break
        pairs.append(new)
        # a score is of one side only by now
        taken = new.select(F.col("_ts").alias("_score"), "_n").unionByName(new.select(F.col("_cs").alias("_score"), "_n"))
        n = F.coalesce("_n", zero)
        rest = wanted.join(taken, "_score", "left").withColumns({"_left": F.col("_left") - n, "_from": F.col("_from") + n})
        free = rest.filter("_left > 0").select(*free.columns)
    runs = reduce(DataFrame.unionByName, pairs)
    inside = (F.col("_score") == F.col("_ts")) & (F.col("_rank") >= F.col("_tf")) & (F.col("_rank") < F.col("_tf") + F.col("_n"))
    asking = ranked.filter("_treated = 1").join(runs, inside).select(key, "_ts", "_cs", (F.col("_cf") + F.col("_rank") - F.col("_tf")).alias("_cr"))
    controls = ranked.filter("_treated = 0").select(F.col(key).alias("control"), F.col("_score").alias("_of"), F.col("_rank").alias("_ofrank"))
    met = asking.join(controls, (F.col("_cs") == F.col("_of")) & (F.col("_cr") == F.col("_ofrank")))
    return met.select(key, "control", F.abs(F.col("_ts") - F.col("_cs")).alias("gap"))


def matched_outcomes(df: DataFrame, pairs: DataFrame, key: str, outcome: str) -> DataFrame:
    """Outcome rates of treated rows and of their matched controls: (n_pairs, treated_rate, control_rate)."""
    outcomes = df.select(F.col(key), F.col(outcome).cast("double").alias("_treated_outcome"))
    controls = outcomes.withColumnsRenamed({key: "control", "_treated_outcome": "_control_outcome"})
    return (
        pairs.join(outcomes, key)
        .join(controls, "control")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.avg("_treated_outcome").alias("treated_rate"),
            F.avg("_control_outcome").alias("control_rate"),
        )
    )
