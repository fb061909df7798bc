"""Queries: folds, learners, metrics, target search, and what builds on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from staytide.functions import clock
from staytide.operators import cohort, folds, grouped, learners, matching, metrics, regions, resample, search, targets
from staytide.plans.basics import _offsets, big, case_medians, r6
from staytide.plans.registry import AVERAGE_SQL, query, risk_sql
from staytide.schemas import HOUR_US
from staytide.session import materialize, shared_dir
from staytide.sources import batches, tables
from staytide.sources.tables import ORDER_FEATURES, PREDS, surface
from staytide.streaming import alerts as A
from staytide.streaming import episodes as E
from staytide.streaming.ensemble import ensemble_scores, latest_moment

# --- folds -------------------------------------------------------------------------------

_FOLD_SQL = """
    SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BIGINT) AS label,
           (row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY md5(concat(o_orderkey, '|42')), o_orderkey) - 1) % 5 AS fold
    FROM orders"""


def _order_folds(spark, sf):
    orders = tables.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("bigint").alias("label")
    )
    return folds.stratified_folds(orders, "o_orderkey", "label")


@query("stratified_kfold", _FOLD_SQL)
def stratified_kfold(spark, sf):
    return _order_folds(spark, sf).withColumn("fold", big("fold"))


@query(
    "contiguous_kfold",
    "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS fold FROM orders",
)
def contiguous_kfold(spark, sf):
    out = folds.contiguous_folds(tables.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return out.withColumn("fold", big("fold"))


@query(
    "train_test_counts",
    f"""
    WITH f AS ({_FOLD_SQL})
    SELECT k.k AS fold, label, COUNT(*) FILTER (WHERE f.fold <> k.k) AS n_train, COUNT(*) FILTER (WHERE f.fold = k.k) AS n_test
    FROM f CROSS JOIN (SELECT unnest(range(0, 5)) AS k) k GROUP BY ALL""",
)
def train_test_counts(spark, sf):
    # counted per fold and label first; only those few rows meet every fold
    per_fold = _order_folds(spark, sf).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))
    marked = per_fold.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn(
        "subset", F.when(F.col("fold") == F.col("k"), "test").otherwise("train")
    )
    return marked.groupBy(big("k").alias("fold"), "label").agg(
        F.sum(F.when(F.col("subset") == "train", F.col("n")).otherwise(0)).alias("n_train"),
        F.sum(F.when(F.col("subset") == "test", F.col("n")).otherwise(0)).alias("n_test"),
    )


# --- metrics -----------------------------------------------------------------------------


def _docs(spark, sf):
    return tables.scored_documents(spark, sf).select(
        "doc_id", "source", "quality", "toxic", F.col("n_chars").cast("double").alias("score")
    )


_AUC_SQL = """
    SELECT {by} COUNT(*) FILTER (WHERE quality = 1) AS n_pos, COUNT(*) FILTER (WHERE quality = 0) AS n_neg,
           (SUM(rk) FILTER (WHERE quality = 1) - COUNT(*) FILTER (WHERE quality = 1)::DOUBLE * (COUNT(*) FILTER (WHERE quality = 1) + 1) / 2)
           / nullif(COUNT(*) FILTER (WHERE quality = 1)::DOUBLE * COUNT(*) FILTER (WHERE quality = 0), 0) AS auc
    FROM (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY n_chars)
                 + (COUNT(*) OVER (PARTITION BY {part}, n_chars) - 1) / 2.0::DOUBLE AS rk FROM f_docs) GROUP BY {group}"""


@query(
    "roc_auc",
    "SELECT n_pos, n_neg, ROUND(auc, 6) AS auc FROM (" + _AUC_SQL.format(by="", part="1", group="()") + ")",
)
def roc_auc(spark, sf):
    return metrics.roc_auc(_docs(spark, sf), [], "score", "quality").withColumn("auc", r6("auc"))


@query(
    "roc_curve",
    """
    SELECT CAST(n_chars AS DOUBLE) AS threshold,
           ROUND((SELECT COUNT(*) FROM f_docs b WHERE b.n_chars >= a.n_chars AND b.quality = 0)::DOUBLE
                 / (SELECT COUNT(*) FROM f_docs WHERE quality = 0), 6) AS fpr,
           ROUND((SELECT COUNT(*) FROM f_docs b WHERE b.n_chars >= a.n_chars AND b.quality = 1)::DOUBLE
                 / (SELECT COUNT(*) FROM f_docs WHERE quality = 1), 6) AS tpr
    FROM (SELECT DISTINCT n_chars FROM f_docs) a""",
)
def roc_curve(spark, sf):
    out = metrics.roc_curve(_docs(spark, sf), [], "score", "quality")
    return out.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query(
    "balanced_accuracy",
    """
    SELECT ROUND((AVG(CAST(n_chars > 900 AS DOUBLE)) FILTER (WHERE quality = 1)
                + AVG(CAST(n_chars <= 900 AS DOUBLE)) FILTER (WHERE quality = 0)) / 2, 6) AS balanced_accuracy FROM f_docs""",
)
def balanced_accuracy(spark, sf):
    out = metrics.balanced_accuracy(_docs(spark, sf), [], "score", "quality", cut=900)
    return out.withColumn("balanced_accuracy", r6("balanced_accuracy"))


@query(
    "fold_metrics",
    "WITH a AS (" + _AUC_SQL.format(by="source,", part="source", group="source") + "),"
    """
    b AS (SELECT source, (AVG(CAST(n_chars > 900 AS DOUBLE)) FILTER (WHERE quality = 1)
                + AVG(CAST(n_chars <= 900 AS DOUBLE)) FILTER (WHERE quality = 0)) / 2 AS ba FROM f_docs GROUP BY source)
    SELECT source AS fold, n_pos, n_neg, ROUND(coalesce(auc, -1), 6) AS auc, ROUND(coalesce(ba, -1), 6) AS balanced_accuracy
    FROM a JOIN b USING (source)""",
)
def fold_metrics(spark, sf):
    out = metrics.fold_metrics(_docs(spark, sf), ["source"], "score", "quality", cut=900)
    return out.select(
        F.col("source").alias("fold"),
        "n_pos",
        "n_neg",
        *[r6(F.coalesce(c, F.lit(-1.0))).alias(c) for c in ("auc", "balanced_accuracy")],
    )


@query(
    "first_fold_prediction",
    f"""
    SELECT stay_id, ROUND({risk_sql(0)}, 6) AS pred_prob, CAST(stay_id % 3 = 0 AS BIGINT) AS gt_label FROM f_medians""",
)
def first_fold_prediction(spark, sf):
    cases = surface(case_medians(spark, sf)).withColumn("gt_label", big(F.col("stay_id") % 3 == 0))
    by_fold = F.array(*[F.struct(F.lit(k).alias("fold"), F.col(p).alias("pred_prob")) for k, p in enumerate(PREDS)])
    every = cases.select("stay_id", "gt_label", F.inline(by_fold))
    out = folds.first_per_key(every, ["stay_id"], ["fold"])
    return out.select("stay_id", r6("pred_prob").alias("pred_prob"), "gt_label")


# --- resampling --------------------------------------------------------------------------


def _vectors(spark, sf):
    return tables.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") == 0).cast("int").alias("label")
    )


@query(
    "smote_neighbors",
    """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = 0),
    d AS (SELECT a.vec_id, b.vec_id AS neighbor, list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
          FROM v a JOIN v b ON a.vec_id <> b.vec_id)
    SELECT vec_id, neighbor, ROUND(d2, 6) AS distance2, rn AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbor) AS rn FROM d) WHERE rn <= 5""",
)
def smote_neighbors(spark, sf):
    small = _vectors(spark, sf).filter(F.col("label") == 1)
    out = resample.nearest_neighbors(small, "vec_id", "vec", k=5)
    return out.select("vec_id", "neighbor", r6("distance2").alias("distance2"), big("rank").alias("rank"))


@query(
    "smote_oversample",
    """
    SELECT label, n AS n_rows, n - real AS n_synthetic FROM (
      SELECT CAST(0 AS BIGINT) AS label, COUNT(*) FILTER (WHERE label <> 0) AS n, COUNT(*) FILTER (WHERE label <> 0) AS real FROM embeddings
      UNION ALL
      SELECT 1, GREATEST(COUNT(*) FILTER (WHERE label <> 0), COUNT(*) FILTER (WHERE label = 0)), COUNT(*) FILTER (WHERE label = 0)
      FROM embeddings)""",
)
def smote_oversample(spark, sf):
    out = resample.oversample(_vectors(spark, sf), "vec_id", "vec", "label")
    return out.groupBy(big("label").alias("label")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("base").isNotNull()).alias("n_synthetic")
    )


@query("smote_rows")
def smote_rows(spark, sf):
    return resample.oversample(_vectors(spark, sf), "vec_id", "vec", "label")


# --- learners ----------------------------------------------------------------------------


def _with_outcome(rows):
    """A label that follows two features but for one row in twenty, and gaps in a third."""
    high = F.col("quantity") + 10 * F.col("n_returned") > 110
    flipped = F.col("o_orderkey") % 20 == 0
    return rows.withColumns(
        {"label": (high != flipped).cast("int"), "discount": F.when(F.col("o_orderkey") % 9 != 4, F.col("discount"))}
    )


def _training(spark, sf):
    """Orders with features and folds, written once: five models read it."""
    rows = folds.stratified_folds(_with_outcome(tables.order_features(spark, sf)), "o_orderkey", "label")
    return materialize(rows, "training")


# the published sizes are the defaults of the library; queries train small models
_BOOSTED = {"rounds": 5, "learning_rate": 0.1}
_FOREST = {"trees": 20}


def _fold_auc(spark, sf, learner, **settings):
    rows = _training(spark, sf)
    models = learners.train_folds(rows, ORDER_FEATURES, "label", learner=learner, **settings)
    scored = learners.out_of_fold(models, rows)
    return _banded(metrics.fold_metrics(scored, ["fold"], "score", "label"), "fold")


def _banded(found, fold):
    """What is certain of the metrics: the counts, and that the AUC is high, as the labels follow the features.

    A constant scorer has 0.5. How many rounds, trees or steps a learner takes is its setting; folds and rows are whole.
    """
    return found.select(big(fold).alias(fold), "n_pos", "n_neg", (F.col("auc") > 0.75).alias("auc_high"))


_OUTCOME_SQL = """
    SELECT o_orderkey, o_custkey, CAST((q + 10 * r > 110) <> (o_orderkey % 20 = 0) AS BIGINT) AS label
    FROM orders JOIN (SELECT l_orderkey, SUM(l_quantity) AS q, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey)
      ON o_orderkey = l_orderkey"""
_TRAINING_SQL = f"""
    SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(concat(o_orderkey, '|42')), o_orderkey) - 1) % 5 AS fold
    FROM ({_OUTCOME_SQL})"""
_COUNTS_SQL = "COUNT(*) FILTER (WHERE label = 1) AS n_pos, COUNT(*) FILTER (WHERE label = 0) AS n_neg, TRUE AS auc_high"
_FOLD_AUC_SQL = f"SELECT fold, {_COUNTS_SQL} FROM ({_TRAINING_SQL}) GROUP BY fold"


@query("gbt_fold_auc", _FOLD_AUC_SQL)
def gbt_fold_auc(spark, sf):
    return _fold_auc(spark, sf, "boosted", **_BOOSTED)


@query("rf_fold_auc", _FOLD_AUC_SQL)
def rf_fold_auc(spark, sf):
    return _fold_auc(spark, sf, "forest", **_FOREST)


@query("svc_fold_auc", _FOLD_AUC_SQL)
def svc_fold_auc(spark, sf):
    return _fold_auc(spark, sf, "svc", maxIter=10)


_SEARCH_ROUNDS = [1, 2, 3, 4, 5]


@query(
    "grid_search",
    f"""
    SELECT CAST(o AS BIGINT) AS outer_fold, learning_rate, rounds, CAST(1 AS BIGINT) AS n_best, TRUE AS auc_high
    FROM (SELECT unnest(range(0, 5)) AS o) CROSS JOIN (SELECT unnest({learners.SEARCH_GRID["learning_rate"]}::DOUBLE[]) AS learning_rate)
    CROSS JOIN (SELECT CAST(unnest({_SEARCH_ROUNDS}) AS BIGINT) AS rounds)""",
)
def grid_search(spark, sf):
    """All rates and five numbers of rounds within each outer fold, one of them the best there."""
    found = search.nested_search(_training(spark, sf), ORDER_FEATURES, "label", rounds=_SEARCH_ROUNDS)
    n_best = F.count_if("best").over(Window.partitionBy("outer"))
    return found.select(
        big("outer").alias("outer_fold"),
        "learning_rate",
        big("rounds").alias("rounds"),
        n_best.alias("n_best"),
        (F.col("auc") > 0.7).alias("auc_high"),
    )


@query(
    "prediction_table",
    f"""
    SELECT CAST(k AS BIGINT) AS model_fold, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS subset, label AS gt,
           COUNT(*) AS n_rows, COUNT(*) AS n_probabilities, COUNT(*) AS n_consistent
    FROM ({_TRAINING_SQL}) CROSS JOIN (SELECT unnest(range(0, 5)) AS k) GROUP BY ALL""",
)
def prediction_table(spark, sf):
    """All rows under all models; probabilities lie within 0 and 1, and the class follows them."""
    rows = _training(spark, sf)
    models = learners.train_folds(rows, ORDER_FEATURES, "label", learner="logistic", maxIter=10)
    found = learners.prediction_table(models, rows, "o_orderkey", "label")
    p = F.col("y_pred_proba")
    return found.groupBy(big("model_fold").alias("model_fold"), "subset", big("gt").alias("gt")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(p.between(0, 1)).alias("n_probabilities"),
        F.count_if(F.col("y_pred") == (p > 0.5).cast("int")).alias("n_consistent"),
    )


@query(
    "external_evaluation",
    f"SELECT CAST(k AS BIGINT) AS model_fold, {_COUNTS_SQL} FROM ({_TRAINING_SQL}) CROSS JOIN (SELECT unnest(range(0, 5)) AS k) WHERE o_custkey % 2 = 1 GROUP BY k",
)
def external_evaluation(spark, sf):
    rows = _training(spark, sf)
    source, other = (rows.filter(F.col("o_custkey") % 2 == i) for i in (0, 1))
    models = learners.train_folds(source, ORDER_FEATURES, "label", learner="logistic", maxIter=10)
    scored = learners.external_predictions(models, other, "o_orderkey", "label")
    return _banded(metrics.fold_metrics(scored, ["model_fold"], "y_pred_proba", "gt"), "model_fold")


@query(
    "model_roundtrip",
    """
    SELECT COUNT(*) AS n_rows, COUNT(*) AS n_same_0, COUNT(*) AS n_same_1, COUNT(*) AS n_same_2, COUNT(*) AS n_same_3, COUNT(*) AS n_same_4
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def model_roundtrip(spark, sf):
    rows = _training(spark, sf)
    models = learners.train_folds(rows, ORDER_FEATURES, "label", learner="forest", trees=5)
    root = shared_dir(spark, "models")
    learners.save_models(models, root, "forest", 12, 18, 24)
    loaded = learners.load_models(spark, root, "forest", 12, 18, 24)
    scored = learners.scorer(loaded, "loaded_")(learners.scorer(models, "kept_")(rows))
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(f"kept_{i}") == F.col(f"loaded_{i}")).alias(f"n_same_{i}") for i in range(5)],
    )


# --- sweep -------------------------------------------------------------------------------

# Moments, windows and outcome spans of the published sweep, in hours.
SWEEP_MOMENTS = [3, 6, 12, 18, 24, 30, 36]
SWEEP_WINDOWS = [3, 6, 12]
SWEEP_OUTCOMES = [6, 12, 24, 48]
# the given events are sparse: one hour of the sweep is half a day of theirs
_SWEEP_UNIT = 12 * HOUR_US

_SWEEP_LABELS = ", ".join(
    f"MAX(CAST(coalesce(off_us + {h * _SWEEP_UNIT} >= death_us, FALSE) AS BIGINT)) AS l{h}" for h in SWEEP_OUTCOMES
)


def _sweep(spark, sf, moments, windows, outcomes):
    m1, m2 = _offsets(spark, sf)
    spans = clock.horizon_labels("off_us", "death_us", outcomes, unit_per_hour=_SWEEP_UNIT)
    labels = dict(zip(outcomes, spans))
    return cohort.sweep(
        m1.withColumns(spans), m2, ["stay_id"], "off_us", "value", labels, moments, windows, _SWEEP_UNIT
    )


@query(
    "sweep_cohorts",
    f"""
    WITH w AS (SELECT p.pw, m.mop FROM (SELECT unnest({SWEEP_WINDOWS}) AS pw) p JOIN (SELECT unnest({SWEEP_MOMENTS}) AS mop) m ON m.mop >= p.pw),
    a AS (SELECT stay_id, pw, mop, median(value) AS m1, {_SWEEP_LABELS} FROM f_off1 JOIN w
          ON off_us >= (mop - pw) * {_SWEEP_UNIT} AND off_us < mop * {_SWEEP_UNIT} GROUP BY ALL),
    b AS (SELECT stay_id, pw, mop, median(value) AS m2 FROM f_off2 JOIN w
          ON off_us >= (mop - pw) * {_SWEEP_UNIT} AND off_us < mop * {_SWEEP_UNIT} GROUP BY ALL),
    c AS (SELECT * FROM a JOIN b USING (stay_id, pw, mop)),
    o AS ({' UNION ALL '.join(f'SELECT stay_id, pw, mop, {h} AS ow, m1, m2, l{h} AS label FROM c' for h in SWEEP_OUTCOMES)})
    SELECT stay_id, CAST(pw AS BIGINT) AS pw, CAST(mop AS BIGINT) AS mop, CAST(ow AS BIGINT) AS ow,
           ROUND(m1, 6) AS m1_valuenum, ROUND(m2, 6) AS m2_valuenum, label FROM o""",
)
def sweep_cohorts(spark, sf):
    out = _sweep(spark, sf, SWEEP_MOMENTS, SWEEP_WINDOWS, SWEEP_OUTCOMES)
    return out.select(
        "stay_id",
        *[big(c).alias(c) for c in ("pw", "mop", "ow")],
        r6("m1_valuenum").alias("m1_valuenum"),
        r6("m2_valuenum").alias("m2_valuenum"),
        big("label").alias("label"),
    )


@query(
    "sweep_predictions",
    f"""
    WITH w AS (SELECT p.pw, m.mop FROM (SELECT unnest({SWEEP_WINDOWS}) AS pw) p JOIN (SELECT unnest({SWEEP_MOMENTS}) AS mop) m ON m.mop >= p.pw),
    a AS (SELECT stay_id, pw, mop, {_SWEEP_LABELS} FROM f_off1 JOIN w
          ON off_us >= (mop - pw) * {_SWEEP_UNIT} AND off_us < mop * {_SWEEP_UNIT} GROUP BY ALL),
    b AS (SELECT DISTINCT stay_id, pw, mop FROM f_off2 JOIN w
          ON off_us >= (mop - pw) * {_SWEEP_UNIT} AND off_us < mop * {_SWEEP_UNIT}),
    c AS (SELECT * FROM a JOIN b USING (stay_id, pw, mop)),
    o AS ({' UNION ALL '.join(f'SELECT stay_id, pw, mop, {h} AS ow, l{h} AS label FROM c' for h in SWEEP_OUTCOMES)}),
    n AS (SELECT pw, mop, ow, COUNT(*) FILTER (WHERE label = 1) AS n_pos, COUNT(*) FILTER (WHERE label = 0) AS n_neg
          FROM o WHERE stay_id % 2 = 1 GROUP BY ALL)
    SELECT CAST(pw AS BIGINT) AS pw, CAST(mop AS BIGINT) AS mop, CAST(ow AS BIGINT) AS ow, n_pos, n_neg,
           n_pos > 0 AND n_neg > 0 AS auc_known FROM n
    WHERE (pw, mop, ow) IN (SELECT (pw, mop, ow) FROM o WHERE stay_id % 2 = 0)""",
)
def sweep_predictions(spark, sf):
    """All windows, moments and spans with five folds each: models of the even stays score the odd ones.

    An AUC within 0 and 1 where both classes occur, by the first fold's model; NULL elsewhere.
    """
    found = _sweep_scores(spark, sf)
    known = F.coalesce(F.col("auc").between(0, 1), F.lit(False))
    return found.select(*[big(c).alias(c) for c in ("pw", "mop", "ow")], "n_pos", "n_neg", known.alias("auc_known"))


def _sweep_scores(spark, sf):
    rows = _sweep(spark, sf, SWEEP_MOMENTS, SWEEP_WINDOWS, SWEEP_OUTCOMES)
    cell, measures = ["pw", "mop", "ow"], ["m1_valuenum", "m2_valuenum"]
    rows = materialize(folds.stratified_folds(rows, "stay_id", "label"), "sweep")
    source, other = (rows.filter(F.col("stay_id") % 2 == i) for i in (0, 1))
    models, scale = grouped.fit_logistic(source, cell, measures, "label")
    scored = grouped.predict_logistic(other, models, scale, cell, measures)
    first = folds.first_per_key(
        scored.select("stay_id", *cell, "model_fold", "pred_prob", "label"), ["stay_id", *cell], ["model_fold"]
    )
    return metrics.roc_auc(first, cell, "pred_prob", "label")


# --- target search -----------------------------------------------------------------------


def _cases(spark, sf):
    return tables.stays(spark, sf).select("stay_id")


def _scored_grid(spark, sf):
    return targets.with_average(surface(targets.with_grid(_cases(spark, sf), "stay_id")), PREDS).select(
        "stay_id", "m1_valuenum", "m2_valuenum", "average_pred"
    )


@query(
    "grid_cross_join",
    """
    SELECT stay_id, COUNT(*) AS n_points, CAST(SUM(m1) AS BIGINT) AS sum_m1, CAST(SUM(m2) AS BIGINT) AS sum_m2, CAST(SUM(m1 * m2) AS BIGINT) AS sum_product
    FROM f_stays CROSS JOIN f_grid GROUP BY stay_id""",
)
def grid_cross_join(spark, sf):
    points = targets.with_grid(_cases(spark, sf), "stay_id")
    m1, m2 = big("m1_valuenum"), big("m2_valuenum")
    return points.groupBy("stay_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum(m1).alias("sum_m1"),
        F.sum(m2).alias("sum_m2"),
        F.sum(m1 * m2).alias("sum_product"),
    )


@query(
    "grid_scoring",
    f"""
    SELECT stay_id, COUNT(*) AS n_points, {', '.join(f'ROUND(AVG({risk_sql(k)}), 6) AS mean_{k}' for k in range(5))},
           ROUND(MIN({risk_sql(4)}), 6) AS lowest_4, ROUND(MAX({risk_sql(4)}), 6) AS highest_4
    FROM f_stays CROSS JOIN f_grid GROUP BY stay_id""",
)
def grid_scoring(spark, sf):
    scored = surface(targets.with_grid(_cases(spark, sf), "stay_id"))
    return scored.groupBy("stay_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        *[r6(F.avg(p)).alias(f"mean_{k}") for k, p in enumerate(PREDS)],
        r6(F.min("pred_4")).alias("lowest_4"),
        r6(F.max("pred_4")).alias("highest_4"),
    )


@query(
    "topk_per_case",
    """
    SELECT stay_id, rn AS rank, m1 AS m1_valuenum, m2 AS m2_valuenum, ROUND(avg_pred, 6) AS average_pred FROM (
      SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY round(avg_pred, 9), m1, m2) AS rn FROM f_scored) WHERE rn <= 100""",
)
def topk_per_case(spark, sf):
    lowest = targets.lowest_points(_scored_grid(spark, sf), "stay_id")
    return lowest.select(
        "stay_id",
        big("rank").alias("rank"),
        big("m1_valuenum").alias("m1_valuenum"),
        big("m2_valuenum").alias("m2_valuenum"),
        r6("average_pred").alias("average_pred"),
    )


@query(
    "topk_target_point",
    """
    SELECT l_suppkey, ROUND(AVG(l_quantity), 6) AS quantity, ROUND(AVG(l_extendedprice), 6) AS price FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(l_discount, 9), l_quantity, l_extendedprice) AS rn FROM lineitem)
    WHERE rn <= 100 GROUP BY l_suppkey""",
)
def topk_target_point(spark, sf):
    lines = tables.table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.col("l_discount").alias("average_pred"),
        F.col("l_quantity").alias("m1_valuenum"),
        F.col("l_extendedprice").alias("m2_valuenum"),
    )
    out = targets.target_points(lines, "l_suppkey")
    return out.select("l_suppkey", r6("optimal_m1").alias("quantity"), r6("optimal_m2").alias("price"))


@query(
    "optimal_targets",
    "SELECT stay_id, ROUND(optimal_m1, 6) AS optimal_m1, ROUND(optimal_m2, 6) AS optimal_m2 FROM f_targets",
)
def optimal_targets(spark, sf):
    out = targets.optimal_targets(_cases(spark, sf), "stay_id", surface, PREDS)
    return out.select("stay_id", r6("optimal_m1").alias("optimal_m1"), r6("optimal_m2").alias("optimal_m2"))


@query(
    "counterfactual_risk",
    f"""
    SELECT stay_id, ROUND({risk_sql(4)}, 6) AS actual_risk, ROUND({risk_sql(4, '80 + stay_id % 10', '118')}, 6) AS optimal_risk
    FROM f_medians""",
)
def counterfactual_risk(spark, sf):
    cases = case_medians(spark, sf).withColumns(
        {"optimal_m1": (80 + F.col("stay_id") % 10).cast("double"), "optimal_m2": F.lit(118.0)}
    )
    out = targets.counterfactual_risk(cases, surface, PREDS)
    return out.select("stay_id", r6("actual_risk").alias("actual_risk"), r6("optimal_risk").alias("optimal_risk"))


def _report(spark, sf):
    cases = case_medians(spark, sf).withColumn("died", (F.col("stay_id") % 3 == 0).cast("bigint"))
    cases = materialize(cases, "cases")
    return targets.target_report(cases, "stay_id", "died", surface, PREDS)


@query(
    "optimal_target_report",
    f"""
    SELECT stay_id AS case_id, ROUND(m1, 6) AS hr, ROUND(m2, 6) AS bp, ROUND(optimal_m1, 6) AS optimal_hr, ROUND(optimal_m2, 6) AS optimal_bp,
           ROUND({risk_sql(4)}, 6) AS actual_risk, ROUND({risk_sql(4, 'optimal_m1', 'optimal_m2')}, 6) AS optimal_risk,
           CAST(stay_id % 3 = 0 AS BIGINT) AS mortality
    FROM f_medians JOIN f_targets USING (stay_id)""",
)
def optimal_target_report(spark, sf):
    out = _report(spark, sf)
    numbers = ["hr", "bp", "optimal_hr", "optimal_bp", "actual_risk", "optimal_risk"]
    return out.select("case_id", *[r6(c).alias(c) for c in numbers], "mortality")


_FINDS_SQL = """
    SELECT stay_id AS case_id, CAST(stay_id % 3 = 0 AS BIGINT) AS mortality, TRUE AS found, TRUE AS risk_low
    FROM f_medians"""


def _trained_targets(spark, sf, outcome, inside, **learner):
    """Report on all stays under models of a planted outcome, learned from orders as points of the grid.

    `found`: the target lies where the outcome is rare. A constant scorer puts all targets in a corner.
    """
    m1, m2 = (40 + F.col("o_custkey") * 7 % 111).cast("double"), (60 + F.col("o_orderkey") * 13 % 141).cast("double")
    orders = tables.table(spark, sf, "orders").withColumns({"m1_valuenum": m1, "m2_valuenum": m2})
    orders = orders.select("o_orderkey", "m1_valuenum", "m2_valuenum", (F.col("o_custkey") % 10).cast("double").alias("shift"))
    rows = folds.stratified_folds(orders.withColumn("died", outcome.cast("int")), "o_orderkey", "died")
    models = learners.train_folds(materialize(rows, "outcomes"), ["m1_valuenum", "m2_valuenum", "shift"], "died", **learner)
    cases = case_medians(spark, sf).withColumns(
        {"shift": (F.col("stay_id") % 10).cast("double"), "died": (F.col("stay_id") % 3 == 0).cast("int")}
    )
    cases = materialize(cases, "cases")
    found = targets.model_targets(cases, "stay_id", models)
    report = targets.target_report(cases, "stay_id", "died", learners.scorer(models), PREDS, targets=found)
    return report.select("case_id", big("mortality").alias("mortality"), inside.alias("found"), (F.col("optimal_risk") < 0.5).alias("risk_low"))


@query("model_targets", _FINDS_SQL)
def model_targets(spark, sf):
    """Targets under five logistic models of an outcome that falls as both measures rise."""
    # one label in ten is turned: without that, coefficients grow until all low risks round to 0
    outcome = (F.col("m1_valuenum") + F.col("m2_valuenum") < 220) != (F.col("o_orderkey") % 10 == 3)
    inside = (F.col("optimal_hr") > 130) & (F.col("optimal_bp") > 175)
    return _trained_targets(spark, sf, outcome, inside, learner="logistic", maxIter=10)


@query("forest_targets", _FINDS_SQL)
def forest_targets(spark, sf):
    """Targets under five forests of an outcome that is rare within a band of both measures."""
    outcome = (F.abs(F.col("m1_valuenum") - 100) > 30) | (F.abs(F.col("m2_valuenum") - 140) > 40)
    inside = F.col("optimal_hr").between(65, 135) & F.col("optimal_bp").between(95, 185)
    return _trained_targets(spark, sf, outcome, inside, **_FOREST, learner="forest")


@query(
    "resumed_targets",
    """
    SELECT stay_id, CAST(ntile(5) OVER (ORDER BY stay_id) - 1 AS BIGINT) AS batch, ROUND(optimal_m1, 6) AS optimal_m1, ROUND(optimal_m2, 6) AS optimal_m2
    FROM f_targets""",
)
def resumed_targets(spark, sf):
    """Targets in five batches by a run that ends after two of them, and one that does the rest."""
    cases = materialize(folds.contiguous_folds(_cases(spark, sf), "stay_id"), "batch-cases")
    root = shared_dir(spark, "target-batches")

    def compute(batch):
        return targets.optimal_targets(cases.filter(F.col("fold") == batch).drop("fold"), "stay_id", surface, PREDS)

    for numbers in (range(2), range(5)):
        batches.run_batches(spark, root, numbers, compute)
    found = batches.read_committed(spark, root, "stay_id long, optimal_m1 double, optimal_m2 double")
    return found.select("stay_id", big("batch").alias("batch"), r6("optimal_m1").alias("optimal_m1"), r6("optimal_m2").alias("optimal_m2"))


# --- alerts, safe zones, adherence, matching ---------------------------------------------


@query(
    "safe_zone",
    """
    SELECT stay_id, COUNT(*) AS n_points, MIN(m1) AS m1_low, MAX(m1) AS m1_high, MIN(m2) AS m2_low, MAX(m2) AS m2_high
    FROM f_scored WHERE round(avg_pred, 9) <= 0.05 GROUP BY stay_id""",
)
def safe_zone(spark, sf):
    out = targets.safe_zones(_scored_grid(spark, sf), ["stay_id"], 0.05)
    bounds = ["m1_low", "m1_high", "m2_low", "m2_high"]
    return out.select("stay_id", "n_points", *[big(c).alias(c) for c in bounds])


_ZONE_MOMENTS = [12, 18]
# the surface of a case at a moment is that of the case so many numbers on
_ZONE_SQL = (
    f"SELECT c.stay_id AS case_id, mop, m1, m2 FROM f_stays c CROSS JOIN (SELECT unnest({_ZONE_MOMENTS}) AS mop) CROSS JOIN f_grid WHERE round("
    + AVERAGE_SQL.replace("stay_id", "(c.stay_id + mop)")
    + ", 9) <= 0.05"
)


@query(
    "safe_regions",
    f"""
    WITH p AS ({_ZONE_SQL}),
    z AS (SELECT case_id, mop, COUNT(*) AS n_points, MIN(m1) AS m1_low, MAX(m1) AS m1_high, MIN(m2) AS m2_low, MAX(m2) AS m2_high FROM p GROUP BY ALL),
    o AS (SELECT case_id, COUNT(*) AS shared FROM p a JOIN p b USING (case_id, m1, m2) WHERE a.mop = {_ZONE_MOMENTS[0]} AND b.mop = {_ZONE_MOMENTS[1]} GROUP BY case_id)
    SELECT case_id, CAST(mop AS BIGINT) AS mop, CAST(0 AS BIGINT) AS region, n_points, CAST(m1_low AS BIGINT) AS m1_low, CAST(m1_high AS BIGINT) AS m1_high,
           CAST(m2_low AS BIGINT) AS m2_low, CAST(m2_high AS BIGINT) AS m2_high, CASE WHEN mop = {_ZONE_MOMENTS[0]} THEN coalesce(shared, 0) END AS shared
    FROM z LEFT JOIN o USING (case_id)""",
)
def safe_regions(spark, sf):
    """Safe zones by moment: the connected region, its size and bounds, and what it shares with that of the next moment."""
    cases = _cases(spark, sf).select(F.col("stay_id").alias("case_id"), F.explode(F.array(*[F.lit(m) for m in _ZONE_MOMENTS])).alias("mop"))
    grid = targets.with_grid(cases.withColumn("stay_id", F.col("case_id") + F.col("mop")), "case_id")
    found = materialize(regions.safe_regions(targets.with_average(surface(grid), PREDS), ["case_id", "mop"], 0.05), "regions")
    shared = regions.overlaps(found, ["case_id"], "mop").select("case_id", "mop", "shared")
    bounds = ["m1_low", "m1_high", "m2_low", "m2_high"]
    return found.join(shared, ["case_id", "mop"]).select("case_id", big("mop").alias("mop"), big("region").alias("region"), "n_points", *[big(c).alias(c) for c in bounds], "shared")


@query(
    "adherence_groups",
    """
    WITH d AS (SELECT stay_id, CAST(sqrt(pow(m1 - optimal_m1, 2) + pow(m2 - optimal_m2, 2)) <= 50 AS BIGINT) AS keeps_dynamic,
                      CAST(sqrt(pow(m1 - 80, 2) + pow(m2 - 120, 2)) <= 50 AS BIGINT) AS keeps_fixed
               FROM f_medians JOIN f_targets USING (stay_id))
    SELECT keeps_dynamic, keeps_fixed, COUNT(*) AS n_stays, COUNT(*) FILTER (WHERE stay_id % 3 = 0) AS n_died
    FROM d GROUP BY ALL""",
)
def adherence_groups(spark, sf):
    report = _report(spark, sf).withColumnsRenamed(
        {"hr": "m1_valuenum", "bp": "m2_valuenum", "optimal_hr": "optimal_m1", "optimal_bp": "optimal_m2"}
    )
    kept = matching.with_adherence(report, tolerance=50)
    return kept.groupBy(big("keeps_dynamic").alias("keeps_dynamic"), big("keeps_fixed").alias("keeps_fixed")).agg(
        F.count(F.lit(1)).alias("n_stays"), F.count_if(F.col("mortality") == 1).alias("n_died")
    )


@query(
    "match_nearest",
    """
    WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AS treated, o_totalprice AS s FROM orders),
    c AS (SELECT s, MIN(o_orderkey) AS k FROM o WHERE NOT treated GROUP BY s),
    b AS (SELECT t.o_orderkey, t.s, c.s AS low, c.k AS low_key FROM (SELECT * FROM o WHERE treated) t ASOF LEFT JOIN c ON t.s >= c.s),
    n AS (SELECT b.*, c.s AS high, c.k AS high_key FROM b ASOF LEFT JOIN c ON b.s <= c.s)
    SELECT o_orderkey, CASE WHEN high IS NULL OR s - low <= high - s THEN low_key ELSE high_key END AS control,
           ROUND(CASE WHEN high IS NULL OR s - low <= high - s THEN s - low ELSE high - s END, 6) AS gap
    FROM n""",
)
def match_nearest(spark, sf):
    orders = tables.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("treated"), "o_totalprice"
    )
    return matching.match_nearest(orders, "o_orderkey", "treated", "o_totalprice").withColumn("gap", r6("gap"))


@query(
    "psm_match",
    """
    SELECT COUNT(*) AS n_pairs, ROUND(AVG(CAST(o_orderstatus = 'F' AS DOUBLE)), 6) AS treated_rate, TRUE AS control_rate_known
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 100)""",
)
def psm_match(spark, sf):
    """Every treated row has a pair."""
    # written once: fills, scaler, learner and scoring all read it
    rows = materialize(tables.order_features(spark, sf).withColumn("treated", (F.col("quantity") > 100).cast("int")), "treated")
    scored = materialize(matching.propensity(rows, ["n_lines", "discount", "tax"], "treated"), "propensity")
    pairs = matching.match_nearest(scored, "o_orderkey", "treated")
    found = matching.matched_outcomes(scored, pairs, "o_orderkey", "label")
    return found.select("n_pairs", r6("treated_rate").alias("treated_rate"), F.col("control_rate").between(0, 1).alias("control_rate_known"))


_CALIPER = 50.0


@query(
    "match_caliper",
    f"""
    SELECT COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_treated, COUNT(*) FILTER (WHERE o_orderstatus <> 'F') AS n_controls, CAST(0 AS BIGINT) AS n_twice,
           CAST(0 AS BIGINT) AS n_wide, CAST(0 AS BIGINT) AS n_not_free, CAST(0 AS BIGINT) AS n_left, TRUE AS some
    FROM orders""",
)
def match_caliper(spark, sf):
    """Pairs without replacement: none twice, none too wide, of the two sides; and no treated row left with a free control within reach."""
    orders = tables.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("treated"), "o_totalprice"
    )
    pairs = materialize(matching.match_without_replacement(orders, "o_orderkey", "treated", _CALIPER, "o_totalprice"), "pairs")
    used = pairs.select("o_orderkey").unionByName(pairs.select(F.col("control").alias("o_orderkey")))
    free = orders.join(used, "o_orderkey", "left_anti")
    near = matching.match_nearest(free, "o_orderkey", "treated", "o_totalprice").filter(F.col("gap") <= _CALIPER)
    sides = orders.agg(
        F.count_if(F.col("treated") == 1).alias("n_treated"), F.count_if(F.col("treated") == 0).alias("n_controls")
    )
    of = orders.select(F.col("o_orderkey").alias("control"), F.col("treated").alias("other"))
    facts = pairs.join(orders.select("o_orderkey", "treated"), "o_orderkey").join(of, "control").agg(
        F.count_if(F.col("gap") > _CALIPER).alias("n_wide"), F.count_if((F.col("treated") != 1) | (F.col("other") != 0)).alias("n_not_free"), (F.count(F.lit(1)) > 10).alias("some")
    )
    twice = used.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_twice"))
    return sides.crossJoin(twice).crossJoin(facts).crossJoin(near.agg(F.count(F.lit(1)).alias("n_left")))


_MOMENTS = [0, 18, 36, 72, 144, 288]


@query(
    "asof_cohort",
    "SELECT event_id, CAST(CASE "
    + " ".join(f"WHEN off_us >= {m * HOUR_US} THEN {m}" for m in sorted(_MOMENTS, reverse=True))
    + " ELSE -1 END AS BIGINT) AS mop FROM f_off1",
)
def asof_cohort(spark, sf):
    m1, _ = _offsets(spark, sf)
    moment = latest_moment("off_us", _MOMENTS, HOUR_US)
    return m1.select("event_id", big(F.coalesce(moment, F.lit(-1))).alias("mop"))


@query(
    "temporal_ensemble",
    f"""
    WITH c AS (SELECT event_id, stay_id % 2 AS site, off_us, value FROM f_off1),
    m AS (SELECT site, mop, mop * {HOUR_US}::BIGINT AS at_us, AVG(value) AS mean, stddev_pop(value) AS dev
          FROM c JOIN (SELECT unnest({_MOMENTS[1:]}) AS mop) ON off_us < mop * {HOUR_US}::BIGINT GROUP BY site, mop HAVING stddev_pop(value) > 0)
    SELECT event_id, CAST(coalesce(m.mop, -1) AS BIGINT) AS mop, ROUND(1 / (1 + exp(-((value - mean) / dev))), 6) AS pred_prob
    FROM c ASOF LEFT JOIN m ON c.site = m.site AND c.off_us >= m.at_us""",
)
def temporal_ensemble(spark, sf):
    """Each event scored by the model of its moment and site: one logistic model per moment, of what came before it."""
    cases = _offsets(spark, sf)[0].select("event_id", (F.col("stay_id") % 2).alias("site"), "off_us", "value")
    windows = [(0, m * HOUR_US) for m in _MOMENTS[1:]]
    held = F.array(*[F.struct(F.lit(m).alias("mop"), F.lit(end).alias("end")) for m, (_, end) in zip(_MOMENTS[1:], windows)])
    seen = cases.select("site", "value", F.inline(F.filter(held, lambda w: F.col("off_us") < w["end"])))
    models = seen.groupBy("site", "mop").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("dev")).filter("dev > 0")
    models = models.select("site", "mop", F.array(-F.col("mean") / F.col("dev"), 1 / F.col("dev")).alias("weights"))
    scored = ensemble_scores(cases, models, ["site"], "off_us", "mop", ["value"], HOUR_US)
    return scored.select("event_id", big(F.coalesce("mop", F.lit(-1))).alias("mop"), r6("pred_prob").alias("pred_prob"))


_ALERT_SQL = """
    WITH w AS (SELECT stay_id, epoch_us(date_trunc('day', ts)) AS window_us, AVG(value) AS mean_value, COUNT(*) AS n_events
               FROM (SELECT user_id AS stay_id, ts, value FROM events WHERE event_type = 'view' AND value <= 300) GROUP BY ALL)
    SELECT stay_id, CAST(window_us AS BIGINT) AS window_us, ROUND(mean_value, 6) AS mean_value, n_events,
           ROUND(mean_value - (70 + stay_id % 10), 6) AS deviation
    FROM w WHERE abs(mean_value - (70 + stay_id % 10)) > 40 {closed}"""


def _alert_targets(spark, sf):
    people = tables.table(spark, sf, "customer")
    return people.select(
        F.col("c_custkey").alias("stay_id"), (70 + F.col("c_custkey") % 10).cast("double").alias("target")
    )


def _alert_columns(df, micros=clock.micros):
    return df.select(
        "stay_id",
        micros("window_start").alias("window_us"),
        r6("mean_value").alias("mean_value"),
        "n_events",
        r6("deviation").alias("deviation"),
    )


@query("deviation_alerts", _ALERT_SQL.format(closed=""))
def deviation_alerts(spark, sf):
    out = A.alerts(
        tables.m1_events(spark, sf), _alert_targets(spark, sf), "stay_id", "ts", "value", "target", "1 day", 40
    )
    return _alert_columns(out)


@query(
    "deviation_alerts_stream",
    _ALERT_SQL.format(
        closed="""AND window_us + 86400000000 <= (
            SELECT epoch_us(date_trunc('millisecond', MAX(ts))) - 3600000000 FROM events WHERE event_type = 'view' AND value <= 300)"""
    ),
)
def deviation_alerts_stream(spark, sf):
    """The same alerts from a stream; windows still open under the watermark give none yet."""
    schema = tables.table(spark, sf, "events").schema
    stream = A.event_stream(spark, sf, schema, files="events*.parquet")
    events = stream.filter((F.col("event_type") == "view") & (F.col("value") <= 300)).select(
        F.col("user_id").alias("stay_id"), clock.instant("ts").alias("ts"), "value"
    )
    out = A.alerts(
        events, _alert_targets(spark, sf), "stay_id", "ts", "value", "target", "1 day", 40, delay="1 hour"
    )
    return _alert_columns(A.drain(out, "alerts"), F.unix_micros)


_EPISODE_DAYS = 2
_EPISODE_SQL = f"""
    WITH mark AS (SELECT epoch_us(date_trunc('millisecond', MAX(ts))) - 3600000000 AS us FROM events WHERE event_type = 'view' AND value <= 300),
    w AS (SELECT user_id AS stay_id, epoch_us(date_trunc('day', ts)) AS s, AVG(value) - (70 + user_id % 10) AS dev
          FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'view' AND value <= 300 GROUP BY user_id, date_trunc('day', ts)),
    seen AS (SELECT *, s + 86400000000 AS e, abs(dev) > 40 AS bad FROM w WHERE s + 86400000000 <= (SELECT us FROM mark)),
    placed AS (SELECT *, lead(s) OVER o AS next_s,
                 bad AND (lag(bad) OVER o IS NOT TRUE OR s - lag(e) OVER o > {_EPISODE_DAYS} * 86400000000) AS fresh
               FROM seen WINDOW o AS (PARTITION BY stay_id ORDER BY s)),
    runs AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY stay_id ORDER BY s) AS run FROM placed),
    told AS (SELECT stay_id, min(s) AS start_us, max(e) AS end_us, count(*) AS n_windows, arg_max(dev, abs(dev)) AS peak, arg_max(next_s, s) AS last_next, max(CASE WHEN next_s IS NULL THEN 1 ELSE 0 END) AS open
             FROM runs WHERE bad GROUP BY stay_id, run)
    SELECT stay_id, CAST(start_us AS BIGINT) AS start_us, CAST(end_us AS BIGINT) AS end_us, CAST(n_windows AS BIGINT) AS n_windows, ROUND(peak, 6) AS peak,
           CASE WHEN open = 0 AND last_next - end_us <= {_EPISODE_DAYS} * 86400000000 THEN 'return' ELSE 'silence' END AS reason
    FROM told WHERE n_windows >= 2 AND (open = 0 OR end_us + {_EPISODE_DAYS} * 86400000000 < (SELECT max(e) FROM seen))"""


def _judged(spark, sf, events, delay=None):
    return E.judged_windows(events, _alert_targets(spark, sf), "stay_id", "ts", "value", "target", "1 day", 40, delay)


def _episode_columns(df):
    return df.select("stay_id", "start_us", "end_us", big("n_windows").alias("n_windows"), r6("peak").alias("peak"), "reason")


@query("alert_episodes", _EPISODE_SQL)
def alert_episodes(spark, sf):
    """Episodes of two deviating days or more that have closed by the last day but for the delay."""
    events = tables.m1_events(spark, sf).withColumn("ts", clock.instant("ts"))
    windows = materialize(_judged(spark, sf, events), "alert-windows")
    watermark = events.agg(F.max(F.unix_micros(F.date_trunc("millisecond", "ts"))) - HOUR_US).first()[0]
    now = E.last_end(windows, watermark or 0)
    return _episode_columns(E.episodes(windows, "stay_id", 2, _EPISODE_DAYS * 24 * HOUR_US, now))


@query("alert_episodes_stream", _EPISODE_SQL)
def alert_episodes_stream(spark, sf):
    """The same episodes, told by a stream as they close."""
    stream = A.event_stream(spark, sf, tables.table(spark, sf, "events").schema, files="events*.parquet")
    events = stream.filter((F.col("event_type") == "view") & (F.col("value") <= 300)).select(
        F.col("user_id").alias("stay_id"), clock.instant("ts").alias("ts"), "value"
    )
    found = E.follow_alerts(_judged(spark, sf, events, "1 hour"), "stay_id", 2, _EPISODE_DAYS * 24 * HOUR_US, shared_dir(spark, "alert-episodes"))
    return _episode_columns(found)
