"""Classifiers per fold on Spark ML, their predictions, and saved models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from staytide.operators.folds import subset

# Learner settings of the published models.
BOOSTED = {
    "learning_rate": 0.01, "rounds": 2000, "max_depth": 3, "min_child": 9, "row_share": 0.8,
    "column_share": 0.6, "class_weight": 64, "seed": 42,
}
FOREST = {"trees": 1000, "seed": 42}
SEARCH_GRID = {"learning_rate": [0.001, 0.01, 0.1, 0.2, 0.3], "rounds": [10, 100, 1000, 2000, 5000]}


def boosted_trees(label: str, weighted: bool = True, **settings) -> GBTClassifier:
    s = {**BOOSTED, **settings}
    gbt = GBTClassifier(
        labelCol=label,
        featuresCol="features",
        stepSize=s["learning_rate"],
        maxIter=s["rounds"],
        maxDepth=s["max_depth"],
        minInstancesPerNode=s["min_child"],
        subsamplingRate=s["row_share"],
        featureSubsetStrategy=str(s["column_share"]),
        seed=s["seed"],
    )
    return gbt.setWeightCol("_weight") if weighted else gbt


def random_forest(label: str, **settings) -> RandomForestClassifier:
    s = {**FOREST, **settings}
    return RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=s["trees"], seed=s["seed"]
    )


def logistic(label: str, **settings) -> LogisticRegression:
    return LogisticRegression(labelCol=label, featuresCol="features", **settings)


def calibrated_svc(label: str, **settings) -> list:
    """Linear support vectors; a logistic fit turns the margin into a probability."""
    margin = VectorAssembler(inputCols=["_margins"], outputCol="_margin", handleInvalid="keep")
    svc = LinearSVC(
        labelCol=label, featuresCol="features", rawPredictionCol="_margins", predictionCol="_side", **settings
    )
    return [svc, margin, LogisticRegression(labelCol=label, featuresCol="_margin")]


def missing_fills(df: DataFrame, features: Sequence[str], constant: float | None = None) -> dict[str, float]:
    """A value for the gaps of each number column: its median (0 where nothing is known), or a constant.

    Features of other types, such as vectors, have no gaps and no entry.
    """
    numbers = [f for f in features if isinstance(df.schema[f].dataType, NumericType)]
    if constant is not None or not numbers:
        return {f: float(constant or 0.0) for f in numbers}
    known = [F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), 0.5, 10_000).alias(f) for f in numbers]
    row = df.agg(*known).first()
    return {f: float(row[f]) if row[f] is not None else 0.0 for f in numbers}


def filled(fills: Mapping[str, float]) -> SQLTransformer:
    """A stage that fills the gaps (NULL or NaN) of columns, as _fill_<name>, and flags them, as _gap_<name>.

    Part of the pipeline, it is saved with the model.
    """
    parts = ["*"]
    for name, value in fills.items():
        known = f"nanvl(cast(`{name}` AS DOUBLE), cast(NULL AS DOUBLE))"
        parts += [
            f"coalesce({known}, double('{value!r}')) AS `_fill_{name}`",
            f"cast({known} IS NULL AS DOUBLE) AS `_gap_{name}`",
        ]
    return SQLTransformer(statement=f"SELECT {', '.join(parts)} FROM __THIS__")


def build(
    learner: str, features: Sequence[str], label: str, fills: Mapping[str, float] | None = None, **settings
) -> Pipeline:
    """A pipeline of filling, assembler and learner: "boosted", "forest", "svc" or "logistic".

    `fills` are the values for gaps, learned from the training rows; without them no gap may occur.
    """
    fills = fills or {}
    inputs = [c for f in features for c in ([f"_fill_{f}", f"_gap_{f}"] if f in fills else [f])]
    # a feature may already be a vector column; the assembler takes both
    assemble = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    first = [filled(fills), assemble] if fills else [assemble]
    if learner == "boosted":
        return Pipeline(stages=[*first, boosted_trees(label, **settings)])
    if learner == "forest":
        return Pipeline(stages=[*first, random_forest(label, **settings)])
    assemble.setOutputCol("_raw")
    scale = StandardScaler(inputCol="_raw", outputCol="features", withMean=True)
    if learner == "svc":
        return Pipeline(stages=[*first, scale, *calibrated_svc(label, **settings)])
    if learner == "logistic":
        return Pipeline(stages=[*first, scale, logistic(label, **settings)])
    raise ValueError(f"unknown learner {learner!r}")


def fit(learner: str, rows: DataFrame, features: Sequence[str], label: str, **settings) -> PipelineModel:
    """A model whose fills are learned from the same rows. Rows without a label are left out."""
    known = rows.filter(F.col(label).isNotNull())
    return build(learner, features, label, missing_fills(known, features), **settings).fit(known)


def with_class_weight(df: DataFrame, label: str, weight: float) -> DataFrame:
    return df.withColumn("_weight", F.when(F.col(label) == 1, float(weight)).otherwise(1.0))


def score_column() -> Column:
    return vector_to_array("probability")[1]


def predict(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Adds the probability of class 1, and drops the model's other columns."""
    return model.transform(df).select(*df.columns, score_column().alias(out))


def scorer(models: Sequence[PipelineModel], prefix: str = "pred_"):
    """A function that adds one prediction column per model."""

    def add(df: DataFrame) -> DataFrame:
        for i, model in enumerate(models):
            df = predict(model, df, f"{prefix}{i}")
        return df

    return add


def train_folds(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    k: int = 5,
    learner: str = "boosted",
    resample=None,
    parallelism: int = 2,
    **settings,
) -> list[PipelineModel]:
    """One model per fold, trained on the other folds. `df` has a column fold and is read k times,
    so it should be a written table or cheap to read.

    `resample` changes the training rows only, so no synthetic row reaches a test fold.
    """
    weight = settings.pop("class_weight", BOOSTED["class_weight"])

    def train(fold: int) -> PipelineModel:
        rows = df.filter(F.col("fold") != fold)
        if resample is not None:
            rows = resample(rows)
        if learner == "boosted":
            rows = with_class_weight(rows, label, 1 if resample is not None else weight)
        return fit(learner, rows, features, label, **settings)

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(train, range(k)))


def out_of_fold(models: Sequence[PipelineModel], df: DataFrame, out: str = "score") -> DataFrame:
    """Each row scored by the model that did not see it."""
    parts = [predict(m, df.filter(F.col("fold") == i), out) for i, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def prediction_table(
    models: Sequence[PipelineModel], df: DataFrame, key: str, label: str, cut: float = 0.5
) -> DataFrame:
    """All rows under all models: (key, model_fold, y_pred, y_pred_proba, gt, subset)."""
    score = scorer(models, "_p")
    long = score(df).withColumn(
        "_m",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("model_fold"),
                        F.col(f"_p{i}").alias("y_pred_proba"),
                        subset(i).alias("subset"),
                    )
                    for i in range(len(models))
                ]
            )
        ),
    )
    return long.select(
        key,
        "_m.model_fold",
        (F.col("_m.y_pred_proba") > cut).cast("int").alias("y_pred"),
        "_m.y_pred_proba",
        F.col(label).alias("gt"),
        "_m.subset",
    )


def external_predictions(
    models: Sequence[PipelineModel], df: DataFrame, key: str, label: str
) -> DataFrame:
    """Models of one source on the whole cohort of another: (key, model_fold, y_pred_proba, gt)."""
    return prediction_table(models, df.withColumn("fold", F.lit(-1)), key, label).drop("subset", "y_pred")


def sweep_predictions(
    cohorts: DataFrame, models: Mapping[tuple[int, int, int], Sequence[PipelineModel]], keys: Sequence[str], label: str
) -> DataFrame:
    """Cohorts of many windows, each scored by its own models: (keys, pw, mop, ow, fold, pred_prob, gt).

    `cohorts` has columns pw, mop and ow; written in folders by these, each part reads its own files.
    """
    parts = []
    for (pw, mop, ow), fold_models in models.items():
        cell = cohorts.filter((F.col("pw") == pw) & (F.col("mop") == mop) & (F.col("ow") == ow))
        by_fold = F.array(
            *[
                F.struct(F.lit(i).alias("fold"), F.col(f"_p{i}").alias("pred_prob"))
                for i in range(len(fold_models))
            ]
        )
        parts.append(
            scorer(fold_models, "_p")(cell).select(
                *keys, "pw", "mop", "ow", F.inline(by_fold), F.col(label).alias("gt")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def model_path(root: str, learner: str, pw: int, mop: int, ow: int, fold: int) -> str:
    return f"{root}/{learner}/pw={pw}/mop={mop}/ow={ow}/fold={fold}"


def save_models(models: Sequence[PipelineModel], root: str, learner: str, pw: int, mop: int, ow: int) -> None:
    for fold, model in enumerate(models):
        model.write().overwrite().save(model_path(root, learner, pw, mop, ow, fold))


def load_models(
    spark: SparkSession, root: str, learner: str, pw: int, mop: int, ow: int, k: int = 5
) -> list[PipelineModel]:
    return [PipelineModel.load(model_path(root, learner, pw, mop, ow, i)) for i in range(k)]
