"""Training, comparison and scoring with MLlib."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logrisk.functions.casts import rounded
from logrisk.config import BOOSTING, EXPLANATION_SIZE, FOLDS
from logrisk.functions import risk
from logrisk.operators import evaluate, splits
from logrisk.operators.schema import ALL_FEATURES, source_kind
from logrisk.session import checkpointed

#: Fits that run side by side, and rows below which a partition of their input is not worth a task.
FITS, PARTITION_ROWS = 8, 100_000
#: The same for a fit that runs alone, and the most rows of a partition.
ALONE_ROWS, MOST_ROWS = 12_500, 250_000
BASELINE = "Majority Baseline"
BOOSTED = "Boosted Trees"


def matrix(rows: DataFrame, features=tuple(ALL_FEATURES)) -> DataFrame:
    """Labelled rows with their feature vector; unknown labels are dropped."""
    known = rows.where(F.col("label").isin(0, 1))
    filled = known.fillna(0, subset=list(features))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def weighted(rows: DataFrame, weights: dict) -> DataFrame:
    """`balanced` weights every class alike; `by_ratio` weights failures by neg/pos."""
    failed = F.col("label") == 1
    return rows.withColumns({
        "balanced": F.when(failed, float(weights["weight_pos"])).otherwise(float(weights["weight_neg"])),
        "by_ratio": F.when(failed, float(weights["pos_ratio"])).otherwise(1.0),
    })


def candidates(size: float = 1.0, seed: int = 42) -> dict[str, Pipeline]:
    """The compared models. `size` scales the number of trees and rounds."""
    def rounds(n: int) -> int:
        return max(2, round(n * size))

    plain = {"labelCol": "label", "featuresCol": "features"}
    boosted = {
        **plain, "maxDepth": BOOSTING["maxDepth"], "stepSize": BOOSTING["stepSize"], "seed": seed,
    }
    return {
        "Logistic Regression": Pipeline(stages=[
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
            LogisticRegression(labelCol="label", featuresCol="scaled", weightCol="balanced", maxIter=100),
        ]),
        "Decision Tree": Pipeline(stages=[
            DecisionTreeClassifier(**plain, weightCol="balanced", maxDepth=6, seed=seed)]),
        "Random Forest": Pipeline(stages=[
            RandomForestClassifier(**plain, weightCol="balanced", maxDepth=8,
                                   numTrees=rounds(200), seed=seed)]),
        "Histogram Boosting": Pipeline(stages=[
            GBTClassifier(**boosted, maxIter=rounds(200), maxBins=255)]),
        BOOSTED: Pipeline(stages=[
            GBTClassifier(**boosted, maxIter=rounds(BOOSTING["maxIter"]), weightCol="by_ratio",
                          subsamplingRate=BOOSTING["subsamplingRate"], featureSubsetStrategy="0.8")]),
    }


def fit(pipeline: Pipeline | None, train: DataFrame) -> PipelineModel | int:
    """A fitted pipeline, or for the baseline the most frequent label."""
    if pipeline is not None:
        return pipeline.fit(train)
    top = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    return int(top["label"])


def apply(model: PipelineModel | int, rows: DataFrame) -> DataFrame:
    """Adds `raw_prob`, the probability of failure."""
    if isinstance(model, int):
        return rows.withColumn("raw_prob", F.lit(float(model)))
    out = model.transform(rows)
    return out.withColumn("raw_prob", vector_to_array("probability")[1]).drop(
        "probability", "rawPrediction", "prediction", "scaled")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: whole groups where both classes have enough, else by row."""
    groups = splits.group_labels(rows)
    if splits.can_group_split(groups).first()["allowed"]:
        held = splits.group_holdout(groups)
        name = "group_id"
    else:
        held = splits.group_holdout(rows.select("process_id", "label"), group="process_id")
        name = "process_id"
    marked = rows.join(held.select(name, "is_test"), name)
    return marked.where("is_test = 0").drop("is_test"), marked.where("is_test = 1").drop("is_test")


def concurrently(tasks: list[Callable[[], object]], spark: SparkSession, at_once: int = FITS) -> list:
    """The results of some driver calls, of which `at_once` run side by side, each in a pool of its own.

    Fits are sequences of small jobs; side by side they fill the cluster.
    Set spark.scheduler.mode to FAIR to share it evenly.
    """
    def in_pool(number: int, task: Callable[[], object]):
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % at_once}")
            return task()
        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(at_once) as threads:
        return [f.result() for f in [threads.submit(in_pool(k, t)) for k, t in enumerate(tasks)]]


def partitions(rows: int, least: int, cores: int) -> int:
    """Partitions of `least` rows or more, on at most all cores; of many rows as many for each core."""
    if rows > cores * MOST_ROWS:
        return cores * -(-rows // (cores * MOST_ROWS))
    return max(1, min(cores, -(-rows // least)))


def compact(rows: DataFrame, least: int = PARTITION_ROWS) -> DataFrame:
    """Stored rows in as few partitions as their number needs, of about equal size; a fit passes over them very often."""
    rows = checkpointed(rows)
    parts = partitions(rows.count(), least, rows.sparkSession.sparkContext.defaultParallelism)
    if parts == 1:
        return checkpointed(rows.coalesce(1))
    # By name and in order, so that random draws meet the same rows in every run.
    return checkpointed(rows.repartition(parts, "process_id").sortWithinPartitions("process_id"))


def with_folds(train: DataFrame, folds: int) -> tuple[DataFrame, list[int]]:
    """Rows with their stratified group fold, and the folds that hold rows."""
    groups = splits.group_folds(splits.group_labels(train), folds=folds)
    numbered = compact(train.join(groups.select("group_id", "fold"), "group_id"))
    return numbered, [r["fold"] for r in numbered.select("fold").distinct().orderBy("fold").collect()]


def fold_f1(pipeline: Pipeline | None, numbered: DataFrame, fold: int) -> float:
    """F1 on one fold of a model fitted on the others."""
    model = fit(pipeline, numbered.where(F.col("fold") != fold))
    scored = apply(model, numbered.where(F.col("fold") == fold))
    counts = evaluate.confusion(scored, prob="raw_prob")
    return evaluate.class_metrics(counts, digits=12).first()["f1"]


def mean_and_deviation(scores: list[float]) -> tuple[float, float]:
    """(0, 0) below two folds."""
    if len(scores) < 2:
        return 0.0, 0.0
    mean = sum(scores) / len(scores)
    return mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5


def fits_and_folds(models: dict[str, Pipeline | None], train: DataFrame, folds: int) -> dict[str, tuple]:
    """(fitted model, (mean, deviation) of F1 over the folds) by name; all fits of all models run side by side."""
    numbered, present = with_folds(train, folds) if folds >= 2 else (compact(train), [])
    if len(present) < 2:
        present = []
    # The longest fits come last in the list of models and are started first.
    order = list(models)[::-1]
    tasks = [(name, fold) for name in order for fold in [None, *present]]
    results = concurrently(
        [partial(fit, models[name], numbered) if fold is None else partial(fold_f1, models[name], numbered, fold) for name, fold in tasks],
        train.sparkSession)
    found = dict(zip(tasks, results))
    return {name: (found[name, None], mean_and_deviation([found[name, f] for f in present])) for name in models}


def metrics_row(scored: DataFrame, name: str, cv: tuple[float, float]) -> DataFrame:
    """All held-out metrics of one model in one row; the rows are scored once."""
    scored = checkpointed(scored.select("label", "raw_prob"))
    counts = evaluate.class_metrics(evaluate.confusion(scored, prob="raw_prob"))
    ranks = evaluate.ranking_metrics(scored, prob="raw_prob")
    loss = evaluate.log_loss(scored, prob="raw_prob")
    joined = counts.crossJoin(F.broadcast(ranks)).crossJoin(F.broadcast(loss))
    return joined.select(
        F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc",
        "mcc", "specificity", "log_loss",
        rounded(F.lit(float(cv[0])), 4).alias("cv_f1_mean"),
        rounded(F.lit(float(cv[1])), 4).alias("cv_f1_std"),
        "tp", "tn", "fp", "fn",
    )


def prepared(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted train rows and test rows, both stored so that fits do not recompute them."""
    train, test = split(matrix(features))
    train, test = compact(train, ALONE_ROWS), compact(test, ALONE_ROWS)
    weights = splits.class_weights(train).first().asDict()
    if not weights["n_pos"] or not weights["n_neg"]:
        raise ValueError("training needs both failures and successes")
    return weighted(train, weights), test


def compare_models(features: DataFrame, *, size: float = 1.0, folds: int = FOLDS,
                   only: tuple[str, ...] | None = None) -> DataFrame:
    """All candidates on one split, ranked by f1, pr_auc and recall."""
    train, test = prepared(features)
    models = {n: p for n, p in {BASELINE: None, **candidates(size)}.items() if not only or n in only}
    fitted = fits_and_folds(models, train, folds)
    rows = concurrently([partial(metrics_row, apply(model, test), name, cv) for name, (model, cv) in fitted.items()], features.sparkSession)
    return evaluate.rank_models(reduce(DataFrame.unionByName, rows))


def comparison_header(features: DataFrame, ranking: DataFrame, name: str) -> DataFrame:
    """Data-set counts, top-ranked and deployed model."""
    counts = features.agg(
        F.count_if(F.col("label").isin(0, 1)).alias("samples"),
        F.count_if(F.col("label") == 1).alias("failures"),
        F.count_if(F.col("label") == 0).alias("successes"),
    )
    key = F.struct("f1", "pr_auc", "recall")
    best = ranking.agg(
        F.max_by("model", key).alias("top_ranked_model"),
        F.max(F.when(F.col("model") == BOOSTED, BOOSTED)).alias("_boosted"))
    return counts.crossJoin(F.broadcast(best)).select(
        F.lit(name).alias("dataset"), "samples", F.lit(len(ALL_FEATURES)).alias("features"),
        "failures", "successes", "top_ranked_model",
        F.coalesce("_boosted", "top_ranked_model").alias("deployed_model"))


def train_model(features: DataFrame, folder: str, *, size: float = 1.0, folds: int = FOLDS) -> DataFrame:
    """Fits the boosted trees, stores model, source and metrics; returns the metrics row."""
    spark = features.sparkSession
    train, test = prepared(features)
    model, cv = fits_and_folds({BOOSTED: candidates(size)[BOOSTED]}, train, folds)[BOOSTED]
    metrics = checkpointed(metrics_row(apply(model, test), BOOSTED, cv))
    model.write().overwrite().save(os.path.join(folder, "model"))
    described = source_kind(features).crossJoin(F.broadcast(metrics))
    described.coalesce(1).write.mode("overwrite").json(os.path.join(folder, "metrics"))
    names = spark.createDataFrame([(json.dumps(ALL_FEATURES),)], "features string")
    names.coalesce(1).write.mode("overwrite").json(os.path.join(folder, "features"))
    return metrics


def train_sources(sources: dict[str, DataFrame | None], folder: str, **options) -> dict[str, DataFrame]:
    """One model per source in its own folder; sources without input are skipped."""
    return {
        name: train_model(rows, os.path.join(folder, name), **options)
        for name, rows in sources.items() if rows is not None
    }


class StoredModel:
    """A stored model with its metrics and the source it was trained on."""

    def __init__(self, spark: SparkSession, folder: str, expected_source: str | None = None):
        self.metrics = spark.read.json(os.path.join(folder, "metrics")).first().asDict()
        self.source = self.metrics["trained_source"]
        wanted = (expected_source or "").lower().strip()
        if wanted and self.source not in ("both", "unknown", wanted):
            raise ValueError(f"model was trained for {self.source!r}, not for {wanted!r}")
        self.model = PipelineModel.load(os.path.join(folder, "model"))

    def prior(self) -> Column:
        return risk.failure_prior(*[self.metrics[c] for c in ("tp", "fn", "tn", "fp")])

    def score(self, features: DataFrame) -> DataFrame:
        """Adds `raw_prob`; missing feature columns count as 0."""
        absent = {c: F.lit(0.0) for c in ALL_FEATURES if c not in features.columns}
        full = features.withColumns(absent) if absent else features
        vectors = VectorAssembler(inputCols=ALL_FEATURES, outputCol="features").transform(full)
        return apply(self.model, vectors).drop("features", *absent)

    def importances(self) -> list[tuple[str, float]]:
        return model_importances(self.model)


def model_importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(feature, importance), largest first; empty for models without importances."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return []
    values = last.featureImportances.toArray()
    pairs = [(name, float(v)) for name, v in zip(ALL_FEATURES, values)]
    return sorted(pairs, key=lambda p: -p[1])


def importance_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    rows = [(n, round(v, 6)) for n, v in model_importances(model)]
    return spark.createDataFrame(rows, "feature string, importance double")


def model_explanation(importances: list[tuple[str, float]], columns: list[str]) -> Column:
    """The most important features with the values of the row."""
    entries = []
    for i, (name, weight) in enumerate(importances[:EXPLANATION_SIZE]):
        value = F.col(name).cast("double") if name in columns else F.lit(0.0)
        entries.append(F.struct(
            F.lit(i + 1).alias("rank"), F.lit(name).alias("feature"),
            rounded(value, 4).alias("value"), F.lit(round(weight, 6)).alias("importance"),
            risk.direction(name, value).alias("direction")))
    if not entries:
        return F.array().cast("array<struct<rank:int,feature:string,value:double,importance:double,direction:string>>")
    return F.array(*entries)


def score_batch(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Probability, prediction, risk band and explanation for feature rows."""
    plain = rows.drop("features").fillna(0, subset=ALL_FEATURES)
    vectors = VectorAssembler(inputCols=ALL_FEATURES, outputCol="features").transform(plain)
    scored = apply(model, vectors).drop("features")
    return scored.withColumns({
        "prediction": risk.prediction("raw_prob"),
        "risk_level": risk.risk_band("raw_prob"),
        "failure_probability": rounded("raw_prob", 4),
        "explanation": model_explanation(model_importances(model), rows.columns),
    })
