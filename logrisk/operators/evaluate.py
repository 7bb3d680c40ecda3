"""Exact evaluation metrics as DataFrame queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.functions.casts import rounded_columns
from logrisk.operators.ordered import Limits, Run, running
from logrisk.session import checkpointed


def _predicted(prob: str | None, pred: str | None, threshold: float) -> Column:
    return F.col(pred) == 1 if pred else F.col(prob) >= threshold


def confusion(rows: DataFrame, *, label: str = "label", prob: str | None = "prob",
              pred: str | None = None, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, tn, fp, fn in one row, or one row per group."""
    hit, true = _predicted(prob, pred, threshold), F.col(label) == 1
    return rows.groupBy(*by).agg(
        F.count_if(hit & true).alias("tp"), F.count_if(~hit & ~true).alias("tn"),
        F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_metrics(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Adds accuracy, precision, recall, f1, mcc, specificity; 0 where undefined."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    out = counts.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn),
        "mcc": _ratio(tp * tn - fp * fn, spread),
        "specificity": _ratio(tn, tn + fp),
    })
    return rounded_columns(out, {
        m: digits for m in ("accuracy", "precision", "recall", "f1", "mcc", "specificity")})


def class_report(counts: DataFrame, names: tuple[str, str] = ("Success", "Failure"),
                 digits: int = 4) -> DataFrame:
    """Per-class precision, recall, f1 and support, then macro and weighted averages."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))

    def entry(order: int, name: str, hit: Column, extra: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(order).alias("position"), F.lit(name).alias("class"),
            _ratio(hit, hit + extra).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"),
            _ratio(F.lit(2.0) * hit, F.lit(2.0) * hit + extra + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    pair = counts.select(
        entry(1, names[0], tn, fn, fp).alias("a"), entry(2, names[1], tp, fp, fn).alias("b"))
    a, b = F.col("a"), F.col("b")
    total = a["support"] + b["support"]

    def average(order: int, name: str, wa: Column, wb: Column) -> Column:
        return F.struct(
            F.lit(order).alias("position"), F.lit(name).alias("class"),
            *[(a[m] * wa + b[m] * wb).alias(m) for m in ("precision", "recall", "f1")],
            total.alias("support"),
        )

    half = F.lit(0.5)
    rows = pair.select(F.explode(F.array(
        a, b, average(3, "macro avg", half, half),
        average(4, "weighted avg", _ratio(a["support"], total), _ratio(b["support"], total)),
    )).alias("r"))
    flat = rows.select("r.position", "r.class", "r.precision", "r.recall", "r.f1",
                       F.col("r.support").cast("long").alias("support"))
    return rounded_columns(flat, {m: digits for m in ("precision", "recall", "f1")})


def log_loss(rows: DataFrame, *, label: str = "label", prob: str = "prob",
             digits: int = 4) -> DataFrame:
    tiny = 2.220446049250313e-16
    p = F.greatest(F.lit(tiny), F.least(F.lit(1.0 - tiny), F.col(prob)))
    loss = -F.avg(F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p)))
    return rounded_columns(rows.agg(loss.alias("log_loss")), {"log_loss": digits})


def by_score(rows: DataFrame, *, label: str = "label", prob: str = "prob") -> DataFrame:
    """Positives and negatives per distinct score: the input of every curve."""
    return rows.groupBy(F.col(prob).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def cumulated(scores: DataFrame, *, limits: Limits = Limits()) -> DataFrame:
    """Counts at or above each score, and the overall counts on every row.

    The distinct scores are stored: they are counted, accumulated and summed.
    """
    scores = checkpointed(scores)
    runs = [Run("tp", "sum", F.col("pos")), Run("fp", "sum", F.col("neg"))]
    out = running(scores, [], [F.col("score").desc()], [runs], limits=limits)
    whole = scores.agg(F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"))
    return out.crossJoin(F.broadcast(whole))


def ranking_metrics(rows: DataFrame, *, label: str = "label", prob: str = "prob",
                    digits: int = 4, limits: Limits = Limits()) -> DataFrame:
    """ROC-AUC (ties averaged) and average precision; 0 where undefined."""
    points = cumulated(by_score(rows, label=label, prob=prob), limits=limits)
    pos, neg, fp, tp = (F.col(c).cast("double") for c in ("pos", "neg", "fp", "tp"))
    below = F.col("n_all").cast("double") - fp
    out = points.agg(
        F.sum(pos * (below + neg / 2)).alias("wins"),
        F.sum(pos * _ratio(tp, tp + fp)).alias("steps"),
        F.max("p_all").cast("double").alias("p"),
        F.max("n_all").cast("double").alias("n"),
    )
    p, n = F.coalesce("p", F.lit(0.0)), F.coalesce("n", F.lit(0.0))
    areas = out.select(
        _ratio(F.col("wins"), p * n).alias("roc_auc"), _ratio(F.col("steps"), p).alias("pr_auc"))
    return rounded_columns(areas, {"roc_auc": digits, "pr_auc": digits})


def roc_points(rows: DataFrame, *, label: str = "label", prob: str = "prob",
               limits: Limits = Limits()) -> DataFrame:
    points = cumulated(by_score(rows, label=label, prob=prob), limits=limits)
    return points.select(
        F.col("score").alias("threshold"),
        _ratio(F.col("fp"), F.col("n_all")).alias("fpr"),
        _ratio(F.col("tp"), F.col("p_all")).alias("tpr"),
    )


def pr_points(rows: DataFrame, *, label: str = "label", prob: str = "prob",
              limits: Limits = Limits()) -> DataFrame:
    points = cumulated(by_score(rows, label=label, prob=prob), limits=limits)
    return points.select(
        F.col("score").alias("threshold"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("p_all")).alias("recall"),
        _ratio(F.col("p_all"), F.col("p_all") + F.col("n_all")).alias("base_rate"),
    )


def score_histogram(rows: DataFrame, *, label: str = "label", prob: str = "prob",
                    bins: int = 40) -> DataFrame:
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(prob) * bins))).cast("int")
    return rows.groupBy(label, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_importances(importances: DataFrame, top: int = 20) -> DataFrame:
    """The largest importances with the mean of all of them."""
    mean = rounded_columns(importances.agg(F.avg("importance").alias("mean_importance")),
                           {"mean_importance": 6})
    best = importances.orderBy(F.desc("importance"), "feature").limit(top)
    return best.crossJoin(F.broadcast(mean))


def rank_models(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("f1"), F.desc("pr_auc"), F.desc("recall"), "model")
