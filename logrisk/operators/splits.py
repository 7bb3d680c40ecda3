"""Group-held-out splits, folds and class weights, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrisk.functions.casts import rounded
from logrisk.config import FOLDS, TEST_SHARE
from logrisk.operators.ordered import Limits, row_numbers
from logrisk.session import checkpointed


def group_labels(rows: DataFrame, group: str = "group_id", label: str = "label") -> DataFrame:
    return rows.groupBy(group).agg(F.max(label).alias("label"))


def can_group_split(groups: DataFrame) -> DataFrame:
    """Group count, classes, smallest class, and whether a split by group is possible."""
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    out = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_groups"),
        F.count(F.lit(1)).alias("n_classes"),
        F.coalesce(F.min("n"), F.lit(0)).alias("smallest"),
    )
    ok = (F.col("n_groups") >= 4) & (F.col("n_classes") == 2) & (F.col("smallest") >= 2)
    return out.withColumn("allowed", ok)


def _shuffled(groups: DataFrame, group: str, limits: Limits) -> DataFrame:
    """Numbers the groups of each label by the md5 of the group id.

    Expects stored groups: they are read once to count and once to number.
    """
    hashed = groups.withColumn("_h", F.md5(F.col(group).cast("string")))
    out = row_numbers(hashed, ["label"], ["_h", group], "rn", total="in_label", limits=limits)
    return out.drop("_h")


def group_holdout(groups: DataFrame, *, group: str = "group_id", share: float = TEST_SHARE,
                  limits: Limits = Limits()) -> DataFrame:
    """`is_test` for the first share of the groups of each label, in hash order."""
    numbered = _shuffled(checkpointed(groups), group, limits)
    test = F.col("rn") <= F.ceil(F.col("in_label") * F.lit(share))
    return numbered.select(group, "label", test.cast("int").alias("is_test"))


def group_folds(groups: DataFrame, *, group: str = "group_id", folds: int = FOLDS,
                limits: Limits = Limits()) -> DataFrame:
    """Stratified fold per group; the number of folds is at most the smallest class."""
    groups = checkpointed(groups)
    numbered = _shuffled(groups, group, limits)
    smallest = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("_k"))
    k = F.least(F.lit(folds), F.col("_k"))
    return numbered.crossJoin(F.broadcast(smallest)).select(
        group, "label", ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def rows_of(rows: DataFrame, groups: DataFrame, group: str = "group_id") -> DataFrame:
    return rows.join(groups.select(group), group, "left_semi")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Negative-to-positive ratio and the balanced weight of each class."""
    out = rows.agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    n = F.col("n_pos") + F.col("n_neg")
    return out.select(
        "n_pos", "n_neg",
        F.when(F.col("n_pos") > 0, rounded(F.col("n_neg") / F.col("n_pos"), 2)).otherwise(1.0)
        .alias("pos_ratio"),
        F.when(F.col("n_pos") > 0, n / (F.lit(2) * F.col("n_pos"))).otherwise(0.0).alias("weight_pos"),
        F.when(F.col("n_neg") > 0, n / (F.lit(2) * F.col("n_neg"))).otherwise(0.0).alias("weight_neg"),
    )
