"""The canonical feature table: metadata plus 62 numeric columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.config import COUNT_FEATURES, LOG1P_COLUMNS, METADATA, VALUE_FEATURES
from logrisk.operators.logfeatures import with_log1p

BASE_FEATURES = COUNT_FEATURES + VALUE_FEATURES
LOG1P_FEATURES = [f"log1p_{c}" for c in LOG1P_COLUMNS]
ALL_FEATURES = BASE_FEATURES + LOG1P_FEATURES


def align(features: DataFrame, source: str | None = None) -> DataFrame:
    """Fills missing columns with 0 and fixes order and types; extra columns are dropped."""
    def number(name: str, kind: str) -> Column:
        if name not in features.columns:
            return F.lit(0).cast(kind).alias(name)
        return F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind)).alias(name)

    have = features.columns
    group = "group_id" if "group_id" in have else "process_id"
    origin = F.lit(source) if source else F.col("source")
    label = F.col("label").cast("int") if "label" in have else F.lit(None).cast("int")
    base = features.select(
        "process_id", F.col(group).alias("group_id"), origin.alias("source"), label.alias("label"),
        *[number(c, "long") for c in COUNT_FEATURES],
        *[number(c, "double") for c in VALUE_FEATURES],
    )
    return with_log1p(base.select(*METADATA, *BASE_FEATURES))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; a column one source lacks becomes 0."""
    names = list(dict.fromkeys(c for part in parts for c in part.columns))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    numeric = [c for c in names if c not in METADATA]
    return united.fillna(0, subset=numeric)


def source_kind(features: DataFrame) -> DataFrame:
    """`trained_source`: the only source, `both` for several, `unknown` for none."""
    name = F.lower(F.trim("source"))
    found = features.select(F.when(name != "", name).alias("s")).distinct()
    return found.agg(F.count("s").alias("n"), F.min("s").alias("one")).select(
        F.when(F.col("n") == 1, F.col("one")).when(F.col("n") > 1, "both")
        .otherwise("unknown").alias("trained_source"))
