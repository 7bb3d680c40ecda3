"""Orders, stored metrics and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logrisk.sources.logs import numbered_rows

ORDER_SCHEMA = (
    "order_id string, customer_id string, order_date string, amount string,"
    " currency string, status string"
)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Orders with their row number `seq` in file order."""
    return numbered_rows(spark.read.schema(ORDER_SCHEMA).option("header", True).csv(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
