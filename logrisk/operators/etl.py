"""Order curation: validation, conversion, expansion and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrisk.functions.casts import rounded_columns
from logrisk.config import ORDER_COLUMNS, USD_RATES
from logrisk.operators.ordered import Limits, row_numbers
from logrisk.session import written


def missing_columns(orders: DataFrame, required=tuple(ORDER_COLUMNS)) -> DataFrame:
    """One row per required column that is absent."""
    spark = orders.sparkSession
    absent = sorted(set(required) - set(orders.columns))
    return spark.createDataFrame([(c,) for c in absent], "missing_column string")


def column_check(orders: DataFrame, required=tuple(ORDER_COLUMNS)) -> DataFrame:
    """Per required column: is it there, and in how many rows is it empty? One scan."""
    def empty(name: str):
        if name not in orders.columns:
            return F.count(F.lit(1))
        return F.count_if(F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == "")

    counted = orders.agg(*[empty(c).alias(c) for c in required])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(int(c in orders.columns)).alias("present"),
                 F.col(c).alias("n_empty")) for c in required])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def _amount():
    return F.coalesce(F.col("amount").cast("string").try_cast("double"), F.lit(0.0))


def non_positive(orders: DataFrame) -> DataFrame:
    return orders.where(_amount() <= 0)


def curate(orders: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Amounts in USD with two digits and the partition they are written to."""
    currency = F.upper(F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("USD")))
    rates = F.create_map(*[F.lit(x) for item in USD_RATES.items() for x in item])
    usd = _amount() * F.coalesce(F.try_element_at(rates, currency), F.lit(1.0))
    out = orders.select(*ORDER_COLUMNS[:3], "status", *carry, usd.alias("amount_usd"))
    return rounded_columns(out, {"amount_usd": 2}).withColumn(
        "risk_partition", F.when(F.col("amount_usd") <= 0, "review").otherwise("clean"))


def expand_rows(orders: DataFrame, target: int, *, order: tuple[str, ...] = ("seq",),
                limits: Limits = Limits()) -> DataFrame:
    """The rows repeated in turn up to `target` rows, with ids `id-000001`.

    The positions are a distributed range, each joined with the row whose turn
    it is; few rows and very many copies are as many tasks as any range.
    """
    numbered = row_numbers(orders, [], list(order), "_rn", limits=limits)
    numbered = written(numbered, "numbered")
    count = numbered.count()
    if not count:
        return numbered.select(*orders.columns, F.lit(0).cast("long").alias("row_index"))
    spark = orders.sparkSession
    places = spark.range(target).select(F.col("id").alias("row_index"), (F.col("id") % count + 1).alias("_rn"))
    ids = F.concat(F.coalesce(F.col("order_id"), F.lit("ORD")), F.lit("-"),
                   F.format_string("%06d", F.col("row_index") + 1))
    return places.join(numbered, "_rn").select(
        *[ids.alias(c) if c == "order_id" else F.col(c) for c in orders.columns], "row_index")


def in_batches(rows: DataFrame, batches: int, *, order: tuple[str, ...] = ("seq",),
               limits: Limits = Limits()) -> DataFrame:
    """`batch` number from 0; every batch but the last has round(n/batches) rows."""
    numbered = row_numbers(rows, [], list(order), "_rn", total="_count", limits=limits)
    wanted = F.greatest(F.lit(1), F.least(F.lit(batches), F.col("_count")))
    size = F.greatest(F.lit(1), F.bround(F.col("_count") / wanted).cast("long"))
    return numbered.withColumn(
        "batch", F.floor((F.col("_rn") - 1) / size).cast("int")).drop("_rn", "_count")


def run_summary(orders: DataFrame) -> DataFrame:
    """Row counts of one curation run, from one scan."""
    curated = curate(orders, carry=("amount",))
    return curated.agg(
        F.count(F.lit(1)).alias("rows_extracted"),
        F.count(F.lit(1)).alias("rows_loaded"),
        F.count_if(_amount() <= 0).alias("non_positive_rows"),
        F.count_if(F.col("risk_partition") == "review").alias("review_rows"),
        F.count_if(F.col("risk_partition") == "clean").alias("clean_rows"),
    )
