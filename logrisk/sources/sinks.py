"""Writers for curated rows, alerts, reports, rankings and metrics."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_curated(rows: DataFrame, folder: str, *, by_risk: bool = False) -> None:
    columns = ["order_id", "customer_id", "order_date", "status", "amount_usd", "risk_partition"]
    writer = rows.select(*columns).write.mode("overwrite").option("header", True)
    (writer.partitionBy("risk_partition") if by_risk else writer).csv(folder)


def write_alerts(alerts: DataFrame, folder: str) -> None:
    """JSON lines with the time of writing."""
    alerts.withColumn("timestamp", F.current_timestamp()).write.mode("overwrite").json(folder)


def append_lines(lines: DataFrame, folder: str, column: str) -> None:
    lines.select(F.col(column).alias("value")).write.mode("append").text(folder)


def append_stream(lines: DataFrame, folder: str, column: str, checkpoint: str) -> StreamingQuery:
    """The streaming form of `append_lines`."""
    text = lines.select(F.col(column).alias("value"))
    return (
        text.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_ranking(ranking: DataFrame, header: DataFrame, folder: str) -> None:
    """One row per model as CSV; the data-set header with the rows as JSON."""
    ranking.coalesce(1).write.mode("overwrite").option("header", True).csv(
        os.path.join(folder, "model_comparison_csv"))
    place = F.struct(F.negative("f1").alias("a"), F.negative("pr_auc").alias("b"),
                     F.negative("recall").alias("c"))
    # As many rows as there are models.
    rows = ranking.agg(F.transform(
        F.sort_array(F.collect_list(F.struct(place.alias("o"), F.struct(*ranking.columns).alias("m")))),
        lambda e: e["m"]).alias("ranking"))
    header.crossJoin(F.broadcast(rows)).coalesce(1).write.mode("overwrite").json(
        os.path.join(folder, "model_comparison_json"))


def write_metrics(metrics: DataFrame, folder: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(folder)


def write_session(report: DataFrame, alerts: DataFrame, lines: DataFrame, folder: str) -> None:
    """The report text per session, and all alerts and lines beside it."""
    report.select("report").write.mode("overwrite").text(os.path.join(folder, "reports"))
    alerts.write.mode("overwrite").json(os.path.join(folder, "alerts"))
    lines.write.mode("overwrite").json(os.path.join(folder, "logs"))
