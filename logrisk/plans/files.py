"""Queries that write the given tables as files in the shared folder and read them back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from logrisk.operators import etl, report
from logrisk.plans import tables
from logrisk.plans.queries import _alerts, _session_alerts, query
from logrisk.session import new_folder, written
from logrisk.sources import logs, registry, sinks, stored
from logrisk.sources import traces as trace_files


def _log_text(spark, folder: str) -> str:
    target = new_folder(spark, "log-text")
    tables.log_raw(spark, folder).orderBy("seq").select("value").write.text(target)
    return target


def _labels_csv(spark, folder: str) -> str:
    target = new_folder(spark, "labels")
    tables.block_labels(spark, folder).write.option("header", True).csv(target)
    return target


def _events_csv(spark, folder: str) -> str:
    target = new_folder(spark, "events")
    tables.job_events(spark, folder).orderBy("seq").drop("seq").write.option("header", True).csv(target)
    return target


@query
def log_text_scan(spark, folder):
    return logs.read_log(spark, _log_text(spark, folder))


@query
def labels_csv_scan(spark, folder):
    return logs.read_labels(spark, _labels_csv(spark, folder))


@query
def job_events_csv_scan(spark, folder):
    return trace_files.read_job_events(spark, _events_csv(spark, folder)).select(
        "seq", "job_id", "event_type", "cpu_request", "user")


@query
def orders_csv_scan(spark, folder):
    target = new_folder(spark, "orders")
    orders = tables.etl_orders(spark, folder)
    orders.orderBy("seq").drop("seq").write.option("header", True).csv(target)
    return stored.read_orders(spark, target).select(
        "seq", "order_id", "customer_id", F.col("amount").cast("double").alias("amount"))


@query
def registry_union(spark, folder):
    rows = registry.load_features(spark, "both", log=_log_text(spark, folder), labels=_labels_csv(spark, folder),
                                  events=_events_csv(spark, folder))
    return rows.select("process_id", "source", "label", "total_lines", "error_count")


@query
def curated_files(spark, folder):
    target = new_folder(spark, "curated")
    sinks.write_curated(etl.curate(tables.etl_orders(spark, folder)), target, by_risk=True)
    kept = spark.read.schema("order_id string, customer_id string, order_date date, status string, amount_usd double, risk_partition string")
    return kept.option("header", True).csv(target).select("order_id", "customer_id", "status", "amount_usd", "risk_partition")


@query
def alert_files(spark, folder):
    target = new_folder(spark, "alerts")
    sinks.write_alerts(_alerts(spark, folder), target)
    kept = spark.read.schema("process_id string, seq long, trigger string, risk_level string, failure_probability double, timestamp timestamp")
    return kept.json(target).where("timestamp is not null").drop("timestamp")


@query
def appended_lines(spark, folder):
    """The log appended twice, and once more by a stream."""
    target, source = new_folder(spark, "raw-lines"), _log_text(spark, folder)
    lines = tables.log_raw(spark, folder)
    for _ in range(2):
        sinks.append_lines(lines, target, "value")
    streamed = new_folder(spark, "stream-lines")
    sinks.append_stream(spark.readStream.text(source), streamed, "value", new_folder(spark, "stream-mark")).awaitTermination()
    return spark.read.text([target, streamed]).groupBy("value").agg(F.count(F.lit(1)).alias("times"))


@query
def session_files(spark, folder):
    """Alerts and lines of the sessions as tables, counted after reading back."""
    target = new_folder(spark, "session")
    # The report reads its alerts several times, so they are stored first.
    alerts = written(_session_alerts(spark, folder).drop("explanation"), "alerts")
    number = F.regexp_extract("value", r"blk_-?(\d+)", 1).cast("long")
    lines = tables.log_raw(spark, folder).select(
        F.concat(F.lit("s"), F.pmod(number, F.lit(13)).cast("string")).alias("session_id"), "seq", F.col("value").alias("line"))
    sinks.write_session(report.session_report(lines, alerts), alerts, lines, target)
    n_alerts = spark.read.schema("session_id string").json(os.path.join(target, "alerts")).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("alerts"))
    n_lines = spark.read.schema("session_id string").json(os.path.join(target, "logs")).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("lines"))
    return n_alerts.join(n_lines, "session_id", "full")


@query
def ranking_files(spark, folder):
    """A ranking of two fixed scores over the labelled blocks, written and read as CSV and JSON."""
    target = new_folder(spark, "ranking")
    labels = tables.block_labels(spark, folder)
    failed = F.count_if(F.col("Label") == "Anomaly").cast("double") / F.count(F.lit(1))
    ranking = labels.agg(failed.alias("f1")).select(
        F.explode(F.array(F.lit("always"), F.lit("never"))).alias("model"), "f1").select(
        "model", F.when(F.col("model") == "always", F.col("f1")).otherwise(0.0).alias("f1"),
        F.lit(0.5).alias("pr_auc"), F.lit(0.5).alias("recall"))
    sinks.write_ranking(ranking, labels.agg(F.count(F.lit(1)).alias("samples")), target)
    body = stored.read_metrics(spark, os.path.join(target, "model_comparison_json"))
    order = body.select("samples", F.posexplode("ranking").alias("place", "m")).select("samples", "place", "m.model")
    return stored.read_ranking(spark, os.path.join(target, "model_comparison_csv")).join(order, "model").select(
        "model", "f1", "place", "samples")
