"""The registered queries: each reads the given tables and returns a DataFrame."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logrisk.functions.casts import rounded
from logrisk.config import STOP_MARKER
from logrisk.functions import policy, risk, text
from logrisk.operators import (
    etl, evaluate, labelled, logfeatures, ml, report, schema, snapshots, splits, traces,
)
from logrisk.plans import monitor, tables
from logrisk.session import checkpointed, new_folder, shared_folder, written
from logrisk.sources import logs, tail
from logrisk.sources.zipcsv import file_system, register_zip_csv
from logrisk.streaming import monitor as live

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTERED[run.__name__] = run
    return run


# ------------------------------------------------------------------ shared inputs

COUNTS = [*logfeatures.FEATURE_ORDER, *[f"log1p_{c}" for c in logfeatures.LOG1P_COLUMNS]]
KEY = ["process_id", "seq", "trigger"]


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    return logfeatures.line_signals(tables.log_raw(spark, folder))


def _prefixes(spark: SparkSession, folder: str) -> DataFrame:
    raw = tables.log_raw(spark, folder)
    return logfeatures.prefix_features(logfeatures.line_signals(raw), total="total")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return logs.clean_labels(tables.block_labels(spark, folder), order=None)


def _alerts(spark: SparkSession, folder: str, **options) -> DataFrame:
    return monitor.monitor_batch(tables.log_raw(spark, folder), **options)


def _session() -> Column:
    number = F.regexp_extract("process_id", r"(\d+)", 1).cast("long")
    return F.concat(F.lit("s"), F.pmod(number, F.lit(13)).cast("string"))


def _session_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts grouped into sessions of many processes, with the stage of the triggering line."""
    alerts = _alerts(spark, folder)
    stage = F.when(F.col("trigger") == "final", "Monitor").otherwise(text.component_stage("component"))
    return alerts.withColumns({"session_id": _session(), "stage": stage})


def _brief(alerts: DataFrame, *more: str) -> DataFrame:
    return alerts.select("session_id", *KEY, "failure_probability", "lines_seen", "stage", *more)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return traces.clean_events(tables.job_events(spark, folder))


def _job_groups(spark: SparkSession, folder: str) -> DataFrame:
    return traces.job_labels(_events(spark, folder)).select(F.col("job_id").alias("group_id"), "label")


def _gpu(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return (traces.gpu_jobs(tables.gpu_jobs(spark, folder)),
            traces.gpu_tasks(tables.gpu_tasks(spark, folder)))


def _app(spark: SparkSession, folder: str) -> DataFrame:
    lines = tables.app_logs(spark, folder)
    return lines.withColumns({
        "session_id": F.col("user_id"),
        "level": text.detect_level(F.col("line")), "stage": text.detect_stage(F.col("line"))})


def _policies() -> Column:
    return F.explode(F.array(*[F.lit(p) for p in policy.POLICIES]))


# ------------------------------------------------------------------ parsing and features


@query
def log_parse(spark, folder):
    parsed = text.parse_lines(tables.log_raw(spark, folder))
    return parsed.withColumn("n_blocks", F.size("block_ids")).drop("block_ids")


@query
def log_explode(spark, folder):
    return _signals(spark, folder).select(
        "process_id", "seq", "pid", "level", "component", "ts_s", "is_error", "kw_error", "kw_warning",
        "kw_critical", "is_retry", "is_exception", "comp_failing")


@query
def risk_every_n(spark, folder):
    """The flagship: features and signal risk at every 20th line of each process."""
    raw = tables.log_raw(spark, folder)
    prefixes = logfeatures.prefix_features(logfeatures.line_signals(raw))
    features = logfeatures.finish_log_features(snapshots.every_n(prefixes))
    scored = features.withColumn("_p", risk.signal_probability())
    return scored.select("process_id", "seq", *COUNTS, rounded("_p", 4).alias("signal_probability"),
                         risk.risk_band("_p").alias("risk_level"))


@query
def log_features(spark, folder):
    return logfeatures.log_features(tables.log_raw(spark, folder))


@query
def label_inner(spark, folder):
    joined = labelled.with_labels(log_features(spark, folder), _labels(spark, folder))
    return joined.select("process_id", "label", "total_lines", "error_count")


@query
def unlabelled_anti(spark, folder):
    return labelled.unlabelled(_signals(spark, folder), _labels(spark, folder))


@query
def error_burst(spark, folder):
    raw = tables.log_raw(spark, folder)
    counted = logfeatures.history_features(logfeatures.line_signals(raw))
    return counted.select("process_id", "max_error_burst")


@query
def log_timing(spark, folder):
    return log_features(spark, folder).select("process_id", "duration_s", "hour_of_day", "is_weekend")


@query
def dataset_counts(spark, folder):
    return labelled.dataset_counts(_signals(spark, folder), _labels(spark, folder))


# ------------------------------------------------------------------ snapshots, sessions, cuts


@query
def early_warning(spark, folder):
    prefixes = _prefixes(spark, folder)
    samples = snapshots.early_warning(prefixes)
    return logfeatures.finish_log_features(samples).select("process_id", "group_id", *COUNTS)


@query
def every_n_plus_final(spark, folder):
    prefixes = _prefixes(spark, folder)
    return snapshots.triggers(prefixes).select(
        *KEY, "total_lines", "error_count", "max_error_burst", "unique_components")


@query
def inactivity_sessions(spark, folder):
    events = tables.table(spark, folder, "events").select(
        F.col("user_id").alias("process_id"), "ts", F.col("event_id").alias("seq"))
    return snapshots.inactivity_sessions(events, gap_s=6 * 3600)


@query
def session_numbers(spark, folder):
    raw = tables.log_raw(spark, folder)
    lines = logfeatures.line_signals(raw).select("process_id", "seq", "ts_s")
    return snapshots.with_sessions(lines, gap=6 * 3600).select("process_id", "seq", "session_no")


@query
def cut_first_high(spark, folder):
    stops = monitor.stop_points(_alerts(spark, folder, final=False))
    lines = _signals(spark, folder).select("process_id", "seq")
    kept = lines.join(stops, "process_id", "left").where(
        F.col("stop_seq").isNull() | (F.col("seq") <= F.col("stop_seq")))
    return kept.groupBy("process_id").agg(
        F.max("stop_seq").alias("stop_seq"), F.count(F.lit(1)).alias("kept_lines"))


@query
def auto_stop_alerts(spark, folder):
    """Each process is its own run, stopped at its first HIGH alert."""
    # The line stays beside its blocks, so the text is read once and never joined.
    raw = tables.log_raw(spark, folder).withColumn("line", F.col("value"))
    own = text.explode_blocks(text.parse_lines(raw).select("seq", "line", "block_ids")).select(
        "seq", F.col("line").alias("value"), F.col("process_id").alias("session_id"))
    alerts = monitor.monitor_until_high(own)
    # A line of two processes belongs to both runs; each run keeps its own process.
    mine = alerts.where(F.col("session_id") == F.col("process_id"))
    return mine.select(*KEY, "lines_seen", "failure_probability", "risk_level", "action")


@query
def cut_marker(spark, folder):
    raw = tables.log_raw(spark, folder)
    marked = raw.withColumn(
        "value", F.when(F.col("seq").isin(500, 700), STOP_MARKER).otherwise(F.col("value")))
    return snapshots.cut_at_marker(marked)


@query
def first_lines(spark, folder):
    bounded = snapshots.first_lines(tables.log_raw(spark, folder), 1000)
    return report.level_histogram(text.parse_lines(bounded))


# ------------------------------------------------------------------ cluster traces


@query
def job_events_parse(spark, folder):
    return _events(spark, folder)


@query
def job_labels(spark, folder):
    return traces.job_labels(_events(spark, folder))


@query
def job_features(spark, folder):
    return traces.job_features(_events(spark, folder))


@query
def reschedules(spark, folder):
    return traces.ordered_events(_events(spark, folder)).groupBy("job_id").agg(
        F.sum("rescheduled").alias("retry_count"), F.max("burst").alias("max_error_burst"),
        F.count(F.lit(1)).alias("n_events"))


@query
def job_early_warning(spark, folder):
    samples = labelled.event_prefixes(_events(spark, folder))
    return traces.job_features(samples).select(
        "process_id", "total_lines", "error_count", "retry_count", "max_error_burst", "duration_s",
        "cpu_request", "oom_signal")


@query
def gpu_job_features(spark, folder):
    return traces.gpu_features(*_gpu(spark, folder))


@query
def gpu_early_warning(spark, folder):
    jobs, _ = _gpu(spark, folder)
    tasks = traces.gpu_tasks(tables.gpu_tasks(spark, folder).withColumn(
        "seq", F.struct("task_name", "plan_cpu")))
    return labelled.gpu_samples(jobs, tasks, early=True).select(
        "process_id", "group_id", "label", "total_lines", "instance_count", "duration_s",
        "cpu_request", "scheduling_delay_s")


@query
def gpu_tasks_semi(spark, folder):
    jobs, tasks = _gpu(spark, folder)
    return traces.tasks_of(tasks, jobs)


@query
def jobs_with_tasks(spark, folder):
    return traces.jobs_with_tasks(*_gpu(spark, folder)).select(
        "job_name", "status", "label", "task_name", "time", "instance_count", "cpu_request",
        "memory_request", "gpu_request")


@query
def bounded_jobs(spark, folder):
    return traces.gpu_jobs(tables.gpu_jobs(spark, folder), limit=500).select("job_name", "status", "label")


@query
def borg_features(spark, folder):
    return traces.borg_features(tables.borg_rows(spark, folder))


@query
def headerless_events(spark, folder):
    """Scheduler events as CSV lines of 12, 8 and 9 columns without a header."""
    e = tables.job_events(spark, folder)
    time = F.format_string("%d", F.col("time").cast("long"))
    head = F.concat_ws(",", time, F.lit(""), "job_id", F.col("event_type").cast("string"), "user",
                       F.col("scheduling_class").cast("string"))
    cpu = (F.col("priority") / 16).cast("string")
    memory = (F.col("scheduling_class") / 4).cast("string")
    numbers = F.concat_ws(",", F.col("priority").cast("string"), cpu, memory, F.lit("0.5"))
    long = F.concat_ws(",", head, F.lit('"name, quoted"'), F.lit(""), numbers)
    short = F.concat_ws(",", time, "job_id", F.col("event_type").cast("string"),
                        F.col("scheduling_class").cast("string"), numbers)
    other = F.concat_ws(",", head, F.lit("name"), F.lit(""), F.lit("extra"))
    line = F.when(F.col("seq") % 3 == 0, long).when(F.col("seq") % 3 == 1, short).otherwise(other)
    return traces.parse_event_lines(e.select("seq", line.alias("value")))


def _sources(spark, folder) -> list[DataFrame]:
    jobs, tasks = _gpu(spark, folder)
    return [
        labelled.log_samples(tables.log_raw(spark, folder), _labels(spark, folder)),
        labelled.job_samples(_events(spark, folder)),
        labelled.gpu_samples(jobs, tasks),
        labelled.borg_samples(tables.borg_rows(spark, folder)),
    ]


@query
def features_union(spark, folder):
    return schema.union_sources(_sources(spark, folder))


@query
def source_kind(spark, folder):
    return schema.source_kind(features_union(spark, folder))


# ------------------------------------------------------------------ scores, reasons, decisions


def _calibrated(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        *KEY, "lines_seen", "raw_model_failure_probability", "signal_failure_probability",
        "failure_probability", "prediction", "risk_level")


def _reasons(alerts: DataFrame) -> DataFrame:
    return alerts.select(*KEY, F.explode("explanation").alias("e")).select(*KEY, "e.*")


@query
def stream_calibration(spark, folder):
    return _calibrated(_alerts(spark, folder))


@query
def signal_explanation(spark, folder):
    return _reasons(_alerts(spark, folder))


@query
def rule_score(spark, folder):
    return _alerts(spark, folder, mode="rules").select(
        *KEY, "failure_probability", "prediction", "risk_level")


@query
def rule_explanation(spark, folder):
    return _reasons(_alerts(spark, folder, mode="rules"))


@query
def feature_directions(spark, folder):
    names = ["error_count", "info_count", "error_rate", "duration_s", "has_fatal"]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]))
    rows = log_features(spark, folder).select("process_id", pairs.alias("v")).select("process_id", "v.*")
    return rows.withColumn("direction", risk.direction(F.col("feature"), F.col("value")))


def _all_policies(spark, folder) -> DataFrame:
    alerts = _alerts(spark, folder)
    reviewed = _signals(spark, folder).where(F.col("process_id").startswith("blk_-"))
    marks = reviewed.select("process_id").distinct().withColumn("_reviewed", F.lit(True))
    joined = alerts.drop("action", "recommendation").join(marks, "process_id", "left")
    return joined.withColumn("reviewed", F.coalesce("_reviewed", F.lit(False))).withColumn("policy", _policies())


@query
def alert_actions(spark, folder):
    action = policy.alert_action(F.col("risk_level"), F.col("policy"), F.col("reviewed"))
    return _all_policies(spark, folder).select(*KEY, "policy", action.alias("action"))


@query
def review_release(spark, folder):
    """Under review, an operator releases every third process at its 20th line, so only later alerts go on."""
    alerts = _alerts(spark, folder)
    number = F.regexp_extract("process_id", r"(\d+)", 1).cast("long")
    marks = alerts.where((F.col("trigger") == "every_n") & (F.col("lines_seen") == 20) & (number % 3 == 0))
    marks = written(marks.select("process_id", "seq"), "marks")
    return _alerts(spark, folder, policy="review", reviewed=marks).select(*KEY, "risk_level", "action")


@query
def recommendation(spark, folder):
    words = policy.alert_recommendation(
        F.col("risk_level"), F.col("policy"), F.col("reviewed"), F.col("process_id"),
        F.col("failure_probability"))
    return _all_policies(spark, folder).select(*KEY, "policy", words.alias("recommendation"))


@query
def session_state(spark, folder):
    """Every third session gave no alert: those report the default text."""
    alerts = _session_alerts(spark, folder)
    silent = F.pmod(F.regexp_extract("session_id", r"(\d+)", 1).cast("int"), F.lit(3)) == 0
    state = report.session_state(alerts.where(~silent))
    return report.session_advice(report.with_idle_sessions(state, alerts))


@query
def final_status(spark, folder):
    state = report.session_state(_session_alerts(spark, folder))
    codes = F.explode(F.array(F.lit(0), F.lit(2), F.lit(None).cast("int")))
    out = state.withColumn("return_code", codes).withColumn(
        "status", policy.final_status(F.col("return_code"), F.col("had_high") == 1))
    return out.select("session_id", "return_code", "status",
                      policy.is_terminal(F.col("status")).cast("int").alias("is_terminal"))


@query
def intervention(spark, folder):
    counts = report.risk_counts(_session_alerts(spark, folder)).withColumn("policy", _policies())
    return counts.select("session_id", "policy", F.col("HIGH").alias("high_risk_count"),
                         policy.intervention(F.col("HIGH"), F.col("policy")).alias("decision"))


# ------------------------------------------------------------------ evaluation and splits


@query
def confusion(spark, folder):
    return evaluate.confusion(tables.scored(spark, folder), threshold=0.1)


@query
def failure_prior(spark, folder):
    counts = confusion(spark, folder)
    prior = risk.failure_prior(*[F.col(c) for c in ("tp", "fn", "tn", "fp")])
    return counts.select(prior.alias("prior"))


@query
def class_metrics(spark, folder):
    return evaluate.class_metrics(confusion(spark, folder))


@query
def class_report(spark, folder):
    return evaluate.class_report(confusion(spark, folder))


@query
def log_loss(spark, folder):
    return evaluate.log_loss(tables.scored(spark, folder))


@query
def roc_auc(spark, folder):
    return evaluate.ranking_metrics(tables.scored(spark, folder)).select("roc_auc")


@query
def avg_precision(spark, folder):
    return evaluate.ranking_metrics(tables.scored(spark, folder)).select("pr_auc")


@query
def roc_points(spark, folder):
    return evaluate.roc_points(tables.scored(spark, folder))


@query
def pr_points(spark, folder):
    return evaluate.pr_points(tables.scored(spark, folder))


@query
def score_hist(spark, folder):
    return evaluate.score_histogram(tables.scored(spark, folder))


def _borg_groups(spark, folder) -> DataFrame:
    return splits.group_labels(traces.borg_features(tables.borg_rows(spark, folder)))


@query
def group_labels(spark, folder):
    return _borg_groups(spark, folder)


@query
def group_split_allowed(spark, folder):
    return splits.can_group_split(_borg_groups(spark, folder))


@query
def group_holdout(spark, folder):
    return splits.group_holdout(_job_groups(spark, folder))


@query
def group_folds(spark, folder):
    return splits.group_folds(_job_groups(spark, folder))


@query
def train_rows(spark, folder):
    held = group_holdout(spark, folder).where("is_test = 0").withColumnRenamed("group_id", "job_id")
    kept = splits.rows_of(_events(spark, folder), held, "job_id")
    return kept.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_events"))


@query
def class_weights(spark, folder):
    return splits.class_weights(traces.borg_features(tables.borg_rows(spark, folder)))


# ------------------------------------------------------------------ free text


@query
def detect_level(spark, folder):
    return report.level_histogram(_app(spark, folder))


@query
def detect_stage(spark, folder):
    return _app(spark, folder).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


NORMAL = ["seq", "level", "stage", "component", "process_id", "normalized_line"]


@query
def normalise_lines(spark, folder):
    lines = tables.app_logs(spark, folder)
    return text.normalise_lines(lines, "line", "user_id", text.line_stamp("ts")).select(*NORMAL)


@query
def normalise_ready(spark, folder):
    lines = tables.log_raw(spark, folder).withColumn("run", F.lit(1))
    return text.normalise_lines(lines, "value", "run", F.lit("700101 000000")).select(*NORMAL)


@query
def component_stage(spark, folder):
    parsed = text.parse_lines(tables.log_raw(spark, folder))
    return parsed.groupBy(text.component_stage("component").alias("stage"), "component").agg(
        F.count(F.lit(1)).alias("n"))


@query
def alert_text(spark, folder):
    return _alerts(spark, folder).select(*KEY, risk.alert_text().alias("alert"))


@query
def text_alerts(spark, folder):
    """Free-text lines through the adapter into the monitor, one process per run."""
    alerts = monitor.monitor_text(tables.app_logs(spark, folder), value="line", pid="user_id",
                                  stamp=text.line_stamp("ts"))
    return alerts.select(*KEY, "lines_seen", "failure_probability", "risk_level", "stage", "component")


# ------------------------------------------------------------------ order curation


@query
def etl_validate(spark, folder):
    return etl.non_positive(tables.etl_orders(spark, folder)).select("order_id", "amount", "currency")


@query
def etl_missing(spark, folder):
    return etl.column_check(tables.etl_orders(spark, folder).drop("status"))


@query
def etl_curate(spark, folder):
    return etl.curate(tables.etl_orders(spark, folder))


@query
def etl_expand(spark, folder):
    orders = tables.etl_orders(spark, folder)
    n = orders.count()
    return etl.expand_rows(orders, 2 * n + n // 2).select("order_id", "row_index", "customer_id", "amount")


@query
def etl_batches(spark, folder):
    return etl.in_batches(tables.etl_orders(spark, folder), 12).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query
def etl_summary(spark, folder):
    return etl.run_summary(tables.etl_orders(spark, folder))


# ------------------------------------------------------------------ session tables


@query
def risk_counts(spark, folder):
    return report.risk_counts(_session_alerts(spark, folder))


@query
def session_summary(spark, folder):
    return report.session_summary(_session_alerts(spark, folder), ("session_id",))


@query
def high_risk_top10(spark, folder):
    return _brief(report.top_high(_session_alerts(spark, folder)))


@query
def high_risk_per_session(spark, folder):
    return _brief(report.top_high_per_session(_session_alerts(spark, folder)), "place")


@query
def first_high(spark, folder):
    return _brief(report.first_high(_session_alerts(spark, folder)))


@query
def latest_high(spark, folder):
    return _brief(report.latest_high(_session_alerts(spark, folder)), "risk_level")


@query
def recent_alerts(spark, folder):
    return _brief(report.newest(_session_alerts(spark, folder), 50, report.arrival()), "risk_level")


@query
def risk_timeline(spark, folder):
    return report.timeline(
        checkpointed(_session_alerts(spark, folder).drop("explanation", "recommendation"))).select(
        "session_id", *KEY, "prediction_no", "percent")


@query
def high_seen_before(spark, folder):
    alerts = checkpointed(_session_alerts(spark, folder).drop("explanation", "recommendation"))
    return report.high_seen_before(alerts).select("session_id", *KEY, "high_before")


@query
def level_hist(spark, folder):
    return report.level_histogram(_app(spark, folder), ("session_id",))


@query
def stage_counts(spark, folder):
    return report.stage_counts(_app(spark, folder))


@query
def stage_state(spark, folder):
    lines = _app(spark, folder)
    alarms = lines.where(F.col("level") == "FATAL").withColumn("risk_level", F.lit("HIGH"))
    return report.stage_state(lines, alarms)


@query
def stage_changes(spark, folder):
    return report.stage_changes(_app(spark, folder))


@query
def resource_summary(spark, folder):
    return report.resource_summary(tables.resource_samples(spark, folder))


@query
def line_resources(spark, folder):
    samples = tables.resource_samples(spark, folder).drop("ts")
    return report.lines_with_samples(_app(spark, folder), samples).select(
        "session_id", "seq", "level", "stage", "cpu_percent", "memory_rss_mb")


@query
def session_report(spark, folder):
    """Summary of every session, with the totals of its complete alert and line tables."""
    # The report reads its alerts several times, so they are stored first.
    alerts = written(_session_alerts(spark, folder).drop("explanation"), "alerts")
    lines = _signals(spark, folder).select("seq", "process_id", "level", "component").withColumns({
        "session_id": _session(), "stage": text.component_stage("component")})
    made = report.session_report(lines, alerts, status="completed", source="events", policy="advise")

    def read(path: str, kind: str) -> Column:
        return F.get_json_object("report", path).cast(kind)

    listed = F.coalesce(F.json_array_length(F.get_json_object("report", "$.summary.high_risk_processes")), F.lit(0))
    return made.select(
        "session_id",
        read("$.summary.status", "string").alias("status"),
        read("$.summary.stop_policy", "string").alias("stop_policy"),
        read("$.summary.recommendation", "string").alias("recommendation"),
        read("$.summary.lines_processed", "long").alias("lines_processed"),
        read("$.summary.total_predictions", "long").alias("total_predictions"),
        read("$.summary.current_risk", "string").alias("current_risk"),
        read("$.summary.latest_probability", "double").alias("latest_probability"),
        read("$.summary.peak_probability", "double").alias("peak_probability"),
        read("$.summary.risk_counts.HIGH", "long").alias("high_count"),
        listed.alias("high_listed"),
    )


# ------------------------------------------------------------------ models


def _samples(spark, folder) -> DataFrame:
    return labelled.job_samples(_events(spark, folder))


@query
def model_compare(spark, folder):
    return ml.compare_models(_samples(spark, folder))


@query
def model_scores(spark, folder):
    train, test = ml.prepared(_samples(spark, folder))
    model = ml.fit(ml.candidates()[ml.BOOSTED], train)
    return ml.score_batch(model, test).select(
        "process_id", "label", "failure_probability", "prediction", "risk_level",
        F.to_json("explanation").alias("explanation"))


@query
def model_heldout(spark, folder):
    """The scored rows are the held-out ones, and each prediction follows its probability."""
    return model_scores(spark, folder).select(
        "process_id", "label", ((F.col("failure_probability") >= 0.5).cast("int") == F.col("prediction")).alias("consistent"))


@query
def model_baseline(spark, folder):
    """Counts of the majority model, all folds and rows."""
    return ml.compare_models(_samples(spark, folder), only=(ml.BASELINE,)).select("model", "accuracy", "tp", "tn", "fp", "fn")


@query
def top_importances(spark, folder):
    train, _ = ml.prepared(_samples(spark, folder))
    model = ml.fit(ml.candidates()["Random Forest"], train)
    return evaluate.top_importances(ml.importance_table(spark, model))


# ------------------------------------------------------------------ streaming and archives


def _stream(spark, folder) -> str:
    """Runs the stream over the whole events table and returns the output folder."""
    target = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    live.monitor_stream(tables.log_lines_of(tables.event_stream(spark, folder)), target, timer_ms=None).awaitTermination()
    return target


@query
def stream_every_n(spark, folder):
    return _calibrated(live.stream_alerts(spark, _stream(spark, folder)))


@query
def stream_final(spark, folder):
    return _calibrated(live.final_alerts(spark, _stream(spark, folder)))


def _grown(lines: DataFrame, target: str, upto: int) -> None:
    """Files of a folder hold their lines up to a number, and half of the next one; earlier bytes stay."""
    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        files, place = file_system(target)
        files.create_dir(place, recursive=True)
        draft = f"{place}/draft-{upto}-{context.taskAttemptId()}"
        with files.open_output_stream(draft, compression=None) as out:
            for seq, value in ((s.as_py(), v.as_py()) for b in batches for s, v in zip(*b.columns)):
                if seq > upto:
                    out.write(value[:len(value) // 2].encode())
                    break
                out.write(f"{value}\n".encode())
        # The longer file takes the place of the shorter one at once.
        files.move(draft, f"{place}/part-{context.partitionId():05d}.log")
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], ["done"])

    lines.mapInArrow(write, "done int").collect()


@query
def stream_tail(spark, folder):
    """Lines of growing files, followed by a stream that starts three times: each line comes once."""
    raw = tables.log_raw(spark, folder).select("seq", "value")
    lines = written(raw, "tail-lines").repartition(4, "seq").sortWithinPartitions("seq")
    last = lines.agg(F.max("seq")).first()[0] or 0
    target, out = new_folder(spark, "growing"), new_folder(spark, "tail")
    for share in (1, 2, 3):
        _grown(lines, target, last * share // 3)
        tail.tail_files(spark, f"{target}/*.log", "start").writeStream.format("parquet").option("path", f"{out}/lines").option(
            "checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(tail.LINES).parquet(f"{out}/lines").groupBy("value").agg(F.count(F.lit(1)).alias("times"))


def _job_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select("process_id", "seq", "trigger", "total_lines", "error_count", "retry_count", "max_error_burst", "unique_components",
                         "duration_s", "cpu_request", "priority", "signal_failure_probability", "failure_probability", "risk_level")


@query
def job_risk_every_n(spark, folder):
    """Risk of jobs after every 5th arrival and the last one, with late events."""
    events = traces.clean_events(tables.late_events(tables.job_events(spark, folder)))
    return _job_alerts(monitor.monitor_events(events, every=5))


@query
def stream_job_every_n(spark, folder):
    """The same on a stream: predictions of the run, and those of its end from the state."""
    target = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    events = traces.clean_events(tables.late_events(tables.job_events_of(tables.event_stream(spark, folder))))
    live.monitor_stream(events, target, timer_ms=None, every=5, kind="events").awaitTermination()
    return _job_alerts(live.stream_alerts(spark, target)).unionByName(
        _job_alerts(live.final_alerts(spark, target, every=5, kind="events")))


@query
def zip_csv_scan(spark, folder):
    """Jobs written as one ZIP per partition, read back without unpacking."""
    jobs = tables.gpu_jobs(spark, folder).drop("seq")
    target, columns = new_folder(spark, "zip"), jobs.columns

    def write(frames):
        from pyspark import TaskContext

        context = TaskContext.get()
        files, place = file_system(target)
        files.create_dir(place, recursive=True)
        # Every attempt writes its own file and names it; files of lost attempts are not read.
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.zip"
        with files.open_output_stream(f"{place}/{name}", compression=None) as out, \
                zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open("pai_job_table.csv", "w") as member:
            member.write((",".join(columns) + "\n").encode())
            for frame in frames:
                member.write(frame.to_csv(index=False, header=False).encode())
        yield pd.DataFrame({"name": [name]})

    made = written(jobs.repartition("job_name").mapInPandas(write, "name string"), "zip-names")
    register_zip_csv(spark)
    # One name per archive.
    paths = ",".join(os.path.join(target, r["name"]) for r in made.collect())
    scan = spark.read.format("zipcsv").option("path", paths)
    rows = scan.option("member", "pai_job_table.csv").load()
    return rows.select("job_name", "user", "status", F.col("start_time").cast("double").alias("start_time"))
