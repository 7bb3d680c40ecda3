"""Session tables: counts, current state, tops, tails, stages, resources, reports.

Alerts carry `session_id`, `seq`, `trigger`, `risk_level`, `failure_probability`.
Final-flush alerts come after all others of a session, whatever their seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrisk.functions.casts import flag, rounded_columns
from logrisk.functions.policy import default_recommendation, stop_reason
from logrisk.operators.ordered import Limits, Run, running

RISKS = ("LOW", "MEDIUM", "HIGH")


def arrival() -> Column:
    """Orders the alerts of a session: final flush last, ties by process id."""
    return F.struct((F.col("trigger") == "final").alias("f"), "seq", "process_id")


def _risk_count(risk: str) -> Column:
    return F.count_if(F.col("risk_level") == risk)


def risk_counts(alerts: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """LOW, MEDIUM and HIGH per session, 0 where absent."""
    return alerts.groupBy(*by).agg(*[_risk_count(r).alias(r) for r in RISKS])


def session_summary(alerts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Predictions, predicted failures with percent, and counts per risk."""
    out = alerts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("prediction") == 1).alias("predicted_failures"),
        *[_risk_count(r).alias(r.lower() + "_risk") for r in reversed(RISKS)],
    )
    share = F.col("predicted_failures") * 100.0 / F.greatest("total_predictions", F.lit(1))
    return rounded_columns(out.withColumn("failure_percent", share), {"failure_percent": 1})


def session_state(alerts: DataFrame) -> DataFrame:
    """Newest risk, probability and text, peak, and whether HIGH was ever seen."""
    return alerts.groupBy("session_id").agg(
        F.max_by("recommendation", arrival()).alias("last_text"),
        F.max_by("risk_level", arrival()).alias("current_risk"),
        F.max_by("failure_probability", arrival()).alias("latest_probability"),
        F.max("failure_probability").alias("peak_probability"),
        F.count(F.lit(1)).alias("total_predictions"),
        F.max((F.col("risk_level") == "HIGH").cast("int")).alias("had_high"),
    )


def with_idle_sessions(state: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions without an alert: LOW, zero probabilities, no predictions."""
    return sessions.select("session_id").distinct().join(state, "session_id", "left").fillna({
        "current_risk": "LOW", "latest_probability": 0.0, "peak_probability": 0.0,
        "total_predictions": 0, "had_high": 0})


def session_advice(state: DataFrame, stopped: Column | None = None,
                   waiting: Column | None = None) -> DataFrame:
    """What a session reports: the text of its last alert, a default one only without alerts."""
    no, had_high = F.lit(False), F.col("had_high") == 1
    return state.withColumn("recommendation", F.coalesce("last_text", default_recommendation(
        no if stopped is None else stopped, no if waiting is None else waiting,
        F.col("current_risk"), had_high))).drop("last_text")


def top_high(alerts: DataFrame, top: int = 10) -> DataFrame:
    """The HIGH alerts with the largest probability, ties in arrival order."""
    return (
        alerts.where(F.col("risk_level") == "HIGH")
        .orderBy(F.desc("failure_probability"), arrival()).limit(top)
    )


def top_high_per_session(alerts: DataFrame, top: int = 10) -> DataFrame:
    """As above for every session; map tasks already keep only `top` rows per session."""
    window = Window.partitionBy("session_id").orderBy(F.desc("failure_probability"), arrival())
    high = alerts.where(F.col("risk_level") == "HIGH")
    return high.withColumn("place", F.row_number().over(window)).where(F.col("place") <= top)


def first_high(alerts: DataFrame, top: int = 10) -> DataFrame:
    return alerts.where(F.col("risk_level") == "HIGH").orderBy(arrival()).limit(top)


def newest(rows: DataFrame, n: int, order: Column | str = "seq") -> DataFrame:
    """The last n rows."""
    return rows.orderBy(F.desc(order) if isinstance(order, str) else order.desc()).limit(n)


def newest_per_session(rows: DataFrame, n: int, order: Column | str = "seq",
                       session: str = "session_id") -> DataFrame:
    last = F.desc(order) if isinstance(order, str) else order.desc()
    window = Window.partitionBy(session).orderBy(last)
    numbered = rows.withColumn("_place", F.row_number().over(window))
    return numbered.where(F.col("_place") <= n).drop("_place")


def latest_high(alerts: DataFrame) -> DataFrame:
    """The newest HIGH alert of each session, else its newest alert."""
    is_high = (F.col("risk_level") == "HIGH").alias("h")
    others = [c for c in alerts.columns if c != "session_id"]
    best = alerts.groupBy("session_id").agg(
        F.max_by(F.struct(*others), F.struct(is_high, arrival().alias("a"))).alias("b"))
    return best.select("session_id", "b.*")


def timeline(alerts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Ordinal of each prediction and its percent, per session."""
    placed = alerts.withColumn("_final", (F.col("trigger") == "final").cast("int"))
    out = running(placed, ["session_id"], ["_final", "seq", "process_id"],
                  [[Run("prediction_no", "sum", F.lit(1).cast("long"))]], limits=limits)
    percent = F.rint(F.col("failure_probability") * 100).cast("int")
    return out.withColumn("percent", percent).drop("_final")


def high_seen_before(alerts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """0/1 per alert: did an earlier alert of the session reach HIGH?"""
    placed = alerts.withColumn("_final", (F.col("trigger") == "final").cast("int"))
    high = flag(F.col("risk_level") == "HIGH")
    out = running(placed, ["session_id"], ["_final", "seq", "process_id"],
                  [[Run("_seen", "max_before", high)]], limits=limits)
    return out.withColumn("high_before", F.coalesce("_seen", F.lit(0))).drop("_seen", "_final")


def level_histogram(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return lines.groupBy(*by, "level").agg(F.count(F.lit(1)).alias("n"))


def stage_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("session_id", "stage").agg(F.count(F.lit(1)).alias("n_lines"))


def stage_state(lines: DataFrame, alerts: DataFrame | None = None,
                finished: str | None = None) -> DataFrame:
    """State of each stage: the newest is running, earlier ones are done.

    A stage with a HIGH alert at or after its last line shows risk. With a
    final status the open stage becomes done, or stopped.
    """
    stages = lines.groupBy("session_id", "stage").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("seq").alias("last_seq"))
    # At most one row per stage name and session.
    newest_seq = F.max("last_seq").over(Window.partitionBy("session_id"))
    open_state = {None: "running", "stopped": "stopped"}.get(finished, "done")
    state = F.when(F.col("last_seq") == newest_seq, open_state).otherwise("done")
    if alerts is not None:
        risky = alerts.where(F.col("risk_level") == "HIGH").groupBy("session_id", "stage").agg(
            F.max("seq").alias("_high_seq"))
        stages = stages.join(risky, ["session_id", "stage"], "left")
        state = F.when(F.col("_high_seq") >= F.col("last_seq"), "risk").otherwise(state)
    return stages.withColumn("state", state).select(
        "session_id", "stage", "n_lines", "last_seq", "state")


def stage_changes(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The lines at which a session enters another stage than that of the line before."""
    place = Run("_prev", "max_before", F.struct("seq", "stage"))
    out = running(lines.select("session_id", "seq", "stage"), ["session_id"], ["seq"], [[place]],
                  limits=limits)
    changed = F.col("_prev").isNull() | (F.col("_prev.stage") != F.col("stage"))
    return out.where(changed).select("session_id", "seq", F.col("_prev.stage").alias("from_stage"),
                                     F.col("stage").alias("to_stage"))


def resource_summary(samples: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    out = [
        F.count(F.lit(1)).alias("samples"),
        F.max("cpu_percent").alias("max_cpu_percent"),
        F.avg("cpu_percent").alias("avg_cpu_percent"),
        F.max("memory_rss_mb").alias("max_memory_rss_mb"),
        F.max("disk_used_percent").alias("max_disk_used_percent"),
    ]
    if "metrics_backend" in samples.columns:
        out.append(F.max_by("metrics_backend", "seq").alias("metrics_backend"))
    return rounded_columns(samples.groupBy(*by).agg(*out), {"avg_cpu_percent": 2})


def lines_with_samples(lines: DataFrame, samples: DataFrame) -> DataFrame:
    """Each line with the resource sample taken at it."""
    return lines.join(samples, ["session_id", "seq"], "left")


def session_report(lines: DataFrame, alerts: DataFrame, samples: DataFrame | None = None, *,
                   status: str = "completed", source: str = "", policy: str = "advise",
                   reviewed: DataFrame | None = None, log_path: str | None = None,
                   output_path: str | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """One JSON summary per session.

    Its alerts and lines are tables of any size, which `sinks.write_session`
    writes beside the summaries, by session; the newest of them for a display
    are `newest_per_session`.

    reviewed: `session_id`, `process_id` of operator releases. Under the review
    policy a session waits for review when its last HIGH alert was not released.
    """
    counts = F.struct(*[F.col(r) for r in RISKS]).alias("risk_counts")
    state = with_idle_sessions(session_state(alerts), lines)
    high = F.when(F.col("risk_level") == "HIGH", stop_reason(F.col("process_id"), F.col("failure_probability")))
    reasons = alerts.groupBy("session_id").agg(
        F.max_by(high, F.when(F.col("risk_level") == "HIGH", arrival())).alias("_reason"),
        F.max_by("process_id", F.when(F.col("risk_level") == "HIGH", arrival())).alias("_process"))
    state = state.join(reasons, "session_id", "left")
    released = F.lit(False)
    if reviewed is not None:
        marks = reviewed.groupBy("session_id").agg(F.sort_array(F.collect_set("process_id")).alias("reviewed_processes"))
        state = state.join(marks, "session_id", "left")
        released = F.coalesce(F.array_contains("reviewed_processes", F.col("_process")), F.lit(False))
    else:
        state = state.withColumn("reviewed_processes", F.array().cast("array<string>"))
    stopped = F.lit(policy == "auto_stop") & F.col("_reason").isNotNull()
    waiting = F.lit(policy == "review") & F.col("_reason").isNotNull() & ~released
    state = session_advice(state, stopped, waiting).withColumns({
        "status": F.lit(status), "source": F.lit(source), "stop_policy": F.lit(policy),
        "stop_reason": F.when(stopped, F.col("_reason")), "review_required": waiting,
        "review_reason": F.when(waiting, F.col("_reason")),
        "reviewed_processes": F.coalesce("reviewed_processes", F.array().cast("array<string>")),
        "log_path": F.lit(log_path).cast("string"), "output_path": F.lit(output_path).cast("string"),
        **(extra or {})}).drop("_reason", "_process")
    summary = (
        state.join(risk_counts(alerts), "session_id", "left").fillna(0, subset=list(RISKS))
        .join(lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines_processed")), "session_id", "left")
    )
    fields = [F.col(c) for c in summary.columns if c not in (*RISKS, "session_id", "had_high")]
    if samples is not None:
        usage = resource_summary(samples)
        usage = usage.select("session_id", F.struct(
            *[c for c in usage.columns if c != "session_id"]).alias("resource_summary"))
        summary = summary.join(usage, "session_id", "left")
        fields.append(F.col("resource_summary"))
    brief = ["process_id", "failure_probability", "lines_seen", "stage", "action"]
    high = top_high_per_session(alerts).groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("place", *brief))).alias("high_risk_processes"))
    joined = summary.join(high, "session_id", "left")
    payload = F.struct(F.struct(*fields, counts, "high_risk_processes").alias("summary"))
    return joined.select("session_id", F.to_json(payload).alias("report"))
