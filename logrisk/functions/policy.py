"""Stop and review decisions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logrisk.config import TERMINAL_STATUSES
from logrisk.functions.risk import percent

#: The policies, and below the texts an operator reads.
POLICIES = ("advise", "auto_stop", "review")


def alert_action(risk: Column, policy: Column, reviewed: Column) -> Column:
    high = (
        F.when(policy == "auto_stop", "AUTO_STOP")
        .when(policy == "review",
              F.when(reviewed, "CONTINUE_AFTER_REVIEW").otherwise("REVIEW_REQUIRED"))
        .otherwise("ADVISE_STOP")
    )
    return F.when(risk == "HIGH", high).when(risk == "MEDIUM", "WATCH").otherwise("CONTINUE")


def stop_reason(process: Column, prob: Column) -> Column:
    return F.concat(F.lit("HIGH risk for "), process, F.lit(" ("), percent(prob), F.lit(")"))


def alert_recommendation(risk: Column, policy: Column, reviewed: Column,
                         process: Column, prob: Column) -> Column:
    """What the operator reads after one alert."""
    kept_on = F.concat(
        F.lit("HIGH risk remains for "), process, F.lit(" ("), percent(prob),
        F.lit("), but the operator already reviewed this process and chose to continue."))
    stop = F.concat(stop_reason(process, prob), F.lit(". Stop and inspect the process."))
    return (
        F.when(risk == "MEDIUM", "MEDIUM risk detected. Continue with close monitoring.")
        .when(risk != "HIGH", "LOW risk detected. The pipeline can continue.")
        .when((policy == "review") & reviewed, kept_on)
        .otherwise(stop)
    )


def default_recommendation(stopped: Column, waiting: Column, current: Column,
                           had_high: Column) -> Column:
    """What a session says at its end when no alert set a recommendation."""
    return (
        F.when(stopped, "Pipeline was stopped because HIGH failure risk was detected.")
        .when(waiting, "Pipeline is waiting for operator review after HIGH failure risk was detected.")
        .when(current == "HIGH", "HIGH risk was detected. Stop the pipeline and inspect the process.")
        .when(current == "MEDIUM",
              "Continue with close monitoring and inspect warning-heavy stages.")
        .when(had_high,
              "Risk has returned to LOW after an earlier HIGH reading. Continue monitoring closely.")
        .otherwise("Pipeline can continue. No high-risk process was detected.")
    )


def final_status(return_code: Column, had_high: Column) -> Column:
    ok = F.coalesce(return_code == 0, F.lit(False))
    return (
        F.when(ok & had_high, "completed_with_high_risk").when(ok, "completed")
        .when(had_high, "failed_with_high_risk").otherwise("failed")
    )


def is_terminal(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin(TERMINAL_STATUSES), F.lit(False))


def intervention(high_count: Column, policy: Column, fail_on_high: bool = False) -> Column:
    """Decision of a scheduler task; optionally an error that fails the task."""
    stopped = (high_count > 0) & (policy == "auto_stop")
    decided = (
        F.when(stopped, "pipeline_stopped").when(high_count > 0, "operator_review_advised")
        .otherwise("continue")
    )
    if not fail_on_high:
        return decided
    text = F.concat(F.lit("HIGH risk detected in "), high_count.cast("string"), F.lit(" prediction(s)."))
    return F.when(high_count > 0, F.raise_error(text).cast("string")).otherwise(decided)
