"""Features of log histories: over every prefix and over whole histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.config import (
    CRITICAL_KEYWORDS, ERROR_KEYWORDS, FAILING_COMPONENTS, LOG1P_COLUMNS, WARNING_KEYWORDS,
)
from logrisk.functions.casts import flag, rounded_columns, share
from logrisk.functions.text import contains_any, explode_blocks, line_seconds, parse_lines
from logrisk.operators.ordered import Limits, Run, bursts, running

# Per-line 0/1 signals and the counter each of them adds up to.
SIGNALS = {
    "is_info": "info_count",
    "is_warn": "warn_count",
    "is_error": "error_count",
    "is_debug": "debug_count",
    "is_fatal": "fatal_count",
    "kw_error": "error_kw_hits",
    "kw_warning": "warning_kw_hits",
    "kw_critical": "critical_kw_hits",
    "is_retry": "retry_count",
    "is_exception": "exception_count",
    "comp_failing": "failing_comp_hits",
    "first_component": "unique_components",
    "first_pid": "unique_pids",
}
FEATURE_ORDER = [
    "total_lines", "info_count", "warn_count", "error_count", "debug_count", "fatal_count",
    "error_rate", "warn_rate", "critical_rate", "error_kw_rate",
    "error_kw_hits", "warning_kw_hits", "critical_kw_hits", "retry_count", "exception_count",
    "unique_components", "failing_comp_hits", "unique_pids", "max_error_burst",
    "duration_s", "hour_of_day", "is_weekend",
    "cpu_request", "memory_request", "disk_request", "priority", "scheduling_class",
    "task_count", "failed_task_count", "event_count",
    "err_x_retry", "has_exception", "has_fatal", "has_retry",
]
# Whole seconds need no rounding, so the duration is not listed.
RATES = {"error_rate": 4, "warn_rate": 4, "critical_rate": 4, "error_kw_rate": 4}


def line_signals(raw: DataFrame) -> DataFrame:
    """Raw lines to one narrow row per (line, process): key, order and small signals.

    The signals are computed before the explode, once per line, and the message
    text does not travel through the shuffle.
    """
    fields = ("date", "time", "pid", "level", "component", "content", "block_ids")
    carried = [c for c in raw.columns if c != "value"]
    # A column of its own, so that the many searches share one lower-cased text.
    parsed = parse_lines(raw).select(*carried, *fields, F.lower("content").alias("message"))
    message = F.col("message")
    narrow = parsed.select(
        *carried,
        "level", "component", "pid", "block_ids",
        line_seconds(F.col("date"), F.col("time")).alias("ts_s"),
        *level_signals(F.col("level")),
        flag(contains_any(message, ERROR_KEYWORDS)).alias("kw_error"),
        flag(contains_any(message, WARNING_KEYWORDS)).alias("kw_warning"),
        flag(contains_any(message, CRITICAL_KEYWORDS)).alias("kw_critical"),
        flag(message.contains("retry") | message.contains("retrying")).alias("is_retry"),
        flag(message.contains("exception")).alias("is_exception"),
        flag(contains_any(F.col("component"), FAILING_COMPONENTS)).alias("comp_failing"),
    )
    return explode_blocks(narrow)


def level_signals(level: Column) -> list[Column]:
    return [
        flag(level == "INFO").alias("is_info"),
        flag(level.isin("WARN", "WARNING")).alias("is_warn"),
        flag(level == "ERROR").alias("is_error"),
        flag(level == "DEBUG").alias("is_debug"),
        flag(level == "FATAL").alias("is_fatal"),
    ]


def is_bad() -> Column:
    return (F.col("is_error") + F.col("is_fatal")) > 0


def prefix_features(
    signals: DataFrame,
    *,
    keys: tuple[str, ...] = ("process_id",),
    order: tuple[str, ...] = ("seq",),
    total: str | None = None,
    carry: tuple[str, ...] = (),
    limits: Limits = Limits(),
) -> DataFrame:
    """Counters of every prefix of every history: one row per line, one shuffle.

    `carry` names columns of the line (stage, component, ...) to keep on its row.
    """
    marks = {"component": "first_component", "pid": "first_pid"}
    inputs = [c for c in SIGNALS if c not in marks.values()]
    slim = signals.select(*dict.fromkeys(
        [*keys, *order, *carry, "component", "pid", "ts_s", *inputs]))
    first = [Run("total_lines", "sum", F.lit(1).cast("long"))]
    first += [Run(name, "sum", F.col(signal)) for signal, name in SIGNALS.items()]
    first += [Run("_first_s", "min", F.col("ts_s")), Run("_last_s", "max", F.col("ts_s"))]
    counted = running(
        slim, list(keys), list(order),
        [first, *bursts(is_bad(), "total_lines", "max_error_burst")],
        firsts=marks, total=total, limits=limits,
    )
    keep = [*keys, *order, *carry] + ([total] if total else [])
    return counted.select(
        *dict.fromkeys(keep), "total_lines", *SIGNALS.values(), "max_error_burst", "_first_s", "_last_s")


def history_features(
    signals: DataFrame,
    *,
    keys: tuple[str, ...] = ("process_id",),
    order: tuple[str, ...] = ("seq",),
    limits: Limits = Limits(),
) -> DataFrame:
    """Counters of whole histories: only run lengths and first marks need the order."""
    marks = {"component": "first_component", "pid": "first_pid"}
    inputs = [c for c in SIGNALS if c not in marks.values()]
    slim = signals.select(*dict.fromkeys([*keys, *order, "component", "pid", "ts_s", *inputs]))
    placed = running(
        slim, list(keys), list(order),
        [[Run("n", "sum", F.lit(1).cast("long"))], *bursts(is_bad())],
        firsts=marks, limits=limits,
    )
    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_lines"),
        *[F.sum(signal).alias(name) for signal, name in SIGNALS.items()],
        F.max("burst").alias("max_error_burst"),
        F.min("ts_s").alias("_first_s"),
        F.max("ts_s").alias("_last_s"),
    )


def timing_columns() -> dict[str, Column]:
    """Duration, hour and weekend flag from the first and last second."""
    start = F.timestamp_seconds("_first_s")
    return {
        "duration_s": F.coalesce((F.col("_last_s") - F.col("_first_s")).cast("double"), F.lit(0.0)),
        "hour_of_day": F.coalesce(F.hour(start), F.lit(0)),
        "is_weekend": flag(F.weekday(start) >= 5),
    }


def with_log1p(features: DataFrame) -> DataFrame:
    raw = features.withColumns({
        f"log1p_{c}": F.log1p(F.greatest(F.lit(0.0), F.col(c).cast("double"))) for c in LOG1P_COLUMNS})
    return rounded_columns(raw, {f"log1p_{c}": 6 for c in LOG1P_COLUMNS})


def finish_log_features(counted: DataFrame, *, log1p: bool = True) -> DataFrame:
    """Rates, timing, products, flags and log1p columns: the 34 + 10 log features."""
    others = [c for c in counted.columns
              if c not in FEATURE_ORDER and c not in ("_first_s", "_last_s")]
    zero = F.lit(0)
    derived = counted.withColumns({
        **timing_columns(),
        "error_rate": share("error_count", "total_lines"),
        "warn_rate": share("warn_count", "total_lines"),
        "critical_rate": share("fatal_count", "total_lines"),
        "error_kw_rate": share("error_kw_hits", "total_lines"),
        "cpu_request": F.lit(0.0), "memory_request": F.lit(0.0), "disk_request": F.lit(0.0),
        "priority": zero, "scheduling_class": zero, "task_count": zero, "failed_task_count": zero,
        "event_count": F.col("total_lines"),
        "err_x_retry": F.col("error_count") * F.col("retry_count"),
        "has_exception": flag(F.col("exception_count") > 0),
        "has_fatal": flag(F.col("fatal_count") > 0),
        "has_retry": flag(F.col("retry_count") > 0),
    })
    ready = rounded_columns(derived.select(*others, *FEATURE_ORDER), RATES)
    return with_log1p(ready) if log1p else ready


def log_features(raw: DataFrame, *, limits: Limits = Limits()) -> DataFrame:
    """Raw lines to the features of every process history."""
    return finish_log_features(history_features(line_signals(raw), limits=limits))
