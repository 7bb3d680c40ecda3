"""From raw lines to alerts: the batch form of the monitor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.functions.casts import rounded_columns
from logrisk.config import PREDICT_EVERY
from logrisk.functions import policy as rules
from logrisk.functions import risk
from logrisk.operators import snapshots
from logrisk.operators.arrivals import event_prefixes
from logrisk.operators.logfeatures import (
    FEATURE_ORDER, finish_log_features, line_signals, prefix_features, with_log1p,
)
from logrisk.operators.ordered import Limits

Scorer = Callable[[DataFrame], DataFrame]


def by_rules(features: DataFrame) -> DataFrame:
    """A raw score from the tier table, for use without a trained model."""
    return features.withColumn("raw_prob", risk.rule_probability())


def calibrate(scored: DataFrame, *, every: int = PREDICT_EVERY, prior: Column | float = 0.10,
              mode: str = "stream") -> DataFrame:
    """Probability, prediction, risk band and explanation from features and `raw_prob`.

    Modes: `stream` blends model, signals and prior; `raw` uses the model alone;
    `rules` uses the tier table. Bands use unrounded values.
    """
    raw = F.col("raw_prob")
    if mode == "raw":
        out = scored.withColumn("_p", raw)
        digits: dict[str, int] = {}
    elif mode == "rules":
        out = scored.withColumns({"_p": risk.rule_probability(), "raw_model_failure_probability": raw})
        digits = {"raw_model_failure_probability": 4}
    elif mode == "stream":
        prior = prior if isinstance(prior, Column) else F.lit(float(prior))
        signal = F.col("signal_failure_probability")
        out = (
            scored.withColumn("signal_failure_probability", risk.signal_probability())
            .withColumns({"_p": risk.calibrated_probability(raw, signal, prior, every),
                          "raw_model_failure_probability": raw})
        )
        digits = {"raw_model_failure_probability": 4, "signal_failure_probability": 4}
    else:
        raise ValueError(f"unknown mode {mode!r}; use stream, raw or rules")
    banded = out.withColumns({
        "prediction": risk.prediction("_p"), "risk_level": risk.risk_band("_p"),
        "failure_probability": F.col("_p")}).drop("_p")
    final = rounded_columns(banded, {**digits, "failure_probability": 4})
    if mode == "raw":
        return final
    reasons = (risk.rule_explanation() if mode == "rules"
               else risk.signal_explanation(F.col("raw_model_failure_probability")))
    return final.withColumn("explanation", reasons)


def decide(alerts: DataFrame, policy: str = "advise",
           reviewed: DataFrame | None = None) -> DataFrame:
    """Adds action and recommendation.

    `reviewed` lists processes an operator released, with the place (`seq`) of
    the release: it counts for alerts behind it. Without a place it counts for all.
    """
    if policy not in rules.POLICIES:
        raise ValueError(f"unknown policy {policy!r}; use one of {rules.POLICIES}")
    known = F.lit(False)
    if reviewed is not None:
        place = F.min("seq") if "seq" in reviewed.columns else F.min(F.lit(-1))
        marks = reviewed.groupBy("process_id").agg(place.cast("long").alias("_reviewed"))
        alerts = alerts.join(marks, "process_id", "left")
        known = F.coalesce(F.col("seq") > F.col("_reviewed"), F.lit(False))
    level, rule = F.col("risk_level"), F.lit(policy)
    return alerts.withColumns({
        "action": rules.alert_action(level, rule, known),
        "recommendation": rules.alert_recommendation(
            level, rule, known, F.col("process_id"), F.col("failure_probability")),
    }).drop("_reviewed")


def monitor_batch(
    raw: DataFrame,
    *,
    every: int = PREDICT_EVERY,
    score: Scorer = by_rules,
    prior: Column | float = 0.10,
    mode: str = "stream",
    policy: str = "advise",
    reviewed: DataFrame | None = None,
    keys: tuple[str, ...] = ("process_id",),
    carry: tuple[str, ...] = ("component",),
    final: bool = True,
    limits: Limits = Limits(),
) -> DataFrame:
    """Alerts for every N-th line of each process and, at the end, for its last line.

    raw: `seq`, `value` and any further columns named in `keys` or `carry`.
    """
    signals = line_signals(raw)
    prefixes = prefix_features(signals, keys=keys, total="total", carry=carry, limits=limits)
    if final:
        fired = snapshots.triggers(prefixes, every)
    else:
        fired = snapshots.every_n(prefixes, every).withColumn("trigger", F.lit("every_n"))
    features = finish_log_features(fired)
    alerts = decide(calibrate(score(features), every=every, prior=prior, mode=mode), policy, reviewed)
    flushed = F.col("trigger") == "final"
    stage_constants = {"component": "pipeline.Monitor", "stage": "Monitor"}
    for name in carry:
        if name in stage_constants:
            alerts = alerts.withColumn(
                name, F.when(flushed, stage_constants[name]).otherwise(F.col(name)))
    return alerts.withColumn("lines_seen", F.col("total_lines"))


def monitor_events(
    events: DataFrame,
    *,
    every: int = PREDICT_EVERY,
    score: Scorer = by_rules,
    prior: Column | float = 0.10,
    mode: str = "stream",
    policy: str = "advise",
    reviewed: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Alerts for every N-th scheduler event of each job, by arrival (`seq`), and for its last one.

    events: rows of `traces.clean_events`. Bursts and retries follow the event
    times of what has arrived, so late events change them.
    """
    features = with_log1p(event_prefixes(events, every, limits=limits))
    alerts = decide(calibrate(score(features), every=every, prior=prior, mode=mode), policy, reviewed)
    return alerts.withColumn("lines_seen", F.col("total_lines"))


def raw_features(names=tuple(FEATURE_ORDER)) -> Column:
    """The features behind an alert as a map."""
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))]).alias("raw_features")


def stop_points(alerts: DataFrame, session: str = "process_id") -> DataFrame:
    """Where an auto-stop session ends: its first HIGH alert."""
    high = (F.col("risk_level") == "HIGH") & (F.col("trigger") == "every_n")
    return alerts.where(high).groupBy(session).agg(F.min("seq").alias("stop_seq"))


def monitor_until_high(raw: DataFrame, *, session: str = "session_id", **options) -> DataFrame:
    """Auto-stop: nothing after the first HIGH alert of a session is processed.

    Two passes: find the stop line of each session, then monitor the kept
    lines, so the final predictions describe the histories up to the stop.
    """
    keys = (session, "process_id")
    options = {**options, "policy": "auto_stop", "keys": keys}
    stops = stop_points(monitor_batch(raw, **{**options, "final": False}), session)
    kept = raw.join(stops, session, "left").where(
        F.col("stop_seq").isNull() | (F.col("seq") <= F.col("stop_seq"))).drop("stop_seq")
    return monitor_batch(kept, **options)


def monitor_text(lines: DataFrame, *, value: str, pid: str, stamp: Column, **options) -> DataFrame:
    """Free-text lines through the adapter into the monitor; stages travel with the lines."""
    from logrisk.functions.text import normalise_lines

    adapted = normalise_lines(lines, value, pid, stamp)
    ready = adapted.select("seq", "stage", pid, F.col("normalized_line").alias("value"))
    carry = tuple(dict.fromkeys([*options.pop("carry", ("component",)), "stage", pid]))
    return monitor_batch(ready, carry=carry, **options)
