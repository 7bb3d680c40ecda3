"""Risk scores, bands and explanations over feature columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logrisk.config import EXPLANATION_SIZE, RISK_FEATURES, RISK_HIGH, RISK_MEDIUM
from logrisk.functions.casts import clipped_ratio, flag

# Fixed values: (feature, scale, weight) of the signal score.
SIGNAL_WEIGHTS = [
    ("fatal_count", 1.0, 2.4),
    ("critical_kw_hits", 1.0, 1.8),
    ("error_count", 2.0, 1.7),
    ("error_rate", 0.30, 1.7),
    ("max_error_burst", 2.0, 1.0),
    ("exception_count", 1.0, 1.0),
    ("retry_count", 2.0, 0.9),
    ("warn_count", 3.0, 0.6),
    ("warn_rate", 0.40, 0.5),
    ("critical_rate", 0.20, 1.3),
]
# Fixed values: (feature, text) in the order in which reasons are listed.
SIGNAL_REASONS = [
    ("fatal_count", "fatal events strongly increase risk"),
    ("error_count", "error events increase risk"),
    ("critical_kw_hits", "critical failure keywords increase risk"),
    ("retry_count", "retries indicate instability"),
    ("warn_count", "warnings indicate emerging pressure"),
    ("max_error_burst", "consecutive errors increase risk"),
    ("total_lines", "more lines increase confidence in the estimate"),
]
# The texts of the rule mode, in order.
RULE_REASONS = [
    ("fatal_count", "fatal log entries strongly increase risk"),
    ("error_count", "error log entries increase risk"),
    ("retry_count", "retries indicate instability"),
    ("warn_count", "warnings indicate early pressure"),
    ("max_error_burst", "consecutive errors increase risk"),
    ("failing_comp_hits", "known HDFS failure components increase risk"),
    ("total_lines", "more observations improve confidence"),
]
REASON = "struct<rank:int,feature:string,value:double,direction:string>"


def _c(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def risk_band(prob) -> Column:
    """From the unrounded probability."""
    prob = F.col(prob) if isinstance(prob, str) else prob
    return F.when(prob >= RISK_HIGH, "HIGH").when(prob >= RISK_MEDIUM, "MEDIUM").otherwise("LOW")


def prediction(prob) -> Column:
    return flag((F.col(prob) if isinstance(prob, str) else prob) >= 0.5)


def _critical_pattern() -> Column:
    return (_c("fatal_count") > 0) | ((_c("critical_kw_hits") >= 2) & (_c("error_count") >= 1))


def _error_pattern() -> Column:
    repeated = (_c("retry_count") >= 1) | (_c("max_error_burst") >= 2)
    return (_c("error_count") >= 3) | ((_c("error_count") >= 2) & repeated)


def signal_probability() -> Column:
    """Risk read off the visible signals of one process prefix."""
    weight_sum = sum(weight for _, _, weight in SIGNAL_WEIGHTS)
    total = F.lit(0.0)
    for name, scale, weight in SIGNAL_WEIGHTS:
        total = total + clipped_ratio(_c(name), scale) * F.lit(weight)
    base = total / F.lit(weight_sum)

    some_trouble = (_c("error_count") >= 1) | (_c("retry_count") >= 2) | (_c("warn_count") >= 3)
    hint = (_c("retry_count") >= 1) | (_c("warn_count") >= 1)
    floor = (
        F.when(_critical_pattern(), 0.90).when(_error_pattern(), 0.62)
        .when(some_trouble, 0.40).when(hint, 0.22).otherwise(0.0)
    )
    raised = F.greatest(base, floor)

    no_errors = (_c("error_count") == 0) & (_c("fatal_count") == 0)
    clean = (
        no_errors & (_c("total_lines") >= 5) & (_c("retry_count") == 0)
        & (_c("critical_kw_hits") == 0) & (_c("exception_count") == 0)
    )
    silent = no_errors & (_c("total_lines") > 0) & (_c("warn_count") == 0)
    cap = F.least(F.when(clean, 0.18).otherwise(1.0), F.when(silent, 0.10).otherwise(1.0))
    capped = F.least(raised, cap)

    share = clipped_ratio(_c("failing_comp_hits"), F.greatest(_c("total_lines"), F.lit(1.0)))
    discount = F.when(no_errors & (_c("total_lines") > 0), F.lit(0.12) * share).otherwise(0.0)
    return _clip(F.greatest(F.lit(0.0), capped - discount), 0.02, 0.98)


def failure_prior(tp, fn, tn, fp) -> Column:
    """Share of failures in the evaluation counts, inside [0.05, 0.35]; 0.10 without counts."""
    tp, fn, tn, fp = (
        F.coalesce(c if isinstance(c, Column) else F.lit(c), F.lit(0)) for c in (tp, fn, tn, fp))
    total = tp + fn + tn + fp
    return F.when(total > 0, _clip((tp + fn) / total, 0.05, 0.35)).otherwise(0.10)


def line_confidence(every: int) -> Column:
    base = F.least(F.lit(1.0), _c("total_lines") / F.lit(float(max(2 * every, 10))))
    weak = (_c("retry_count") >= 1) | (_c("critical_kw_hits") >= 1)
    floor = (
        F.when(_c("fatal_count") > 0, 0.90).when(_critical_pattern(), 0.75)
        .when(_error_pattern(), 0.60).when(_c("error_count") >= 1, 0.45)
        .when(weak, 0.35).otherwise(0.0)
    )
    return F.greatest(base, floor)


def calibrated_probability(raw: Column, signal: Column, prior: Column, every: int) -> Column:
    """Blend of model, signal and prior, pulled to the prior while few lines are known."""
    blend = F.lit(0.15) * raw + F.lit(0.70) * signal + F.lit(0.15) * prior
    return _clip(prior + line_confidence(every) * (blend - prior), 0.02, 0.98)


def rule_probability() -> Column:
    """Tier table over the visible counts."""
    fatal, error = _c("fatal_count"), _c("error_count")
    retry, warn = _c("retry_count"), _c("warn_count")

    def tier(top: float, *terms: Column) -> Column:
        value = terms[0]
        for term in terms[1:]:
            value = value + term
        return F.least(F.lit(top), value)

    return (
        F.when((fatal > 0) | (_c("critical_kw_hits") > 0),
               tier(0.98, F.lit(0.86), F.lit(0.03) * fatal, F.lit(0.01) * error))
        .when((error >= 2) | (_c("max_error_burst") >= 2),
              tier(0.82, F.lit(0.70), F.lit(0.03) * error, F.lit(0.02) * retry))
        .when(error == 1, tier(0.68, F.lit(0.56), F.lit(0.03) * retry))
        .when((retry > 0) | (warn >= 2),
              tier(0.58, F.lit(0.43), F.lit(0.04) * retry, F.lit(0.02) * warn))
        .when(warn == 1, 0.34)
        .otherwise(0.12)
    )


def _reasons(order, idle_text: str, first: list[Column]) -> Column:
    """Ranked reasons: nonzero counts in the given order, `total_lines` always, five at most."""
    entries = list(first)
    for name, text in order:
        value = _c(name)
        listed = F.struct(
            F.lit(name).alias("feature"),
            value.alias("value"),
            F.when(value != 0, text).otherwise(idle_text).alias("direction"),
        )
        entries.append(listed if name == "total_lines" else F.when(value != 0, listed))
    kept = F.slice(F.filter(F.array(*entries), lambda e: e.isNotNull()), 1, EXPLANATION_SIZE)
    ranked = F.transform(kept, lambda e, i: F.struct(
        (i + 1).cast("int").alias("rank"), e["feature"].alias("feature"),
        e["value"].alias("value"), e["direction"].alias("direction")))
    return ranked.cast(f"array<{REASON}>")


def signal_explanation(rounded_raw: Column) -> Column:
    head = F.struct(
        F.lit("raw_model_probability").alias("feature"),
        rounded_raw.alias("value"),
        F.lit("raw model output before stream calibration").alias("direction"),
    )
    return _reasons(SIGNAL_REASONS, "no strong risk signal observed", [head])


def rule_explanation() -> Column:
    return _reasons(RULE_REASONS, "no direct risk signal", [])


def direction(feature, value: Column) -> Column:
    """Text for one feature value; `feature` is a name or a column of names."""
    risky = feature.isin(RISK_FEATURES) if isinstance(feature, Column) else F.lit(feature in RISK_FEATURES)
    return (
        F.when(value > 0, F.when(risky, "↑ increases failure risk")
               .otherwise("↓ reduces failure risk"))
        .otherwise("neutral")
    )


def percent(prob) -> Column:
    prob = F.col(prob) if isinstance(prob, str) else prob
    return F.concat(F.rint(prob * 100).cast("int").cast("string"), F.lit("%"))


def alert_text() -> Column:
    """One line per alert, without the wall-clock prefix."""
    verdict = F.when(F.col("prediction") == 1, "[WARN] FAILURE PREDICTED").otherwise("[OK] OK")
    return F.concat(
        F.lit("["), F.col("risk_level"), F.lit("]  "), verdict,
        F.lit("  | process: "), F.col("process_id"),
        F.lit("  | prob: "), percent("failure_probability"),
        F.lit("  | lines seen: "), F.col("lines_seen").cast("string"),
    )
