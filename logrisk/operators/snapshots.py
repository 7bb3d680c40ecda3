"""Which prefixes are scored: every N lines, the last line, fractions, cuts, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.config import FLUSH_SECONDS, PREDICT_EVERY
from logrisk.functions.text import is_stop_marker
from logrisk.operators.ordered import Limits, Run, running

FRACTIONS = (0.25, 0.50, 0.75, 1.0)


def check_fractions(fractions) -> list[float]:
    values = [float(f) for f in fractions]
    if not values or any(f <= 0 or f > 1 for f in values):
        raise ValueError("every fraction must be above 0 and at most 1")
    return values


def at_fraction(n: str, total: str, fractions=FRACTIONS) -> Column:
    """True on the rows that end a prefix of one of the given sizes."""
    sizes = [
        F.greatest(F.lit(1), F.least(F.col(total), F.ceil(F.col(total) * F.lit(f)))).cast("long")
        for f in check_fractions(fractions)
    ]
    return F.array_contains(F.array(*sizes), F.col(n))


def early_warning(prefixes: DataFrame, *, n: str = "total_lines", total: str = "total",
                  fractions=FRACTIONS, key: str = "process_id") -> DataFrame:
    """Prefix samples named `id@size_of_total`; the original id becomes the group."""
    name = F.concat(F.col(key), F.lit("@"), F.col(n).cast("string"), F.lit("_of_"),
                    F.col(total).cast("string"))
    group = [] if "group_id" in prefixes.columns else [F.col(key).alias("group_id")]
    others = [F.col(c) for c in prefixes.columns if c != key]
    return prefixes.where(at_fraction(n, total, fractions)).select(
        name.alias(key), *group, *others)


def every_n(prefixes: DataFrame, every: int = PREDICT_EVERY, n: str = "total_lines") -> DataFrame:
    if every < 1:
        raise ValueError("every must be at least 1")
    return prefixes.where(F.col(n) % every == 0)


def triggers(prefixes: DataFrame, every: int = PREDICT_EVERY, *, n: str = "total_lines",
             total: str = "total") -> DataFrame:
    """Every-N rows plus the final row of each key, told apart by `trigger`.

    A last row that is also a multiple of N gives both.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    fired = F.filter(
        F.array(
            F.when(F.col(n) % every == 0, F.lit("every_n")),
            F.when(F.col(n) == F.col(total), F.lit("final")),
        ),
        lambda t: t.isNotNull(),
    )
    return prefixes.withColumn("trigger", F.explode(fired))


def with_sessions(lines: DataFrame, *, key: str = "process_id", ts: str = "ts_s",
                  order: tuple[str, ...] = ("seq",), gap: int = FLUSH_SECONDS,
                  limits: Limits = Limits()) -> DataFrame:
    """Numbers the activity sessions of a key; a gap longer than `gap` starts a new one.

    `gap` is in the unit of `ts`. The time before a row is the newest time seen
    so far, so a line that arrives late never opens a session.
    """
    starts = F.when(F.col(ts) - F.col("_seen") > gap, 1).otherwise(0)
    out = running(
        lines, [key], list(order),
        [[Run("_seen", "max_before", F.col(ts))], [Run("session_no", "sum", starts)]],
        limits=limits,
    )
    return out.withColumn("session_no", F.col("session_no") + 1).drop("_seen")


def inactivity_sessions(lines: DataFrame, *, key: str = "process_id", ts: str = "ts",
                        order: tuple[str, ...] = ("seq",), gap_s: int = FLUSH_SECONDS,
                        limits: Limits = Limits()) -> DataFrame:
    """Start, end and row count per activity session of a key.

    Not by `session_window`, which merges all rows of a key in one task.
    """
    timed = lines.select(key, ts, *order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    numbered = with_sessions(timed, key=key, ts="_us", order=order, gap=gap_s * 1_000_000,
                             limits=limits)
    return numbered.groupBy(key, "session_no").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_rows"))


def cut_after_first(rows: DataFrame, condition: Column, *, key: str, order: str,
                    keep_cut_row: bool = True) -> DataFrame:
    """Keeps each key's rows up to its first row that meets the condition.

    The cut points come from map-side minima; the join back is an ordinary
    equi join, so a huge key is split by the skew-join rule.
    """
    cuts = rows.where(condition).groupBy(key).agg(F.min(order).alias("_cut"))
    joined = rows.join(cuts, key, "left")
    inside = F.col(order) <= F.col("_cut") if keep_cut_row else F.col(order) < F.col("_cut")
    return joined.where(F.col("_cut").isNull() | inside).drop("_cut")


def cut_at_marker(raw: DataFrame, *, value: str = "value", order: str = "seq") -> DataFrame:
    """Lines before the first completion marker of the log."""
    cut = raw.where(is_stop_marker(value)).agg(F.min(order).alias("_cut"))
    # One aggregate row: the cross join is a broadcast of a single number.
    return raw.crossJoin(F.broadcast(cut)).where(
        F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))).drop("_cut")


def first_lines(raw: DataFrame, limit: int, order: str = "seq") -> DataFrame:
    """The first lines in file order, for dense line numbers that start at 0."""
    return raw.where(F.col(order) < limit)
