"""Prefix features of jobs whose events arrive out of the order of their times.

A prediction fires by arrival, after every N-th event of a job, but bursts and
retries follow the times of the events that have arrived so far. The events of
a job in order of time are the leaves of a tree. A node sums up the run of
failures at its start, at its end and its longest one, the first and the last
event, and the retries inside; two neighbours merge into their parent, so a
node's summary only changes when one of its leaves arrives. Level by level,
each parent takes the newest summary of every child at each change. Changes
between two predictions count once, so upper levels have few rows. All of it
is running maxima over ordered groups, which also hold for a huge job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.config import FAIL_EVENTS, PREDICT_EVERY, SCHEDULE_EVENT
from logrisk.operators.ordered import Limits, Run, row_numbers, running
from logrisk.operators.traces import finish_job_features, is_fail
from logrisk.session import written

#: Children of a node.
CHILDREN = 8
SUMMARY = ["size", "head", "tail", "best", "first_schedules", "last_fails", "retries"]


def _sum(name: str, value: Column) -> Run:
    return Run(name, "sum", value)


def _max(name: str, value: Column) -> Run:
    return Run(name, "max", value)


def leaf() -> Column:
    """The summary of one event."""
    failed = is_fail().cast("long")
    values = [F.lit(1).cast("long"), failed, failed, failed, F.col("event_type") == SCHEDULE_EVENT, is_fail(), F.lit(0).cast("long")]
    return F.struct(*[v.alias(n) for n, v in zip(SUMMARY, values)])


def merged(a: Column, b: Column) -> Column:
    """The summary of two neighbours in time; a missing one changes nothing."""
    across = (a["last_fails"] & b["first_schedules"]).cast("long")
    both = F.struct(
        (a["size"] + b["size"]).alias("size"),
        F.when(a["head"] == a["size"], a["size"] + b["head"]).otherwise(a["head"]).alias("head"),
        F.when(b["tail"] == b["size"], b["size"] + a["tail"]).otherwise(b["tail"]).alias("tail"),
        F.greatest(a["best"], b["best"], a["tail"] + b["head"]).alias("best"),
        a["first_schedules"].alias("first_schedules"), b["last_fails"].alias("last_fails"),
        (a["retries"] + b["retries"] + across).alias("retries"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def runs_at(events: DataFrame, every: int, *, order: str = "seq", limits: Limits = Limits()) -> DataFrame:
    """job_id, turn, max_error_burst, retry_count over the events of the first `turn` * every arrivals.

    events: job_id, time, event_type, `n` (number of the arrival in its job)
    and the order column. The last turn of a job may be shorter.
    """
    ranked = row_numbers(events.select("job_id", "time", order, "event_type", "n"), ["job_id"], ["time", order], "rank", limits=limits)
    nodes = ranked.select("job_id", (F.col("rank") - 1).alias("place"), F.ceil(F.col("n") / every).cast("long").alias("turn"), leaf().alias("s"))
    nodes = written(nodes, "arrival-level")
    width = nodes.agg(F.max("place")).first()[0]
    while width:
        nodes = written(_parents(nodes, limits), "arrival-level")
        width //= CHILDREN
    return _newest(nodes, ["job_id"]).select(
        "job_id", "turn", F.col("s.best").alias("max_error_burst"), F.col("s.retries").alias("retry_count"))


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each turn: all rows of a turn hold what came before them in it."""
    return rows.groupBy(*keys, "turn").agg(F.max_by("s", "s.size").alias("s"))


def _parents(nodes: DataFrame, limits: Limits) -> DataFrame:
    """The summaries of the next level at every turn in which a child changed."""
    newest = _newest(nodes, ["job_id", "place"])
    child, parent = F.pmod("place", F.lit(CHILDREN)), F.floor(F.col("place") / CHILDREN)
    rows = newest.select("job_id", parent.alias("place"), child.alias("child"), "turn", "s")
    # The newest summary of a child is the one with the greatest turn.
    children = [f"_c{k}" for k in range(CHILDREN)]
    latest = [Run(c, "max", F.when(F.col("child") == k, F.struct("turn", "s"))) for k, c in enumerate(children)]
    known = running(rows, ["job_id", "place"], ["turn", "child"], [latest], limits=limits)
    # A fold names each part once; nested expressions would repeat them at every step.
    kind = nodes.schema["s"].dataType.simpleString()
    summary = F.aggregate(F.array(*[F.col(f"{c}.s") for c in children]), F.lit(None).cast(kind), merged)
    return known.select("job_id", "place", "turn", summary.alias("s"))


def event_prefixes(events: DataFrame, every: int = PREDICT_EVERY, *, order: str = "seq",
                   limits: Limits = Limits()) -> DataFrame:
    """Counters of each job after every N-th arrival and after its last one.

    events: rows of `clean_events`; `order` is the order of arrival. Result: one
    row per prediction with the order column, `trigger` (every_n, final) and the
    36 features.
    """
    def codes(*wanted: int) -> Column:
        return F.col("event_type").isin(list(wanted)).cast("long")

    def top(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name))

    timed = F.when(F.col("time") > 0, F.col("time"))
    counted = running(events, ["job_id"], [order], [[
        _sum("n", F.lit(1).cast("long")),
        _sum("info_count", codes(0, 1)), _sum("warn_count", codes(7, 8)),
        _sum("error_count", codes(*FAIL_EVENTS)), _sum("fatal_count", codes(5, 6)),
        _sum("warning_kw_hits", codes(7)), _sum("exception_count", codes(2, 3)),
        _sum("unique_components", F.col("first_user")),
        _sum("_timed", timed.isNotNull().cast("long")), _max("_last", timed), Run("_first", "min", timed),
        _max("_cpu", top("cpu_request")), _max("_memory", top("memory_request")), _max("_disk", top("disk_request")),
    ], [
        # The values of the first arrival.
        _max("_priority", F.when(F.col("n") == 1, F.col("priority"))),
        _max("_class", F.when(F.col("n") == 1, F.col("scheduling_class"))),
    ]], firsts={"user": "first_user"}, total="total", limits=limits)
    counted = written(counted, "arrivals")
    runs = runs_at(counted, every, order=order, limits=limits)
    full, last = F.col("n") % every == 0, F.col("n") == F.col("total")
    triggers = F.array_compact(F.array(F.when(full, F.lit("every_n")), F.when(last, F.lit("final"))))
    fired = counted.where(full | last).withColumn("turn", F.ceil(F.col("n") / every).cast("long"))
    fired = fired.join(runs, ["job_id", "turn"]).select(
        "job_id", F.col(order), F.explode(triggers).alias("trigger"), F.col("n").alias("total_lines"), "info_count", "warn_count", "error_count",
        "fatal_count", "warning_kw_hits", "exception_count", "retry_count", "unique_components", "max_error_burst",
        F.when(F.col("_timed") >= 2, F.col("_last") - F.col("_first")).otherwise(0.0).alias("_span"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("_cpu", "_memory", "_disk")],
        F.col("_priority").alias("priority"), F.col("_class").alias("scheduling_class"))
    return finish_job_features(fired, order, "trigger")

