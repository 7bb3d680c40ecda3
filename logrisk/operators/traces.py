"""Cluster traces: scheduler events, GPU jobs with tasks, and instance rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.config import (
    EVENT_COLUMNS_8, EVENT_COLUMNS_12, EVENT_NAMES, FAIL_EVENTS, FINISH_EVENT, SCHEDULE_EVENT,
)
from logrisk.functions.casts import (
    flag, label_flag, number, resource_struct, rounded_columns, safe_double, share,
)
from logrisk.operators.ordered import Limits, Run, bursts, running

# ---------------------------------------------------------------- scheduler events


def event_name(code: Column) -> Column:
    pairs = [F.lit(x) for item in EVENT_NAMES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit("UNKNOWN"))


def is_fail(code="event_type") -> Column:
    return F.col(code).isin(FAIL_EVENTS)


def clean_events(raw: DataFrame, order: str = "seq") -> DataFrame:
    """Typed events from text columns; rows without job id or with a bad code are dropped.

    Header names are folded (case, spaces) and the known aliases accepted.
    """
    folded = raw.toDF(*[c if c == order else c.strip().lower() for c in raw.columns])

    def pick(*names: str, default: str = "") -> Column:
        for name in names:
            if name in folded.columns:
                return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        return F.lit(default)

    def measure(*names: str, kind: str = "double") -> Column:
        for name in names:
            if name in folded.columns:
                return number(folded, name, kind)
        return F.lit(0).cast(kind)

    code = pick("event_type", "type", default="-1").try_cast("double").try_cast("int")
    typed = folded.select(
        F.col(order),
        measure("time", "timestamp").alias("time"),
        pick("job_id", "jobid").alias("job_id"),
        code.alias("event_type"),
        event_name(code).alias("event_name"),
        measure("scheduling_class", kind="int").alias("scheduling_class"),
        measure("priority", kind="int").alias("priority"),
        measure("cpu_request", "cpu").alias("cpu_request"),
        measure("memory_request", "memory").alias("memory_request"),
        measure("disk_space_request", "disk").alias("disk_request"),
        pick("user").alias("user"),
    )
    return typed.where((F.col("job_id") != "") & F.col("event_type").isNotNull())


def parse_event_lines(lines: DataFrame, value: str = "value", order: str = "seq",
                      header: list[str] | None = None) -> DataFrame:
    """Events from raw CSV lines with a known header, or by the number of columns."""
    width = max(len(EVENT_COLUMNS_12), len(header or ()))
    names = [f"c{i}" for i in range(width)]
    row = F.from_csv(F.col(value), F.lit(", ".join(f"{n} string" for n in names)),
                     {"mode": "PERMISSIVE", "quote": '"'})
    # The number of fields: separators outside quotes, plus one.
    bare = F.regexp_replace(F.col(value), r'"(?:[^"]|"")*"', "q")
    size = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    cells = lines.select(F.col(order), row.alias("r"), size.alias("size"))

    def at(layout: list[str], name: str) -> Column:
        if name not in layout:
            return F.lit(None).cast("string")
        return F.col("r")[names[layout.index(name)]]

    wanted = list(dict.fromkeys(EVENT_COLUMNS_12 + EVENT_COLUMNS_8))
    if header is not None:
        layout = [h.strip().lower() for h in header]
        columns = [at(layout, name).alias(name) for name in wanted]
    else:
        columns = [
            F.when(F.col("size") >= 12, at(EVENT_COLUMNS_12, name))
            .when(F.col("size") == 8, at(EVENT_COLUMNS_8, name))
            .otherwise(at(EVENT_COLUMNS_12[:8], name)).alias(name)
            for name in wanted
        ]
    return clean_events(cells.select(order, *columns), order)


def job_labels(events: DataFrame, order: str = "seq") -> DataFrame:
    """1 if any failing event, else 0 if finished; jobs without either are dropped."""
    finish = F.col("event_type") == FINISH_EVENT
    failed_at = F.when(is_fail(), F.col(order))
    done_at = F.when(finish, F.col(order))
    labelled = events.groupBy("job_id").agg(
        F.max(F.when(is_fail(), 1).when(finish, 0)).alias("label"),
        F.coalesce(F.max_by("event_type", failed_at), F.max_by("event_type", done_at))
        .alias("terminal_event"),
    )
    return labelled.where(F.col("label").isNotNull())


def ordered_events(events: DataFrame, *, order: str = "seq", total: str | None = None,
                   limits: Limits = Limits()) -> DataFrame:
    """Adds row number, running burst and reschedule flag per job, by time then file order."""
    failed_before = Run("_last_fail", "max_before", F.when(is_fail(), F.col("n")))
    ok, burst = bursts(is_fail())
    out = running(
        events, ["job_id"], ["time", order],
        [[Run("n", "sum", F.lit(1).cast("long"))], [failed_before, *ok], burst],
        firsts={"user": "first_user"}, total=total, limits=limits,
    )
    again = (F.col("event_type") == SCHEDULE_EVENT) & (F.col("_last_fail") == F.col("n") - 1)
    return out.withColumn("rescheduled", flag(again)).drop("_last_fail", "_last_ok")


def job_features(events: DataFrame, *, order: str = "seq", limits: Limits = Limits()) -> DataFrame:
    """36 features per job; ordering and aggregation share the shuffle on the job id."""
    placed = ordered_events(events, order=order, limits=limits)

    def codes(*wanted: int) -> Column:
        return F.count_if(F.col("event_type").isin(list(wanted)))

    def top(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col(name) > 0, F.col(name))), F.lit(0.0))

    timed = F.when(F.col("time") > 0, F.col("time"))
    base = placed.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_lines"),
        codes(0, 1).alias("info_count"),
        codes(7, 8).alias("warn_count"),
        codes(*FAIL_EVENTS).alias("error_count"),
        codes(5, 6).alias("fatal_count"),
        codes(7).alias("warning_kw_hits"),
        codes(2, 3).alias("exception_count"),
        F.sum("rescheduled").alias("retry_count"),
        F.sum("first_user").alias("unique_components"),
        F.max("burst").alias("max_error_burst"),
        F.when(F.count(timed) >= 2, F.max(timed) - F.min(timed)).otherwise(0.0).alias("_span"),
        top("cpu_request").alias("_cpu"),
        top("memory_request").alias("_memory"),
        top("disk_request").alias("_disk"),
        F.min_by("priority", order).alias("priority"),
        F.min_by("scheduling_class", order).alias("scheduling_class"),
    )
    return finish_job_features(base)


def finish_job_features(base: DataFrame, *carry: str) -> DataFrame:
    """Rates, products and flags from the counters of jobs or of their prefixes; `carry` columns stay."""
    # Spans above 1e9 are microseconds.
    span = F.when(F.col("_span") > 1e9, F.col("_span") / 1e6).otherwise(F.col("_span"))
    out = base.withColumn("_span", span).select(
        F.col("job_id").alias("process_id"), *carry,
        "total_lines", "info_count", "warn_count", "error_count",
        F.lit(0).alias("debug_count"), "fatal_count",
        share("error_count", "total_lines").alias("error_rate"),
        share("warn_count", "total_lines").alias("warn_rate"),
        share("fatal_count", "total_lines").alias("critical_rate"),
        share("error_count", "total_lines").alias("error_kw_rate"),
        F.col("error_count").alias("error_kw_hits"),
        "warning_kw_hits",
        F.col("fatal_count").alias("critical_kw_hits"),
        "retry_count", "exception_count", "unique_components",
        F.col("error_count").alias("failing_comp_hits"),
        F.lit(1).alias("unique_pids"),
        "max_error_burst",
        F.col("_span").alias("duration_s"),
        F.lit(0).alias("hour_of_day"), F.lit(0).alias("is_weekend"),
        F.col("_cpu").alias("cpu_request"),
        F.col("_memory").alias("memory_request"),
        F.col("_disk").alias("disk_request"),
        "priority", "scheduling_class",
        F.col("total_lines").alias("task_count"),
        F.col("error_count").alias("failed_task_count"),
        F.col("total_lines").alias("event_count"),
        (F.col("error_count") * F.col("retry_count")).alias("err_x_retry"),
        flag(F.col("exception_count") > 0).alias("has_exception"),
        flag(F.col("fatal_count") > 0).alias("has_fatal"),
        flag(F.col("retry_count") > 0).alias("has_retry"),
        flag(F.col("_memory") > 0.80).alias("oom_signal"),
        flag(F.col("_span") > 14400).alias("timeout_signal"),
    )
    return rounded_columns(out, {
        "error_rate": 4, "warn_rate": 4, "critical_rate": 4, "error_kw_rate": 4, "duration_s": 2,
        "cpu_request": 4, "memory_request": 4, "disk_request": 4})


# ---------------------------------------------------------------- GPU jobs and tasks


def gpu_jobs(raw: DataFrame, *, order: str = "seq", limit: int | None = None) -> DataFrame:
    """Finished and failed jobs, one row per name (the last row wins).

    `limit` keeps the first so many different jobs in file order.
    """
    status = F.lower(F.trim("status"))
    name = F.trim(F.col("job_name").cast("string"))
    kept = raw.select(
        order, name.alias("job_name"), status.alias("status"),
        number(raw, "start_time").alias("job_start_time"),
        *[F.col(c) for c in ("user",) if c in raw.columns],
        *[number(raw, c).alias("job_end_time") for c in ("end_time",) if c in raw.columns],
    ).where(status.isin("terminated", "failed") & (name != ""))
    if limit:
        seen = kept.groupBy("job_name").agg(F.min(order).alias("_first"))
        last = seen.orderBy("_first").limit(limit).agg(F.max("_first").alias("_last"))
        kept = kept.crossJoin(F.broadcast(last)).where(F.col(order) <= F.col("_last")).drop("_last")
    others = [c for c in kept.columns if c not in ("job_name", order)]
    latest = kept.groupBy("job_name").agg(F.max_by(F.struct(*others), order).alias("j"))
    return latest.select("job_name", "j.*", flag(F.col("j.status") == "failed").alias("label"))


def gpu_tasks(raw: DataFrame) -> DataFrame:
    """Typed tasks; planned cpu and gpu are percent of one unit."""
    return raw.select(
        *[F.col(c) for c in ("seq",) if c in raw.columns],
        F.trim(F.col("job_name").cast("string")).alias("job_name"),
        F.coalesce(F.col("task_name"), F.lit("")).alias("task_name"),
        number(raw, "start_time").alias("time"),
        number(raw, "inst_num").alias("instance_count"),
        (number(raw, "plan_cpu") / 100.0).alias("cpu_request"),
        number(raw, "plan_mem").alias("memory_request"),
        (number(raw, "plan_gpu") / 100.0).alias("gpu_request"),
    )


def tasks_of(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    return tasks.join(jobs.select("job_name"), "job_name", "left_semi")


def jobs_with_tasks(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs and their tasks; a job without tasks gets one default task."""
    named = tasks.withColumn("_has", F.lit(True))
    out = jobs.join(named, "job_name", "left")

    def or_default(name: str, value: Column) -> Column:
        return F.when(F.col("_has"), F.col(name)).otherwise(value)

    return out.withColumns({
        "task_name": or_default("task_name", F.lit("job")),
        "time": or_default("time", F.col("job_start_time")),
        "instance_count": or_default("instance_count", F.lit(1.0)),
        "cpu_request": or_default("cpu_request", F.lit(0.0)),
        "memory_request": or_default("memory_request", F.lit(0.0)),
        "gpu_request": or_default("gpu_request", F.lit(0.0)),
    }).drop("_has")


def gpu_features(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Features per GPU job. Tasks are summed before the join, so no hot job travels."""
    started = F.when(F.col("time") > 0, F.col("time"))
    summed = tasks.groupBy("job_name").agg(
        F.count(F.lit(1)).alias("_tasks"),
        F.count_distinct("task_name").alias("_names"),
        F.sum("instance_count").alias("_instances"),
        F.min(started).alias("_min_start"),
        F.max(started).alias("_max_start"),
        F.max("cpu_request").alias("_cpu"),
        F.max("memory_request").alias("_memory"),
        F.max("gpu_request").alias("_gpu"),
    )
    start = F.col("job_start_time")
    has_tasks = F.col("_tasks").isNotNull()
    own = F.when(start > 0, start)
    joined = jobs.join(summed, "job_name", "left").withColumns({
        "_min_start": F.when(has_tasks, F.col("_min_start")).otherwise(own),
        "_max_start": F.when(has_tasks, F.col("_max_start")).otherwise(own),
        "_tasks": F.coalesce("_tasks", F.lit(1)),
        "_names": F.coalesce("_names", F.lit(1)),
        "_instances": F.coalesce("_instances", F.lit(1.0)),
        "_cpu": F.coalesce("_cpu", F.lit(0.0)),
        "_memory": F.coalesce("_memory", F.lit(0.0)),
        "_gpu": F.coalesce("_gpu", F.lit(0.0)),
    })

    def since_start(moment: str) -> Column:
        known = (start != 0) & F.col(moment).isNotNull()
        return F.when(known, F.greatest(F.lit(0.0), F.col(moment) - start)).otherwise(0.0)

    out = joined.select(
        F.col("job_name").alias("process_id"),
        "label",
        F.col("_tasks").alias("total_lines"),
        F.col("_tasks").alias("info_count"),
        F.col("_names").alias("unique_components"),
        F.col("_instances").cast("long").alias("unique_pids"),
        since_start("_max_start").alias("duration_s"),
        F.col("_cpu").alias("cpu_request"),
        F.col("_memory").alias("memory_request"),
        F.col("_gpu").alias("gpu_request"),
        F.col("_tasks").alias("task_count"),
        F.col("_instances").alias("instance_count"),
        F.col("_tasks").alias("event_count"),
        since_start("_min_start").alias("scheduling_delay_s"),
        flag(since_start("_max_start") > 14400).alias("timeout_signal"),
    )
    return rounded_columns(out, {
        "duration_s": 2, "cpu_request": 4, "memory_request": 4, "gpu_request": 4,
        "instance_count": 4, "scheduling_delay_s": 4})


# ---------------------------------------------------------------- instance rows


def borg_features(raw: DataFrame, order: str = "seq") -> DataFrame:
    """One feature row per labelled instance row; no end-time features."""
    def measure(name: str, kind: str = "double") -> Column:
        return number(raw, name, kind) if name in raw.columns else F.lit(0).cast(kind)

    request = resource_struct("resource_request")
    usage = resource_struct("random_sample_usage")
    collection = F.trim(F.coalesce(
        F.nullif(F.col("collection_id").cast("string"), F.lit("")), F.lit("unknown")))
    instance = F.trim(F.coalesce(
        F.nullif(F.col("instance_index").cast("string"), F.lit("")), F.col(order).cast("string")))
    typed = raw.select(
        order,
        label_flag("failed").alias("label"),
        collection.alias("group_id"),
        F.concat_ws(":", collection, instance, F.col(order).cast("string")).alias("process_id"),
        request.alias("req"), usage.alias("use"),
        measure("assigned_memory").alias("assigned_memory"),
        *[measure(c).alias(c) for c in (
            "page_cache_memory", "cycles_per_instruction",
            "memory_accesses_per_instruction", "sample_rate")],
        *[measure(c, "int").alias(c) for c in ("scheduling_class", "priority", "cluster")],
    ).where(F.col("label").isNotNull())
    typed = typed.withColumns({
        "cpu_request": safe_double("req.cpus"), "memory_request": safe_double("req.memory"),
        "cpu_usage_sample": safe_double("use.cpus"), "memory_usage_sample": safe_double("use.memory"),
    }).drop("req", "use")
    held = F.greatest("memory_request", "assigned_memory", F.lit(0.0))
    one = F.lit(1)
    values = ["cpu_usage_sample", "memory_usage_sample", "assigned_memory", "page_cache_memory",
              "cycles_per_instruction", "memory_accesses_per_instruction", "sample_rate"]
    out = typed.select(
        "process_id", "group_id", "label",
        one.alias("total_lines"), one.alias("info_count"),
        one.alias("unique_components"), one.alias("unique_pids"),
        F.lit(0.0).alias("duration_s"), "cpu_request", "memory_request",
        "priority", "scheduling_class", one.alias("task_count"), one.alias("event_count"),
        flag(F.col("memory_usage_sample") > held).alias("oom_signal"), *values, "cluster",
    )
    return rounded_columns(out, {"cpu_request": 6, "memory_request": 6, **{c: 6 for c in values}})
