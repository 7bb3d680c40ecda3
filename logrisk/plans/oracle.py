"""The registered queries as plain SQL for another engine, written from the definitions."""

from __future__ import annotations

from logrisk.config import CRITICAL_KEYWORDS, ERROR_KEYWORDS, FAILING_COMPONENTS, WARNING_KEYWORDS

LOG_RAW = """log_raw as (
 select event_id as seq, ts, user_id,
  strftime(ts,'%y%m%d %H%M%S') || ' ' || cast(100 + user_id % 5 as varchar) || ' ' ||
  case when event_type='error' and value >= 150 then 'FATAL' when event_type='error' then 'ERROR'
       when event_type='signup' then 'WARN' when event_type='view' and value < 5 then 'DEBUG' else 'INFO' end
  || ' ' || case event_type when 'click' then 'pipeline.Extractor' when 'view' then 'pipeline.SchemaValidator'
       when 'purchase' then 'pipeline.Loader' when 'signup' then 'pipeline.Transformer'
       else 'dfs.DataNode$DataXceiver' end
  || ': ' || case when event_type='error' and value >= 150 then 'Critical corruption detected for block '
       when event_type='error' and value >= 75 then 'IOException while processing block '
       when event_type='error' then 'Timeout while loading; retrying block '
       when event_type='signup' then 'Slow transform observed for block ' else 'Processed batch for block ' end
  || 'blk_' || case when user_id % 7 = 0 then '-' else '' end || cast(user_id as varchar)
  || case when event_id % 10 = 0 then ' mirrored to blk_' || cast(user_id + 1 as varchar) else '' end as value
 from events)"""

LINE = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+(\S+):\s+(.+)$"

PARSED = f"""parsed as (
 select seq, p.d as date, p.t as time, p.pid as pid, p.l as level, p.c as component, p.m as content,
  list_distinct(regexp_extract_all(p.m, 'blk_-?\\d+')) as block_ids
 from (select seq, regexp_extract(value, '{LINE}', ['d','t','pid','l','c','m']) as p
       from log_raw where regexp_matches(value, '{LINE}')))"""

LINES = f"""lines as (
 select seq, unnest(block_ids) as process_id, pid, level, component,
  cast(epoch(try_strptime(date || time, '%y%m%d%H%M%S')) as bigint) as ts_s,
  cast(level = 'INFO' as int) as i_info, cast(level in ('WARN','WARNING') as int) as i_warn,
  cast(level = 'ERROR' as int) as i_error, cast(level = 'DEBUG' as int) as i_debug,
  cast(level = 'FATAL' as int) as i_fatal,
  cast(regexp_matches(lower(content), '{"|".join(ERROR_KEYWORDS)}') as int) as k_error,
  cast(regexp_matches(lower(content), '{"|".join(WARNING_KEYWORDS)}') as int) as k_warn,
  cast(regexp_matches(lower(content), '{"|".join(CRITICAL_KEYWORDS)}') as int) as k_crit,
  cast(contains(lower(content), 'retry') or contains(lower(content), 'retrying') as int) as k_retry,
  cast(contains(lower(content), 'exception') as int) as k_exc,
  cast(regexp_matches(component, '{"|".join(FAILING_COMPONENTS)}') as int) as c_fail
 from parsed)"""

ISLANDS = """islands as (
 select *, sum(case when i_error + i_fatal > 0 then 0 else 1 end)
   over (partition by process_id order by seq) as island from lines),
runs as (
 select *, sum(case when i_error + i_fatal > 0 then 1 else 0 end)
   over (partition by process_id, island order by seq) as run from islands)"""

COUNTER_SQL = {
    "info_count": "i_info", "warn_count": "i_warn", "error_count": "i_error", "debug_count": "i_debug",
    "fatal_count": "i_fatal", "error_kw_hits": "k_error", "warning_kw_hits": "k_warn",
    "critical_kw_hits": "k_crit", "retry_count": "k_retry", "exception_count": "k_exc",
    "failing_comp_hits": "c_fail",
}

PREFIX = "prefix as (select process_id, seq, component, count(*) over w as total_lines, " + ", ".join(
    f"cast(sum({c}) over w as bigint) as {n}" for n, c in COUNTER_SQL.items()
) + """, count(distinct component) over w as unique_components, count(distinct pid) over w as unique_pids,
 cast(max(run) over w as bigint) as max_error_burst, min(ts_s) over w as first_s, max(ts_s) over w as last_s,
 count(*) over (partition by process_id) as total
 from runs window w as (partition by process_id order by seq rows between unbounded preceding and current row))"""

HISTORY = "history as (select process_id, count(*) as total_lines, " + ", ".join(
    f"cast(sum({c}) as bigint) as {n}" for n, c in COUNTER_SQL.items()
) + """, count(distinct component) as unique_components, count(distinct pid) as unique_pids,
 cast(max(run) as bigint) as max_error_burst, min(ts_s) as first_s, max(ts_s) as last_s
 from runs group by process_id)"""

DERIVED = """rnd(error_count / total_lines, 4) as error_rate, rnd(warn_count / total_lines, 4) as warn_rate,
 rnd(fatal_count / total_lines, 4) as critical_rate, rnd(error_kw_hits / total_lines, 4) as error_kw_rate,
 rnd(cast(last_s - first_s as double), 2) as duration_s,
 cast(hour(make_timestamp(first_s * 1000000)) as int) as hour_of_day,
 cast(isodow(make_timestamp(first_s * 1000000)) >= 6 as int) as is_weekend,
 cast(0 as double) as cpu_request, cast(0 as double) as memory_request, cast(0 as double) as disk_request,
 0 as priority, 0 as scheduling_class, 0 as task_count, 0 as failed_task_count, total_lines as event_count,
 error_count * retry_count as err_x_retry, cast(exception_count > 0 as int) as has_exception,
 cast(fatal_count > 0 as int) as has_fatal, cast(retry_count > 0 as int) as has_retry"""

LOG1P_NAMES = ["total_lines", "error_count", "warn_count", "fatal_count", "error_kw_hits", "retry_count",
               "exception_count", "duration_s", "err_x_retry", "max_error_burst"]
LOG1P = ", ".join(f"rnd(ln(1 + greatest(0, {c})), 6) as log1p_{c}" for c in LOG1P_NAMES)


def finished(source: str, name: str) -> str:
    return (f"{name} as (select * exclude (first_s, last_s), {LOG1P} from "
            f"(select *, {DERIVED} from {source}))")


LOG_BASE = ",\n".join([LOG_RAW, PARSED, LINES, ISLANDS])
FIRED = """fired as (
 select *, 'every_n' as trigger from prefix where total_lines % 20 = 0
 union all select *, 'final' as trigger from prefix where total_lines = total)"""


def _ratio(x: str, scale: str) -> str:
    return f"greatest(cast(0 as double), least(cast(1 as double), cast({x} as double) / cast({scale} as double)))"


SIGNAL_SUM = " + ".join(
    f"{_ratio(c, s)} * cast({w} as double)" for c, s, w in [
        ("fatal_count", "1.0", "2.4"), ("critical_kw_hits", "1.0", "1.8"), ("error_count", "2.0", "1.7"),
        ("error_rate", "0.30", "1.7"), ("max_error_burst", "2.0", "1.0"), ("exception_count", "1.0", "1.0"),
        ("retry_count", "2.0", "0.9"), ("warn_count", "3.0", "0.6"), ("warn_rate", "0.40", "0.5"),
        ("critical_rate", "0.20", "1.3")])
STRONG = "(fatal_count > 0 or (critical_kw_hits >= 2 and error_count >= 1))"
MODERATE = "(error_count >= 2 and (retry_count >= 1 or max_error_burst >= 2))"


def exact_round(x: str, digits: int) -> str:
    """Rounding of the exact binary value, ties to even; see `casts.rounded`."""
    c = f"cast({10 ** digits} as double)"
    x = f"cast(({x}) as double)"
    p = f"({x} * {c})"
    high = f"({x} * 134217729 - ({x} * 134217729 - {x}))"
    error = f"(({high} * {c} - {p}) + ({x} - {high}) * {c})"
    return (f"(case when {p} - floor({p}) = 0.5 then case when {error} > 0 then floor({p}) + 1 when {error} < 0 then floor({p}) "
            f"else 2 * floor(({p} + 1) / 2) end when {p} - floor({p}) > 0.5 then floor({p}) + 1 else floor({p}) end / {c})")


def with_rounding(sql: str) -> str:
    """Replaces every `rnd(expression, digits)` by its arithmetic, innermost first."""
    while "rnd(" in sql:
        start = sql.rindex("rnd(")
        depth, comma, at = 1, None, start + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            if sql[at] == "," and depth == 1:
                comma = at
            at += 1
        expression, digits = sql[start + 4:comma], int(sql[comma + 1:at - 1])
        sql = sql[:start] + exact_round(expression, digits) + sql[at:]
    return sql


def D(x) -> str:
    return f"cast({x} as double)"


SCORES = f"""s1 as (select *, ({SIGNAL_SUM}) / {D(12.9)} as base from feats),
s2 as (select *, case when {STRONG} then greatest(base, {D(0.9)})
  when error_count >= 3 or {MODERATE} then greatest(base, {D(0.62)})
  when error_count >= 1 or retry_count >= 2 or warn_count >= 3 then greatest(base, {D(0.4)})
  when retry_count >= 1 or warn_count >= 1 then greatest(base, {D(0.22)}) else base end as v from s1),
s3 as (select * replace (case when total_lines >= 5 and error_count = 0 and fatal_count = 0 and retry_count = 0
  and critical_kw_hits = 0 and exception_count = 0 then least(v, {D(0.18)}) else v end as v) from s2),
s4 as (select * replace (case when total_lines > 0 and error_count = 0 and fatal_count = 0 and warn_count = 0
  then least(v, {D(0.1)}) else v end as v) from s3),
s5 as (select *, greatest({D(0.02)}, least({D(0.98)},
  case when error_count = 0 and fatal_count = 0 and total_lines > 0
   then greatest({D(0)}, v - {D(0.12)} * {_ratio('failing_comp_hits', 'greatest(total_lines, 1)')}) else v end)) as signal,
  case when fatal_count > 0 or critical_kw_hits > 0
     then least({D(0.98)}, {D(0.86)} + {D(0.03)} * fatal_count + {D(0.01)} * error_count)
   when error_count >= 2 or max_error_burst >= 2
     then least({D(0.82)}, {D(0.7)} + {D(0.03)} * error_count + {D(0.02)} * retry_count)
   when error_count = 1 then least({D(0.68)}, {D(0.56)} + {D(0.03)} * retry_count)
   when retry_count > 0 or warn_count >= 2
     then least({D(0.58)}, {D(0.43)} + {D(0.04)} * retry_count + {D(0.02)} * warn_count)
   when warn_count = 1 then {D(0.34)} else {D(0.12)} end as raw from s4),
s6 as (select *, case when fatal_count > 0 then greatest(c0, {D(0.9)}) when {STRONG} then greatest(c0, {D(0.75)})
   when error_count >= 3 or {MODERATE} then greatest(c0, {D(0.6)}) when error_count >= 1 then greatest(c0, {D(0.45)})
   when retry_count >= 1 or critical_kw_hits >= 1 then greatest(c0, {D(0.35)}) else c0 end as confidence
  from (select *, least({D(1)}, total_lines / {D(40)}) as c0 from s5)),
s7 as (select *, greatest({D(0.02)}, least({D(0.98)}, {D(0.1)} + confidence *
   ({D(0.15)} * raw + {D(0.7)} * signal + {D(0.15)} * {D(0.1)} - {D(0.1)}))) as p from s6),
alerts as (select *, 's' || cast(cast(regexp_extract(process_id, '(\\d+)', 1) as bigint) % 13 as varchar) as session_id,
  rnd(p, 4) as failure_probability, cast(p >= {D(0.5)} as int) as prediction,
  case when p >= {D(0.7)} then 'HIGH' when p >= {D(0.4)} then 'MEDIUM' else 'LOW' end as risk_level,
  case when trigger = 'final' then 'Monitor' when component = 'pipeline.Extractor' or contains(component, 'DataXceiver') then 'Extract'
   when contains(component, 'SchemaValidator') then 'Validate' when contains(component, 'Transformer') then 'Transform'
   when contains(component, 'Loader') then 'Load' else 'Monitor' end as stage,
  (trigger = 'final')::int as is_final from s7)"""

WITH_PREFIX = f"with {LOG_BASE},\n{PREFIX}"
WITH_ALERTS = f"{WITH_PREFIX},\n{FIRED},\n{finished('fired', 'feats')},\n{SCORES}"
WITH_EVERY = (f"{WITH_PREFIX},\nfired as (select *, 'every_n' as trigger from prefix where total_lines % 20 = 0),\n"
              f"{finished('fired', 'feats')},\n{SCORES}")
WITH_HISTORY = f"with {LOG_BASE},\n{HISTORY},\n{finished('history', 'feats')}"

FEATURES_34 = [
    "total_lines", "info_count", "warn_count", "error_count", "debug_count", "fatal_count", "error_rate",
    "warn_rate", "critical_rate", "error_kw_rate", "error_kw_hits", "warning_kw_hits", "critical_kw_hits",
    "retry_count", "exception_count", "unique_components", "failing_comp_hits", "unique_pids",
    "max_error_burst", "duration_s", "hour_of_day", "is_weekend", "cpu_request", "memory_request",
    "disk_request", "priority", "scheduling_class", "task_count", "failed_task_count", "event_count",
    "err_x_retry", "has_exception", "has_fatal", "has_retry"]
FEATURES_44 = ", ".join(FEATURES_34 + [f"log1p_{c}" for c in LOG1P_NAMES])

LABELS = """fx_labels as (
 select distinct 'blk_' || case when user_id % 7 = 0 then '-' else '' end || cast(user_id as varchar) as process_id,
  case when user_id % 7 = 0 then 1 else 0 end as label from events where user_id % 11 <> 10)"""

JOB_EVENTS = """job_events as (
 select event_id as seq, cast(event_id*1000 as double) as time,
  cast(user_id as varchar) || '-' || cast(cast(floor(day(ts)/5) as int) as varchar) as job_id,
  case when event_type='view' then 0 when event_type='click' then 1 when event_type='error' and value>=120 then 5
   when event_type='error' and value>=100 then 3 when event_type='error' and value>=90 then 2
   when event_type='error' and value>=85 then 6 when event_type='purchase' and value<40 then 4
   when event_type='signup' and value<40 then 7 else 8 end as event_type,
  cast(user_id % 4 as int) as scheduling_class, cast(event_id % 12 as int) as priority,
  value/400 as cpu_request, value/300 as memory_request, value/1000 as disk_request,
  'u' || cast(user_id % 13 as varchar) as "user" from events)"""
EVENT_NAME = """case event_type when 0 then 'SUBMIT' when 1 then 'SCHEDULE' when 2 then 'EVICT' when 3 then 'FAIL'
 when 4 then 'FINISH' when 5 then 'KILL' when 6 then 'LOST' when 7 then 'UPDATE_PENDING'
 when 8 then 'UPDATE_RUNNING' else 'UNKNOWN' end"""
JOB_LABELS = """job_labels as (
 select job_id, max(case when event_type in (2,3,5,6) then 1 when event_type = 4 then 0 end) as label,
  coalesce(max_by(event_type, seq) filter (where event_type in (2,3,5,6)),
           max_by(event_type, seq) filter (where event_type = 4)) as terminal_event
 from job_events group by job_id having max(case when event_type in (2,3,5,6) then 1 when event_type = 4 then 0 end) is not null)"""


def job_runs(source: str = "job_events") -> str:
    return f"""job_placed as (
 select *, lag(event_type) over (partition by job_id order by time, seq) as before,
  sum(case when event_type in (2,3,5,6) then 0 else 1 end) over (partition by job_id order by time, seq) as island
 from {source}),
job_runs as (
 select *, case when event_type = 1 and before in (2,3,5,6) then 1 else 0 end as again,
  sum(case when event_type in (2,3,5,6) then 1 else 0 end) over (partition by job_id, island order by time, seq) as run
 from job_placed),
job_base as (
 select job_id as process_id, count(*) as total_lines,
  count(*) filter (where event_type in (0,1)) as info_count, count(*) filter (where event_type in (7,8)) as warn_count,
  count(*) filter (where event_type in (2,3,5,6)) as error_count, 0 as debug_count,
  count(*) filter (where event_type in (5,6)) as fatal_count,
  count(*) filter (where event_type in (2,3,5,6)) as error_kw_hits,
  count(*) filter (where event_type = 7) as warning_kw_hits,
  count(*) filter (where event_type in (5,6)) as critical_kw_hits,
  cast(sum(again) as bigint) as retry_count, count(*) filter (where event_type in (2,3)) as exception_count,
  count(distinct "user") as unique_components, count(*) filter (where event_type in (2,3,5,6)) as failing_comp_hits,
  1 as unique_pids, cast(max(run) as bigint) as max_error_burst,
  case when count(*) filter (where time > 0) >= 2
   then max(time) filter (where time > 0) - min(time) filter (where time > 0) else {D(0)} end as span0,
  0 as hour_of_day, 0 as is_weekend,
  coalesce(max(cpu_request) filter (where cpu_request > 0), 0) as cpu,
  coalesce(max(memory_request) filter (where memory_request > 0), 0) as mem,
  coalesce(max(disk_request) filter (where disk_request > 0), 0) as disk,
  min_by(priority, seq) as priority, min_by(scheduling_class, seq) as scheduling_class
 from job_runs group by job_id),
job_feats as (
 select process_id, total_lines, info_count, warn_count, error_count, debug_count, fatal_count,
  rnd(error_count / total_lines, 4) as error_rate, rnd(warn_count / total_lines, 4) as warn_rate,
  rnd(fatal_count / total_lines, 4) as critical_rate, rnd(error_count / total_lines, 4) as error_kw_rate,
  error_kw_hits, warning_kw_hits, critical_kw_hits, retry_count, exception_count, unique_components,
  failing_comp_hits, unique_pids, max_error_burst, rnd(span, 2) as duration_s, hour_of_day, is_weekend,
  rnd(cpu, 4) as cpu_request, rnd(mem, 4) as memory_request, rnd(disk, 4) as disk_request,
  priority, scheduling_class, total_lines as task_count, error_count as failed_task_count,
  total_lines as event_count, error_count * retry_count as err_x_retry,
  cast(exception_count > 0 as int) as has_exception, cast(fatal_count > 0 as int) as has_fatal,
  cast(retry_count > 0 as int) as has_retry, cast(mem > 0.8 as int) as oom_signal,
  cast(span > 14400 as int) as timeout_signal
 from (select *, case when span0 > 1e9 then span0 / 1e6 else span0 end as span from job_base))"""


GPU = """jobs as (
 select cast(o_orderkey as varchar) as job_name, 'u' || cast(o_custkey as varchar) as "user",
  case o_orderstatus when 'F' then 'failed' else 'terminated' end as status,
  cast(o_orderstatus = 'F' as int) as label, cast(epoch(o_orderdate) as double) as job_start_time
 from orders where o_orderstatus in ('F','O')),
tasks as (
 select cast(l_orderkey as varchar) as job_name, 'task' || cast(l_linenumber as varchar) as task_name,
  l_quantity as instance_count, l_extendedprice/100/100 as cpu_request, l_tax*100 as memory_request,
  l_discount*1000/100 as gpu_request, cast(epoch(l_shipdate) as double) as time from lineitem)"""
GPU_FEATS = f"""gpu_rows as (
 select j.*, coalesce(t.task_name, 'job') as task_name, coalesce(t.instance_count, 1) as instance_count,
  coalesce(t.cpu_request, 0) as cpu_request, coalesce(t.memory_request, 0) as memory_request,
  coalesce(t.gpu_request, 0) as gpu_request,
  case when t.job_name is null then j.job_start_time else t.time end as time
 from jobs j left join tasks t on j.job_name = t.job_name),
gpu_base as (
 select job_name as process_id, any_value(label) as label, count(*) as n, count(distinct task_name) as names,
  sum(instance_count) as instances, max(cpu_request) as cpu, max(memory_request) as mem, max(gpu_request) as gpu,
  any_value(job_start_time) as st, max(time) filter (where time > 0) as t1, min(time) filter (where time > 0) as t0
 from gpu_rows group by job_name),
gpu_feats as (
 select process_id, label, n as total_lines, n as info_count, names as unique_components,
  cast(trunc(instances) as bigint) as unique_pids,
  rnd(case when st <> 0 and t1 is not null then greatest(0, t1 - st) else 0 end, 2) as duration_s,
  rnd(cpu, 4) as cpu_request, rnd(mem, 4) as memory_request, rnd(gpu, 4) as gpu_request,
  n as task_count, rnd(instances, 4) as instance_count, n as event_count,
  rnd(case when st <> 0 and t0 is not null then greatest(0, t0 - st) else 0 end, 4) as scheduling_delay_s,
  cast(case when st <> 0 and t1 is not null then greatest(0, t1 - st) else 0 end > 14400 as int) as timeout_signal
 from gpu_base)"""

BORG = """borg_feats as (
 select cast(l_orderkey as varchar) || ':' || cast(l_linenumber as varchar) || ':' ||
   cast(l_orderkey * 10 + l_linenumber as varchar) as process_id,
  cast(l_orderkey as varchar) as group_id, case l_returnflag when 'R' then 1 else 0 end as label,
  1 as total_lines, 1 as info_count, 1 as unique_components, 1 as unique_pids, cast(0 as double) as duration_s,
  cast(cast(round(l_discount*100) as int) as double) as cpu_request,
  case when l_linenumber = 3 then cast(0 as double) else cast(cast(round(l_tax*100) as int) as double) end as memory_request,
  cast(l_partkey % 12 as int) as priority, cast(l_orderkey % 4 as int) as scheduling_class,
  1 as task_count, 1 as event_count,
  cast(cast(l_quantity as int) % 12 > greatest(case when l_linenumber = 3 then 0 else cast(round(l_tax*100) as int) end,
    l_extendedprice/100000, 0) as int) as oom_signal,
  cast(l_linenumber as double) as cpu_usage_sample, cast(cast(l_quantity as int) % 12 as double) as memory_usage_sample,
  rnd(l_extendedprice/100000, 6) as assigned_memory, cast(0 as double) as page_cache_memory,
  cast(0 as double) as cycles_per_instruction, cast(0 as double) as memory_accesses_per_instruction,
  cast(0 as double) as sample_rate, 0 as cluster
 from lineitem where l_returnflag in ('R','A'))"""

ETL = """etl as (
 select o_orderkey as seq, cast(o_orderkey as varchar) as order_id, cast(o_custkey as varchar) as customer_id,
  o_orderdate as order_date, round(o_totalprice-50000,2) as amount,
  case o_orderpriority when '1-URGENT' then 'usd' when '2-HIGH' then 'EUR' when '3-MEDIUM' then 'GBP'
   when '4-NOT SPECIFIED' then 'NGN' else null end as currency, o_orderstatus as status from orders),
curated as (
 select *, rnd(amount * case upper(coalesce(currency, 'USD')) when 'EUR' then cast(1.08 as double)
   when 'GBP' then cast(1.25 as double) when 'NGN' then cast(0.00067 as double) else cast(1 as double) end, 2) as amount_usd
 from etl)"""

APP = """app as (
 select event_id as seq, user_id, ts,
  case when event_id % 3 = 0 then case event_type when 'error' then 'Timeout while loading records'
    when 'signup' then 'Slow transform observed; retry window is close' when 'view' then 'Panic: abort requested'
    else 'Read partition with records' end
   else '[' || case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING' when 'view' then 'DEBUG' else 'INFO' end
    || '] ' || case event_type when 'error' then 'Load' when 'signup' then 'Transform' when 'view' then 'Archive'
    when 'click' then 'Extract' else 'Validate' end || ' - step finished' end as line from events),
app_level as (
 select *, case when regexp_matches(line, '\\[(FATAL|ERROR|WARN|WARNING|INFO|DEBUG)\\]', 'i')
   then replace(upper(regexp_extract(line, '\\[(FATAL|ERROR|WARNING|WARN|INFO|DEBUG)\\]', 1, 'i')), 'WARNING', 'WARN')
   when regexp_matches(lower(line), 'fatal|critical|panic|abort|terminate') then 'FATAL'
   when regexp_matches(lower(line), 'error|failed|failure|exception|timeout|corrupt') then 'ERROR'
   when regexp_matches(lower(line), 'warn|warning|retry|slow|fallback|threshold|queue full') then 'WARN'
   else 'INFO' end as level,
  case when contains(lower(line), 'extract') then 'Extract' when contains(lower(line), 'validate') then 'Validate'
   when contains(lower(line), 'transform') then 'Transform' when contains(lower(line), 'load') then 'Load'
   when contains(lower(line), 'report') then 'Report'
   when regexp_extract(line, '\\[(?:INFO|WARN|WARNING|ERROR|FATAL|DEBUG)\\]\\s+([A-Za-z_]+)', 1) <> ''
   then upper(substr(regexp_extract(line, '\\[(?:INFO|WARN|WARNING|ERROR|FATAL|DEBUG)\\]\\s+([A-Za-z_]+)', 1), 1, 1))
     || lower(substr(regexp_extract(line, '\\[(?:INFO|WARN|WARNING|ERROR|FATAL|DEBUG)\\]\\s+([A-Za-z_]+)', 1), 2))
   else 'External' end as stage from app)"""

SCORED = """scored as (select event_id as id, case when event_type='error' then 1 else 0 end as label,
  (value + 1) / cast(600 as double) as prob from events)"""
POINTS = """pts as (select prob as score, count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg
  from scored group by prob),
cum as (select *, cast(sum(pos) over (order by score desc) as double) as tp, cast(sum(neg) over (order by score desc) as double) as fp,
  cast(sum(pos) over () as double) as p_all, cast(sum(neg) over () as double) as n_all from pts)"""
CONFUSION = """cm as (select count(*) filter (where prob >= cast(0.1 as double) and label = 1) as tp,
  count(*) filter (where prob < cast(0.1 as double) and label = 0) as tn,
  count(*) filter (where prob >= cast(0.1 as double) and label = 0) as fp,
  count(*) filter (where prob < cast(0.1 as double) and label = 1) as fn from scored)"""
RATIO = "case when {b} > 0 then ({a}) / cast({b} as double) else cast(0 as double) end"


def ratio(a: str, b: str) -> str:
    return RATIO.format(a=a, b=f"({b})")


HOLDOUT = f"""grp as (select job_id as group_id, label from job_labels),
num as (select group_id, label, row_number() over (partition by label order by md5(group_id), group_id) as rn,
  count(*) over (partition by label) as in_label from grp)"""

EXPLAIN_SIGNAL = [
    ("fatal_count", "fatal events strongly increase risk"), ("error_count", "error events increase risk"),
    ("critical_kw_hits", "critical failure keywords increase risk"), ("retry_count", "retries indicate instability"),
    ("warn_count", "warnings indicate emerging pressure"), ("max_error_burst", "consecutive errors increase risk"),
    ("total_lines", "more lines increase confidence in the estimate")]
EXPLAIN_RULE = [
    ("fatal_count", "fatal log entries strongly increase risk"), ("error_count", "error log entries increase risk"),
    ("retry_count", "retries indicate instability"), ("warn_count", "warnings indicate early pressure"),
    ("max_error_burst", "consecutive errors increase risk"),
    ("failing_comp_hits", "known HDFS failure components increase risk"),
    ("total_lines", "more observations improve confidence")]


def explanation(source: str, entries, head: str | None = None) -> str:
    """Rows (position, feature, value, direction) ranked by position, five at most."""
    parts = [head] if head else []
    for i, (name, text) in enumerate(entries):
        parts.append(f"select process_id, seq, trigger, {i + 1} as pos, '{name}' as feature, "
                     f"rnd(cast({name} as double), 4) as value, '{text}' as direction from {source} "
                     f"where {name} <> 0")
    return ("select process_id, seq, trigger, cast(rank as int) as rank, feature, value, direction from ("
            "select *, row_number() over (partition by process_id, seq, trigger order by pos) as rank from ("
            + " union all ".join(parts) + ")) where rank <= 5")


POLICIES = "(values ('advise'), ('auto_stop'), ('review')) as pol(policy)"
ACTION = """case when risk_level = 'HIGH' then case policy when 'auto_stop' then 'AUTO_STOP'
  when 'review' then case when process_id like 'blk_-%' then 'CONTINUE_AFTER_REVIEW' else 'REVIEW_REQUIRED' end
  else 'ADVISE_STOP' end when risk_level = 'MEDIUM' then 'WATCH' else 'CONTINUE' end"""
PERCENT = "cast(cast(round_even(failure_probability * 100, 0) as int) as varchar) || '%'"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["log_parse"] = (f"with {LOG_RAW}, {PARSED} select seq, date, time, pid, level, component, content, "
                      "cast(len(block_ids) as int) as n_blocks from parsed")
    q["log_explode"] = (f"with {LOG_RAW}, {PARSED}, {LINES} select process_id, seq, pid, level, component, ts_s, "
                        "i_error as is_error, k_error as kw_error, k_warn as kw_warning, k_crit as kw_critical, "
                        "k_retry as is_retry, k_exc as is_exception, c_fail as comp_failing from lines")
    q["risk_every_n"] = (f"{WITH_EVERY} select process_id, seq, {FEATURES_44}, rnd(signal, 4) as signal_probability, "
                         f"case when signal >= {D(0.7)} then 'HIGH' when signal >= {D(0.4)} then 'MEDIUM' else 'LOW' end as risk_level from s5")
    q["log_features"] = f"{WITH_HISTORY} select process_id, {FEATURES_44} from feats"
    q["label_inner"] = (f"{WITH_HISTORY}, {LABELS} select f.process_id, l.label, f.total_lines, f.error_count "
                        "from feats f join fx_labels l on f.process_id = l.process_id")
    q["unlabelled_anti"] = (f"with {LOG_RAW}, {PARSED}, {LINES}, {LABELS} select distinct process_id from lines "
                            "where process_id not in (select process_id from fx_labels)")
    q["error_burst"] = f"{WITH_HISTORY} select process_id, max_error_burst from feats"
    q["log_timing"] = f"{WITH_HISTORY} select process_id, duration_s, hour_of_day, is_weekend from feats"
    q["dataset_counts"] = (f"with {LOG_RAW}, {PARSED}, {LINES}, {LABELS}, p as (select distinct process_id from lines) "
                           "select count(label) as labelled, count(*) filter (where label = 1) as failures, "
                           "count(*) filter (where label = 0) as successes, count(*) filter (where label is null) as skipped "
                           "from p left join fx_labels using (process_id)")
    sizes = ", ".join(f"greatest(1, least(total, cast(ceil(total * {D(f)}) as bigint)))" for f in (0.25, 0.5, 0.75, 1.0))
    q["early_warning"] = (f"{WITH_PREFIX}, picked as (select * from prefix where total_lines in ({sizes})), "
                          f"{finished('picked', 'feats')} select process_id || '@' || total_lines || '_of_' || total as process_id, "
                          f"process_id as group_id, {FEATURES_44} from feats")
    q["every_n_plus_final"] = (f"{WITH_PREFIX}, {FIRED} select process_id, seq, trigger, total_lines, error_count, "
                               "max_error_burst, unique_components from fired")
    q["inactivity_sessions"] = (
        "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour "
        "then 0 else 1 end as b from events), n as (select *, sum(b) over (partition by user_id order by ts) as s from g) "
        "select user_id as process_id, cast(s as bigint) as session_no, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_rows from n group by user_id, s")
    q["session_numbers"] = (
        f"with {LOG_RAW}, {PARSED}, {LINES}, g as (select process_id, seq, case when ts_s - max(ts_s) over (partition by process_id "
        "order by seq rows between unbounded preceding and 1 preceding) > 21600 then 1 else 0 end as b from lines) "
        "select process_id, seq, cast(1 + sum(b) over (partition by process_id order by seq) as bigint) as session_no from g")
    q["cut_first_high"] = (
        f"{WITH_EVERY}, cut as (select process_id, min(seq) as stop_seq from alerts where risk_level = 'HIGH' group by process_id) "
        "select l.process_id, max(c.stop_seq) as stop_seq, count(*) as kept_lines from lines l left join cut c on l.process_id = c.process_id "
        "where c.stop_seq is null or l.seq <= c.stop_seq group by l.process_id")
    q["auto_stop_alerts"] = (
        f"{WITH_PREFIX}, fired as (select *, 'every_n' as trigger from prefix), {finished('fired', 'feats')}, {SCORES}, "
        "cut as (select process_id, min(seq) as stop_seq from alerts where risk_level = 'HIGH' and total_lines % 20 = 0 group by process_id), "
        "kept as (select a.*, coalesce(c.stop_seq, max(a.seq) over (partition by a.process_id)) as last_seq from alerts a left join cut c "
        "on a.process_id = c.process_id), "
        "fin as (select * replace ('final' as trigger) from kept where seq = last_seq "
        "union all select * from kept where seq <= last_seq and total_lines % 20 = 0) "
        "select process_id, seq, trigger, total_lines as lines_seen, failure_probability, risk_level, "
        "case when risk_level = 'HIGH' then 'AUTO_STOP' when risk_level = 'MEDIUM' then 'WATCH' else 'CONTINUE' end as action from fin")
    q["cut_marker"] = (f"with {LOG_RAW}, marked as (select seq, case when seq in (500, 700) then '__PIPELINE_MONITOR_STOP__' else value end as value from log_raw) "
                       "select seq, value from marked where seq < (select min(seq) from marked where contains(value, '__PIPELINE_MONITOR_STOP__'))")
    q["first_lines"] = (f"with {LOG_RAW}, {PARSED} select level, count(*) as n from parsed where seq < 1000 group by level")
    q["job_events_parse"] = (f"with {JOB_EVENTS} select seq, time, job_id, event_type, {EVENT_NAME} as event_name, scheduling_class, "
                             "priority, cpu_request, memory_request, disk_request, \"user\" from job_events")
    q["job_labels"] = f"with {JOB_EVENTS}, {JOB_LABELS} select job_id, label, terminal_event from job_labels"
    q["job_features"] = f"with {JOB_EVENTS}, {job_runs()} select * from job_feats"
    q["reschedules"] = (f"with {JOB_EVENTS}, {job_runs()} select job_id, cast(sum(again) as bigint) as retry_count, "
                        "cast(max(run) as bigint) as max_error_burst, count(*) as n_events from job_runs group by job_id")
    q["job_early_warning"] = (
        f"with {JOB_EVENTS}, num as (select *, row_number() over (partition by job_id order by seq) as rn, "
        "count(*) over (partition by job_id) as total from job_events), "
        f"sz as (select distinct job_id, total, unnest([{sizes}]) as size from num), "
        "pre as (select n.* exclude (job_id, rn, total), n.job_id || '@' || s.size || '_of_' || s.total as job_id "
        "from num n join sz s on n.job_id = s.job_id and n.rn <= s.size), "
        f"{job_runs('pre')} select process_id, total_lines, error_count, retry_count, max_error_burst, duration_s, "
        "cpu_request, oom_signal from job_feats")
    late = ("arr as (select * replace ((seq + ((seq * 7919) % 50) * 40) * 1000003 + seq as seq) from job_events), "
            "num as (select *, row_number() over (partition by job_id order by seq) as rn, count(*) over (partition by job_id) as total from arr), "
            "sz as (select job_id as own_id, rn as size, seq as fired_at, unnest(case when rn % 5 = 0 and rn = total then ['every_n', 'final'] "
            "when rn % 5 = 0 then ['every_n'] else ['final'] end) as trigger from num where rn % 5 = 0 or rn = total), "
            "pre as (select n.* exclude (job_id, rn, total), n.job_id || '@' || s.size as job_id from num n join (select distinct own_id, size from sz) s "
            f"on n.job_id = s.own_id and n.rn <= s.size), {job_runs('pre')}, "
            "feats as (select f.* exclude (process_id), own_id as process_id, fired_at as seq, trigger, '' as component from job_feats f join sz on f.process_id = own_id || '@' || size)")
    scores = SCORES.replace(f"total_lines / {D(40)}", f"total_lines / {D(10)}")
    q["job_risk_every_n"] = (
        f"with {JOB_EVENTS}, {late}, {scores} select process_id, seq, trigger, total_lines, error_count, retry_count, max_error_burst, "
        "unique_components, duration_s, cpu_request, priority, rnd(signal, 4) as signal_failure_probability, failure_probability, risk_level from alerts")
    q["stream_job_every_n"] = q["job_risk_every_n"]
    q["gpu_job_features"] = f"with {GPU}, {GPU_FEATS} select * from gpu_feats"
    q["gpu_early_warning"] = (
        f"with {GPU}, {GPU_FEATS}, num as (select *, row_number() over (partition by job_name order by task_name, cpu_request) as rn, "
        "count(*) over (partition by job_name) as total from gpu_rows), "
        f"sz as (select distinct job_name, total, unnest([{sizes}]) as size from num), "
        "pre as (select s.job_name || '@' || s.size || '_of_' || s.total as process_id, n.* exclude (total) from num n join sz s "
        "on n.job_name = s.job_name and n.rn <= s.size) "
        "select process_id, any_value(job_name) as group_id, any_value(label) as label, count(*) as total_lines, "
        "rnd(sum(instance_count), 4) as instance_count, rnd(greatest(0, max(time) - any_value(job_start_time)), 2) as duration_s, "
        "rnd(max(cpu_request), 4) as cpu_request, rnd(greatest(0, min(time) - any_value(job_start_time)), 4) as scheduling_delay_s "
        "from pre group by process_id")
    q["gpu_tasks_semi"] = (f"with {GPU} select job_name, task_name, time, instance_count, cpu_request, memory_request, gpu_request "
                           "from tasks where job_name in (select job_name from jobs)")
    q["jobs_with_tasks"] = (f"with {GPU}, {GPU_FEATS} select job_name, status, label, task_name, time, instance_count, cpu_request, "
                            "memory_request, gpu_request from gpu_rows")
    q["bounded_jobs"] = (f"with {GPU} select job_name, status, label from jobs order by cast(job_name as bigint) limit 500")
    q["borg_features"] = f"with {BORG} select * from borg_feats"
    q["headerless_events"] = (
        f"with {JOB_EVENTS} select seq, time, job_id, event_type, {EVENT_NAME} as event_name, scheduling_class, "
        "case when seq % 3 = 2 then 0 else priority end as priority, "
        f"case when seq % 3 = 2 then {D(0)} else cast(priority as double) / 16 end as cpu_request, "
        f"case when seq % 3 = 2 then {D(0)} else cast(scheduling_class as double) / 4 end as memory_request, "
        f"case when seq % 3 = 2 then {D(0)} else {D(0.5)} end as disk_request, "
        "case when seq % 3 = 1 then '' else \"user\" end as \"user\" from job_events")
    log_part = f"select process_id, process_id as group_id, 'hdfs' as source, label, {', '.join(FEATURES_34)} from feats join fx_labels using (process_id)"
    job_part = ("select process_id, process_id as group_id, 'google' as source, label, job_feats.* exclude (process_id) "
                "from job_feats join job_labels on process_id = job_id")
    gpu_part = "select process_id, process_id as group_id, 'alibaba' as source, label, gpu_feats.* exclude (process_id, label) from gpu_feats"
    borg_part = "select process_id, group_id, 'google2019' as source, label, borg_feats.* exclude (process_id, group_id, label) from borg_feats"
    from logrisk.config import COUNT_FEATURES, VALUE_FEATURES
    aligned = ", ".join([f"cast(coalesce({c}, 0) as bigint) as {c}" for c in COUNT_FEATURES]
                        + [f"cast(coalesce({c}, 0) as double) as {c}" for c in VALUE_FEATURES])
    missing = ("select cast(0 as double) as failed_instance_count, cast(0 as double) as cpu_usage_avg, cast(0 as double) as cpu_usage_max, "
               "cast(0 as double) as memory_usage_avg, cast(0 as double) as memory_usage_max, null as process_id, null as group_id, null as source, null as label where false")
    q["features_union"] = (
        f"{WITH_HISTORY}, {LABELS}, {JOB_EVENTS}, {JOB_LABELS}, {job_runs()}, {GPU}, {GPU_FEATS}, {BORG}, "
        f"u as ({log_part} union all by name {job_part} union all by name {gpu_part} union all by name {borg_part} union all by name {missing}), "
        f"a as (select process_id, group_id, source, label, {aligned} from u) select *, {LOG1P} from a")
    q["source_kind"] = "select 'both' as trained_source"
    q["stream_calibration"] = (f"{WITH_ALERTS} select process_id, seq, trigger, total_lines as lines_seen, rnd(raw, 4) as raw_model_failure_probability, "
                               "rnd(signal, 4) as signal_failure_probability, failure_probability, prediction, risk_level from alerts")
    head = ("select process_id, seq, trigger, 0 as pos, 'raw_model_probability' as feature, rnd(raw, 4) as value, "
            "'raw model output before stream calibration' as direction from alerts")
    q["signal_explanation"] = f"{WITH_ALERTS} " + explanation("alerts", EXPLAIN_SIGNAL, head)
    q["rule_score"] = (f"{WITH_ALERTS} select process_id, seq, trigger, rnd(raw, 4) as failure_probability, cast(raw >= {D(0.5)} as int) as prediction, "
                       f"case when raw >= {D(0.7)} then 'HIGH' when raw >= {D(0.4)} then 'MEDIUM' else 'LOW' end as risk_level from alerts")
    q["rule_explanation"] = f"{WITH_ALERTS} " + explanation("alerts", EXPLAIN_RULE)
    risk_names = ("'error_count','error_rate','error_kw_hits','error_kw_rate','fatal_count','critical_rate','retry_count','exception_count',"
                  "'max_error_burst','err_x_retry','failing_comp_hits','has_exception','has_fatal','has_retry','memory_request','oom_signal',"
                  "'timeout_signal','log1p_error_count','log1p_fatal_count','log1p_retry_count','log1p_exception_count','log1p_err_x_retry','log1p_max_error_burst'")
    q["feature_directions"] = (
        f"{WITH_HISTORY}, v as (unpivot (select process_id, cast(error_count as double) as error_count, cast(info_count as double) as info_count, "
        "error_rate, duration_s, cast(has_fatal as double) as has_fatal from feats) on error_count, info_count, error_rate, duration_s, has_fatal into name feature value value) "
        f"select process_id, feature, value, case when value > 0 then case when feature in ({risk_names}) then '↑ increases failure risk' "
        "else '↓ reduces failure risk' end else 'neutral' end as direction from v")
    q["alert_actions"] = f"{WITH_ALERTS} select process_id, seq, trigger, policy, {ACTION} as action from alerts, {POLICIES}"
    reason = f"'HIGH risk for ' || process_id || ' (' || {PERCENT} || ')'"
    q["recommendation"] = (
        f"{WITH_ALERTS} select process_id, seq, trigger, policy, case when risk_level = 'MEDIUM' then 'MEDIUM risk detected. Continue with close monitoring.' "
        "when risk_level <> 'HIGH' then 'LOW risk detected. The pipeline can continue.' when policy = 'review' and process_id like 'blk_-%' "
        f"then 'HIGH risk remains for ' || process_id || ' (' || {PERCENT} || '), but the operator already reviewed this process and chose to continue.' "
        f"else {reason} || '. Stop and inspect the process.' end as recommendation from alerts, {POLICIES}")
    state = ("st as (select session_id, arg_max(risk_level, (is_final, seq, process_id)) as current_risk, "
             "arg_max(failure_probability, (is_final, seq, process_id)) as latest_probability, max(failure_probability) as peak_probability, "
             "count(*) as total_predictions, cast(max(cast(risk_level = 'HIGH' as int)) as int) as had_high from alerts group by session_id)")
    last_text = ("case when risk_level = 'MEDIUM' then 'MEDIUM risk detected. Continue with close monitoring.' "
                 "when risk_level <> 'HIGH' then 'LOW risk detected. The pipeline can continue.' "
                 f"else {reason} || '. Stop and inspect the process.' end")
    # Sessions without alerts: every third one.
    q["session_state"] = (
        f"{WITH_ALERTS}, heard as (select * from alerts where cast(substr(session_id, 2) as int) % 3 <> 0), "
        f"s as (select session_id, arg_max({last_text}, (is_final, seq, process_id)) as recommendation, "
        "arg_max(risk_level, (is_final, seq, process_id)) as current_risk, arg_max(failure_probability, (is_final, seq, process_id)) as latest_probability, "
        "max(failure_probability) as peak_probability, count(*) as total_predictions, max(cast(risk_level = 'HIGH' as int)) as had_high from heard group by session_id) "
        "select a.session_id, coalesce(current_risk, 'LOW') as current_risk, coalesce(latest_probability, 0.0) as latest_probability, "
        "coalesce(peak_probability, 0.0) as peak_probability, coalesce(total_predictions, 0) as total_predictions, cast(coalesce(had_high, 0) as int) as had_high, "
        "coalesce(recommendation, 'Pipeline can continue. No high-risk process was detected.') as recommendation "
        "from (select distinct session_id from alerts) a left join s using (session_id)")
    q["final_status"] = (
        f"{WITH_ALERTS}, {state} select session_id, return_code, case when return_code = 0 and had_high = 1 then 'completed_with_high_risk' "
        "when return_code = 0 then 'completed' when had_high = 1 then 'failed_with_high_risk' else 'failed' end as status, "
        "1 as is_terminal from st, (values (0), (2), (null)) as rc(return_code)")
    q["intervention"] = (
        f"{WITH_ALERTS}, c as (select session_id, count(*) filter (where risk_level = 'HIGH') as high_risk_count from alerts group by session_id) "
        "select session_id, policy, high_risk_count, case when high_risk_count > 0 and policy = 'auto_stop' then 'pipeline_stopped' "
        f"when high_risk_count > 0 then 'operator_review_advised' else 'continue' end as decision from c, {POLICIES}")
    q["confusion"] = f"with {SCORED}, {CONFUSION} select * from cm"
    q["failure_prior"] = (f"with {SCORED}, {CONFUSION} select greatest({D(0.05)}, least({D(0.35)}, (tp + fn) / cast(tp + fn + tn + fp as double))) as prior from cm")
    mcc_root = "sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))"
    q["class_metrics"] = (
        f"with {SCORED}, {CONFUSION}, d as (select tp::double as tp, tn::double as tn, fp::double as fp, fn::double as fn from cm) "
        f"select cast(tp as bigint) as tp, cast(tn as bigint) as tn, cast(fp as bigint) as fp, cast(fn as bigint) as fn, "
        f"rnd({ratio('tp+tn', 'tp+tn+fp+fn')}, 4) as accuracy, rnd({ratio('tp', 'tp+fp')}, 4) as precision, "
        f"rnd({ratio('tp', 'tp+fn')}, 4) as recall, rnd({ratio('2*tp', '2*tp+fp+fn')}, 4) as f1, "
        f"rnd({ratio('tp*tn-fp*fn', mcc_root)}, 4) as mcc, rnd({ratio('tn', 'tn+fp')}, 4) as specificity from d")
    q["class_report"] = (
        f"with {SCORED}, {CONFUSION}, r as (select 1 as position, 'Success' as class, {ratio('tn', 'tn+fn')} as p, {ratio('tn', 'tn+fp')} as r, "
        f"{ratio('2*tn', '2*tn+fp+fn')} as f, tn+fp as s from cm union all select 2, 'Failure', {ratio('tp', 'tp+fp')}, {ratio('tp', 'tp+fn')}, "
        f"{ratio('2*tp', '2*tp+fp+fn')}, tp+fn from cm), x as (select * from r union all select 3, 'macro avg', avg(p), avg(r), avg(f), cast(sum(s) as bigint) from r "
        "union all select 4, 'weighted avg', sum(p*s)/sum(s), sum(r*s)/sum(s), sum(f*s)/sum(s), cast(sum(s) as bigint) from r) "
        "select position, class, rnd(p, 4) as precision, rnd(r, 4) as recall, rnd(f, 4) as f1, s as support from x")
    q["log_loss"] = (f"with {SCORED} select rnd(-avg(case when label = 1 then ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, prob))) "
                     "else ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, prob))) end), 4) as log_loss from scored")
    q["roc_auc"] = (f"with {SCORED}, {POINTS} select rnd({ratio('sum(pos * (n_all - fp + neg / 2.0))', 'max(p_all) * max(n_all)')}, 4) as roc_auc from cum")
    q["avg_precision"] = f"with {SCORED}, {POINTS} select rnd(sum(pos * tp / (tp + fp)) / max(p_all), 4) as pr_auc from cum"
    q["roc_points"] = f"with {SCORED}, {POINTS} select score as threshold, fp / n_all as fpr, tp / p_all as tpr from cum"
    q["pr_points"] = (f"with {SCORED}, {POINTS} select score as threshold, tp / (tp + fp) as precision, tp / p_all as recall, "
                      "p_all / (p_all + n_all) as base_rate from cum")
    q["score_hist"] = f"with {SCORED} select label, cast(greatest(0, least(39, floor(prob * 40))) as int) as bin, count(*) as n from scored group by 1, 2"
    q["group_labels"] = f"with {BORG} select group_id, max(label) as label from borg_feats group by group_id"
    q["group_split_allowed"] = (f"with {BORG}, g as (select group_id, max(label) as label from borg_feats group by group_id), "
                                "s as (select label, count(*) as n from g group by label) select cast(sum(n) as bigint) as n_groups, count(*) as n_classes, "
                                "min(n) as smallest, sum(n) >= 4 and count(*) = 2 and min(n) >= 2 as allowed from s")
    q["group_holdout"] = (f"with {JOB_EVENTS}, {JOB_LABELS}, {HOLDOUT} select group_id, label, "
                          f"cast(rn <= ceil(in_label * {D(0.25)}) as int) as is_test from num")
    q["train_rows"] = (f"with {JOB_EVENTS}, {JOB_LABELS}, {HOLDOUT} select e.job_id, count(*) as n_events from job_events e "
                       f"join num on e.job_id = num.group_id where rn > ceil(in_label * {D(0.25)}) group by e.job_id")
    q["group_folds"] = (f"with {JOB_EVENTS}, {JOB_LABELS}, {HOLDOUT} select group_id, label, "
                        "cast((rn - 1) % least(5, (select min(c) from (select count(*) as c from num group by label))) as int) as fold from num")
    q["class_weights"] = (f"with {BORG}, c as (select count(*) filter (where label = 1) as n_pos, count(*) filter (where label = 0) as n_neg from borg_feats) "
                          "select n_pos, n_neg, rnd(n_neg / n_pos, 2) as pos_ratio, (n_pos + n_neg) / (2 * n_pos) as weight_pos, "
                          "(n_pos + n_neg) / (2 * n_neg) as weight_neg from c")
    q["detect_level"] = f"with {APP} select level, count(*) as n from app_level group by level"
    q["detect_stage"] = f"with {APP} select stage, count(*) as n from app_level group by stage"
    q["normalise_lines"] = (
        f"with {APP} select seq, level, stage, 'external.' || stage as component, 'blk_-99' || lpad(cast(user_id as varchar), 8, '0') as process_id, "
        "strftime(ts, '%y%m%d %H%M%S') || ' ' || cast(user_id as varchar) || ' ' || level || ' external.' || stage || ': ' || stage || ' stage event for ' "
        "|| 'blk_-99' || lpad(cast(user_id as varchar), 8, '0') || ': ' || line as normalized_line from app_level")
    q["normalise_ready"] = (
        f"with {LOG_RAW}, {PARSED} select seq, level, case when contains(lower(content), 'extract') then 'Extract' when contains(lower(content), 'validate') then 'Validate' "
        "when contains(lower(content), 'transform') then 'Transform' when contains(lower(content), 'load') then 'Load' when contains(lower(content), 'report') then 'Report' "
        "else 'External' end as stage, component, regexp_extract(content, 'blk_-?\\d+') as process_id, value as normalized_line from parsed join log_raw using (seq)")
    q["component_stage"] = (
        f"with {LOG_RAW}, {PARSED} select case when contains(component, 'Extractor') or contains(component, 'DataXceiver') then 'Extract' "
        "when contains(component, 'SchemaValidator') then 'Validate' when contains(component, 'Transformer') then 'Transform' "
        "when contains(component, 'Loader') then 'Load' else 'Monitor' end as stage, component, count(*) as n from parsed group by 1, 2")
    q["alert_text"] = (f"{WITH_ALERTS} select process_id, seq, trigger, '[' || risk_level || ']  ' || case when prediction = 1 then '[WARN] FAILURE PREDICTED' "
                       f"else '[OK] OK' end || '  | process: ' || process_id || '  | prob: ' || {PERCENT} || '  | lines seen: ' || total_lines as alert from alerts")
    q["text_alerts"] = (
        f"with {APP}, log_raw as (select seq, strftime(ts, '%y%m%d %H%M%S') || ' ' || cast(user_id as varchar) || ' ' || level || ' external.' || stage || ': ' "
        "|| stage || ' stage event for ' || 'blk_-99' || lpad(cast(user_id as varchar), 8, '0') || ': ' || line as value from app_level), "
        f"{PARSED}, {LINES}, {ISLANDS}, {PREFIX}, {FIRED}, {finished('fired', 'feats')}, {SCORES} "
        "select process_id, seq, trigger, total_lines as lines_seen, failure_probability, risk_level, "
        "case when trigger = 'final' then 'Monitor' else replace(component, 'external.', '') end as stage, "
        "case when trigger = 'final' then 'pipeline.Monitor' else component end as component from alerts")
    q["etl_validate"] = f"with {ETL} select order_id, amount, currency from etl where amount <= 0"
    q["etl_missing"] = f"with {ETL} " + " union all ".join(
        f"select '{c}' as column_name, {int(c != 'status')} as present, "
        + ("count(*)" if c == "status" else f"count(*) filter (where coalesce(trim(cast({c} as varchar)), '') = '')")
        + " as n_empty from etl" for c in ("order_id", "customer_id", "order_date", "amount", "currency", "status"))
    q["etl_curate"] = (f"with {ETL} select order_id, customer_id, order_date, status, amount_usd, "
                       "case when amount_usd <= 0 then 'review' else 'clean' end as risk_partition from curated")
    q["etl_expand"] = (
        f"with {ETL}, n as (select *, row_number() over (order by seq) - 1 as r, count(*) over () as c from etl) "
        "select order_id || '-' || lpad(cast(i + 1 as varchar), 6, '0') as order_id, cast(i as bigint) as row_index, customer_id, amount from n "
        "join (select unnest(range(0, (select cast(2 * count(*) + count(*) // 2 as bigint) from etl))) as i) g on g.i % n.c = n.r")
    q["etl_batches"] = (f"with {ETL}, n as (select *, row_number() over (order by seq) as rn, count(*) over () as c from etl) "
                        "select cast(floor((rn - 1) / round_even(c / 12.0, 0)) as int) as batch, count(*) as n_rows, min(seq) as first_seq, max(seq) as last_seq from n group by 1")
    q["etl_summary"] = (f"with {ETL} select count(*) as rows_extracted, count(*) as rows_loaded, count(*) filter (where amount <= 0) as non_positive_rows, "
                        "count(*) filter (where amount_usd <= 0) as review_rows, count(*) filter (where amount_usd > 0) as clean_rows from curated")
    q["risk_counts"] = (f'{WITH_ALERTS} select session_id, count(*) filter (where risk_level = \'LOW\') as "LOW", count(*) filter (where risk_level = \'MEDIUM\') as "MEDIUM", '
                        'count(*) filter (where risk_level = \'HIGH\') as "HIGH" from alerts group by session_id')
    q["session_summary"] = (
        f"{WITH_ALERTS} select session_id, count(*) as total_predictions, count(*) filter (where prediction = 1) as predicted_failures, "
        "count(*) filter (where risk_level = 'HIGH') as high_risk, count(*) filter (where risk_level = 'MEDIUM') as medium_risk, "
        "count(*) filter (where risk_level = 'LOW') as low_risk, rnd(count(*) filter (where prediction = 1) * cast(100 as double) / count(*), 1) as failure_percent from alerts group by session_id")
    brief = "session_id, process_id, seq, trigger, failure_probability, total_lines as lines_seen, stage"
    q["high_risk_top10"] = f"{WITH_ALERTS} select {brief} from alerts where risk_level = 'HIGH' order by failure_probability desc, is_final, seq, process_id limit 10"
    q["high_risk_per_session"] = (
        f"{WITH_ALERTS} select {brief}, place from (select *, cast(row_number() over (partition by session_id order by failure_probability desc, is_final, seq, process_id) as int) as place "
        "from alerts where risk_level = 'HIGH') where place <= 10")
    q["first_high"] = f"{WITH_ALERTS} select {brief} from alerts where risk_level = 'HIGH' order by is_final, seq, process_id limit 10"
    q["latest_high"] = (
        f"{WITH_ALERTS} select {brief}, risk_level from (select *, row_number() over (partition by session_id order by cast(risk_level = 'HIGH' as int) desc, is_final desc, seq desc, process_id desc) as place "
        "from alerts) where place = 1")
    q["recent_alerts"] = f"{WITH_ALERTS} select {brief}, risk_level from alerts order by is_final desc, seq desc, process_id desc limit 50"
    q["risk_timeline"] = (f"{WITH_ALERTS} select session_id, process_id, seq, trigger, row_number() over (partition by session_id order by is_final, seq, process_id) as prediction_no, "
                          "cast(round_even(failure_probability * 100, 0) as int) as percent from alerts")
    q["high_seen_before"] = (
        f"{WITH_ALERTS} select session_id, process_id, seq, trigger, coalesce(max(cast(risk_level = 'HIGH' as int)) over (partition by session_id order by is_final, seq, process_id "
        "rows between unbounded preceding and 1 preceding), 0) as high_before from alerts")
    q["level_hist"] = f"with {APP} select user_id as session_id, level, count(*) as n from app_level group by 1, 2"
    q["stage_counts"] = f"with {APP} select user_id as session_id, stage, count(*) as n_lines from app_level group by 1, 2"
    q["stage_state"] = (
        f"with {APP}, s as (select user_id as session_id, stage, count(*) as n_lines, max(seq) as last_seq, max(seq) filter (where level = 'FATAL') as high_seq from app_level group by 1, 2) "
        "select session_id, stage, n_lines, last_seq, case when high_seq >= last_seq then 'risk' when last_seq = max(last_seq) over (partition by session_id) then 'running' else 'done' end as state from s")
    q["stage_changes"] = (
        f"with {APP}, s as (select user_id as session_id, seq, lag(stage) over (partition by user_id order by seq) as from_stage, stage as to_stage from app_level) "
        "select * from s where from_stage is null or from_stage <> to_stage")
    q["resource_summary"] = (
        "select user_id as session_id, count(*) as samples, max(value/4) as max_cpu_percent, rnd(avg(value/4), 2) as avg_cpu_percent, "
        "max(value*2) as max_memory_rss_mb, max(100-value/10) as max_disk_used_percent from events group by user_id")
    q["line_resources"] = (f"with {APP} select a.user_id as session_id, a.seq, a.level, a.stage, e.value/4 as cpu_percent, e.value*2 as memory_rss_mb "
                           "from app_level a join events e on a.seq = e.event_id and a.user_id = e.user_id")
    q["session_report"] = (
        f"{WITH_ALERTS}, {state}, l as (select 's' || cast(cast(regexp_extract(process_id, '(\\d+)', 1) as bigint) % 13 as varchar) as session_id, count(*) as lines_processed from lines group by 1), "
        f"h as (select session_id, count(*) filter (where risk_level = 'HIGH') as n, arg_max({last_text}, (is_final, seq, process_id)) as recommendation from alerts group by session_id) "
        "select session_id, 'completed' as status, 'advise' as stop_policy, recommendation, lines_processed, total_predictions, current_risk, latest_probability, peak_probability, "
        "h.n as high_count, cast(least(h.n, 10) as int) as high_listed from st join l using (session_id) join h using (session_id)")
    q["zip_csv_scan"] = (
        "select cast(o_orderkey as varchar) as job_name, 'u' || cast(o_custkey as varchar) as \"user\", case o_orderstatus when 'F' then 'Failed' when 'O' then 'Terminated' else 'Running' end as status, "
        "cast(epoch(o_orderdate) as double) as start_time from orders")
    q["stream_every_n"] = q["stream_calibration"].replace("from alerts", "from alerts where trigger = 'every_n'")
    q["stream_final"] = q["stream_calibration"].replace("from alerts", "from alerts where trigger = 'final'")
    held = f"with {JOB_EVENTS}, {JOB_LABELS}, {HOLDOUT}, te as (select * from num where rn <= ceil(in_label * {D(0.25)}))"
    q["model_heldout"] = f"{held} select group_id as process_id, label, true as consistent from te"
    q["model_baseline"] = (
        f"{held}, maj as (select cast(avg(label) > 0.5 as int) as m from num where rn > ceil(in_label * {D(0.25)})), "
        "c as (select count(*) filter (where label = 1 and m = 1) as tp, count(*) filter (where label = 0 and m = 0) as tn, "
        "count(*) filter (where label = 0 and m = 1) as fp, count(*) filter (where label = 1 and m = 0) as fn from te, maj) "
        "select 'Majority Baseline' as model, rnd((tp + tn) / cast(tp + tn + fp + fn as double), 4) as accuracy, tp, tn, fp, fn from c")
    q["review_release"] = (
        f"{WITH_ALERTS}, m as (select process_id, min(seq) as at from alerts where trigger = 'every_n' and total_lines = 20 "
        "and cast(regexp_extract(process_id, '(\\d+)', 1) as bigint) % 3 = 0 group by process_id) "
        "select a.process_id, a.seq, a.trigger, risk_level, case when risk_level = 'MEDIUM' then 'WATCH' when risk_level <> 'HIGH' then 'CONTINUE' "
        "when a.seq > m.at then 'CONTINUE_AFTER_REVIEW' else 'REVIEW_REQUIRED' end as action from alerts a left join m on a.process_id = m.process_id")
    # Files written and read back.
    q["log_text_scan"] = f"with {LOG_RAW} select row_number() over (order by seq) - 1 as seq, value from log_raw"
    q["labels_csv_scan"] = f"with {LABELS} select process_id, label from fx_labels"
    q["job_events_csv_scan"] = (f"with {JOB_EVENTS} select row_number() over (order by seq) - 1 as seq, job_id, event_type, cpu_request, \"user\" from job_events")
    q["orders_csv_scan"] = f"with {ETL} select row_number() over (order by seq) - 1 as seq, order_id, customer_id, amount from etl"
    q["registry_union"] = (f"select process_id, source, label, total_lines, error_count from ({q['features_union']}) where source in ('hdfs', 'google')")
    q["curated_files"] = (f"with {ETL} select order_id, customer_id, status, amount_usd, "
                          "case when amount_usd <= 0 then 'review' else 'clean' end as risk_partition from curated")
    q["alert_files"] = f"{WITH_ALERTS} select process_id, seq, trigger, risk_level, failure_probability from alerts"
    q["appended_lines"] = f"with {LOG_RAW} select value, 3 * count(*) as times from log_raw group by value"
    q["stream_tail"] = f"with {LOG_RAW} select value, count(*) as times from log_raw group by value"
    q["session_files"] = (
        f"{WITH_ALERTS}, l as (select 's' || cast(cast(regexp_extract(value, 'blk_-?(\\d+)', 1) as bigint) % 13 as varchar) as session_id, count(*) as lines from log_raw group by 1), "
        "n as (select session_id, count(*) as alerts from alerts group by session_id) select coalesce(n.session_id, l.session_id) as session_id, alerts, lines from n full join l on n.session_id = l.session_id")
    q["ranking_files"] = (
        f"with {LABELS}, s as (select avg(label) as f1, count(*) as samples from fx_labels) "
        "select 'always' as model, f1, 0 as place, samples from s union all select 'never', 0.0, 1, samples from s")
    return {name: with_rounding(sql) for name, sql in q.items()}
