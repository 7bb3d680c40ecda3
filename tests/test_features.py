"""Hand-counted histories, invariants and edge cases."""

import pytest
from pyspark.sql import functions as F

from logrisk.functions import risk
from logrisk.operators import logfeatures as lf
from logrisk.operators import snapshots, traces
from logrisk.operators.schema import ALL_FEATURES, align
from logrisk.plans.monitor import monitor_batch, monitor_until_high

FATAL = [
    ("INFO", "etl.Reader", "opened shard {b}"),
    ("WARN", "dfs.DataNode$DataXceiver", "slow disk under {b}"),
    ("INFO", "etl.Reader", "closed shard {b}"),
    ("WARN", "etl.Writer", "timeout on {b}"),
    ("ERROR", "etl.Reader", "checksum error in {b}"),
    ("ERROR", "dfs.FSNamesystem", "retry of {b} refused, exception kept"),
    ("ERROR", "etl.Writer", "failed to flush {b}"),
    ("ERROR", "etl.Writer", "failed to flush {b} again"),
    ("FATAL", "dfs.FSNamesystem", "cannot place {b}, abort"),
    ("FATAL", "dfs.NameNode", "corruption of {b}"),
]
STABLE = [("INFO", "etl.Loader", "page of {b} kept")] * 10


def log(template, block="blk_1", start=0):
    return [f"260101 0000{start + i:02d} 100 {level} {component}: {text.format(b=block)}"
            for i, (level, component, text) in enumerate(template)]


def test_fatal_history(lines):
    row = lf.log_features(lines(log(FATAL))).first()
    assert (row["total_lines"], row["info_count"], row["warn_count"], row["error_count"], row["fatal_count"]) == (10, 2, 2, 4, 2)
    # Lines 5 to 10 are errors or fatal.
    assert row["max_error_burst"] == 6
    assert (row["error_rate"], row["warn_rate"], row["critical_rate"]) == (0.4, 0.2, 0.2)
    assert (row["duration_s"], row["hour_of_day"], row["is_weekend"]) == (9.0, 0, 0)
    assert (row["unique_components"], row["failing_comp_hits"], row["unique_pids"]) == (5, 4, 1)


def test_stable_history(lines):
    out = lf.log_features(lines(log(STABLE))).withColumn("p", risk.signal_probability()).first()
    assert out["info_count"] == 10 and out["error_count"] == out["error_kw_hits"] == 0
    assert out["p"] <= 0.10


def test_edges(lines):
    empty = lf.log_features(lines([]))
    assert empty.count() == 0 and len(empty.columns) == 45
    one = lf.log_features(lines(["081332 256199 1 WARNING c: odd blk_3 date blk_3"])).first()
    assert (one["total_lines"], one["warn_count"], one["duration_s"], one["hour_of_day"]) == (1, 1, 0.0, 0)
    assert lf.log_features(lines(["260101 000000 1 INFO c: no process"])).count() == 0


def test_full_prefix_is_history(lines):
    raw = lines(log(FATAL) + log(STABLE, "blk_2", 20))
    prefixes = lf.prefix_features(lf.line_signals(raw), total="total")
    last = prefixes.where("total_lines = total").drop("total", "seq")
    whole = lf.history_features(lf.line_signals(raw))
    names = whole.columns
    assert sorted(map(repr, last.select(*names).collect())) == sorted(map(repr, whole.collect()))


def test_snapshot_sizes(lines):
    raw = lines(log(STABLE[:2]))
    prefixes = lf.prefix_features(lf.line_signals(raw), total="total")
    names = {r["process_id"] for r in snapshots.early_warning(prefixes).collect()}
    assert names == {"blk_1@1_of_2", "blk_1@2_of_2"}
    with pytest.raises(ValueError):
        snapshots.check_fractions([0.0, 0.5])


def test_triggers(lines):
    raw = lines(log(STABLE * 4))
    alerts = monitor_batch(raw, every=20).select("trigger", "lines_seen").collect()
    assert sorted(map(tuple, alerts)) == [("every_n", 20), ("every_n", 40), ("final", 40)]


def test_stop_marker(lines):
    raw = lines(["a", "b __PIPELINE_MONITOR_STOP__", "c"])
    assert [r["seq"] for r in snapshots.cut_at_marker(raw).collect()] == [0]
    assert snapshots.cut_at_marker(lines(["a", "c"])).count() == 2


def test_auto_stop(lines):
    raw = lines(log(FATAL) + log(STABLE, start=20)).withColumn("session_id", F.lit("run"))
    alerts = monitor_until_high(raw, every=5).orderBy("seq", "trigger").collect()
    assert [(r["lines_seen"], r["trigger"], r["action"]) for r in alerts][-2:] == [
        (10, "every_n", "AUTO_STOP"), (10, "final", "AUTO_STOP")]
    assert max(r["lines_seen"] for r in alerts) == 10


def test_probability_bounds(lines):
    for mode in ("stream", "rules"):
        rows = monitor_batch(lines(log(FATAL) + log(STABLE, "blk_2", 20)), every=1, mode=mode).collect()
        assert all(0.02 <= r["failure_probability"] <= 0.98 for r in rows)
        assert all(1 <= len(r["explanation"]) <= 5 for r in rows)
        assert all([e["rank"] for e in r["explanation"]] == list(range(1, len(r["explanation"]) + 1)) for r in rows)


def events(spark, rows):
    names = "seq long, time string, job_id string, event_type string, cpu_request string"
    return traces.clean_events(spark.createDataFrame(rows, names))


def test_jobs(spark):
    e = events(spark, [
        (0, "1", "a", "4", "0.5"), (1, "2", "a", "3", "0.9"),
        (2, "1", "b", "0", ""), (3, "2", "b", "2", "x"), (4, "2", "b", "1", "0.1"), (5, "3000000000", "b", "4.0", "0.2"),
        (6, "1", "c", "0", "1"), (7, "1", "", "0", "1"), (8, "1", "d", "bad", "1"),
    ])
    labels = {r["job_id"]: (r["label"], r["terminal_event"]) for r in traces.job_labels(e).collect()}
    # A failure wins over a finish; jobs without an end have no label.
    assert labels == {"a": (1, 3), "b": (1, 2)}
    rows = {r["process_id"]: r for r in traces.job_features(e).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["b"]["retry_count"] == 1 and rows["b"]["cpu_request"] == 0.2
    # A span above 1e9 is in microseconds.
    assert rows["b"]["duration_s"] == 3000.0


def test_header_aliases(spark):
    raw = spark.createDataFrame([(0, "7", " j ", "1", "0.3")], "seq long, ` TIMESTAMP ` string, JobId string, type string, CPU string")
    row = traces.clean_events(raw).first()
    assert (row["time"], row["job_id"], row["event_type"], row["event_name"], row["cpu_request"]) == (7.0, "j", 1, "SCHEDULE", 0.3)


def test_gpu_jobs(spark):
    jobs = spark.createDataFrame([
        (0, "a", "Failed", "100"), (1, "b", "Running", "1"), (2, "a", "Terminated", "50"), (3, "c", "terminated", "10"),
        (4, "d", "failed", "10"),
    ], "seq long, job_name string, status string, start_time string")
    kept = traces.gpu_jobs(jobs)
    assert {r["job_name"]: r["label"] for r in kept.collect()} == {"a": 0, "c": 0, "d": 1}
    assert {r["job_name"] for r in traces.gpu_jobs(jobs, limit=2).collect()} == {"a", "c"}
    tasks = traces.gpu_tasks(spark.createDataFrame(
        [("a", "t1", "2", "400", "8", "50", "70"), ("a", "t2", "1", "100", "4", "200", "60")],
        "job_name string, task_name string, inst_num string, plan_cpu string, plan_mem string, plan_gpu string, start_time string"))
    rows = {r["process_id"]: r for r in traces.gpu_features(kept, tasks).collect()}
    a, c = rows["a"], rows["c"]
    assert (a["total_lines"], a["instance_count"], a["cpu_request"], a["gpu_request"]) == (2, 3.0, 4.0, 2.0)
    assert (a["duration_s"], a["scheduling_delay_s"]) == (20.0, 10.0)
    # A job without tasks counts as one default task.
    assert (c["total_lines"], c["instance_count"], c["duration_s"]) == (1, 1.0, 0.0)


def test_canonical_schema(lines):
    out = align(lf.log_features(lines(log(FATAL))), "hdfs")
    assert len(ALL_FEATURES) == 62
    assert out.columns == ["process_id", "group_id", "source", "label", *ALL_FEATURES]
    assert out.first()["gpu_request"] == 0.0
