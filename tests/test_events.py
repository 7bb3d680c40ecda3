"""Scheduler events that arrive late: batch, stream and a plain definition."""

import random

import pytest
from pyspark.sql import functions as F

from logrisk.operators import arrivals, traces
from logrisk.operators.ordered import Limits
from logrisk.plans.monitor import monitor_events
from logrisk.streaming import events as live
from logrisk.streaming import monitor

EVENTS = ("seq long, time double, job_id string, event_type int, event_name string, scheduling_class int, priority int, "
          "cpu_request double, memory_request double, disk_request double, user string")


def plain_runs(events):
    """(longest run of failures, retries) of (time, seq, code) in order of time."""
    best = run = retries = 0
    before = None
    for _, _, code in sorted(events):
        failed = code in (2, 3, 5, 6)
        run = run + 1 if failed else 0
        best = max(best, run)
        retries += code == 1 and before in (2, 3, 5, 6)
        before = code
    return best, retries


def kind(code):
    return live.FAILS if code in (2, 3, 5, 6) else live.SCHEDULES if code == 1 else live.OTHER


@pytest.mark.parametrize("block", [2, 7, 512])
def test_blocks_of_timed_events(monkeypatch, block):
    monkeypatch.setattr(live, "BLOCK", block)
    r = random.Random(block)
    kept, heads, seen = {}, [], []
    for part in range(6):
        # Each part is a micro-batch: the state is written and read again.
        runs = live.TimedRuns([list(h) for h in heads], lambda n: live.unpacked(kept[n]), lambda n, e: kept.update({n: live.packed(e)}))
        for _ in range(60):
            seq = len(seen)
            event = (float(seq // 3 + r.choice([0, 0, 0, -5, -40])), seq, r.choice([0, 1, 1, 2, 3, 5, 6, 8]))
            seen.append(event)
            runs.add(event[0], event[1], kind(event[2]))
            whole = runs.whole()
            assert (whole[3], whole[6]) == plain_runs(seen) and whole[0] == len(seen)
        runs.flush()
        heads = runs.heads
    assert sum(len(live.unpacked(v)) for v in kept.values()) == len(seen)


def made(seed, jobs=6, count=400, late=25):
    """Events of jobs of very different sizes, in order of arrival."""
    r, rows = random.Random(seed), []
    for seq in range(count):
        job = min(int(r.expovariate(0.9)), jobs - 1)
        time = float(max(0, seq - (r.randrange(late) if r.random() < 0.4 else 0)) // 2 * 1000)
        rows.append((seq, time, f"j{job}", r.choice([0, 1, 1, 2, 3, 4, 5, 6, 7, 8]), "x", r.randrange(4), r.randrange(12),
                     r.choice([0.0, 0.5, 0.25]), r.random(), 0.0, f"u{r.randrange(5)}"))
    return rows


def plain_prefixes(rows, every):
    out, held = [], {}
    last = {r[2]: r[0] for r in rows}
    for row in sorted(rows):
        mine = held.setdefault(row[2], [])
        mine.append(row)
        for trigger, fires in (("every_n", len(mine) % every == 0), ("final", last[row[2]] == row[0])):
            if fires:
                best, retries = plain_runs([(e[1], e[0], e[3]) for e in mine])
                codes = [e[3] for e in mine]
                out.append((row[2], row[0], trigger, len(mine), sum(c in (2, 3, 5, 6) for c in codes), retries, best,
                            len({e[10] for e in mine}), max(e[7] for e in mine), mine[0][6], mine[0][5]))
    return sorted(out)


def columns(df):
    return sorted(map(tuple, df.select("process_id", "seq", "trigger", "total_lines", "error_count", "retry_count", "max_error_burst",
                                       "unique_components", "cpu_request", "priority", "scheduling_class").collect()))


@pytest.mark.parametrize("limits", [Limits(), Limits(hot_rows=60, chunk_rows=25)])
def test_prefixes_like_the_definition(spark, limits):
    rows = made(3)
    got = arrivals.event_prefixes(spark.createDataFrame(rows, EVENTS), 7, limits=limits)
    assert columns(got) == plain_prefixes(rows, 7)


def test_no_events(spark):
    none = spark.createDataFrame([], EVENTS)
    assert arrivals.event_prefixes(none, 5).count() == 0
    assert monitor_events(none).count() == 0


def test_whole_histories_agree(spark):
    rows = spark.createDataFrame(made(5), EVENTS)
    final = arrivals.event_prefixes(rows, 1000).where("trigger = 'final'").drop("seq", "trigger")
    whole = traces.job_features(rows)
    assert sorted(map(tuple, final.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("parts", [1, 5])
def test_stream_equals_batch(spark, tmp_path, parts):
    rows = made(9, count=200)
    for k in range(parts):
        some = rows[k * len(rows) // parts:(k + 1) * len(rows) // parts]
        spark.createDataFrame(some, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    query = monitor.monitor_stream(source, target, timer_ms=None, every=7, kind="events")
    query.awaitTermination()
    names = ["process_id", "seq", "trigger", "failure_probability", "risk_level", "retry_count", "max_error_burst", "log1p_error_count", "action"]
    want = monitor_events(spark.createDataFrame(rows, EVENTS), every=7).select(names)
    got = monitor.stream_alerts(spark, target).select(names).unionByName(
        monitor.final_alerts(spark, target, every=7, kind="events").select(names))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_silent_jobs_are_flushed_once(spark, tmp_path):
    spark.createDataFrame(made(2, count=60), EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    query = monitor.monitor_stream(source, target, timer_ms=500, every=7, kind="events", trigger={"processingTime": "1 second"})
    jobs = len({r[2] for r in made(2, count=60)})
    for _ in range(60):
        flushed = monitor.stream_alerts(spark, target).where(F.col("trigger") == "timeout")
        if flushed.count() >= jobs:
            break
        query.awaitTermination(1)
    query.stop()
    assert flushed.select("process_id").distinct().count() == jobs == flushed.count()
