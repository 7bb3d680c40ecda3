"""Running aggregates: the chunked way gives what the plain window gives."""

import random

import pytest
from pyspark.sql import functions as F

from logrisk.operators.logfeatures import history_features, line_signals, prefix_features
from logrisk.operators.ordered import Limits, Run, bursts, row_numbers, running, tasks_for
from logrisk.operators.snapshots import early_warning, with_sessions
from logrisk.operators.traces import clean_events, job_features
from logrisk.operators.evaluate import ranking_metrics
from logrisk.operators.splits import group_folds, group_holdout
from logrisk.plans import tables
from conftest import SMALL

SPLIT = Limits(hot_rows=20, chunk_rows=15)


def same(a, b):
    names = sorted(a.columns)
    left = sorted(map(repr, a.select(*names).collect()))
    assert names == sorted(b.columns)
    assert left == sorted(map(repr, b.select(*names).collect()))
    assert left


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of the rows; values with NULLs."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(60)}"
        rows.append((key, i, rng.randrange(5), rng.choice(["a", "b", "c", None]), rng.random() < 0.4))
    return spark.createDataFrame(rows, "key string, seq long, v int, name string, bad boolean")


def brute(rows):
    """The definition, one row at a time."""
    state, out = {}, {}
    for key, seq, v, name, bad in sorted(rows, key=lambda r: r[1]):
        s = state.setdefault(key, {"n": 0, "sum": 0, "max": None, "names": set(), "run": 0, "burst": 0})
        before = s["max"]
        s["n"] += 1
        s["sum"] += v
        s["max"] = v if s["max"] is None else max(s["max"], v)
        first = int(name not in s["names"])
        s["names"].add(name)
        s["run"] = s["run"] + 1 if bad else 0
        s["burst"] = max(s["burst"], s["run"])
        out[(key, seq)] = (s["n"], s["sum"], s["max"], before, first, s["burst"])
    return out


@pytest.mark.parametrize("limits", [Limits(), SPLIT, Limits(hot_rows=100, chunk_rows=7)])
def test_running_equals_definition(skewed, limits):
    stages = [[Run("n", "sum", F.lit(1)), Run("total_v", "sum", F.col("v")), Run("top", "max", F.col("v")),
               Run("before", "max_before", F.col("v"))], *bursts(F.col("bad"))]
    out = running(skewed, ["key"], ["seq"], stages, firsts={"name": "first"}, total="total", limits=limits)
    want = brute([tuple(r) for r in skewed.collect()])
    sizes = {r["key"]: r["count"] for r in skewed.groupBy("key").count().collect()}
    got = out.collect()
    assert len(got) == 900
    for r in got:
        assert (r["n"], r["total_v"], r["top"], r["before"], r["first"], r["burst"]) == want[(r["key"], r["seq"])]
        assert r["total"] == sizes[r["key"]]


def test_global_row_numbers(skewed):
    for limits in (Limits(), SPLIT):
        out = row_numbers(skewed, [], [F.col("seq").desc()], "rn", total="all", limits=limits).collect()
        assert all(r["rn"] == 900 - r["seq"] and r["all"] == 900 for r in out)


def test_hot_processes(spark):
    raw = tables.log_raw(spark, "/root/testdata/sf0.001")
    signals = line_signals(raw)
    same(prefix_features(signals, total="total"), prefix_features(signals, total="total", limits=SPLIT))
    same(history_features(signals), history_features(signals, limits=SPLIT))
    lines = signals.select("process_id", "seq", "ts_s")
    same(with_sessions(lines, gap=3600), with_sessions(lines, gap=3600, limits=SPLIT))


def test_hot_jobs(spark):
    events = clean_events(tables.job_events(spark, SMALL)).withColumn("job_id", F.substring("job_id", 1, 1))
    # Equal times, so that file order decides.
    tied = events.withColumn("time", F.floor(F.col("time") / 50000).cast("double"))
    for rows in (events, tied):
        same(job_features(rows), job_features(rows, limits=Limits(hot_rows=-1, chunk_rows=40)))


def test_curves_and_splits(spark):
    scored = tables.scored(spark, SMALL)
    same(ranking_metrics(scored, digits=9), ranking_metrics(scored, digits=9, limits=SPLIT))
    groups = spark.range(500).select(
        F.concat(F.lit("g"), "id").alias("group_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    same(group_holdout(groups), group_holdout(groups, limits=SPLIT))
    same(group_folds(groups), group_folds(groups, limits=SPLIT))


def test_early_warning_of_hot_process(spark):
    signals = line_signals(tables.log_raw(spark, SMALL))
    plain = early_warning(prefix_features(signals, total="total"))
    same(plain, early_warning(prefix_features(signals, total="total", limits=SPLIT)))


def test_windows_of_many_groups_are_dealt_by_rows(spark):
    """Small rows compress well, so partitions joined by bytes would be one task here."""
    rows = spark.range(4000).select((F.col("id") % 97).alias("key"), F.col("id").alias("seq"), F.lit("a").alias("name"))
    limits = Limits(task_rows=100)
    out = running(rows, ["key"], ["seq"], [[Run("n", "sum", F.lit(1).cast("long"))]], firsts={"name": "first"}, limits=limits)
    assert out.rdd.getNumPartitions() == 40
    same(out, running(rows, ["key"], ["seq"], [[Run("n", "sum", F.lit(1).cast("long"))]], firsts={"name": "first"}, limits=Limits(None)))


def test_tasks_for_rows():
    assert [tasks_for(n, 12, 1000) for n in (0, 5, 100, 101, 500, 5000, 12_001, 90_000)] == [1, 1, 1, 2, 5, 12, 13, 90]
