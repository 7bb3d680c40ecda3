"""Readers and writers on small files."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from logrisk.operators import etl, report
from logrisk.plans.monitor import monitor_batch
from logrisk.sources import logs, registry, sinks, stored
from logrisk.sources import traces as trace_files
from test_features import FATAL, STABLE, log


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    return str(path)


def test_log_lines_keep_file_order(spark, tmp_path):
    folder = tmp_path / "logs"
    os.makedirs(folder)
    for k in range(3):
        write(folder / f"part-{k}.log", "".join(f"file {k} line {i}\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = logs.read_log(spark, str(folder)).orderBy("seq").collect()
        first = logs.read_log(spark, str(folder), limit=405).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["seq"] for r in rows] == list(range(1200))
    assert [r["value"] for r in rows] == [f"file {k} line {i}" for k in range(3) for i in range(400)]
    assert first == 405


def test_splits_may_change_before_the_action(spark, tmp_path):
    """Executors that come or go change the splits of a scan, never the rows."""
    write(tmp_path / "a.log", "".join(f"line {i}\n" for i in range(20_000)))
    log = logs.read_log(spark, str(tmp_path / "a.log"))
    spark.conf.set("spark.sql.files.minPartitionNum", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = log.orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["seq"], r["value"]) for r in rows] == [(i, f"line {i}") for i in range(20_000)]


def test_traces_are_read_whole(spark, tmp_path):
    """No limit unless the caller names one; a limit counts over all archives."""
    header = "failed,collection_id,instance_index,event\n"
    for k in range(2):
        make_zip(tmp_path / f"b{k}.zip", borg_traces_data=header + "".join(f"0,{k},{i},FINISH\n" for i in range(60_000)))
    path = str(tmp_path / "b*.zip")
    assert trace_files.read_borg(spark, path).count() == 120_000
    some = trace_files.read_borg(spark, path, limit=60_010)
    assert {r[0]: r[1] for r in some.groupBy("collection_id").count().collect()} == {"0": 60_000, "1": 10}
    jobs = "job_name,inst_id,user,status,start_time,end_time\n" + "".join(f"j{i},1,u,Failed,1,2\n" for i in range(21_000))
    gpu = make_zip(tmp_path / "g.zip", pai_job_table=jobs, pai_task_table="job_name,task_name,inst_num,status,start_time,end_time,plan_cpu,plan_mem,plan_gpu,gpu_type\n")
    assert trace_files.read_gpu_trace(spark, gpu)[0].count() == 21_000


def test_invalid_bytes(spark, tmp_path):
    path = write(tmp_path / "x.log", b"ok \xff line\n", "wb")
    assert "�" in logs.read_log(spark, path).first()["value"]


def test_labels(spark, tmp_path):
    path = write(tmp_path / "l.csv", "block_id,label\nblk_1,ANOMALY\nblk_2,Normal\nblk_1,normal\n")
    assert {r["process_id"]: r["label"] for r in logs.read_labels(spark, path).collect()} == {"blk_1": 0, "blk_2": 0}


def test_load_hdfs_and_both(spark, tmp_path):
    log_path = write(tmp_path / "a.log", "\n".join(log(FATAL) + log(STABLE, "blk_2", 20)) + "\n")
    labels = write(tmp_path / "l.csv", "BlockId,Label\nblk_1,Anomaly\nblk_2,Normal\nblk_9,Normal\n")
    rows = registry.load_features(spark, "hdfs", log=log_path, labels=labels).collect()
    assert {(r["process_id"], r["label"], r["total_lines"]) for r in rows} == {("blk_1", 1, 10), ("blk_2", 0, 10)}
    early = registry.load_features(spark, "hdfs", early=True, log=log_path, labels=labels)
    assert early.count() == 8 and {r["group_id"] for r in early.collect()} == {"blk_1", "blk_2"}
    both = registry.load_features(spark, "both", log=log_path, labels=labels, events=str(tmp_path / "none.csv"))
    assert both.count() == 2
    with pytest.raises(FileNotFoundError):
        registry.load_features(spark, "google", events=str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        registry.load_features(spark, "other")


def test_job_events_csv(spark, tmp_path):
    text = "time,job_id,event_type,user,cpu_request\n1,a,0,u,0.1\n2,a,3,u,0.2\n3,b,4,v,\n,,9,,\n"
    path = write(tmp_path / "e.csv", text)
    rows = registry.load_features(spark, "google", events=path).collect()
    assert {(r["process_id"], r["label"]) for r in rows} == {("a", 1), ("b", 0)}
    assert trace_files.read_job_events(spark, path, limit=2).count() == 2


def make_zip(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name + ".csv", text)
    return str(path)


def test_gpu_archive(spark, tmp_path):
    path = make_zip(
        tmp_path / "gpu.zip",
        pai_job_table="job_name,inst_id,user,status,start_time,end_time\na,1,u,Failed,10,20\nb,2,u,Terminated,5,9\nc,3,u,Waiting,5,9\n",
        pai_task_table='job_name,task_name,inst_num,status,start_time,end_time,plan_cpu,plan_mem,plan_gpu,gpu_type\na,"t,1",2,x,12,13,100,1.5,50,T4\nc,t,1,x,1,2,1,1,1,\n')
    rows = {r["process_id"]: r for r in registry.load_features(spark, "alibaba", archive=path).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["cpu_request"], rows["a"]["gpu_request"], rows["a"]["scheduling_delay_s"]) == (1.0, 0.5, 2.0)
    assert rows["b"]["task_count"] == 1
    with pytest.raises(Exception, match="no member"):
        trace_files.read_zip_csv(spark, path, "absent.csv").count()


def test_borg_archive(spark, tmp_path):
    header = "failed,collection_id,instance_index,event,start_time,resource_request,random_sample_usage,assigned_memory,priority\n"
    body = ("1,7,0,FAIL,5,\"{'cpus': 0.25, 'memory': 0.5}\",\"{'cpus': 0.1, 'memory': 0.9}\",0.2,3\n"
            "maybe,7,1,FAIL,5,None,None,0,1\n0,,,FINISH,5,None,garbage,0,1\n")
    path = make_zip(tmp_path / "b.zip", borg_traces_data=header + body)
    rows = {r["process_id"]: r for r in registry.load_features(spark, "google2019", archive=path).collect()}
    assert set(rows) == {"7:0:0", "unknown:2:2"}
    assert (rows["7:0:0"]["oom_signal"], rows["7:0:0"]["cpu_request"], rows["7:0:0"]["group_id"]) == (1, 0.25, "7")


def test_orders(spark, tmp_path):
    path = write(tmp_path / "o.csv", "order_id,customer_id,order_date,amount,currency,status\n"
                 "1,C1,2026-05-01,42.50,usd,paid\n2,C2,2026-05-01,100,EUR,paid\n3,C3,2026-05-02,0,,x\n4,C4,2026-05-02,5,ZZZ,x\n")
    orders = stored.read_orders(spark, path)
    rows = {r["order_id"]: (r["amount_usd"], r["risk_partition"]) for r in etl.curate(orders).collect()}
    assert rows == {"1": (42.5, "clean"), "2": (108.0, "clean"), "3": (0.0, "review"), "4": (5.0, "clean")}
    assert etl.non_positive(orders).count() == 1
    assert etl.missing_columns(orders.drop("amount")).first()[0] == "amount"
    grown = etl.expand_rows(orders, 10)
    assert {r["order_id"] for r in grown.collect()} >= {"1-000001", "2-000010", "4-000008"} and grown.count() == 10
    assert etl.expand_rows(orders, 2).count() == 2
    out = str(tmp_path / "curated")
    sinks.write_curated(etl.curate(orders), out, by_risk=True)
    assert os.path.isdir(os.path.join(out, "risk_partition=review"))
    assert spark.read.option("header", True).csv(out).count() == 4


def test_report_files(spark, lines, tmp_path):
    raw = lines(log(FATAL) + log(STABLE, "blk_2", 20))
    alerts = monitor_batch(raw, every=5).withColumns({"session_id": F.lit("run"), "stage": F.lit("Load")})
    text_lines = raw.select(F.lit("run").alias("session_id"), "seq", F.lit("INFO").alias("level"),
                            F.lit("Load").alias("stage"), F.col("value").alias("line"))
    made = report.session_report(text_lines, alerts)
    sinks.write_session(made, alerts, text_lines, str(tmp_path / "session"))
    body = json.loads(spark.read.text(str(tmp_path / "session" / "reports")).first()["value"])
    assert body["summary"]["lines_processed"] == 20 and body["summary"]["total_predictions"] == 6
    assert body["summary"]["risk_counts"]["HIGH"] == len(body["summary"]["high_risk_processes"]) > 0
    last = alerts.orderBy("trigger", "seq").where("trigger = 'final'").collect()[-1]
    assert body["summary"]["recommendation"] == last["recommendation"]
    assert (body["summary"]["status"], body["summary"]["review_required"], body["summary"]["reviewed_processes"]) == ("completed", False, [])
    held = report.session_report(text_lines, alerts, policy="review").first()["report"]
    assert json.loads(held)["summary"]["review_required"] and "HIGH risk for" in json.loads(held)["summary"]["review_reason"]
    marks = alerts.select("session_id", "process_id").distinct()
    free = json.loads(report.session_report(text_lines, alerts, policy="review", reviewed=marks).first()["report"])["summary"]
    assert not free["review_required"] and len(free["reviewed_processes"]) == 2
    assert spark.read.json(str(tmp_path / "session" / "alerts")).count() == 6
    assert spark.read.json(str(tmp_path / "session" / "logs")).count() == 20
    sinks.append_lines(raw, str(tmp_path / "raw"), "value")
    sinks.append_lines(raw, str(tmp_path / "raw"), "value")
    assert spark.read.text(str(tmp_path / "raw")).count() == 40


def test_idle_session(spark):
    empty = spark.createDataFrame([], "session_id string, seq long, process_id string, trigger string,"
                                  " risk_level string, failure_probability double, prediction int, recommendation string")
    sessions = spark.createDataFrame([("s",)], "session_id string")
    row = report.with_idle_sessions(report.session_state(empty), sessions).first()
    assert (row["current_risk"], row["latest_probability"], row["total_predictions"]) == ("LOW", 0.0, 0)


def test_tail_and_append_stream(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(folder)
    write(folder / "a.log", "one\ntwo\n")
    sinks.append_stream(logs.tail_log(spark, str(folder)).select("value"), out, "value", str(tmp_path / "cp")).awaitTermination()
    write(folder / "b.log", "three\n")
    sinks.append_stream(logs.tail_log(spark, str(folder)).select("value"), out, "value", str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == ["one", "three", "two"]


def test_ranking_files(spark, tmp_path):
    ranking = spark.createDataFrame([("a", 0.5, 0.1, 0.2), ("b", 0.9, 0.1, 0.2)], "model string, f1 double, pr_auc double, recall double")
    header = spark.createDataFrame([("x", 10)], "dataset string, samples long")
    sinks.write_ranking(ranking, header, str(tmp_path))
    body = stored.read_metrics(spark, str(tmp_path / "model_comparison_json")).first()
    assert body["dataset"] == "x" and [m["model"] for m in body["ranking"]] == ["b", "a"]
    assert stored.read_ranking(spark, str(tmp_path / "model_comparison_csv")).count() == 2


def test_session_files_compute_alerts_once(spark, monkeypatch):
    """The report reads the alerts several times, and they are written as well: all from one stored copy."""
    from conftest import SMALL
    from logrisk.plans import files

    calls, alerts_of = [], files._session_alerts
    stored = files.written

    def kept(df, name):
        calls.append(name)
        return stored(df, name)

    monkeypatch.setattr(files, "written", kept)
    out = files.session_files(spark, SMALL).collect()
    assert calls == ["alerts"]
    assert sum(r["alerts"] or 0 for r in out) == alerts_of(spark, SMALL).count() > 0
