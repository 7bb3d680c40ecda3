"""The stream gives what the batch monitor gives, however the lines are cut into batches."""

import os
import time

import pytest
from pyspark.sql import functions as F

from logrisk.plans import tables
from logrisk.config import STOP_MARKER
from logrisk.plans.monitor import monitor_batch, monitor_text, monitor_until_high
from logrisk.sources import logs
from logrisk.streaming import monitor as live
from conftest import SMALL

COLUMNS = ["process_id", "seq", "lines_seen", "failure_probability", "risk_level", "action", "component"]


def picked(alerts):
    return sorted(map(tuple, alerts.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The log in three files, in line order."""
    folder = str(tmp_path_factory.mktemp("in"))
    raw = tables.log_raw(spark, SMALL).where("seq < 300").select("seq", "value")
    for k in range(3):
        part = raw.where(F.floor(F.col("seq") / 100) == k)
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder, files=1):
    reader = spark.readStream.schema("seq long, value string").option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def test_batch_equals_stream(spark, parts, tmp_path):
    out = str(tmp_path / "out")
    seen = []
    live.monitor_stream(stream(spark, parts), out, every=5, on_alerts=lambda a, n: seen.append(n), timer_ms=None).awaitTermination()
    batch = monitor_batch(spark.read.parquet(parts), every=5)
    assert len(seen) >= 3
    assert picked(live.stream_alerts(spark, out)) == picked(batch.where("trigger = 'every_n'"))
    assert picked(live.final_alerts(spark, out, every=5)) == picked(batch.where("trigger = 'final'"))


def test_silence_restarts_counting(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts = [(0, "260101 000000"), (1, "260101 000010"), (2, "260101 000041"), (3, "260101 000111")]
    rows = [(i, f"{t} 1 INFO c: x blk_1") for i, t in texts]
    spark.createDataFrame(rows, "seq long, value string").coalesce(1).write.parquet(folder)
    live.monitor_stream(stream(spark, folder), out, every=2, gap_s=30, timer_ms=None).awaitTermination()
    got = live.stream_alerts(spark, out).select("trigger", "seq", "lines_seen", "session_no").collect()
    # A gap of exactly 30 seconds goes on; 31 seconds end the process.
    assert sorted(map(tuple, got)) == [("every_n", 1, 2, 1), ("every_n", 3, 2, 2), ("timeout", 1, 2, 1)]


def test_high_stops_the_query(spark, parts, tmp_path):
    out = str(tmp_path / "out")
    query = live.monitor_stream(stream(spark, parts), out, every=2, policy="auto_stop", stop_on_high=True,
                                trigger={"processingTime": "0 seconds"})
    assert query.awaitTermination(120)
    alerts = live.stream_alerts(spark, out)
    assert alerts.where("action = 'AUTO_STOP'").count() > 0


def test_auto_stop_cuts_like_the_batch(spark, parts, tmp_path):
    """Nothing behind the first HIGH alert of a session, over several micro-batches."""
    out = str(tmp_path / "out")
    session = F.concat(F.lit("s"), F.col("seq") % 3)
    schema = "seq long, value string"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(parts).withColumn("session_id", session)
    live.monitor_stream(source, out, every=2, policy="auto_stop", keys=("session_id", "process_id"), session="session_id",
                        timer_ms=None).awaitTermination()
    raw = spark.read.schema(schema).parquet(parts).withColumn("session_id", session)
    batch = monitor_until_high(raw, every=2).where("trigger = 'every_n'")
    assert picked(live.stream_alerts(spark, out)) == picked(batch)
    stopped = {r["session_id"] for r in batch.where("risk_level = 'HIGH'").collect()}
    rest = live.final_alerts(spark, out, session="session_id", every=2, policy="auto_stop")
    assert stopped and not stopped & {r["session_id"] for r in rest.collect()}


def test_silence_on_the_clock(spark, tmp_path):
    """A silent process is flushed, dropped from the state, and gets no second final prediction."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"260101 0000{i:02d} 1 INFO c: x blk_1") for i in range(3)]
    spark.createDataFrame(rows, "seq long, value string").coalesce(1).write.parquet(folder)
    query = live.monitor_stream(stream(spark, folder), out, every=2, timer_ms=500,
                                trigger={"processingTime": "1 second"})
    try:
        # The alerts can be read at any time, before the first batch as well.
        deadline = time.time() + 90
        while time.time() < deadline and not live.stream_alerts(spark, out).where("trigger = 'timeout'").count():
            time.sleep(1)
    finally:
        query.stop()
    row = live.stream_alerts(spark, out).where("trigger = 'timeout'").first()
    assert (row["lines_seen"], row["seq"]) == (3, 2)
    assert live.final_alerts(spark, out, every=2).count() == 0


def test_tail_to_alerts_and_marker(spark, tmp_path):
    """Files of a folder to alerts; the completion marker ends the run."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)
    at = time.time() - 1000
    for k in range(4):
        path = os.path.join(folder, f"{9 - k}.log")
        text = [f"260101 00{k:02d}{i:02d} 1 INFO c: x blk_1" for i in range(5)]
        if k == 2:
            text.insert(3, "260101 000300 1 INFO pipeline.Monitor: " + STOP_MARKER)
        with open(path, "w") as f:
            f.write("\n".join(text) + "\n")
        os.utime(path, (at + 10 * k, at + 10 * k))
    query = live.monitor_stream(logs.tail_log(spark, folder, max_files=1), out, every=2, timer_ms=None,
                                trigger={"processingTime": "0 seconds"}, features=True)
    assert query.awaitTermination(120)
    alerts = live.stream_alerts(spark, out).orderBy("lines_seen").collect()
    # Thirteen lines stand before the marker.
    assert [r["lines_seen"] for r in alerts] == [2, 4, 6, 8, 10, 12]
    assert alerts[-1]["file"].endswith("7.log") and alerts[-1]["seq"] == 1
    assert alerts[0]["raw_features"]["total_lines"] == 2.0


def test_repeated_batches_count_once(spark, parts, tmp_path):
    out = str(tmp_path / "out")
    live.monitor_stream(stream(spark, parts), out, every=5, timer_ms=None).awaitTermination()
    before = picked(live.stream_alerts(spark, out))
    half = live.stream_alerts(spark, out).limit(5)
    half.write.parquet(os.path.join(out, "alerts", "batch=1", "attempt=lost"))
    assert picked(live.stream_alerts(spark, out)) == before


def test_free_text_on_the_stream(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"step {i}: error while loading rows, retry", 7, "p1") for i in range(6)]
    spark.createDataFrame(rows, "seq long, line string, run int, profile string").coalesce(1).write.parquet(folder)
    source = spark.readStream.schema("seq long, line string, run int, profile string").parquet(folder)
    stamp = F.lit("260101 000000")
    live.monitor_text_stream(source, out, value="line", pid="run", stamp=stamp, carry=("profile",), every=2,
                             timer_ms=None).awaitTermination()
    got = live.stream_alerts(spark, out).collect()
    still = monitor_text(spark.read.parquet(folder), value="line", pid="run", stamp=stamp, every=2)
    assert sorted((r["process_id"], r["seq"], r["stage"], r["risk_level"]) for r in got) == sorted(
        (r["process_id"], r["seq"], r["stage"], r["risk_level"]) for r in still.where("trigger = 'every_n'").collect())
    assert len(got) == 3 and {(r["profile"], r["run"]) for r in got} == {("p1", 7)}


def test_running_summary(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [("a", 1, 0.2, "LOW", 0), ("a", 2, 0.8, "HIGH", 1), ("b", 1, 0.5, "MEDIUM", 1)]
    names = "process_id string, seq long, failure_probability double, risk_level string, prediction int"
    spark.createDataFrame(rows, names).write.parquet(folder)
    source = spark.readStream.schema(names).parquet(folder)
    query = (live.session_counts(source).writeStream.outputMode("complete").format("memory").queryName("summary")
             .option("checkpointLocation", target).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {r["process_id"]: r for r in spark.table("summary").collect()}
    assert (got["a"]["total_predictions"], got["a"]["HIGH"], got["a"]["current_risk"], got["a"]["peak_probability"]) == (2, 1, "HIGH", 0.8)
    assert got["b"]["MEDIUM"] == 1
