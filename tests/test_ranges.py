"""Numbered lines by ranges, limits that read little, and growing files."""

import gzip
import os

import pytest

from logrisk.sources import logs, ranges, registry, tail

DATA = b"\xef\xbb\xbfone\r\ntwo\rthree\n\nfour \xff x\n" + b"y" * 3000 + b"\nlast"


def plain(data):
    data = data[3:] if data.startswith(b"\xef\xbb\xbf") else data
    return [x.decode("utf-8", "replace") for x in data.splitlines()]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_lines_by_ranges(spark, tmp_path, size):
    (tmp_path / "a.log").write_bytes(DATA)
    (tmp_path / "b c.log").write_bytes(b"")
    (tmp_path / "d.log").write_bytes(b"x\n\ny")
    found = ranges.plain_files(spark, str(tmp_path))
    want = list(enumerate(plain(DATA) + ["x", "", "y"]))
    if size > 2:
        assert sorted(map(tuple, ranges.numbered_lines(spark, found, size=size).collect())) == want
    for limit in (0, 1, 3, 7, 100):
        got = sorted(map(tuple, ranges.numbered_lines(spark, found, limit, size=max(size, 7)).collect()))
        assert got == want[:limit]


def test_ranges_equal_sparks_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(DATA)
    by_spark = sorted(r.value for r in spark.read.text(str(tmp_path)).collect())
    assert sorted(r.value for r in logs.read_log(spark, str(tmp_path)).collect()) == by_spark


def test_a_limit_reads_the_first_ranges_only(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_bytes(b"".join(b"line %06d\n" % k for k in range(10_000)))
    asked = []
    counted = ranges._counted
    monkeypatch.setattr(ranges, "_counted", lambda s, r: asked.extend(r) or counted(s, r))
    found = ranges.plain_files(spark, str(tmp_path))
    got = ranges.numbered_lines(spark, found, limit=150, size=1000)
    assert [r.seq for r in sorted(got.collect())] == list(range(150))
    # 12 bytes a line: the second of 120 ranges would do; twice as many are counted each time.
    assert len(asked) == 3 and got.rdd.getNumPartitions() == 2


def test_compressed_files_are_placed(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wb") as out:
        out.write(b"a\nb\nc\n")
    assert ranges.plain_files(spark, str(tmp_path)) is None
    assert sorted(map(tuple, logs.read_log(spark, str(tmp_path), 2).collect())) == [(0, "a"), (1, "b")]


def test_a_broken_input_is_an_error(spark, tmp_path):
    (tmp_path / "a.log").write_text("081109 203518 148 INFO dfs.DataNode: blk_1 ok\n")
    (tmp_path / "labels.csv").write_text("BlockId,Label\nblk_1,Normal\n")
    paths = {"log": str(tmp_path / "a.log"), "labels": str(tmp_path / "labels.csv")}
    assert registry.load_features(spark, "both", **paths).count() == 1
    assert registry.load_features(spark, "both", **paths, events=str(tmp_path / "missing.csv")).count() == 1
    with pytest.raises(FileNotFoundError):
        registry.load_features(spark, "both", events=str(tmp_path / "missing.csv"))
    (tmp_path / "events.csv").write_text("time,job_id,event_type\n1,a,0\n")
    os.chmod(tmp_path / "events.csv", 0o644)
    broken = registry.trace_files.read_job_events
    registry.trace_files.read_job_events = lambda s, p, n: spark.range(1).select("no_such_column")
    try:
        with pytest.raises(Exception, match="no_such_column"):
            registry.load_features(spark, "both", **paths, events=str(tmp_path / "events.csv"))
    finally:
        registry.trace_files.read_job_events = broken


# ------------------------------------------------------------------ growing files

class Follower:
    """Runs a tail of a pattern to its end, again and again, from one checkpoint."""

    def __init__(self, spark, folder, pattern, begin="start"):
        self.spark, self.folder, self.pattern, self.begin = spark, folder, pattern, begin

    def lines(self):
        query = tail.tail_files(self.spark, self.pattern, self.begin).writeStream.format("parquet").option(
            "path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = self.spark.read.schema(tail.LINES).parquet(f"{self.folder}/out").orderBy("file", "seq").collect()
        return [r.value for r in rows]


def append(path, text):
    with open(path, "a") as out:
        out.write(text)


def test_appended_lines_come_once(spark, tmp_path):
    log = tmp_path / "app.log"
    follow = Follower(spark, tmp_path, f"{tmp_path}/*.log")
    append(log, "one\ntwo\nthr")
    assert follow.lines() == ["one", "two"]
    assert follow.lines() == ["one", "two"]
    append(log, "ee\r\n\nfour")
    assert follow.lines() == ["one", "two", "three", ""]
    append(log, "\n")
    append(tmp_path / "other.log", "x\n")
    assert follow.lines() == ["one", "two", "three", "", "four", "x"]


def test_from_the_end_only_new_lines(spark, tmp_path):
    append(tmp_path / "app.log", "old\nhalf")
    follow = Follower(spark, tmp_path, f"{tmp_path}/app.log", "end")
    assert follow.lines() == []
    append(tmp_path / "app.log", " done\nnew\n")
    assert follow.lines() == ["half done", "new"]
    with pytest.raises(Exception, match="begins at"):
        Follower(spark, tmp_path / "b", f"{tmp_path}/app.log", "middle").lines()


def test_replaced_and_renamed_files(spark, tmp_path):
    log = tmp_path / "app.log"
    follow = Follower(spark, tmp_path, f"{tmp_path}/app.log,{tmp_path}/app.log.1")
    append(log, "a1\na2\n")
    assert follow.lines() == ["a1", "a2"]
    append(log, "a3\n")
    os.rename(log, tmp_path / "app.log.1")
    append(log, "b1\nb2\nb3\n")
    assert sorted(follow.lines()) == ["a1", "a2", "a3", "b1", "b2", "b3"]
    log.write_text("b1\n")
    assert sorted(follow.lines()) == ["a1", "a2", "a3", "b1", "b1", "b2", "b3"]


def test_pieces_of_offsets():
    known = {"a": [100, "x"], "b": [50, "y"]}
    assert tail.pieces({}, known, 60) == [("a", 0, 60), ("a", 60, 100), ("b", 0, 50)]
    assert tail.pieces(known, known) == []
    # a was renamed to c and grew, a new a came, b was cut.
    assert tail.pieces(known, {"a": [10, "z"], "b": [20, "y"], "c": [130, "x"]}) == [("a", 0, 10), ("b", 0, 20), ("c", 100, 130)]


def test_lines_are_monitored(spark, tmp_path):
    from logrisk.streaming import monitor

    line = "081109 203518 148 {} dfs.DataNode: {} on blk_1\n"
    append(tmp_path / "app.log", line.format("INFO", "ok") * 10)
    def run():
        raw = tail.tail_files(spark, f"{tmp_path}/app.log", "start")
        monitor.monitor_stream(raw, str(tmp_path / "alerts"), timer_ms=None, every=10).awaitTermination()
        return monitor.stream_alerts(spark, str(tmp_path / "alerts")).orderBy("total_lines").select("total_lines", "fatal_count").collect()
    assert [tuple(r) for r in run()] == [(10, 0)]
    append(tmp_path / "app.log", line.format("FATAL", "fail") * 10)
    assert [tuple(r) for r in run()] == [(10, 0), (20, 10)]
