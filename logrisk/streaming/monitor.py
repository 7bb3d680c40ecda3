"""The monitor on streams: keyed state per process, the batch rules on top."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logrisk.config import FLUSH_SECONDS, PREDICT_EVERY
from logrisk.functions.text import is_stop_marker, normalise_lines
from logrisk.operators.logfeatures import SIGNALS, finish_log_features, line_signals
from logrisk.plans.monitor import Scorer, by_rules, calibrate, decide, raw_features
from logrisk.session import exists
from logrisk.streaming.events import event_stream, finish_events, named
from logrisk.streaming.names import Names

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTERS = list(SIGNALS.values())
SUMMED = {s: c for s, c in SIGNALS.items() if c not in ("unique_components", "unique_pids")}
#: Key of the completion marker, which is no process.
MARKER = "\u0000marker"
MARKER_LINE = "000101 000000 0 INFO pipeline.Monitor: blk_0"
NUMBERS = ["session_no", "total_lines", *COUNTERS, "max_error_burst", "_run", "_first_s", "_last_s", "_seen_s"]
NAME = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())])
#: Bits of the signals of a line that makes a run longer.
BAD = sum(1 << k for k, s in enumerate(SUMMED) if s in ("is_error", "is_fatal"))
MARK = T.StructType([T.StructField("seen", T.BooleanType())])
#: What the state holds beside the counters.
HELD = ("_names", "_heads", "_events", "_users")
COMMIT = "attempt string, ended boolean, batch long"


def counter_type(places: list[T.StructField]) -> T.StructType:
    """Counters of a process, and what its newest line carries."""
    return T.StructType([T.StructField(c, T.LongType()) for c in NUMBERS] + places)


def state_type(places: list[T.StructField]) -> T.StructType:
    """The counters with the first FEW names, so that most processes are one value of the state."""
    return T.StructType([*counter_type(places).fields, T.StructField("_names", T.StringType())])


def output_type(keys: list[str], places: list[T.StructField]) -> T.StructType:
    """Every key hands back a batch of its own, whose cost is by the column, so the counters are one array."""
    return T.StructType([T.StructField(k, T.StringType()) for k in [*keys, "trigger"]]
                        + [T.StructField("counts", T.ArrayType(T.LongType()))] + places)


class PrefixCounter(StatefulProcessor):
    """Counters of one process: fixed-size state, plus its components and pids as map keys when they are many.

    Emits a row for every N-th line and one when a process was silent too long
    (`timeout`). A process that was silent on the clock is dropped; if it
    speaks again it is a new one. The newest counters stay in the state, where
    `final_alerts` reads them.
    """

    def __init__(self, every: int, gap_s: int | None, timer_ms: int | None,
                 keys: list[str], order: list[str], places: list[T.StructField]):
        self.every, self.gap_s, self.timer_ms = every, gap_s, timer_ms
        self.keys, self.order, self.places = keys, order, [f.name for f in places]
        self.state, self.output = state_type(places), output_type(keys, places)
        self.made = Row(*self.output.names)
        self.hits: dict[int, list[str]] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", self.state)
        self.names = handle.getMapState("names", NAME, MARK)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Rows of one process inside one micro-batch; the trigger options bound them.
        rows = list(rows)
        at = {name: k for k, name in enumerate(rows[0].__fields__)}
        order = [at[c] for c in self.order]
        rows = sorted(map(tuple, rows), key=lambda r: tuple(r[k] for k in order))
        places = [(c, at[c]) for c in self.places]
        if key[len(self.keys) - 1] == MARKER:
            for row in rows:
                yield self._emit(key, "marker", {**self._fresh(1), **{c: row[k] for c, k in places}})
            return
        state = self._load()
        names = Names(self.names, state.pop("_names"))
        seen = [("component", "unique_components", at["component"]), ("pid", "unique_pids", at["pid"])]
        bits, ts = at["bits"], at["ts_s"]
        for row in rows:
            second = row[ts]
            silent = self.gap_s is not None and state["_seen_s"] is not None and second is not None
            if silent and second - state["_seen_s"] > self.gap_s:
                yield self._emit(key, "timeout", state)
                names.clear()
                state = self._fresh(state["session_no"] + 1)
            for name, k in places:
                state[name] = row[k]
            state["total_lines"] += 1
            for counter in self._hits(row[bits]):
                state[counter] += 1
            for kind, counter, k in seen:
                state[counter] += names.add((kind, row[k]))
            self._time(state, row[bits], second)
            if state["total_lines"] % self.every == 0:
                yield self._emit(key, "every_n", state)
        state["_names"] = names.packed()
        self.counters.update(tuple(state[f.name] for f in self.state.fields))
        if self.timer_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timer_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.counters.exists():
            yield self._emit(key, "timeout", self._load())
        self.names.clear()
        self.counters.clear()

    def close(self) -> None:
        pass

    def _fresh(self, session_no: int) -> dict:
        state = {c: 0 for c in NUMBERS} | {c: None for c in self.places}
        state.update(session_no=session_no, _first_s=None, _last_s=None, _seen_s=None)
        return state

    def _load(self) -> dict:
        kept = self.counters.get()
        if kept is None:
            return {**self._fresh(1), "_names": None}
        return dict(zip(self.state.names, kept))

    def _hits(self, bits: int) -> list[str]:
        """The counters that a line adds to."""
        if bits not in self.hits:
            self.hits[bits] = [counter for k, counter in enumerate(SUMMED.values()) if bits >> k & 1]
        return self.hits[bits]

    def _time(self, state: dict, bits: int, second: int | None) -> None:
        state["_run"] = state["_run"] + 1 if bits & BAD else 0
        state["max_error_burst"] = max(state["max_error_burst"], state["_run"])
        if second is not None:
            state["_first_s"] = second if state["_first_s"] is None else min(state["_first_s"], second)
            state["_last_s"] = second if state["_last_s"] is None else max(state["_last_s"], second)
            state["_seen_s"] = state["_last_s"]

    def _emit(self, key: tuple, trigger: str, state: dict) -> Row:
        counts = [state[c] for c in NUMBERS]
        return self.made(*key, trigger, counts, *[state[c] for c in self.places])


def prefix_stream(raw: DataFrame, *, every: int = PREDICT_EVERY, gap_s: int | None = None,
                  timer_ms: int | None = 1000 * FLUSH_SECONDS, keys: tuple[str, ...] = ("process_id",),
                  order: tuple[str, ...] = ("seq",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Counter rows of a stream of lines (`value`, the order columns, and those of `keys` and `carry`).

    gap_s: split a process by silence in log time; timer_ms: by silence on the
    clock. Completion markers give rows of their own (trigger `marker`).
    """
    marked = raw.withColumn("_marked", is_stop_marker("value"))
    marked = marked.withColumn("value", F.when(F.col("_marked"), MARKER_LINE).otherwise(F.col("value")))
    lines = line_signals(marked).withColumn("process_id", F.when(F.col("_marked"), MARKER).otherwise(F.col("process_id")))
    # Rows are handed over cell by cell, so the signals of a line travel as the bits of one number.
    bits = reduce(Column.bitwiseOR, (F.shiftleft(F.col(s).cast("int"), k) for k, s in enumerate(SUMMED)))
    kinds = {f.name: f for f in lines.schema.fields}
    places = [T.StructField(c, kinds[c].dataType) for c in dict.fromkeys([*order, "component", *carry])]
    lines = lines.select(*dict.fromkeys([*keys, *[f.name for f in places], "pid", "ts_s"]), bits.alias("bits"))
    counted = lines.groupBy(*keys).transformWithState(
        statefulProcessor=PrefixCounter(every, gap_s, timer_ms, list(keys), list(order), places),
        outputStructType=output_type(list(keys), places),
        outputMode="Update", timeMode="ProcessingTime" if timer_ms is not None else "None")
    return counted.select(*keys, "trigger", *named("counts", NUMBERS), *[f.name for f in places])


#: Features from the counter rows of each kind of stream.
FINISH = {"lines": finish_log_features, "events": finish_events}


def alerts_of(rows: DataFrame, *, every: int = PREDICT_EVERY, score: Scorer = by_rules,
              prior: Column | float = 0.10, mode: str = "stream", policy: str = "advise",
              reviewed: DataFrame | None = None, features: bool = False, kind: str = "lines") -> DataFrame:
    """Counter rows to alerts by the rules of the batch monitor; `features` adds the map of features."""
    known = score(FINISH[kind](rows))
    out = decide(calibrate(known, every=every, prior=prior, mode=mode), policy, reviewed)
    if features:
        out = out.withColumn("raw_features", raw_features())
    return out.withColumn("lines_seen", F.col("total_lines"))


def monitor_stream(
    raw: DataFrame,
    folder: str,
    *,
    every: int = PREDICT_EVERY,
    gap_s: int | None = None,
    timer_ms: int | None = 1000 * FLUSH_SECONDS,
    keys: tuple[str, ...] = ("process_id",),
    order: tuple[str, ...] | None = None,
    carry: tuple[str, ...] = (),
    session: str | None = None,
    on_alerts: Callable[[DataFrame, int], None] | None = None,
    stop_on_high: bool = False,
    trigger: dict | None = None,
    **rules,
) -> StreamingQuery:
    """Starts the monitor; alerts go to `folder/alerts`. `rules` are options of `alerts_of`.

    With kind="events" the stream holds scheduler events as of
    `traces.clean_events`, in the order of arrival `seq`; jobs are processes.

    Every attempt at a micro-batch writes to a place of its own and counts only
    once its commit is written, so readers never see half a batch and a
    repeated batch adds nothing. The order columns are those of `tail_log` if
    the stream has them, else `seq`.

    A completion marker ends the run: alerts from there on are dropped and the
    query stops after the batch. With policy auto_stop the alerts of a session
    (column `session`, without one the process) behind its first HIGH alert are
    dropped, in this batch and in later ones; with `stop_on_high` the first HIGH
    alert also ends the query. The call returns at once in every case.
    """
    spark = raw.sparkSession
    # Keyed processors need this state store; the default one cannot hold map state.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    order = order or (("arrived", "file", "split", "seq") if "arrived" in raw.columns else ("seq",))
    session = session or keys[-1]
    rows = event_stream(raw, every=every, timer_ms=timer_ms) if rules.get("kind") == "events" else prefix_stream(raw, every=every, gap_s=gap_s, timer_ms=timer_ms, keys=keys, order=order,
                         carry=tuple(dict.fromkeys([*carry, *([] if session in keys else [session])])))
    empty = alerts_of(spark.createDataFrame([], rows.schema), every=every, **rules)
    _write_schema(spark, folder, empty.schema)
    over = threading.Event()

    def handle(batch: DataFrame, number: int) -> None:
        done = os.path.join(folder, "commits", f"batch={number}")
        if not exists(spark, os.path.join(done, "_SUCCESS")):
            ended = committed(spark, folder).where("ended").limit(1).count() > 0
            batch = batch.persist()
            place = F.struct(*order)
            marker = batch.where(F.col("trigger") == "marker").agg(F.min(place).alias("_cut"))
            ends = marker.where(F.col("_cut").isNotNull()).count() > 0
            fired = batch.where(F.lit(not ended) & (F.col("trigger") != "marker"))
            if ends:
                # One aggregate row.
                fired = fired.crossJoin(F.broadcast(marker)).where(place < F.col("_cut")).drop("_cut")
            alerts = alerts_of(fired, every=every, **rules)
            if rules.get("policy") == "auto_stop":
                alerts = _until_high(alerts, stream_alerts(spark, folder), session, order)
            attempt = uuid.uuid4().hex
            alerts.write.parquet(os.path.join(folder, "alerts", f"batch={number}", f"attempt={attempt}"))
            batch.unpersist()
            spark.createDataFrame([(attempt, ended or ends)], "attempt string, ended boolean").coalesce(1) \
                .write.mode("overwrite").parquet(done)
        alerts = _alerts_in(spark, folder, committed(spark, folder).where(F.col("batch") == number))
        if on_alerts is not None:
            on_alerts(alerts, number)
        if committed(spark, folder).where("ended").limit(1).count() or (
                stop_on_high and alerts.where(F.col("risk_level") == "HIGH").limit(1).count()):
            over.set()

    query = (
        rows.writeStream.foreachBatch(handle).outputMode("update")
        .option("checkpointLocation", os.path.join(folder, "checkpoint"))
        .trigger(**(trigger or {"availableNow": True})).start()
    )

    def stop_when_over() -> None:
        while query.isActive and not over.wait(1):
            pass
        if query.isActive:
            query.stop()

    threading.Thread(target=stop_when_over, daemon=True).start()
    return query


def monitor_text_stream(lines: DataFrame, folder: str, *, value: str, pid: str, stamp: Column,
                        carry: tuple[str, ...] = (), **options) -> StreamingQuery:
    """Free-text lines through the adapter into the monitor; stage, `pid` and `carry` go to the alerts."""
    adapted = normalise_lines(lines, value, pid, stamp)
    places = [c for c in ("arrived", "file", "split") if c in lines.columns]
    ready = adapted.select("seq", *places, "stage", pid, *carry, F.col("normalized_line").alias("value"))
    return monitor_stream(ready, folder, carry=("stage", pid, *carry), **options)


def _until_high(alerts: DataFrame, before: DataFrame, session: str, order: tuple[str, ...]) -> DataFrame:
    """Alerts of sessions that had no HIGH alert before, up to their first one now."""
    high = (F.col("risk_level") == "HIGH") & (F.col("trigger") == "every_n")
    alerts = alerts.join(before.where(high).select(session).distinct(), session, "left_anti")
    stops = alerts.where(high).groupBy(session).agg(F.min(F.struct(*order)).alias("_stop"))
    return alerts.join(stops, session, "left").where(
        F.col("_stop").isNull() | (F.struct(*order) <= F.col("_stop"))).drop("_stop")


def _write_schema(spark: SparkSession, folder: str, schema: T.StructType) -> None:
    spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(
        os.path.join(folder, "schema"))


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts that count: attempt, ended, batch; one row per finished micro-batch."""
    path = os.path.join(folder, "commits")
    if not exists(spark, path):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).parquet(path)


def _alerts_in(spark: SparkSession, folder: str, commits: DataFrame) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(os.path.join(folder, "schema")).first()[0]))
    path = os.path.join(folder, "alerts")
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    placed = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType())])
    rows = spark.read.schema(placed).parquet(path)
    return rows.join(commits.select("batch", "attempt"), ["batch", "attempt"], "left_semi").select(*schema.names)


def stream_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts of finished micro-batches; none before the first."""
    return _alerts_in(spark, folder, committed(spark, folder))


def final_alerts(spark: SparkSession, folder: str, session: str | None = None, **rules) -> DataFrame:
    """The end-of-run predictions of a stopped stream: the counters its state still holds.

    Processes flushed by silence are no longer in it. With policy auto_stop,
    sessions that were stopped (column `session`, without one the process) have
    no prediction here: their state counts lines behind the stop as well.
    """
    state = spark.read.format("statestore").option("stateVarName", "counters").load(os.path.join(folder, "checkpoint"))
    newest = state.select("key.*", "value.*").drop(*HELD).withColumns({
        "trigger": F.lit("final"), "component": F.lit("pipeline.Monitor")})
    if "stage" in newest.columns:
        newest = newest.withColumn("stage", F.lit("Monitor"))
    alerts = alerts_of(newest, **rules)
    if rules.get("policy") != "auto_stop":
        return alerts
    session = session or "process_id"
    stopped = stream_alerts(spark, folder).where((F.col("risk_level") == "HIGH") & (F.col("trigger") == "every_n"))
    return alerts.join(stopped.select(session).distinct(), session, "left_anti")


def session_counts(alerts: DataFrame, session: str = "process_id") -> DataFrame:
    """Running summary per session, for a streaming query in update or complete mode."""
    return alerts.groupBy(session).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("prediction") == 1).alias("predicted_failures"),
        *[F.count_if(F.col("risk_level") == r).alias(r) for r in ("LOW", "MEDIUM", "HIGH")],
        F.max("failure_probability").alias("peak_probability"),
        F.max_by("risk_level", "seq").alias("current_risk"),
    )
