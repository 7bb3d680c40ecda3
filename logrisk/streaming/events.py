"""Scheduler events on streams: keyed state per job, predictions by arrival, runs by event time."""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections import namedtuple
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logrisk.config import FAIL_EVENTS, FLUSH_SECONDS, PREDICT_EVERY, SCHEDULE_EVENT
from logrisk.operators.logfeatures import with_log1p
from logrisk.operators.traces import finish_job_features
from logrisk.streaming.names import Names

#: Events of a block; twice as many are split.
BLOCK = 512
#: What a code means for runs.
OTHER, FAILS, SCHEDULES = 0, 1, 2
COUNTS = {
    "info_count": (0, 1), "warn_count": (7, 8), "error_count": tuple(FAIL_EVENTS), "fatal_count": (5, 6),
    "warning_kw_hits": (7,), "exception_count": (2, 3),
}
LONGS = ["total_lines", *COUNTS, "retry_count", "unique_components", "max_error_burst", "_timed"]
DOUBLES = ["_first", "_last", "_cpu", "_memory", "_disk"]
INTS = ["priority", "scheduling_class"]
USER = T.StructType([T.StructField("user", T.StringType())])
NUMBER = T.StructType([T.StructField("block", T.LongType())])
PACKED = T.StructType([T.StructField("events", T.BinaryType())])
SEEN = T.StructType([T.StructField("seen", T.BooleanType())])


Event = namedtuple("Event", "process_id seq time event_type scheduling_class priority cpu_request memory_request disk_request user")


def merged(a: tuple, b: tuple) -> tuple:
    """Summary of two stretches: size, run at the head, at the tail, longest, first schedules, last fails, retries."""
    return (a[0] + b[0], a[0] + b[1] if a[1] == a[0] else a[1], b[0] + a[2] if b[2] == b[0] else b[2],
            max(a[3], b[3], a[2] + b[1]), a[4], b[5], a[6] + b[6] + (a[5] and b[4]))


def single(kind: int) -> tuple:
    fails = int(kind == FAILS)
    return 1, fails, fails, fails, kind == SCHEDULES, bool(fails), 0


class TimedRuns:
    """Events in order of (time, seq), in blocks with summaries.

    An event at the end costs no more than a merge of two summaries; one in
    the middle reads and sums up the block it belongs to. `load` and `save`
    fetch and keep the events of a block; `heads` is a list of
    [time, seq, number, summary] per block.
    """

    def __init__(self, heads: list, load, save):
        self.heads, self.load, self.save = heads, load, save
        self.keys = [(h[0], h[1]) for h in heads]
        self.open: dict[int, list] = {}
        self.changed: set[int] = set()
        self.before = None

    def _block(self, number: int) -> list:
        if number not in self.open:
            self.open[number] = self.load(number)
        return self.open[number]

    def add(self, time: float, seq: int, kind: int) -> None:
        event = (time, seq, kind)
        if not self.heads:
            self._put(0, [event])
            return
        at = max(0, bisect_right(self.keys, (time, seq)) - 1)
        head = self.heads[at]
        events = self._block(head[2])
        if event > events[-1]:
            events.append(event)
            head[3] = merged(head[3], single(kind))
        else:
            events.insert(bisect_right(events, event), event)
            head[0], head[1] = events[0][:2]
            self.keys[at] = (head[0], head[1])
            head[3] = reduce(merged, map(single, (e[2] for e in events)))
        self.changed.add(head[2])
        if at < len(self.heads) - 1:
            self.before = None
        if len(events) > 2 * BLOCK:
            self.open[head[2]] = events[:BLOCK]
            head[3] = reduce(merged, map(single, (e[2] for e in events[:BLOCK])))
            self._put(at + 1, events[BLOCK:])

    def _put(self, at: int, events: list) -> None:
        number = len(self.heads)
        self.open[number] = events
        self.changed.add(number)
        self.heads.insert(at, [events[0][0], events[0][1], number, reduce(merged, map(single, (e[2] for e in events)))])
        self.keys.insert(at, events[0][:2])
        self.before = None

    def whole(self) -> tuple:
        """Summary of all events; that of all blocks but the last is kept until one of them changes."""
        if len(self.heads) > 1:
            if self.before is None:
                self.before = reduce(merged, (tuple(h[3]) for h in self.heads[:-1]))
            return merged(self.before, self.heads[-1][3])
        return tuple(self.heads[0][3])

    def flush(self) -> None:
        for number in self.changed:
            self.save(number, self.open[number])
        self.changed.clear()


def packed(events: list) -> bytes:
    times, seqs, kinds = zip(*events)
    return array("d", times).tobytes() + array("q", seqs).tobytes() + bytes(kinds)


def unpacked(raw: bytes) -> list:
    n = len(raw) // 17
    times, seqs = array("d"), array("q")
    times.frombytes(raw[:8 * n])
    seqs.frombytes(raw[8 * n:16 * n])
    return list(zip(times, seqs, raw[16 * n:]))


def counter_type() -> T.StructType:
    kinds = [(LONGS, T.LongType()), (DOUBLES, T.DoubleType()), (INTS, T.IntegerType()), (["seq"], T.LongType())]
    return T.StructType([T.StructField(n, k) for names, k in kinds for n in names])


def state_type() -> T.StructType:
    """The counters with the heads of the blocks, an only block and few users: most jobs are one value of the state."""
    held = [("_heads", T.StringType()), ("_events", T.BinaryType()), ("_users", T.StringType())]
    return T.StructType([*counter_type().fields, *[T.StructField(n, k) for n, k in held]])


def output_type() -> T.StructType:
    """Every key hands back a batch of its own, whose cost is by the column, so the counters are two arrays."""
    return T.StructType([T.StructField("process_id", T.StringType()), T.StructField("trigger", T.StringType()),
                         T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("sums", T.ArrayType(T.DoubleType()))])


def named(array: str, names: list[str], kind: str = "long") -> list[Column]:
    """The elements of an array as columns."""
    return [F.col(array)[k].cast(kind).alias(n) for k, n in enumerate(names)]


class EventCounter(StatefulProcessor):
    """Counters of one job in arrival order, runs in time order.

    Emits a row after every N-th event, and one when a job was silent on the
    clock (`timer_ms`), which also drops its state.
    """

    def __init__(self, every: int, timer_ms: int | None):
        self.every, self.timer_ms = every, timer_ms
        self.fields, self.made = state_type().names, Row(*output_type().names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", state_type())
        self.blocks = handle.getMapState("blocks", NUMBER, PACKED)
        self.users = handle.getMapState("users", USER, SEEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Arrivals of one job inside one micro-batch; the trigger options bound them.
        rows = sorted(map(Event._make, rows), key=lambda r: r.seq)
        kept = self.counters.get()
        state = dict(zip(self.fields, kept)) if kept is not None else self._fresh(rows[0])
        only, users = state["_events"], Names(self.users, state["_users"])
        heads = json.loads(state["_heads"]) if state["_heads"] else []

        def load(n: int) -> list:
            return unpacked(only if len(heads) == 1 else self.blocks.getValue((n,))[0])

        def save(n: int, events: list) -> None:
            if len(runs.heads) == 1:
                state["_events"] = packed(events)
            else:
                # An only block has grown into several; the first of them changed with that.
                state["_events"] = None
                self.blocks.updateValue((n,), (packed(events),))

        runs = TimedRuns(heads, load, save)
        for row in rows:
            self._add(state, row, runs, users)
            if state["total_lines"] % self.every == 0:
                self._sum_up(state, runs)
                yield self._emit(key, "every_n", state)
        self._sum_up(state, runs)
        runs.flush()
        state["_heads"], state["_users"] = json.dumps(runs.heads), users.packed()
        self.counters.update(tuple(state[n] for n in self.fields))
        if self.timer_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timer_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.counters.exists():
            yield self._emit(key, "timeout", dict(zip(self.fields, self.counters.get())))
        for store in (self.counters, self.blocks, self.users):
            store.clear()

    def close(self) -> None:
        pass

    def _fresh(self, row: Event) -> dict:
        zeros = {c: 0 for c in LONGS} | {"_cpu": 0.0, "_memory": 0.0, "_disk": 0.0} | {"_heads": None, "_events": None, "_users": None}
        return zeros | {"_first": None, "_last": None, "seq": None, "priority": row.priority, "scheduling_class": row.scheduling_class}

    def _add(self, state: dict, row: Event, runs: TimedRuns, users: Names) -> None:
        code, time = row.event_type, row.time
        state["total_lines"] += 1
        state["seq"] = row.seq
        for name, codes in COUNTS.items():
            state[name] += code in codes
        state["unique_components"] += users.add((row.user,))
        if time > 0:
            state["_timed"] += 1
            state["_first"] = time if state["_first"] is None else min(state["_first"], time)
            state["_last"] = time if state["_last"] is None else max(state["_last"], time)
        for name, value in (("_cpu", row.cpu_request), ("_memory", row.memory_request), ("_disk", row.disk_request)):
            state[name] = max(state[name], value)
        runs.add(time, row.seq, FAILS if code in FAIL_EVENTS else SCHEDULES if code == SCHEDULE_EVENT else OTHER)

    def _sum_up(self, state: dict, runs: TimedRuns) -> None:
        whole = runs.whole()
        state["max_error_burst"], state["retry_count"] = whole[3], whole[6]

    def _emit(self, key: tuple, trigger: str, state: dict) -> Row:
        counts = [state[n] for n in [*LONGS, "seq", *INTS]]
        return self.made(key[0], trigger, counts, [state[n] for n in DOUBLES])


def event_stream(events: DataFrame, *, every: int = PREDICT_EVERY, timer_ms: int | None = 1000 * FLUSH_SECONDS) -> DataFrame:
    """Counter rows of a stream of scheduler events as of `traces.clean_events`, with `seq` as order of arrival."""
    # Rows are handed over cell by cell, so only what is counted travels.
    keyed = events.select(*[F.col("job_id").alias(c) if c == "process_id" else F.col(c) for c in Event._fields])
    counted = keyed.groupBy("process_id").transformWithState(
        statefulProcessor=EventCounter(every, timer_ms), outputStructType=output_type(), outputMode="Update",
        timeMode="ProcessingTime" if timer_ms is not None else "None")
    n = len(LONGS) + 1
    whole = named("counts", [*LONGS, "seq"]) + named("counts", [*LONGS, "seq", *INTS], "int")[n:] + named("sums", DOUBLES, "double")
    return counted.select("process_id", "trigger", *whole).select("process_id", "trigger", *counter_type().names)


def finish_events(rows: DataFrame) -> DataFrame:
    """Counter rows to features: the 36 of a job and the log1p columns."""
    span = F.when(F.col("_timed") >= 2, F.col("_last") - F.col("_first")).otherwise(0.0)
    keys = [c for c in ("seq", "trigger") if c in rows.columns]
    return with_log1p(finish_job_features(rows.withColumn("_span", span).withColumnRenamed("process_id", "job_id"), *keys))
