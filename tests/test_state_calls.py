"""Streams keep a small process as one value of the state, and a large one whole."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from logrisk.plans import tables
from logrisk.streaming import events as live
from logrisk.streaming import monitor, names
from conftest import SMALL
from test_events import kind, plain_runs


class Store:
    """Value or map state of one key; counts the calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def containsKey(self, key):
        self.calls += 1
        return key in self.map

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def clear(self):
        self.value, self.map = None, {}


class Handle:
    def __init__(self):
        self.stores = {}

    def getValueState(self, name, schema):
        return self.stores.setdefault(name, Store())

    getMapState = lambda self, name, key, value: self.stores.setdefault(name, Store())

    def calls(self):
        return sum(s.calls for s in self.stores.values())


def test_a_line_process_is_one_value():
    counter = monitor.PrefixCounter(5, None, None, ["process_id"], ["seq"],
                                    [T.StructField("seq", T.LongType()), T.StructField("component", T.StringType())])
    handle, out = Handle(), []
    counter.init(handle)
    made = Row("process_id", "seq", "component", "pid", "ts_s", "bits")
    error = 1 << list(monitor.SUMMED).index("is_error")
    for part in range(3):
        rows = [made("p", 10 * part + k, f"c{k}", str(k % 4), k, error if k < 3 else 0) for k in range(10)]
        out += counter.handleInputRows(("p",), iter(rows), None)
    assert handle.calls() <= 6
    counts = [dict(zip(monitor.NUMBERS, r["counts"])) for r in out]
    assert [c["total_lines"] for c in counts] == [5, 10, 15, 20, 25, 30]
    assert (counts[-1]["unique_components"], counts[-1]["unique_pids"]) == (10, 4)
    assert (counts[-1]["error_count"], counts[-1]["max_error_burst"]) == (9, 3)


def test_many_names_go_on_in_the_map(monkeypatch):
    monkeypatch.setattr(names, "FEW", 3)
    store, held, new = Store(), None, 0
    for _ in range(3):
        met = names.Names(store, held)
        new += sum(met.add(("pid", str(k))) for k in [*range(10), *range(10)])
        held = met.packed()
    assert new == 10 and len(store.map) == 7


@pytest.mark.parametrize("block", [2, 7, 512])
def test_a_job_of_one_block_is_one_value(monkeypatch, block):
    monkeypatch.setattr(live, "BLOCK", block)
    r, handle, seen = random.Random(block), Handle(), []
    for part in range(6):
        counter = live.EventCounter(1, None)
        counter.init(handle)
        before, rows = handle.calls(), []
        for _ in range(9):
            seq = len(seen)
            seen.append((float(seq // 3 + r.choice([0, 0, -5, -40])), seq, r.choice([0, 1, 1, 2, 3, 5, 6, 8])))
            rows.append(live.Event("j", seq, seen[-1][0], seen[-1][2], 1, 2, 0.5, 0.1, 0.0, f"u{seq % 3}"))
        last = list(counter.handleInputRows(("j",), iter(rows), None))[-1]
        counts = dict(zip(live.LONGS, last["counts"]))
        assert (counts["max_error_burst"], counts["retry_count"]) == plain_runs(seen)
        assert (counts["total_lines"], counts["unique_components"]) == (len(seen), 3)
        if block == 512:
            assert handle.calls() - before <= 2
    state = dict(zip(counter.fields, handle.stores["counters"].value))
    assert (state["_events"] is None) == (block < 512) == bool(handle.stores["blocks"].map)
    blocks = handle.stores["blocks"].map or {(0,): (state["_events"],)}
    kept = sorted(e for packed, in blocks.values() for e in live.unpacked(packed))
    assert kept == sorted((t, s, kind(c)) for t, s, c in seen)


def test_a_small_file_is_dealt(spark):
    """Lines of a file of one split are made in as many tasks as a shuffle has."""
    plan = tables.event_stream(spark, SMALL)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression [event_id" in plan
