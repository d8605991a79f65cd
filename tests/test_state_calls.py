"""What the keyed states of streams cost: calls to the state store for a shipment in a batch, and the files of a batch."""

import collections
import json

import pytest
from pyspark.sql import Row, functions as F

from haulscope.catalog import queries as catalog
from haulscope.catalog.context import Run
from haulscope.model.params import DEFAULT, MICROS
from haulscope.streaming import flows, incidents, tracking

T0 = 1_788_220_800 * MICROS


class Clock:
    def __init__(self, us):
        self.ms = us // 1000

    def getCurrentWatermarkInMs(self):
        return self.ms


class Handle:
    """A state store in memory that counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers, self.values = collections.Counter(), set(), {}

    def getValueState(self, name, *schema):
        return State(self, name)

    getMapState = getListState = getValueState

    def listTimers(self):
        self.calls["listTimers"] += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls["registerTimer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls["deleteTimer"] += 1
        self.timers.remove(at)


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def __getattr__(self, call):
        def called(*given):
            self.handle.calls[call] += 1
            held = self.handle.values
            if call == "update":
                held[self.name] = given[0]
            elif call == "clear":
                held.pop(self.name, None)
            elif call == "updateValue":
                held.setdefault(self.name, {})[given[0]] = given[1]
            elif call == "removeKey":
                del held[self.name][given[0]]
            elif call == "iterator":
                return iter([*held.get(self.name, {}).items()])
            elif call == "exists":
                return self.name in held
            return held.get(self.name)

        return called


def begun(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def test_waiting_signals_cost_one_read_and_one_write():
    processor = incidents.IncidentProcessor(DEFAULT)
    handle = begun(processor)
    lines = [Row(signal=f'{T0 + m * 60 * MICROS} {{"event_id":"e{m}","excess":"NaN"}}') for m in range(30)]
    assert list(processor.handleInputRows(("s1",), lines[:20], Clock(T0 - MICROS))) == []
    assert list(processor.handleInputRows(("s1",), lines[20:], Clock(T0 + 9 * 60 * MICROS))) == []
    assert handle.calls == {"get": 2, "update": 2, "registerTimer": 2, "deleteTimer": 1}
    assert handle.timers == {(T0 + 600 * MICROS) // 1000 - 1} and handle.values["seen"][0] == T0 + 9 * 60 * MICROS
    # the last line is over: what waited is gone, and the silence after it is found when the clock is past it
    handle.timers.clear()
    (told,) = processor.handleExpiredTimer(("s1",), Clock(T0 + 30 * 3600 * MICROS), None)
    assert told.rule == incidents.QUIET and told.onset_us == T0 + 29 * 60 * MICROS and handle.values["seen"][-1] is None


def test_a_line_gives_back_its_signal(spark):
    given = {"rule": "R", "stop_id": 'a"\n b', "event_id": "é 1", "breach": True, "hold_us": 2**60, "excess": 0.1, "observed": float("inf"), "note": ""}
    signal = incidents._BLANK | given | {"shipment_id": "s", "occurred_us": T0 + 1}
    row = spark.createDataFrame([tuple(signal.values())], incidents.SIGNAL).select(incidents._line().alias("line")).first()
    assert incidents._parsed(T0 + 1, row.line) == signal | {"shipment_id": None} and "\n" not in row.line


def test_a_track_costs_one_read_and_one_write():
    processor = tracking.TrackProcessor(DEFAULT)
    handle = begun(processor)

    def fix(i, at, event_id=None, **more):
        sides = {"stops": ["A", "B"], "labels": [tracking.IN, tracking.OUT], "road_km": [0.1, 20.0]}
        return Row(occurred_us=T0 + at * MICROS, fix=json.dumps(sides | {"event_id": event_id or i, "speed_kph": 40.0} | more))

    away = {"labels": [tracking.OUT, tracking.OUT], "road_km": [9.0, 11.0]}
    # repeats of an instant: the lowest id counts
    first = [fix(2, 100), fix(1, 0), fix(3, 0, labels=[tracking.OUT, tracking.OUT]), fix(4, 200)]
    second = [fix(5, 200, **away), fix(6, 300, **away), fix(7, 500, accuracy_m=5.0, **away)]
    told = [*processor.handleInputRows(("s",), first, None), *processor.handleInputRows(("s",), second, None)]
    assert handle.calls == {"get": 2, "update": 2}
    assert [(r.type, r.stop_id, (r.occurred_us - T0) // MICROS, r.caused_by) for r in told] == [
        ("shipment.arrived", "A", 0, "4"), ("shipment.departed", "A", 300, "7"), ("eta.updated", "B", 300, "6"), ("eta.updated", "B", 500, "7")
    ]
    # a batch of rows that are older costs a read
    assert list(processor.handleInputRows(("s",), first, None)) == [] and handle.calls == {"get": 3, "update": 2}


def test_silences_keep_their_timer():
    processor = tracking.SilenceProcessor(2700 * MICROS)
    handle = begun(processor)
    row = lambda s: Row(occurred_us=T0 + s * MICROS, event_id=s, completed=False)
    assert list(processor.handleInputRows(("s",), [row(60), row(0)], None)) == []
    told = list(processor.handleInputRows(("s",), [row(4000), row(50)], None))
    assert [(r.change, r.onset_us, r.caused_by) for r in told] == [("raised", T0 + 60 * MICROS, "60"), ("cleared", T0 + 60 * MICROS, "4000")]
    assert handle.calls == {"get": 2, "update": 2, "registerTimer": 2, "deleteTimer": 1} and handle.timers == {(T0 + 6700 * MICROS) // 1000}
    handle.timers.clear()
    assert [r.change for r in processor.handleExpiredTimer(("s",), None, None)] == ["raised"]
    assert [r.change for r in processor.handleInputRows(("s",), [row(9000)], None)] == ["cleared"]
    assert handle.timers == {(T0 + 11_700 * MICROS) // 1000} and not handle.calls["listTimers"]


def test_a_gate_keeps_its_timer():
    processor = flows.GateProcessor(900 * MICROS)
    handle = begun(processor)
    row = lambda s, kind="position": Row(type=kind, shipment_id="s", at_us=s, heard_us=T0 + s * MICROS, offset=s, payload="{}")
    heard = [[row(500), row(0), row(10, "status")], [row(899)], [row(900), row(950, "status")]]
    told = [[r.at_us for r in processor.handleInputRows(("s",), rows, None)] for rows in heard]
    assert told == [[0, 10], [], [900, 950]]
    assert handle.calls == {"get": 3, "update": 2, "registerTimer": 2, "deleteTimer": 1} and handle.timers == {(T0 + 1800 * MICROS) // 1000 + 1}


@pytest.mark.parametrize("file_rows, files", [(100_000, 1), (25, 4)])
def test_a_micro_batch_is_several_files(spark, monkeypatch, file_rows, files):
    monkeypatch.setattr(catalog, "FILE_ROWS", file_rows, raising=False)
    # the third batch has no row, the last one row
    rows = spark.range(400).select("id", F.when(F.col("id") < 399, F.col("id") % 200).otherwise(399).alias("at"))
    seen = {}
    stream = catalog._as_stream(Run(spark, ""), rows, "at").withColumn("path", F.input_file_name())
    flows.run_batches(stream, "files", lambda batch, k: seen.update({k: [(r.id, r.at, r.path) for r in batch.collect()]}))
    told = {k: sorted(r[:2] for r in v) for k, v in seen.items()}
    want = {k: sorted((r.id, r["at"]) for r in rows.collect() if r["at"] // 100 == k) for k in range(4)}
    assert {k: told.get(k, []) for k in range(4)} == want and set(told) <= set(range(4))
    assert [len({r[2] for r in seen[k]}) for k in (0, 1, 3)] == [files, files, 1]


def test_stays_cross_batches_as_text():
    """A visit whose run inside, proof and departure come in three batches."""
    processor = tracking.TrackProcessor(DEFAULT)
    handle = begun(processor)

    def told(*rows):
        fixes = [Row(occurred_us=T0 + at * MICROS, fix=json.dumps({"event_id": at, "stops": ["A"], "labels": [side], "road_km": [0.0]})) for at, side in rows]
        events = processor.handleInputRows(("s",), fixes, None)
        return [(r.type, (r.occurred_us - T0) // MICROS, r.dwell_s) for r in events if r.type != "eta.updated"]

    assert told((0, tracking.IN), (100, tracking.BETWEEN)) == []
    assert told((180, tracking.UNUSABLE), (181, tracking.BETWEEN)) == [("shipment.arrived", 0, None)]
    assert told((400, tracking.OUT), (580, tracking.OUT)) == [("shipment.departed", 400, 400)]
    assert told((9000, tracking.IN), (9900, tracking.IN)) == [] and handle.calls == {"get": 4, "update": 4}
