"""The keyed state of streamed incidents against the rules, event by event."""

import pytest
from pyspark.sql import functions as F

from haulscope.model.params import DEFAULT, MICROS
from haulscope.session import new_table
from haulscope.streaming import flows, incidents

SCHEMA = incidents.SIGNAL
T0 = 1_788_220_800 * MICROS  # rows at the epoch would be behind the first watermark
EMPTY = {c.split()[0]: None for c in incidents.SIGNAL.split(", ")}


def at(minute):
    return T0 + minute * 60 * MICROS


def minute_of(us):
    return None if us is None else (us - T0) // MICROS / 60


def signal(minute, rule=None, breach=None, **more):
    given = {"shipment_id": "s1", "rule": rule, "occurred_us": at(minute), "event_id": f"e{minute}", "breach": breach, "hold_us": 0, "severity": 1}
    return EMPTY | given | more


def run(spark, batches, guard_s=0.0, silences=False, delay="5 minutes"):
    """The incident table after ``batches``; a last row without shipment moves the clock an hour on."""
    path = new_table(spark, "signals")
    columns = [c.split()[0] for c in incidents.SIGNAL.split(", ")]
    end = max(s["occurred_us"] for b in batches for s in b)
    clock = EMPTY | {"occurred_us": end + 3600 * MICROS}
    for rows in [*batches, [clock]]:
        spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = incidents.topic(flows.file_source(spark, path, spark.read.parquet(path).schema, 1), delay)
    changes = incidents.incident_changes(stream, params=DEFAULT, guard_s=guard_s, silences=silences)
    out = new_table(spark, "incidents")
    flows.run_batches(changes, "incidents", incidents.upsert(out, changes.schema))
    return incidents.incident_rows(incidents.held_incidents(spark, out, changes.schema), F.lit(end).cast("bigint")).orderBy("onset_us").collect()


def late(minute, breach, **more):
    return signal(minute, incidents.LATE, breach, stop_id="A", observed=float(minute), note=f"n{minute}", recovery=more.pop("recovery", "BACK_WITHIN_WINDOW"), **more)


def test_an_incident_is_restated_escalated_and_ended(spark):
    rows = run(spark, [[late(1, True)], [late(2, True), late(3, True)], [late(20, True, severity=2, onset_us=at(0), recovery="ARRIVED_LATE")], [late(40, False)]])
    assert len(rows) == 1
    r = rows[0]
    assert (r.severity, r.state, r.restated, r.resolution) == ("CRITICAL", "CLEARED", 3, "ARRIVED_LATE")
    assert tuple(map(minute_of, (r.onset_us, r.raised_us, r.cleared_us))) == (1, 1, 20)
    assert (r.raised_detail, r.detail, r.raised_by, r.cleared_by) == ("n1", "n20", "e1", "e20")


def test_a_late_arrival_nobody_foresaw_is_raised_and_ended_at_once(spark):
    rows = run(spark, [[late(5, False)], [late(30, True, severity=2, onset_us=at(10), recovery="ARRIVED_LATE")]])
    assert [(*map(minute_of, (r.onset_us, r.raised_us, r.cleared_us)), r.open_s, r.restated) for r in rows] == [(10, 30, 30, 1200, 0)]


def test_one_open_incident_for_each_rule_and_stop(spark):
    both = [late(1, True), late(2, True) | {"stop_id": "B"}, signal(3, incidents.ASTRAY, True, excess=20.0, observed=20.0, threshold=12.0)]
    rows = run(spark, [both, [late(4, True), late(5, False) | {"stop_id": "B"}]])
    assert sorted((r.type, r.stop_id or "", r.state, r.restated) for r in rows) == [
        (incidents.LATE, "A", "OPEN", 1), (incidents.LATE, "B", "CLEARED", 0), (incidents.ASTRAY, "", "OPEN", 0)
    ]


def test_late_rows_are_put_in_order(spark):
    """A clearing heard before the breach it follows; what comes after the watermark has passed is ignored."""
    rows = run(spark, [[late(4, False), late(1, True)], [late(3, True), late(30, True)], [late(31, True)], [late(2, False)]])
    assert [(minute_of(r.onset_us), r.state, r.restated) for r in rows] == [(1, "CLEARED", 1), (30, "OPEN", 1)]


def test_a_breach_must_be_held(spark):
    hold = {"hold_us": 600 * MICROS, "excess": 13.0, "observed": 13.0, "threshold": 12.0, "recovery": "BACK_ON_ROUTE"}
    rows = [signal(m, incidents.ASTRAY, True, **hold) for m in (0, 5, 9)] + [signal(10, incidents.ASTRAY, False, **hold)]
    rows += [signal(m, incidents.ASTRAY, True, **hold | {"excess": float(m)}) for m in (20, 25, 30, 35)] + [signal(33, incidents.ASTRAY, None)]
    (r,) = run(spark, [rows[:5], rows[5:]])
    assert (minute_of(r.onset_us), minute_of(r.raised_us), r.restated, r.worst) == (20, 30, 1, 35.0)
    assert r.raised_detail == "30 km off the planned route for 10 minutes." and r.detail == "35 km off the planned route for 15 minutes."


@pytest.mark.parametrize("kind", ["position", "status", "estimate", "departure"])
def test_any_event_ends_a_silence(spark, kind):
    judged = {"position": {"rule": incidents.IDLE}, "estimate": {"rule": incidents.LATE, "breach": False, "stop_id": "A"}}.get(kind, {})
    rows = run(spark, [[signal(0)], [signal(50, **judged)], [signal(55)]], silences=True)
    told = [(minute_of(r.onset_us), minute_of(r.cleared_us), r.cleared_by, r.resolution) for r in rows]
    # the clock of the test goes on for an hour after the last event
    assert told == [(0, 50, "e50", "REPORTING_AGAIN"), (55, None, None, None)]


def test_the_final_arrival_ends_the_watch(spark):
    rows = run(spark, [[signal(0)], [signal(50, completes=True)], [signal(200)]], silences=True)
    assert [(minute_of(r.onset_us), r.resolution) for r in rows] == [(0, "SHIPMENT_COMPLETED")]


def test_a_replay_raises_no_silence(spark):
    """The event time of a backlog runs far ahead; in real time every shipment has just been heard from."""
    backlog = [[signal(0), signal(0) | {"shipment_id": "s2"}], [signal(300)], [signal(700)]]
    assert run(spark, backlog, silences=True, guard_s=30.0) == []
    assert {(r.shipment_id, r.state) for r in run(spark, backlog, silences=True)} == {("s1", "CLEARED"), ("s1", "OPEN"), ("s2", "OPEN")}
