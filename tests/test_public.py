"""The public view of an archive folded out of order and partly twice, on a few records."""

import ast
import inspect
import json
from collections import Counter
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import duckdb
import pytest

from haulscope.catalog import queries as catalog
from haulscope.catalog.oracle_base import compose
from haulscope.model.params import DEFAULT
from haulscope.plans import archive

SCHEMA = f"{archive.RECORD_SCHEMA}, headers array<struct<key:string,value:binary>>"
ONE, TWO, UNSEEN = "SHP-AB-00001", "SHP-AB-00002", "SHP-AB-00004"


def us(clock):
    h, m, s = (int(p) for p in clock.split(":"))
    return int(datetime(2026, 9, 1, h, m, s, tzinfo=timezone.utc).timestamp()) * 1_000_000


class Log:
    def __init__(self):
        self.rows = []

    def tell(self, topic, kind, ship, clock, heard=None, headers=(), cut=None, offset=None, **more):
        offset = len(self.rows) if offset is None else offset
        value = json.dumps({"eventId": f"e-{offset}", "type": kind, "shipmentId": ship, "occurredAt": f"2026-09-01T{clock}Z"} | more)
        self.rows.append((f"fleet.{topic}", 0, offset, us(heard or clock), ship, value[:cut], list(headers)))

    def position(self, ship, clock, heard, speed, **more):
        where = {"position": {"latitude": 1.5, "longitude": 2.5}, "speedKph": speed, "vehicleId": f"VEH-{ship[-5:]}"}
        self.tell("position", "position", ship, clock, heard, **where, **more)


def log_rows():
    log = Log()
    log.position(ONE, "02:00:00", "02:00:05", 50.0)
    log.position(ONE, "09:00:00", "09:00:05", 0.0)
    log.position(ONE, "09:00:00", "09:01:05", 0.0, offset=1_000)  # a repeat
    log.position(ONE, "05:30:00", "10:10:00", 70.0)  # late and older
    log.position(ONE, "09:30:00", "09:30:00", 80.0, cut=40)
    log.position(ONE, "11:00:00", "11:00:00", 90.0, headers=[(archive.REPLAY_HEADER, b"x")])
    log.position(TWO, "01:00:00", "01:00:00", 60.0)
    log.position(UNSEEN, "11:30:00", "11:30:00", 60.0)  # the archive of these queries lacks every ninth shipment's positions
    log.tell("status", "status", ONE, "02:00:00", status="IN_TRANSIT")
    log.tell("derived", "shipment.arrived", ONE, "03:00:00", stopId="S1")
    log.tell("derived", "shipment.departed", ONE, "04:30:00", stopId="S1")
    log.tell("derived", "shipment.arrived", ONE, "08:30:00", stopId="S2")
    raised = {"exceptionType": "LATE", "severity": "WARNING", "detail": "d", "observedValue": 2.0, "thresholdValue": 1.0}
    log.tell("exceptions", "exception.raised", ONE, "04:10:00", exceptionId="X1", **raised)
    log.tell("exceptions", "exception.cleared", ONE, "08:20:00", exceptionId="X1", exceptionType="LATE", raisedAt="2026-09-01T04:10:00Z", resolution="done")
    log.tell("exceptions", "exception.raised", ONE, "05:00:00", exceptionId="X2", stopId="S2", **raised)
    log.tell("exceptions", "exception.raised", UNSEEN, "05:20:00", exceptionId="X3", **raised)
    return log.rows


@pytest.fixture
def run(spark, monkeypatch):
    records = spark.createDataFrame(log_rows(), SCHEMA)
    monkeypatch.setattr(catalog, "_archived", lambda run: records)
    shipments = spark.createDataFrame([(s, "AB") for s in (ONE, TWO, UNSEEN)], "shipment_id string, lane string")
    plans = spark.createDataFrame([("AB", [("S1",), ("S2",), ("S3",)])], "lane string, stops array<struct<stop_id:string>>")
    return SimpleNamespace(spark=spark, params=DEFAULT, shipments=shipments, plans=plans)


def test_no_function_of_the_catalog_is_bound_twice():
    """Loops that write SQL run at import: a variable of theirs must not take a function's name."""
    body = ast.parse(inspect.getsource(catalog)).body
    functions = [n.name for n in body if isinstance(n, ast.FunctionDef)]
    others = {m.id for n in body if not isinstance(n, ast.FunctionDef) for m in ast.walk(n) if isinstance(m, ast.Name) and isinstance(m.ctx, ast.Store)}
    assert not others.intersection(functions)
    assert not [name for name, times in Counter(functions).items() if times > 1]


def test_fold_merge_counts_each_hour_once(run):
    got = {r.topic: (r.hours, r.events, r.skipped, r.unreadable, r.facts, r.newest_received_us) for r in catalog.fold_merge(run).collect()}
    assert got == {
        "fleet.position": (4, 5, 0, 1, 4, us("10:10:00")),
        "fleet.status": (1, 1, 1, 0, 0, us("02:00:00")),
        "fleet.derived": (3, 3, 0, 0, 3, us("08:30:00")),
        "fleet.exceptions": (3, 4, 0, 0, 4, us("08:20:00")),
    }


def test_public_summary_shows_the_newest_position_of_each_shipment(run):
    one, two = sorted(catalog.public_summary(run).collect(), key=lambda r: r.shipment_id)
    assert (one.shipment_id, one.vehicle_id, one.occurred_us, one.received_us) == (ONE, "VEH-00001", us("09:00:00"), us("09:00:05"))
    assert (one.stale_s, one.speed_kph, one.movement, one.at_stop_id, one.at_since_us) == (10_795, 0.0, "AT_STOP", "S2", us("08:30:00"))
    assert (one.stops_completed, one.stops_total, one.open_incidents, one.open_types, one.worst_severity) == (2, 3, 1, "LATE:S2", "WARNING")
    assert (two.shipment_id, two.occurred_us, two.stale_s, two.movement, two.at_stop_id) == (TWO, us("01:00:00"), 39_600, "MOVING", None)
    assert (two.stops_completed, two.stops_total, two.open_incidents, two.open_types, two.worst_severity) == (0, 3, 0, "", None)


def test_public_incidents_pair_raise_and_clear_of_any_hours(run):
    rows = {r.exception_id: r for r in catalog.public_incidents(run).collect()}
    assert {k: (r.shipment_id, r.stop_id, r.onset_us, r.cleared_us, r.resolution, r.state) for k, r in rows.items()} == {
        "X1": (ONE, None, us("04:10:00"), us("08:20:00"), "done", "CLEARED"),
        "X2": (ONE, "S2", us("05:00:00"), None, None, "OPEN"),
        "X3": (UNSEEN, None, us("05:20:00"), None, None, "OPEN"),
    }
    assert {(r.type, r.severity, r.detail, r.observed_value, r.threshold_value) for r in rows.values()} == {("LATE", "WARNING", "d", 2.0, 1.0)}


def test_public_incidents_of_events_without_a_time_equal_their_sql(spark, tmp_path):
    """Events without a time still count among those of their user, so the places of the others depend on them."""
    begin, rows = datetime(2024, 1, 1), []
    for user in (0, 1, 2, 7):
        for i in range(120):
            ts = None if i % 10 == user else begin + timedelta(hours=5 * i, minutes=user)
            rows.append((user * 1_000 + i, ts, user, "click", float(i % 50) if i % 13 else None))
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.QUERIES["public_incidents"](spark, str(tmp_path))
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({compose(catalog.ORACLES['public_incidents'])})").fetchall()
    assert want and Counter(map(tuple, df.collect())) == Counter(want)


def test_public_meta_counts_shipments_seen_and_open_incidents(run):
    (row,) = catalog.public_meta(run).collect()
    assert (row.tracked, row.open_incidents, row.source, row.through_us) == (2, 2, "archive", us("10:10:00"))
