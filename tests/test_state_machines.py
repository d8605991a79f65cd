"""Set-oriented operators against sequential state machines, on tracks cut into slices of many widths."""

import random

import pytest
from pyspark.sql import functions as F

from haulscope.model.params import DEFAULT
from haulscope.operators import conditions, eta, geofence, positions
from haulscope.sources import plan
from tests import tracks

SCHEMA = (
    "event_id bigint, shipment_id string, lane string, occurred_us bigint, received_us bigint, lat double, lon double, "
    "speed_kph double, accuracy_m double, temp_c double, setpoint_c double"
)


def frame(spark, rows):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def stops(spark):
    return spark.createDataFrame(
        [("TST", "r", s[0], s[1], s[0], "x", "y", s[2], s[3], s[4], "DELIVERY", 60) for s in tracks.STOPS],
        "lane string, route_id string, stop_id string, seq bigint, name string, city string, state string, lat double, "
        "lon double, radius_m double, kind string, dwell_s bigint",
    )


@pytest.fixture(scope="module")
def many():
    """One long track beside short ones: the hot shipment has most of the rows."""
    rows = tracks.random_track(1, 900)
    for k in range(2, 12):
        rows += [dict(r, event_id=r["event_id"] + 10_000 * k) for r in tracks.random_track(k, 90, f"SHP-TST-{k:04d}")]
    random.Random(0).shuffle(rows)
    return rows


def by_ship(rows):
    out = {}
    for r in rows:
        out.setdefault(r["shipment_id"], []).append(r)
    return out


@pytest.mark.parametrize("width, rows", [(300, 10**9), (3600, 10**9), (10**9, 10**9), (10**9, 40), (3600, 7)])
def test_visits_and_estimates(spark, stops, many, width, rows):
    p = DEFAULT.but(slice_seconds=width, slice_rows=rows)
    track = positions.one_per_instant(frame(spark, many), p)
    sides = geofence.fix_stop_sides(track, stops, p)
    visited = geofence.visits(sides, p)
    got = {
        (r.shipment_id, r.stop_id): (r.arrived_us, r.arrival_caused_by, r.departed_us, r.departure_caused_by)
        for r in visited.collect()
    }
    published = {}
    for r in eta.estimates(track, sides, visited, stops, p).orderBy("occurred_us").collect():
        published.setdefault(r.shipment_id, []).append((r.stop_id, int(r.caused_by), r.estimate_us, r.previous_us))
    want, want_eta = {}, {}
    for ship, rows in by_ship(many).items():
        visits, out = tracks.run_fences(rows)
        want.update({(ship, stop): v for stop, v in visits.items()})
        if out:
            want_eta[ship] = out
    assert got == want and len(want) > 5
    assert published == want_eta


@pytest.mark.parametrize("width, rows", [(300, 10**9), (7200, 10**9), (7200, 11)])
def test_excursions(spark, many, width, rows):
    p = DEFAULT.but(slice_seconds=width, slice_rows=rows, excursion_seconds=300)
    terms = spark.createDataFrame([], "shipment_id string, min_c double, max_c double, tolerance_s bigint, cold_chain boolean")
    track = positions.one_per_instant(frame(spark, many), p)
    got = {}
    for r in conditions.temperature_excursions(track, terms, p).orderBy("onset_us").collect():
        got.setdefault(r.shipment_id, []).append((r.onset_us, r.raised_us, round(r.worst, 6), r.cleared_us))

    def judge(r):
        if r["setpoint_c"] is None:
            return None
        return r["temp_c"] > 7, max(0.0, r["temp_c"] - 7)

    want = {}
    for ship, rows in by_ship(many).items():
        found = tracks.run_condition(rows, judge, 300)
        if found:
            want[ship] = [(a, b, round(c, 6), d) for a, b, c, d in found]
    assert got == want and sum(map(len, want.values())) > 20


def test_silences(spark, many):
    p = DEFAULT.but(silence_seconds=300, slice_seconds=600)
    none = spark.createDataFrame([], "shipment_id string, completed_us bigint")
    terms = spark.createDataFrame([], "shipment_id string, cold_chain boolean")
    track = positions.one_per_instant(frame(spark, many), p)
    got = {(r.shipment_id, r.onset_us, r.cleared_us) for r in conditions.signal_loss(track, none, terms, p).collect()}
    newest, want = max(r["occurred_us"] for r in many), set()
    for ship, rows in by_ship(many).items():
        at = sorted({r["occurred_us"] for r in rows})
        want |= {(ship, a, b) for a, b in zip(at, at[1:]) if b - a >= 300 * tracks.US}
        if newest - at[-1] >= 300 * tracks.US:
            want.add((ship, at[-1], None))
    assert got == want and any(c is None for _, _, c in want)


def test_order_and_repeats_do_not_matter(spark, stops, many):
    def result(rows):
        track = positions.one_per_instant(frame(spark, rows))
        return sorted(map(tuple, geofence.visits_of_track(track, stops).collect()))

    shuffled = list(many) + random.Random(3).sample(many, 200)
    random.Random(4).shuffle(shuffled)
    assert result(many) == result(shuffled)


def test_late_rows_and_trail(spark, many):
    rows = frame(spark, many)
    late = {r.event_id for r in positions.late_rows(rows, DEFAULT.but(slice_seconds=900)).collect()}
    want = set()
    for ship in by_ship(many).values():
        top = None
        for r in sorted(ship, key=lambda r: (r["received_us"], r["event_id"])):
            if top is not None and r["occurred_us"] <= top:
                want.add(r["event_id"])
            top = r["occurred_us"] if top is None else max(top, r["occurred_us"])
    assert late == want and want


def test_thinning(spark, many):
    p = DEFAULT.but(gate_millis=600_000, slice_seconds=900)
    got = {r.event_id for r in positions.thin(frame(spark, many), p).collect()}
    want = set()
    for ship in by_ship(many).values():
        last = None
        for r in sorted(ship, key=lambda r: (r["received_us"], r["event_id"])):
            if last is None or r["received_us"] - last >= 600 * tracks.US:
                want.add(r["event_id"])
                last = r["received_us"]
    assert got == want


def fix(event_id, at, lat, **more):
    base = dict(
        event_id=event_id, shipment_id="SHP-TST-0001", lane="TST", occurred_us=at * tracks.US, received_us=at * tracks.US, lat=lat, lon=20.0,
        speed_kph=0.0, accuracy_m=3.0, temp_c=None, setpoint_c=None,
    )
    return {**base, **more}


def test_drive_through_and_exact_dwell(spark, stops):
    def arrivals(rows):
        return geofence.visits_of_track(positions.one_per_instant(frame(spark, rows)), stops).count()

    assert arrivals([fix(1, 0, 10.0), fix(2, 179, 10.0), fix(3, 200, 10.3)]) == 0
    assert arrivals([fix(1, 0, 10.0), fix(2, 180, 10.0)]) == 1
    # an inaccurate fix confirms nothing
    assert arrivals([fix(1, 0, 10.0), fix(2, 180, 10.0, accuracy_m=101.0)]) == 0


def test_unknown_accuracy_does_not_cost_confidence(spark):
    df = spark.createDataFrame(
        [(900, 0.0, 0, 0, None), (900, 0.0, 0, 0, 250.0)],
        "moving_s bigint, gap_s double, occurred_us bigint, last_moving_us bigint, accuracy_m double",
    )
    assert [r.confidence for r in eta.confidence(df).collect()] == [1.0, 0.5]


def test_leg_distance_ends(spark):
    legs = [((10.0, 20.0), (10.1, 20.0))]
    df = spark.createDataFrame([(9.9, 20.0), (10.2, 20.0), (10.05, 20.1)], "lat double, lon double").withColumn(
        "legs", F.array(F.struct(*[F.lit(v).alias(n) for n, v in zip(("lat_a", "lon_a", "lat_b", "lon_b"), (*legs[0][0], *legs[0][1]))]))
    )
    km = [r[0] for r in df.select(positions.off_plan_km(F.col("lat"), F.col("lon"), F.col("legs"))).collect()]
    assert km[0] == pytest.approx(tracks.meters(9.9, 20, 10, 20) / 1000)
    assert km[1] == pytest.approx(tracks.meters(10.2, 20, 10.1, 20) / 1000)
    assert km[2] == pytest.approx(10.95, abs=0.01)


def test_lanes_have_one_final_stop(spark):
    assert plan.final_stops(plan.lane_stops(spark)).count() == 4
