"""The registered queries, each next to the SQL that computes the same from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.catalog import oracle_ingest
from haulscope.catalog.context import NOW_US, Run, tidy
from haulscope.catalog.oracle_base import (
    INCIDENT_COLUMNS, brg, compose, dist, instant, minutes, part, sev_name, sev_rank, up, uuid3,
)
from haulscope.fixtures import archive as archive_fixtures
from haulscope.functions import geo, ids, text
from haulscope.functions.text import abbreviate, first_line, lane_code, round_half_up, safe_int
from haulscope.functions.timeparts import day_text, int_div, hour_start_us, hour_text, instant_text, instant_us
from haulscope.model.contracts import CONTRACTS
from haulscope.model.params import MICROS
from haulscope.operators import asof, conditions, contracts, eta, geofence, manifests, positions, reconcile, slices
from haulscope.plans import archive, events as ev, fleet as fleet_plan, ingest, live, public, reference
from haulscope.session import new_table, stage
from haulscope.sources import plan
from haulscope.streaming import closing, flows, incidents, tracking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def register(build: Callable[[Run], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, sf_dir: build(Run(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = oracle
        return build

    return register


def pick(source: str, plain: str, doubles: str = "", places: int = 6) -> str:
    """SELECT with the doubles rounded as ``tidy`` does."""
    columns = plain.split() + [f"{up(c, places)} AS {c}" for c in doubles.split()]
    return f"SELECT {', '.join(columns)} FROM {source}"


FIX_PLAIN = "event_id user_id lane shipment_id vehicle_id tracker_id probe_id occurred_us received_us"
FIX_DOUBLE = "lat lon speed_kph accuracy_m temp_c setpoint_c"
INCIDENT_DOUBLE = ("raised_value", "observed_value", "threshold_value", "worst")
INCIDENT_SELECT = ", ".join(
    f"{up(c, 6)} AS {c}" if c in INCIDENT_DOUBLE else ("CAST(restated AS BIGINT) AS restated" if c == "restated" else c)
    for c in INCIDENT_COLUMNS.split(", ")
)


# --- plan and fixes ------------------------------------------------------------------------------


@query(pick("fixes", FIX_PLAIN, FIX_DOUBLE))
def fleet_fixes(run: Run) -> DataFrame:
    return tidy(run.fixes)


@query(
    "SELECT shipment_id, s.lane, s.route_id, s.stop_id, s.seq, s.name, s.kind, s.radius_m FROM (SELECT DISTINCT shipment_id, lane FROM fixes) JOIN lane_stop s USING (lane)"
)
def plan_stops(run: Run) -> DataFrame:
    return plan.itineraries(run.shipments, run.stops).select(
        "shipment_id", "lane", "route_id", "stop_id", "seq", "name", "kind", "radius_m"
    )


@query("SELECT count(DISTINCT shipment_id) AS shipments, count(*) AS scheduled_stops FROM (SELECT DISTINCT shipment_id, lane FROM fixes) JOIN lane_stop USING (lane)")
def plan_census(run: Run) -> DataFrame:
    sizes = run.shipments.withColumn("lane", lane_code(F.col("shipment_id"))).join(run.plans, "lane")
    return sizes.agg(F.count(F.lit(1)).alias("shipments"), F.sum(F.size("stops").cast("bigint")).alias("scheduled_stops"))


@query(
    f"""SELECT lane, shipments, {up('m', 3)} AS route_m, {up('m / 1000.0::DOUBLE * 1.30::DOUBLE', 3)} AS road_km, planned_dwell_s,
    shipments * planned_dwell_s AS fleet_dwell_s
  FROM (SELECT lane, count(DISTINCT shipment_id) AS shipments FROM fixes GROUP BY lane)
  JOIN (SELECT lane, sum({dist('lat_a', 'lon_a', 'lat_b', 'lon_b')}) AS m FROM lane_leg GROUP BY lane) USING (lane)
  JOIN (SELECT lane, CAST(sum(dwell_s) AS BIGINT) AS planned_dwell_s FROM lane_stop GROUP BY lane) USING (lane)"""
)
def route_totals(run: Run) -> DataFrame:
    fleet = run.shipments.groupBy("lane").agg(F.count(F.lit(1)).alias("shipments"))
    totals = plan.route_totals(run.stops, run.params.circuity).drop("stops")
    return tidy(fleet.join(totals, "lane").withColumn("fleet_dwell_s", F.col("shipments") * F.col("planned_dwell_s")), 3)


@query(
    f"""SELECT event_id, stop_id, {up('m', 3)} AS meters, {up('CASE WHEN b >= 360 THEN 0.0::DOUBLE ELSE b END', 6)} AS bearing_deg,
    {up('degrees(lat2) + 0.00000003::DOUBLE', 6)} AS back_lat, {up('0.00000003::DOUBLE + lon0 + degrees(atan2(sin(th) * sin(arc) * cos(radians(lat0)), cos(arc) - sin(radians(lat0)) * sin(lat2)))', 6)} AS back_lon
  FROM (SELECT *, radians(b) AS th, asin(sin(radians(lat0)) * cos(m / 6371008.8::DOUBLE) + cos(radians(lat0)) * sin(m / 6371008.8::DOUBLE) * cos(radians(b))) AS lat2,
      m / 6371008.8::DOUBLE AS arc FROM (
    SELECT f.event_id, s.stop_id, s.lat AS lat0, s.lon AS lon0, {dist('s.lat', 's.lon', 'f.lat', 'f.lon')} AS m,
      CASE WHEN degrees({brg('s.lat', 's.lon', 'f.lat', 'f.lon')}) < 0 THEN degrees({brg('s.lat', 's.lon', 'f.lat', 'f.lon')}) + 360 ELSE degrees({brg('s.lat', 's.lon', 'f.lat', 'f.lon')}) END AS b
    FROM fixes f JOIN lane_stop s USING (lane) WHERE s.seq = 0))"""
)
def geo_functions(run: Run) -> DataFrame:
    """Distance and bearing from the first stop to each fix, and the point reached by going that way."""
    origin = run.stops.where("seq = 0").select("lane", "stop_id", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    df = run.fixes.join(origin, "lane")
    at = [F.col(c) for c in ("lat0", "lon0", "lat", "lon")]
    df = df.withColumns({"meters": geo.haversine_m(*at), "bearing_deg": geo.initial_bearing_deg(*at)})
    df = df.withColumn("back", geo.destination(F.col("lat0"), F.col("lon0"), F.col("bearing_deg"), F.col("meters")))
    return df.select(
        "event_id", "stop_id", round_half_up(F.col("meters"), 3).alias("meters"), round_half_up(F.col("bearing_deg"), 6).alias("bearing_deg"),
        round_half_up(F.col("back.latitude") + 0.00000003, 6).alias("back_lat"), round_half_up(F.col("back.longitude") + 0.00000003, 6).alias("back_lon"),
    )


@query(
    f"""SELECT shipment_id, stop_id, i AS point, {up('s.lon + radius_m / 111320.0::DOUBLE / cos(radians(s.lat)) * cos(i / 32.0::DOUBLE * 2.0::DOUBLE * pi())', 6)} AS lon,
    {up('s.lat + radius_m / 111320.0::DOUBLE * sin(i / 32.0::DOUBLE * 2.0::DOUBLE * pi())', 6)} AS lat
  FROM (SELECT DISTINCT shipment_id, lane FROM fixes) JOIN lane_stop s USING (lane), (SELECT CAST(range AS BIGINT) AS i FROM range(33))"""
)
def geofence_polygons(run: Run) -> DataFrame:
    rings = plan.itineraries(run.shipments, run.stops).withColumn("ring", geo.ring(F.col("lat"), F.col("lon"), F.col("radius_m")))
    return tidy(
        rings.select("shipment_id", "stop_id", F.posexplode("ring").alias("point", "p")).select(
            "shipment_id", "stop_id", F.col("point").cast("bigint").alias("point"), F.col("p.longitude").alias("lon"), F.col("p.latitude").alias("lat")
        )
    )


@query(
    f"""SELECT event_id, {uuid3("'TELEMATICS'", 'tracker_id', instant('occurred_us'), "''")} AS source_event_id, {instant('occurred_us')} AS occurred_text,
    occurred_us // 3600000000 * 3600000000 AS hour_us, strftime(make_timestamp(occurred_us), '%Y-%m-%d') AS dt, strftime(make_timestamp(occurred_us), '%H') AS hour,
    {minutes('received_us - occurred_us')} AS lag_minutes, lane AS lane_code, floor(-value + 0.5::DOUBLE) AS rounded_up,
    coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN ' ' || event_id || ' ' WHEN event_id % 3 = 1 THEN 'x' || event_id END AS BIGINT), 0) AS safe_number,
    'line ' || event_id AS first_line,
    CASE WHEN length(repeat('ab', 18) || event_id) <= 40 THEN repeat('ab', 18) || event_id ELSE substr(repeat('ab', 18) || event_id, 1, 40) || '...' END AS short,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS json_k
  FROM fixes JOIN (SELECT event_id, value, props FROM events) USING (event_id)"""
)
def scalar_functions(run: Run) -> DataFrame:
    """Identifiers, instants, roundings and text helpers over every fix."""
    e = F.col("event_id")
    source = run.spark.read.parquet(f"{run.sf_dir}/events.parquet").select("event_id", "value", "props")
    df = run.fixes.join(source, "event_id")
    text = F.when(e % 3 == 0, F.concat(F.lit(" "), e.cast("string"), F.lit(" "))).when(e % 3 == 1, F.concat(F.lit("x"), e.cast("string")))
    at = instant_text(F.col("occurred_us"))
    return df.select(
        "event_id",
        ids.source_event_id(F.lit("TELEMATICS"), F.col("tracker_id"), at, F.lit("")).alias("source_event_id"),
        at.alias("occurred_text"),
        hour_start_us(instant_us(at)).alias("hour_us"),
        day_text(F.col("occurred_us")).alias("dt"),
        hour_text(F.col("occurred_us")).alias("hour"),
        int_div(F.col("received_us") - F.col("occurred_us"), 60 * MICROS).alias("lag_minutes"),
        lane_code(F.col("shipment_id")).alias("lane_code"),
        round_half_up(-F.col("value"), 0).alias("rounded_up"),
        safe_int(text).cast("bigint").alias("safe_number"),
        first_line(F.concat(F.lit("line "), e.cast("string"), F.lit("\nsecond"))).alias("first_line"),
        abbreviate(F.concat(F.lit("ab" * 18), e.cast("string"))).alias("short"),
        F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("json_k"),
    )


# --- positions -----------------------------------------------------------------------------------

part(
    "newest",
    "SELECT * FROM fixes QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY occurred_us DESC, event_id) = 1",
)


@query(pick("newest", FIX_PLAIN, FIX_DOUBLE))
def current_position(run: Run) -> DataFrame:
    return tidy(run.current)


part(
    "near",
    f"""SELECT event_id, arg_min(stop_id, m) AS nearest_stop_id, min(m) AS nearest_m FROM (
    SELECT event_id, s.stop_id, {dist('f.lat', 'f.lon', 's.lat', 's.lon')} AS m FROM fixes f JOIN lane_stop s USING (lane)) GROUP BY event_id""",
)


@query(f"SELECT event_id, nearest_stop_id, {up('nearest_m', 3)} AS nearest_m FROM near")
def nearest_stop(run: Run) -> DataFrame:
    df = positions.nearest_stop(positions.with_plan(run.fixes, run.plans))
    return df.select("event_id", "nearest_stop_id", round_half_up(F.col("nearest_m"), 3).alias("nearest_m"))


@query(f"SELECT event_id, {up('km', 6)} AS off_plan_km FROM leg_fact")
def leg_distance(run: Run) -> DataFrame:
    df = positions.with_plan(run.track, run.plans)
    km = positions.off_plan_km(F.col("lat"), F.col("lon"), F.col("legs"))
    return df.select("event_id", round_half_up(km, 6).alias("off_plan_km"))


@query("SELECT count(*) AS fixes, count(*) FILTER (WHERE lane = 'BOM') AS unplanned FROM fixes")
def unplanned_fixes(run: Run) -> DataFrame:
    """Fixes of shipments without a plan, when one lane is missing from the catalogue."""
    known = run.plans.where("lane <> 'BOM'")
    missing = positions.unplanned(run.fixes, known).select(F.lit(0).alias("one"), F.lit(1).alias("unplanned"))
    return run.fixes.select(F.lit(1).alias("one"), F.lit(0).alias("unplanned")).union(missing).agg(
        F.sum("one").alias("fixes"), F.sum("unplanned").alias("unplanned")
    )


@query(f"SELECT {up('min(lat)', 6)} AS min_lat, {up('max(lat)', 6)} AS max_lat, {up('min(lon)', 6)} AS min_lon, {up('max(lon)', 6)} AS max_lon FROM newest")
def fleet_bounds(run: Run) -> DataFrame:
    return tidy(positions.fleet_bounds(run.current))


@query(
    f"SELECT count(*) FILTER (WHERE speed_kph >= 5) AS moving, count(*) AS vehicles, {up('avg(speed_kph) FILTER (WHERE speed_kph >= 5)', 6)} AS avg_moving_kph FROM newest"
)
def fleet_speed(run: Run) -> DataFrame:
    return tidy(positions.fleet_speed(run.current, run.params))


@query(pick("newest ORDER BY occurred_us DESC, event_id DESC LIMIT 500", "shipment_id event_id occurred_us", "lat lon"))
def recent_positions(run: Run) -> DataFrame:
    df = run.current.select("shipment_id", "event_id", "occurred_us", "lat", "lon")
    return tidy(df.orderBy(F.desc("occurred_us"), F.desc("event_id")).limit(run.params.recent_positions))


@query(
    pick(
        "(SELECT * FROM fixes QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY occurred_us DESC, event_id DESC) <= 300)",
        "shipment_id event_id occurred_us", "lat lon speed_kph",
    )
)
def track_last_n(run: Run) -> DataFrame:
    """The newest 300 fixes of each shipment, oldest first."""
    df = run.fixes.select("shipment_id", "event_id", "occurred_us", "lat", "lon", "speed_kph")
    return positions.in_track_order(tidy(positions.last_n(df, run.params.track_points)))


part(
    "trail_point",
    """SELECT * FROM (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM track WINDOW w AS (PARTITION BY shipment_id ORDER BY occurred_us))
  WHERE lat IS DISTINCT FROM p_lat OR lon IS DISTINCT FROM p_lon
  QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY occurred_us DESC, event_id DESC) <= 60""",
)


@query(pick("trail_point", "shipment_id event_id occurred_us", "lat lon"))
def trail(run: Run) -> DataFrame:
    return tidy(positions.trail(run.fixes, run.params).drop("slice"))


@query(
    f"""SELECT shipment_id, count(*) AS points, {up('arg_min(lat, occurred_us)', 6)} AS first_lat, {up('arg_max(lon, occurred_us)', 6)} AS last_lon
  FROM trail_point GROUP BY shipment_id HAVING count(*) >= 2"""
)
def trail_lines(run: Run) -> DataFrame:
    lines = positions.linestrings(positions.trail(run.fixes, run.params))
    return tidy(
        lines.select(
            "shipment_id",
            F.size("points").cast("bigint").alias("points"),
            F.element_at("points", 1)["lat"].alias("first_lat"),
            F.element_at("points", -1)["lon"].alias("last_lon"),
        )
    )


@query(
    f"""SELECT shipment_id, string_agg(CAST({up('lon', 4)} AS VARCHAR) || ' ' || CAST({up('lat', 4)} AS VARCHAR), ',' ORDER BY occurred_us, event_id) AS line
  FROM trail_point GROUP BY shipment_id HAVING count(*) >= 2"""
)
def trail_text(run: Run) -> DataFrame:
    """The whole line of each trail, point by point."""
    lines = positions.linestrings(positions.trail(run.fixes, run.params))
    number = lambda c: round_half_up(c, 4).cast("string")
    points = F.transform("points", lambda p: F.concat(number(p["lon"]), F.lit(" "), number(p["lat"])))
    return lines.select("shipment_id", F.array_join(points, ",").alias("line"))


@query("SELECT event_id, shipment_id, received_us FROM fixes")
def dedup_events(run: Run) -> DataFrame:
    """Repeats (event_id % 37 = 0, a minute later) drop out again."""
    fixes = run.fixes.select("event_id", "shipment_id", "received_us")
    repeats = fixes.where("event_id % 37 = 0").withColumn("received_us", F.col("received_us") + 60 * MICROS)
    return positions.dedup(fixes.unionByName(repeats))


@query(
    """SELECT event_id, shipment_id, occurred_us, seen_us FROM (SELECT event_id, shipment_id, occurred_us, max(occurred_us) OVER
    (PARTITION BY shipment_id ORDER BY received_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_us FROM fixes)
  WHERE occurred_us <= seen_us"""
)
def late_rows(run: Run) -> DataFrame:
    return positions.late_rows(run.fixes, run.params).select("event_id", "shipment_id", "occurred_us", "seen_us")


part(
    "gate_row",
    """SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY received_us) AS rn FROM
  (SELECT event_id, shipment_id, received_us FROM fixes QUALIFY row_number() OVER (PARTITION BY shipment_id, received_us ORDER BY event_id) = 1)""",
)
part(
    "gate_pass",
    """RECURSIVE gate_pass AS (
    SELECT event_id, shipment_id, received_us, rn, true AS kept, received_us AS held FROM gate_row WHERE rn = 1
    UNION ALL
    SELECT r.event_id, r.shipment_id, r.received_us, r.rn, r.received_us - g.held >= 900000000,
      CASE WHEN r.received_us - g.held >= 900000000 THEN r.received_us ELSE g.held END
    FROM gate_pass g JOIN gate_row r ON r.shipment_id = g.shipment_id AND r.rn = g.rn + 1)""",
)


@query("SELECT event_id, shipment_id, received_us FROM gate_pass WHERE kept")
def thin_positions(run: Run) -> DataFrame:
    """At most one fix per shipment and quarter hour (the sample's fixes are minutes apart)."""
    fixes = run.fixes.select("event_id", "shipment_id", "received_us")
    return positions.thin(fixes, run.params.but(gate_millis=900_000))


@query(
    f"""SELECT shipment_id, CASE WHEN speed_kph >= 5 THEN 'MOVING' ELSE 'STOPPED' END AS movement,
    greatest(0, ({NOW_US} - received_us) // 1000000) AS stale_s, ({NOW_US} - received_us) // 1000000 > 600 AS stale,
    CASE WHEN shipment_id LIKE '%3' THEN 'AT_STOP' WHEN speed_kph >= 5 THEN 'MOVING' ELSE 'STOPPED' END AS sticky FROM newest"""
)
def movement_flags(run: Run) -> DataFrame:
    """Movement without a plan, staleness, and what a bare fix does to an earlier movement."""
    stale = positions.stale_seconds(F.col("received_us"), F.lit(NOW_US).cast("bigint"))
    before = F.when(F.col("shipment_id").endswith("3"), "AT_STOP").otherwise("MOVING")
    none = F.lit(0)
    return run.current.select(
        "shipment_id",
        positions.movement(F.col("speed_kph"), none, none, F.lit(False), run.params).alias("movement"),
        stale.alias("stale_s"),
        (stale > run.params.stale_seconds).alias("stale"),
        positions.movement_after_fix(before, F.col("speed_kph"), run.params).alias("sticky"),
    )


# --- geofence and estimates ----------------------------------------------------------------------


@query("SELECT * FROM visit")
def geofence_visits(run: Run) -> DataFrame:
    return run.visits


@query(
    f"""SELECT shipment_id, stop_id, 'shipment.arrived' AS type, {uuid3("'ARRIVED'", 'shipment_id', 'stop_id', instant('arrived_us'))} AS event_id,
    arrived_us AS occurred_us, CAST(arrival_caused_by AS VARCHAR) AS caused_by, NULL::BIGINT AS dwell_s FROM visit
  UNION ALL
  SELECT shipment_id, stop_id, 'shipment.departed', {uuid3("'DEPARTED'", 'shipment_id', 'stop_id', instant('departed_us'))}, departed_us,
    CAST(departure_caused_by AS VARCHAR), dwell_s FROM visit WHERE departed_us IS NOT NULL"""
)
def geofence_events(run: Run) -> DataFrame:
    return geofence.visit_events(run.visits)


@query(f"SELECT stop_id, count(*) AS stays, CAST(sum(dwell_s) AS BIGINT) AS dwell_s, {up('avg(dwell_s)', 3)} AS avg_dwell_s FROM visit WHERE dwell_s IS NOT NULL GROUP BY stop_id")
def dwell(run: Run) -> DataFrame:
    left = run.visits.where("dwell_s IS NOT NULL")
    return tidy(left.groupBy("stop_id").agg(F.count(F.lit(1)).alias("stays"), F.sum("dwell_s").alias("dwell_s"), F.avg("dwell_s").alias("avg_dwell_s")), 3)


@query("SELECT shipment_id, stop_id, event_id, caused_by, occurred_us, estimate_us, previous_us, remaining_km, confidence FROM eta")
def eta_updates(run: Run) -> DataFrame:
    return run.estimates


@query(
    f"""SELECT event_id, shipment_id, moving_s, last_moving_us, {up('learned_kph', 6)} AS learned_kph, {up('gap_s', 6)} AS gap_s FROM learned"""
)
def eta_learned_speed(run: Run) -> DataFrame:
    return tidy(eta.learn(run.track, run.params).select("event_id", "shipment_id", "moving_s", "last_moving_us", "learned_kph", "gap_s"))


part(
    "stop_state",
    """SELECT n.shipment_id, s.seq, s.stop_id, s.name, s.city, s.lat, s.lon, v.arrived_us, v.departed_us,
    CASE WHEN v.arrived_us IS NULL THEN 'PENDING' WHEN v.departed_us IS NULL THEN 'AT' ELSE 'DEPARTED' END AS status, v.dwell_s
  FROM newest n JOIN lane_stop s USING (lane) LEFT JOIN visit v ON v.shipment_id = n.shipment_id AND v.stop_id = s.stop_id""",
)


@query("SELECT shipment_id, seq, stop_id, name, city, arrived_us, departed_us, status, dwell_s FROM stop_state")
def stop_status(run: Run) -> DataFrame:
    return fleet_plan.planned_stops(run.current, run.plans, run.visits).select(
        "shipment_id", "seq", "stop_id", "name", "city", "arrived_us", "departed_us", "status", "dwell_s"
    )


# --- incidents -----------------------------------------------------------------------------------


@query(f"SELECT {INCIDENT_SELECT} FROM hot_incident")
def temperature_excursions(run: Run) -> DataFrame:
    return tidy(run.excursions(run.track, run.terms))


@query(f"SELECT {INCIDENT_SELECT} FROM idle_incident")
def unplanned_stops(run: Run) -> DataFrame:
    return tidy(run.idle(run.track, run.terms))


@query(f"SELECT {INCIDENT_SELECT} FROM astray_incident")
def route_deviations(run: Run) -> DataFrame:
    return tidy(run.astray(run.track))


@query(f"SELECT {INCIDENT_SELECT} FROM late_incident")
def late_arrivals(run: Run) -> DataFrame:
    return tidy(run.late())


@query(f"SELECT {INCIDENT_SELECT} FROM quiet_incident")
def signal_loss(run: Run) -> DataFrame:
    return tidy(run.quiet())


@query(f"SELECT {INCIDENT_SELECT} FROM incidents")
def incident_table(run: Run) -> DataFrame:
    return tidy(run.incidents)


@query(
    f"""SELECT exception_id, type, shipment_id, stop_id, severity, 'exception.raised' AS event_type, {uuid3("'RAISED'", 'exception_id')} AS event_id,
    onset_us AS occurred_us, raised_by AS caused_by, raised_detail AS detail, {up('raised_value', 6)} AS observed_value, {up('threshold_value', 6)} AS threshold_value,
    NULL::BIGINT AS since_us, NULL::BIGINT AS open_s, NULL::VARCHAR AS resolution FROM incidents
  UNION ALL
  SELECT exception_id, type, shipment_id, stop_id, severity, 'exception.cleared', {uuid3("'CLEARED'", 'exception_id')}, cleared_us, cleared_by, NULL, NULL, NULL,
    onset_us, open_s, resolution
  FROM incidents WHERE cleared_us IS NOT NULL"""
)
def incident_events(run: Run) -> DataFrame:
    return tidy(conditions.incident_events(run.incidents))


@query("SELECT type, state, count(*) AS incidents FROM incidents GROUP BY type, state")
def incident_counts(run: Run) -> DataFrame:
    return conditions.incident_counts(run.incidents)


@query(
    f"""SELECT shipment_id, {sev_name('max(' + sev_rank('severity') + ')')} AS worst_severity, count(*) AS open_incidents FROM incidents WHERE state = 'OPEN' GROUP BY shipment_id"""
)
def worst_severity(run: Run) -> DataFrame:
    return conditions.worst_severity(run.incidents)


@query(f"SELECT {INCIDENT_SELECT} FROM incidents WHERE state = 'OPEN'")
def open_incidents(run: Run) -> DataFrame:
    return tidy(conditions.open_incidents(run.incidents))


@query(f"SELECT {INCIDENT_SELECT} FROM incidents ORDER BY onset_us DESC, exception_id LIMIT 200")
def recent_incidents(run: Run) -> DataFrame:
    return tidy(conditions.recent_incidents(run.incidents, params=run.params))


@query(
    f"""SELECT event_id, {up('temp_c - setpoint_c', 6)} AS deviation, breach, {up('excess', 6)} AS excess, {up('threshold', 6)} AS breached_bound
  FROM reading JOIN (SELECT event_id, temp_c, setpoint_c FROM track) USING (event_id)"""
)
def temperature_bands(run: Run) -> DataFrame:
    """Every reading against its band."""
    readings = run.track.where("temp_c IS NOT NULL")
    df = conditions.band_of(conditions.with_terms(readings, run.terms), run.params)
    return tidy(df.select("event_id", "deviation", "breach", "excess", F.col("threshold").alias("breached_bound")))


@query(
    """SELECT shipment_id, count(*) AS instants, max(occurred_us) AS last_us FROM (SELECT shipment_id, occurred_us FROM fixes
    UNION SELECT shipment_id, arrived_us FROM visit UNION SELECT shipment_id, departed_us FROM visit WHERE departed_us IS NOT NULL) GROUP BY shipment_id"""
)
def sightings(run: Run) -> DataFrame:
    """Positions, arrivals and departures as one set of signs of life."""
    derived = geofence.visit_events(run.visits)
    seen = conditions.sightings(run.fixes, derived, params=run.params)
    return seen.groupBy("shipment_id").agg(F.count(F.lit(1)).alias("instants"), F.max("occurred_us").alias("last_us"))


# --- fleet read models ---------------------------------------------------------------------------

part(
    "eta_last",
    "SELECT shipment_id, arg_max(stop_id, occurred_us) AS eta_stop_id, arg_max(estimate_us, occurred_us) AS eta_us, arg_max(confidence, occurred_us) AS eta_conf FROM eta GROUP BY shipment_id",
)
part(
    "open_group",
    f"""SELECT shipment_id, count(*) AS open_incidents, string_agg(type, ',' ORDER BY -({sev_rank('severity')}), onset_us, exception_id) AS open_types,
    max({sev_rank('severity')}) AS worst_rank FROM incidents WHERE state = 'OPEN' GROUP BY shipment_id""",
)
part(
    "ahead_leg",
    f"""SELECT shipment_id, sum({dist('p_lat', 'p_lon', 'lat', 'lon')}) AS left_m FROM (
    SELECT s.shipment_id, s.lat, s.lon, coalesce(lag(s.lat) OVER w, n.lat) AS p_lat, coalesce(lag(s.lon) OVER w, n.lon) AS p_lon
    FROM stop_state s JOIN newest n USING (shipment_id) WHERE s.arrived_us IS NULL WINDOW w AS (PARTITION BY s.shipment_id ORDER BY s.seq)) GROUP BY shipment_id""",
)
part(
    "stop_sum",
    """SELECT shipment_id, count(*) AS total, count(arrived_us) AS done, min(seq) FILTER (WHERE arrived_us IS NULL) AS next_seq,
    min(seq) FILTER (WHERE status = 'AT') AS at_seq FROM stop_state GROUP BY shipment_id""",
)
part(
    "summary",
    f"""SELECT shipment_id, vehicle_id, occurred_us, received_us, stale_s, lat, lon, speed_kph, accuracy_m, movement, at_stop_id, at_stop_since_us, next_stop_id, next_stop_km,
    CASE WHEN next_stop_id IS NOT NULL AND estimate_pending IS NULL THEN eta_us END AS estimate_us,
    CASE WHEN next_stop_id IS NOT NULL AND estimate_pending IS NULL THEN eta_conf END AS confidence, estimate_pending, stops_completed, stops_total,
    fraction_complete, remaining_km, open_incidents, open_types, worst_severity
  FROM (SELECT *, CASE WHEN next_stop_id IS NULL THEN NULL WHEN movement = 'AT_STOP' THEN 'AT_A_STOP' WHEN eta_us IS NULL THEN 'NO_ESTIMATE_YET'
      WHEN eta_stop_id <> next_stop_id THEN 'SUPERSEDED' END AS estimate_pending FROM (
    SELECT n.shipment_id, n.vehicle_id, n.occurred_us, n.received_us, greatest(0, ({NOW_US} - n.received_us) // 1000000) AS stale_s, n.lat, n.lon, n.speed_kph, n.accuracy_m,
      CASE WHEN s.done = s.total THEN 'DELIVERED' WHEN at_seq IS NOT NULL THEN 'AT_STOP' WHEN n.speed_kph >= 5 THEN 'MOVING' ELSE 'STOPPED' END AS movement,
      a.stop_id AS at_stop_id, a.arrived_us AS at_stop_since_us, x.stop_id AS next_stop_id,
      {dist('n.lat', 'n.lon', 'x.lat', 'x.lon')} / 1000.0::DOUBLE * 1.30::DOUBLE AS next_stop_km, e.eta_us, e.eta_conf, e.eta_stop_id,
      s.done AS stops_completed, s.total AS stops_total,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - coalesce(left_m, 0.0::DOUBLE) / route_m)) AS fraction_complete,
      coalesce(left_m, 0.0::DOUBLE) / 1000.0::DOUBLE * 1.30::DOUBLE AS remaining_km,
      coalesce(o.open_incidents, 0) AS open_incidents, o.open_types, {sev_name('worst_rank')} AS worst_severity
    FROM newest n JOIN stop_sum s USING (shipment_id) JOIN (SELECT lane, sum({dist('lat_a', 'lon_a', 'lat_b', 'lon_b')}) AS route_m FROM lane_leg GROUP BY lane) r USING (lane)
    LEFT JOIN stop_state a ON a.shipment_id = n.shipment_id AND a.seq = s.at_seq LEFT JOIN stop_state x ON x.shipment_id = n.shipment_id AND x.seq = s.next_seq
    LEFT JOIN eta_last e ON e.shipment_id = n.shipment_id LEFT JOIN open_group o ON o.shipment_id = n.shipment_id LEFT JOIN ahead_leg l ON l.shipment_id = n.shipment_id))""",
)
SUMMARY_PLAIN = (
    "shipment_id vehicle_id occurred_us received_us stale_s movement at_stop_id at_stop_since_us next_stop_id estimate_us "
    "estimate_pending stops_completed stops_total open_incidents open_types worst_severity"
)
SUMMARY_DOUBLE = "lat lon speed_kph accuracy_m next_stop_km confidence fraction_complete remaining_km"


@query(pick("summary", SUMMARY_PLAIN, SUMMARY_DOUBLE))
def fleet_summary(run: Run) -> DataFrame:
    return tidy(fleet_plan.in_fleet_order(run.summary))


@query(pick("summary WHERE movement <> 'DELIVERED' OR shipment_id = 'SHP-DEL-0004'", SUMMARY_PLAIN, SUMMARY_DOUBLE))
def fleet_drawn(run: Run) -> DataFrame:
    return tidy(fleet_plan.drawn(run.summary, "SHP-DEL-0004"))


@query(
    """SELECT count(*) FILTER (WHERE movement = 'MOVING') AS moving, count(*) FILTER (WHERE movement = 'STOPPED') AS stopped,
    count(*) FILTER (WHERE movement = 'AT_STOP') AS at_stop, count(*) FILTER (WHERE movement = 'DELIVERED') AS delivered,
    count(*) FILTER (WHERE stale_s > 600) AS stale, CAST(sum(open_incidents) AS BIGINT) AS open_incidents,
    count(*) FILTER (WHERE worst_severity = 'CRITICAL') AS critical_shipments FROM summary"""
)
def fleet_status(run: Run) -> DataFrame:
    return fleet_plan.status(run.summary, run.params)


@query("SELECT (SELECT count(*) FROM newest) AS tracked_shipments, (SELECT count(*) FROM incidents WHERE state = 'OPEN') AS open_exceptions")
def fleet_meta(run: Run) -> DataFrame:
    return fleet_plan.meta(run.current, run.incidents)


@query(
    """SELECT s.shipment_id, s.movement, s.next_stop_id, s.worst_severity, m.customer_id, m.mode, m.schema_version, m.created_us, p.stops,
    coalesce(i.incidents, 0) AS incidents, i.newest_incident, coalesce(t.trail_points, 0) AS trail_points
  FROM summary s LEFT JOIN manifest_fact m USING (shipment_id)
  LEFT JOIN (SELECT shipment_id, string_agg(seq || '|' || stop_id || '|' || status, ';' ORDER BY seq) AS stops FROM stop_state GROUP BY shipment_id) p USING (shipment_id)
  LEFT JOIN (SELECT shipment_id, count(*) AS incidents, max_by(exception_id, (onset_us, exception_id)) AS newest_incident FROM incidents GROUP BY shipment_id) i USING (shipment_id)
  LEFT JOIN (SELECT shipment_id, count(*) AS trail_points FROM trail_point GROUP BY shipment_id) t USING (shipment_id)"""
)
def shipment_detail(run: Run) -> DataFrame:
    current = positions.current_position(run.staged_track)
    stops = fleet_plan.planned_stops(current, run.plans, run.staged_visits)
    points = positions.trail(run.staged_track.drop("slice"), run.params)
    return fleet_plan.detail(run.summary, stops, run.manifests, run.staged_incidents, points)


# --- identity and ingest -------------------------------------------------------------------------


def _asof(run: Run, kind: str, column: str) -> DataFrame:
    facts = run.fixes.select("event_id", F.lit(kind).alias("key_kind"), F.col(column).alias("key"), F.col("occurred_us").alias("at_us"))
    return asof.resolve(facts, asof.unambiguous_periods(run.assignments)).select("event_id", "as_shipment", "as_vehicle")


@query(oracle_ingest.asof("vehicle", "vehicle_id"))
def asof_vehicle(run: Run) -> DataFrame:
    return _asof(run, "vehicle", "vehicle_id")


@query(oracle_ingest.asof("device", "probe_id"))
def asof_device(run: Run) -> DataFrame:
    return _asof(run, "device", "probe_id")


@query(oracle_ingest.asof("shipment", "shipment_id"))
def asof_shipment(run: Run) -> DataFrame:
    return _asof(run, "shipment", "shipment_id")


EVENT_DOUBLE = "lat lon speed_kph heading_deg odometer_km accuracy_m temp_c setpoint_c"
EVENT_PLAIN = " ".join(c for c in ("message_id", *ingest.EVENT_COLUMNS) if c not in EVENT_DOUBLE.split())


def _normalized(run: Run, source: str) -> DataFrame:
    from haulscope.fixtures import feeds as feed_fixtures

    messages = feed_fixtures.messages(run.spark, run.sf_dir).where(F.col("source") == source)
    return tidy(ingest.events(ingest.judged(messages, run.assignments)))


@query(pick("feed_event WHERE source = 'TELEMATICS'", EVENT_PLAIN, EVENT_DOUBLE))
def normalize_telematics(run: Run) -> DataFrame:
    return _normalized(run, "TELEMATICS")


@query(pick("feed_event WHERE source = 'MOBILE_APP'", EVENT_PLAIN, EVENT_DOUBLE))
def normalize_mobile(run: Run) -> DataFrame:
    return _normalized(run, "MOBILE_APP")


@query(pick("feed_event WHERE source = 'REEFER_SENSOR'", EVENT_PLAIN, EVENT_DOUBLE))
def normalize_reefer(run: Run) -> DataFrame:
    return _normalized(run, "REEFER_SENSOR")


@query(pick("feed_event WHERE source = 'EDI_214'", EVENT_PLAIN, EVENT_DOUBLE))
def normalize_edi(run: Run) -> DataFrame:
    return _normalized(run, "EDI_214")


@query(pick("feed_event", EVENT_PLAIN, EVENT_DOUBLE))
def canonical_events(run: Run) -> DataFrame:
    return tidy(ingest.events(run.feed_rows))


@query("SELECT *, CASE WHEN source = 'EDI_214' THEN 'application/edi-x12' ELSE 'application/json' END AS content_type, true AS body_kept FROM dead")
def dead_letters(run: Run) -> DataFrame:
    """Dead letters as read back from the sink; the body is compared with the message it came in."""
    path = new_table(run.spark, "dead")
    ingest.write_dead_letters(ingest.dead_letters(run.feed_rows), path)
    sent = run.spark.read.parquet(path).withColumn("reason", F.col("reason").cast("string"))
    came = run.staged_messages.select("message_id", F.xxhash64("body").alias("came"))
    return sent.join(came, "message_id").select(
        "message_id", "source", "reason", "detail", "routing_key", "received_us", "content_type",
        (F.xxhash64("body") == F.col("came")).alias("body_kept"),
    )


@query(
    """SELECT source, outcome, count(*) AS messages FROM (SELECT source, 'PUBLISHED' AS outcome FROM feed_event UNION ALL SELECT source, reason FROM dead) GROUP BY source, outcome"""
)
def ingest_outcomes(run: Run) -> DataFrame:
    return ingest.outcomes(run.feed_rows)


@query(
    """SELECT message_id, source, published, dead_lettered, CASE WHEN dead_lettered = 0 THEN 'ACCEPTED' WHEN published = 0 THEN 'DEAD_LETTERED' ELSE 'PARTIAL' END AS verdict
  FROM (SELECT message_id, source, count(*) FILTER (WHERE kind = 1) AS published, count(*) FILTER (WHERE kind = 0) AS dead_lettered FROM (
    SELECT message_id, source, 1 AS kind FROM feed_event UNION ALL SELECT message_id, source, 0 FROM dead) GROUP BY message_id, source)"""
)
def ingest_verdicts(run: Run) -> DataFrame:
    return ingest.verdicts(run.feed_rows)


@query(
    f"""SELECT event_id, 'fleet.' || type AS topic, shipment_id AS key, source AS source_header, type AS type_header, occurred_text AS json_occurred,
    {up('temp_c', 6)} AS json_celsius, status AS json_status, {up('lat', 6)} AS json_lat, reason_code IS NULL AS reason_omitted FROM feed_event"""
)
def event_records(run: Run) -> DataFrame:
    """The log records of canonical events, read back from their JSON."""
    records = ev.feed_records(ingest.events(run.feed_rows))
    header = lambda k: F.get(F.filter("headers", lambda h: h["key"] == k), F.lit(0))["value"].cast("string")
    at = lambda path: F.get_json_object("value", path)
    return tidy(
        records.select(
            "event_id", "topic", "key", header("source").alias("source_header"), header("event-type").alias("type_header"),
            at("$.occurredAt").alias("json_occurred"), at("$.temperature.celsius").cast("double").alias("json_celsius"),
            at("$.status").alias("json_status"), at("$.position.latitude").cast("double").alias("json_lat"),
            (~F.col("value").contains('"reasonCode"')).alias("reason_omitted"),
        )
    )


@query(
    """SELECT CASE WHEN event_id % 41 = 0 THEN 'occurredAt' WHEN event_id % 43 = 0 THEN 'shipmentId' WHEN event_id % 47 = 0 THEN 'position' END AS missing, count(*) AS events FROM fixes GROUP BY 1"""
)
def completeness(run: Run) -> DataFrame:
    """First missing field a consumer names before it sets an event aside."""
    e = F.col("event_id")
    df = run.fixes.select(
        F.when((e % 43 != 0) | (e % 41 == 0), F.col("shipment_id")).alias("shipment_id"),
        F.when(e % 41 != 0, F.col("occurred_us")).alias("occurred_us"),
        F.when(e % 47 != 0, F.col("lat")).alias("lat"),
        "lon",
    )
    return df.groupBy(ingest.first_missing().alias("missing")).agg(F.count(F.lit(1)).alias("events"))


# --- manifests -----------------------------------------------------------------------------------

TERM_PLAIN = "shipment_id customer_id mode tolerance_s opens_us closes_us cold_chain"


@query(pick("terms", TERM_PLAIN, "min_c max_c"))
def sla_terms(run: Run) -> DataFrame:
    return tidy(run.terms)


@query("SELECT customer_id, mode, count(*) AS manifests, min(shipment_id) AS first_shipment_id FROM manifest_fact GROUP BY customer_id, mode")
def manifest_census(run: Run) -> DataFrame:
    return manifests.census(run.manifests)


@query("SELECT shipment_id, mode, created_us FROM manifest_fact WHERE customer_id = 'MEDIVAULT'")
def manifests_by_customer(run: Run) -> DataFrame:
    return manifests.by_customer(run.manifests, "MEDIVAULT").select("shipment_id", "mode", "created_us")


@query("SELECT shipment_id, customer_id FROM manifest_fact WHERE mode = 'LTL'")
def manifests_by_mode(run: Run) -> DataFrame:
    return manifests.by_mode(run.manifests, "LTL").select("shipment_id", "customer_id")


@query("SELECT shipment_id, customer_id FROM manifest_fact WHERE full_body AND lane = 'BOM' AND fault <> 2")
def manifests_by_body_field(run: Run) -> DataFrame:
    return manifests.by_body_field(run.manifests, "serviceLevel", "STANDARD").select("shipment_id", "customer_id")


@query(
    """SELECT shipment_id, string_agg(problem, '; ' ORDER BY problem) AS problems FROM (
    SELECT shipment_id, 'schema_version is required' AS problem FROM manifest_fact WHERE schema_version IS NULL
    UNION ALL SELECT shipment_id, 'body must be an object' FROM manifest_fact WHERE NOT full_body) GROUP BY shipment_id"""
)
def envelope_check(run: Run) -> DataFrame:
    return manifests.envelope_problems(run.manifests)


part(
    "broken",
    """SELECT shipment_id, '1' AS version, field, "constraint", message FROM (
    SELECT shipment_id, '' AS field, 'type' AS "constraint", 'array found, object expected' AS message FROM manifest_fact WHERE fault <> 4 AND NOT full_body
    UNION ALL SELECT shipment_id, '', 'additionalProperties', 'property ''surprise'' is not declared' FROM manifest_fact WHERE fault = 0 AND full_body
    UNION ALL SELECT shipment_id, '', 'required', 'required property ''' || CASE lane WHEN 'HYD' THEN 'custody' WHEN 'DEL' THEN 'pallets' WHEN 'BLR' THEN 'billTo' ELSE 'recipient' END || ''' not found'
      FROM manifest_fact WHERE fault = 1 AND full_body
    UNION ALL SELECT shipment_id, CASE lane WHEN 'HYD' THEN '/drugLicenceNo' WHEN 'DEL' THEN '/dcCode' WHEN 'BLR' THEN '/freightClass' ELSE '/serviceLevel' END,
      CASE WHEN lane IN ('HYD', 'DEL') THEN 'pattern' ELSE 'enum' END,
      CASE lane WHEN 'HYD' THEN 'does not match the pattern ^[A-Z]{2}/[0-9]{2}/[0-9]{4}$' WHEN 'DEL' THEN 'does not match the pattern ^DC-[A-Z]{3}-[0-9]{2}$'
        WHEN 'BLR' THEN 'is not one of ["50", "55", "60", "65", "70", "77.5", "85", "92.5", "100", "125", "150", "175", "200"]'
        ELSE 'is not one of ["SAME_DAY", "NEXT_DAY", "STANDARD", "ECONOMY"]' END FROM manifest_fact WHERE fault = 2 AND full_body
    UNION ALL SELECT shipment_id, CASE lane WHEN 'HYD' THEN '/temperature/maxC' WHEN 'DEL' THEN '/pallets' WHEN 'BLR' THEN '/pieces/0/weightKg' ELSE '/weightKg' END,
      CASE lane WHEN 'HYD' THEN 'maximum' WHEN 'DEL' THEN 'minimum' WHEN 'BLR' THEN 'exclusiveMinimum' ELSE 'maximum' END,
      CASE lane WHEN 'HYD' THEN 'breaks maximum 25' WHEN 'DEL' THEN 'breaks minimum 1' WHEN 'BLR' THEN 'breaks exclusiveMinimum 0' ELSE 'breaks maximum 32' END
      FROM manifest_fact WHERE fault = 3 AND full_body)""",
)


@query("SELECT * FROM broken")
def manifest_violations(run: Run) -> DataFrame:
    return contracts.violations(run.manifests, contracts.constraints(run.spark, CONTRACTS))


part(
    "judged",
    """SELECT shipment_id, customer_id, mode, CASE WHEN fault <> 4 THEN '1' END AS version, coalesce(n, 0) AS violations,
    CASE WHEN fault = 4 THEN 'NO_SCHEMA' WHEN n > 0 THEN 'INVALID' ELSE 'VALID' END AS outcome
  FROM manifest_fact LEFT JOIN (SELECT shipment_id, count(*) AS n FROM broken GROUP BY shipment_id) USING (shipment_id)""",
)


@query("SELECT * FROM judged")
def manifest_outcomes(run: Run) -> DataFrame:
    return contracts.outcomes(run.manifests, contracts.constraints(run.spark, CONTRACTS))


@query("SELECT customer_id, outcome, count(*) AS manifests FROM judged GROUP BY customer_id, outcome")
def conformance_report(run: Run) -> DataFrame:
    return contracts.conformance(run.manifests, contracts.constraints(run.spark, CONTRACTS))


@query(
    """SELECT shipment_id, count(*) AS nodes FROM (SELECT m.shipment_id, unnest(range(n)) FROM (SELECT *, CASE WHEN NOT full_body THEN 1 ELSE
      CASE lane WHEN 'HYD' THEN 16 - CASE WHEN fault = 1 THEN 4 ELSE 0 END WHEN 'DEL' THEN 19 - CASE WHEN fault = 1 THEN 1 ELSE 0 END
        WHEN 'BLR' THEN 16 - CASE WHEN fault = 1 THEN 3 ELSE 0 END + 1 ELSE 11 - CASE WHEN fault = 1 THEN 4 ELSE 0 END END + CASE WHEN fault = 0 THEN 1 ELSE 0 END END AS n
    FROM manifest_fact) m) GROUP BY shipment_id"""
)
def manifest_nodes(run: Run) -> DataFrame:
    """Size of every flattened body."""
    return contracts.flatten(run.manifests).groupBy("shipment_id").agg(F.count(F.lit(1)).alias("nodes"))


@query(
    """SELECT unit, CAST(sum(n) AS BIGINT) AS nodes, count(DISTINCT shipment_id) AS manifests FROM manifest_fact
  JOIN (VALUES ('HYD', '°C', 2), ('HYD', 'min', 1), ('DEL', 'INR', 2), ('BLR', 'kg', 1), ('BLR', 'cm', 3), ('BOM', 'kg', 1), ('BOM', 'INR', 2)) AS v(lane, unit, n) USING (lane)
  WHERE full_body GROUP BY unit"""
)
def manifest_units(run: Run) -> DataFrame:
    """Numbers in the bodies by the unit that their key, or the key around it, names."""
    nodes = contracts.flatten(run.manifests).where("kind IN ('number', 'integer')")
    names = F.filter(F.split("shape", "/"), lambda s: s != "*")
    unit = text.unit_of_key(F.element_at(names, -1), F.try_element_at(names, F.lit(-2)))
    told = nodes.withColumn("unit", unit).where("unit IS NOT NULL")
    return told.groupBy("unit").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("shipment_id").alias("manifests"))


part(
    "section_plan",
    """SELECT * FROM (VALUES ('HYD', '/drugLicenceNo', 'field', NULL, NULL, NULL), ('HYD', '/temperature', 'group', 3, NULL, NULL), ('HYD', '/temperature/minC', 'field', NULL, NULL, NULL),
    ('HYD', '/temperature/maxC', 'field', NULL, NULL, NULL), ('HYD', '/temperature/excursionToleranceMinutes', 'field', NULL, NULL, NULL), ('HYD', '/consignment', 'group', 5, NULL, NULL),
    ('HYD', '/consignment/batchNo', 'field', NULL, NULL, NULL), ('HYD', '/consignment/expiryDate', 'field', NULL, NULL, NULL), ('HYD', '/consignment/units', 'field', NULL, NULL, NULL),
    ('HYD', '/consignment/controlledSubstance', 'field', NULL, NULL, NULL), ('HYD', '/consignment/productName', 'field', NULL, NULL, NULL), ('HYD', '/custody', 'table', 1, 1, NULL),
    ('DEL', '/dcCode', 'field', NULL, NULL, NULL), ('DEL', '/asnNumber', 'field', NULL, NULL, NULL), ('DEL', '/purchaseOrders', 'table', 2, NULL, NULL), ('DEL', '/deliveryWindow', 'group', 3, NULL, NULL),
    ('DEL', '/deliveryWindow/opensAt', 'field', NULL, NULL, NULL), ('DEL', '/deliveryWindow/closesAt', 'field', NULL, NULL, NULL), ('DEL', '/deliveryWindow/dockNumber', 'field', NULL, NULL, NULL),
    ('DEL', '/pallets', 'field', NULL, 1, NULL), ('DEL', '/temperatureControlled', 'field', NULL, NULL, NULL),
    ('BLR', '/ewayBillNo', 'field', NULL, NULL, NULL), ('BLR', '/freightClass', 'field', NULL, NULL, NULL), ('BLR', '/pieces', 'table', 1, NULL, NULL), ('BLR', '/billTo', 'group', 2, 1, NULL),
    ('BLR', '/billTo/party', 'field', NULL, 1, NULL), ('BLR', '/billTo/gstin', 'field', NULL, 1, NULL), ('BLR', '/accessorials', 'list', 1, NULL, NULL),
    ('BOM', '/trackingNumber', 'field', NULL, NULL, NULL), ('BOM', '/serviceLevel', 'field', NULL, NULL, NULL), ('BOM', '/weightKg', 'field', NULL, NULL, NULL), ('BOM', '/recipient', 'group', 3, 1, NULL),
    ('BOM', '/recipient/name', 'field', NULL, 1, NULL), ('BOM', '/recipient/pincode', 'field', NULL, 1, NULL), ('BOM', '/recipient/phone', 'field', NULL, 1, NULL),
    ('BOM', '/signatureRequired', 'field', NULL, NULL, NULL), ('BOM', '/declaredValueInr', 'field', NULL, NULL, NULL), ('BOM', '/codAmountInr', 'field', NULL, NULL, NULL),
    ('HYD', '/surprise', 'field', NULL, NULL, 0), ('DEL', '/surprise', 'field', NULL, NULL, 0), ('BLR', '/surprise', 'field', NULL, NULL, 0), ('BOM', '/surprise', 'field', NULL, NULL, 0))
  AS v(lane, path, class, entries, not_with, only_with)""",
)


@query(
    """SELECT shipment_id, path, class, CAST(entries AS BIGINT) AS entries, path IN ('/temperature', '/deliveryWindow') AS reserved FROM manifest_fact JOIN section_plan USING (lane)
  WHERE full_body AND coalesce(fault <> not_with, true) AND coalesce(fault = only_with, true)"""
)
def manifest_sections(run: Run) -> DataFrame:
    """Fields, groups, tables and lists of every manifest."""
    return contracts.sections(run.manifests).select("shipment_id", "path", "class", "entries", "reserved")


@query(
    """SELECT shipment_id, path, "row"::BIGINT AS "row", place::BIGINT AS place, name, value FROM (
    SELECT shipment_id, lane, fault, '/purchaseOrders' AS path, 0 AS "row", unnest([0, 1, 2, 3]) AS place, unnest(['poNumber', 'lineCount', 'valueInr', 'department']) AS name,
      unnest(['PO' || (user_id + 50000000), CAST(user_id % 40 + 12 AS VARCHAR), '180000', 'Grocery']) AS value FROM manifest_fact WHERE full_body AND lane = 'DEL'
    UNION ALL SELECT shipment_id, lane, fault, '/purchaseOrders', 1, unnest([0, 1, 2, 3]), unnest(['poNumber', 'lineCount', 'valueInr', 'department']),
      unnest(['PO' || (user_id + 50000001), '4', '60000.5', NULL]) FROM manifest_fact WHERE full_body AND lane = 'DEL'
    UNION ALL SELECT shipment_id, lane, fault, '/pieces', 0, unnest([0, 1, 2, 3]), unnest(['description', 'weightKg', 'dimensionsCm', 'hazmat']),
      unnest(['Components', CASE WHEN fault = 3 THEN '0' ELSE CAST(user_id % 9 * 15 + 210 AS VARCHAR) END, '{"length":120,"width":80,"height":95}', 'false']) FROM manifest_fact WHERE full_body AND lane = 'BLR'
    UNION ALL SELECT shipment_id, lane, fault, '/custody', 0, unnest([0, 1]), unnest(['party', 'handedOverAt']), unnest(['Genome Valley', '2026-08-31T22:00:00Z'])
      FROM manifest_fact WHERE full_body AND lane = 'HYD' AND fault <> 1)"""
)
def manifest_tables(run: Run) -> DataFrame:
    """Cells of the tables in all manifests; columns in the order they are first seen."""
    return contracts.tables(run.manifests).select("shipment_id", "path", "row", "place", "name", "value")


@query(
    """SELECT customer_id, mode, 0::BIGINT AS problems, count(*) AS manifests FROM manifest_fact WHERE fault <> 4 GROUP BY customer_id, mode"""
)
def reserved_paths_check(run: Run) -> DataFrame:
    """Contracts in force whose reserved paths have another shape, with the manifests they would affect."""
    checked = contracts.reserved_path_problems(contracts.constraints(run.spark, CONTRACTS))
    counted = run.manifests.groupBy("customer_id", "mode").agg(F.count(F.lit(1)).alias("manifests"))
    return checked.join(counted, ["customer_id", "mode"]).select(
        "customer_id", "mode", F.when(F.col("problems") != "", 1).otherwise(0).cast("bigint").alias("problems"), "manifests"
    )


# --- archive, replay, public view ----------------------------------------------------------------

part(
    "pos_record",
    """SELECT *, received_us + CASE WHEN copy = 0 THEN 0 ELSE 60000000 END AS timestamp_us, event_id % 41 = 0 AS cut,
    CASE WHEN event_id % 41 <> 0 AND event_id % 47 <> 0 THEN 'e-' || event_id END AS eid
  FROM fixes, (VALUES (0), (1)) AS c(copy) WHERE copy = 0 OR event_id % 37 = 0""",
)


def _archived(run: Run) -> DataFrame:
    """All topics of the fleet's log."""
    fixes = stage(run.fixes, "fixes")
    visit_events = geofence.visit_events(run.staged_visits)
    told = conditions.incident_events(run.staged_incidents)
    return (
        archive_fixtures.position_records(fixes)
        .unionByName(archive_fixtures.status_records(fixes))
        .unionByName(archive_fixtures.derived_records(visit_events))
        .unionByName(archive_fixtures.exception_records(told))
        .unionByName(archive_fixtures.estimate_records(run.staged_estimates))
    )


@query(
    """SELECT 'fleet.position' AS topic, strftime(make_timestamp(timestamp_us), '%Y-%m-%d') AS dt, strftime(make_timestamp(timestamp_us), '%H') AS hour,
    count(*) AS records, count(DISTINCT user_id % 12) AS partitions FROM pos_record GROUP BY ALL"""
)
def archive_layout(run: Run) -> DataFrame:
    """Records per topic and hour after a round trip through the archive; replayed copies are left out."""
    path = new_table(run.spark, "archive")
    archive.write(archive_fixtures.position_records(run.fixes), path)
    schema = f"record_topic string, {archive.RECORD_SCHEMA}, dt string, hour string"
    return run.spark.read.schema(schema).json(path).groupBy("topic", "dt", "hour").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("partition").alias("partitions")
    )


def _misfiled(run: Run) -> str:
    """Position archive in which every 101st record lies an hour too late."""
    path = new_table(run.spark, "archive")
    records = archive.skip_replayed(archive_fixtures.position_records(run.fixes))
    shift = F.when(F.col("offset") % 101 == 0, 3600 * MICROS).otherwise(0)
    laid = archive.layout(records.withColumn("_at", F.col("timestamp_us")).withColumn("timestamp_us", F.col("timestamp_us") + shift))
    # one file an hour
    laid = laid.repartition("dt", "hour")
    archive.write_laid_out(laid.withColumn("timestamp_us", F.col("_at")), path)
    return path


@query(
    """SELECT shipment_id AS key, 'fleet.position-' || (user_id % 12) || '@' || (event_id + CASE WHEN copy = 0 THEN 0 ELSE 1000000000000 END) AS origin,
    CASE WHEN cut THEN 'UNPARSEABLE' ELSE 'INCOMPLETE' END AS reason,
    CASE WHEN cut THEN 'unreadable JSON' WHEN event_id % 59 = 0 THEN 'missing shipmentId' ELSE 'missing position' END AS detail, CASE WHEN cut THEN 40::BIGINT END AS cut_at, true AS told
  FROM pos_record WHERE cut OR event_id % 59 = 0 OR event_id % 43 = 0"""
)
def consumer_dead_letters(run: Run) -> DataFrame:
    """Positions from the log that no consumer can use: cut, without a shipment, or without a place."""
    e = F.col("event_id")
    records = archive.skip_replayed(archive_fixtures.position_records(run.fixes.withColumn("lat", F.when(e % 43 != 0, F.col("lat")))))
    unnamed = F.regexp_replace("value", '"shipmentId":"[^"]*",?', "")
    event = F.col("offset") % archive_fixtures.REPEAT_OFFSET
    records = records.withColumn("value", F.when(event % 59 == 0, unnamed).otherwise(F.col("value")))
    # the last cut, so that both flaws of one event leave 40 characters
    records = records.withColumn("value", F.when(event % 41 == 0, F.rpad("value", 40, ".")).otherwise(F.col("value")))
    path = new_table(run.spark, "dead")
    ingest.write_dead_letters(ingest.consumer_dead_letters(records), path)
    sent = run.spark.read.parquet(path).withColumn("reason", F.col("reason").cast("string"))
    header = lambda n: F.col("headers")[n]["value"].cast("string")
    told = (header(0) == F.col("reason")) & (header(1) == F.col("detail")) & (header(2) == F.col("origin"))
    cut_at = F.when(F.col("reason") == "UNPARSEABLE", F.length("value").cast("bigint"))
    return sent.select("key", "origin", "reason", "detail", cut_at.alias("cut_at"), told.alias("told"))


part(
    "replayed",
    """SELECT * FROM (SELECT *, CASE WHEN (CASE WHEN copy = 0 THEN event_id ELSE event_id + 1000000000000 END) % 101 = 0 THEN 3600000000 ELSE 0 END AS shift FROM pos_record)
  WHERE timestamp_us + shift >= 1788228000000000 AND timestamp_us + shift < 1788242400000000""",
)


REPLAY_FROM_US = 1_788_228_000_000_000


@query(
    """SELECT 'fleet.position' AS topic, count(DISTINCT (timestamp_us + shift) // 3600000000) AS files, count(*) AS lines, count(*) FILTER (WHERE shift > 0) AS misplaced,
    count(*) FILTER (WHERE eid IS NULL) AS without_event_id, count(DISTINCT eid) AS distinct_ids, count(eid) - count(DISTINCT eid) AS duplicates,
    count(DISTINCT eid) AS published, count(*) FILTER (WHERE shift > 0 OR eid IS NULL) = 0 AS ok FROM replayed
  UNION ALL SELECT 'fleet.status', count(DISTINCT received_us // 3600000000), count(*), 0, 0, count(*), 0, 0, count(*) > 0 FROM fixes
    WHERE temp_c IS NOT NULL AND received_us >= 1788228000000000 AND received_us < 1788242400000000"""
)
def replay_report(run: Run) -> DataFrame:
    """Check of four hours of two topics: one with flaws that is published, one without that is only verified."""
    path, end = _misfiled(run), REPLAY_FROM_US + 4 * 3600 * MICROS
    archive.write(archive_fixtures.status_records(run.fixes).repartition(hour_text(F.col("timestamp_us"))), path)
    report = lambda topic, target: archive.replay_report(archive.scan(run.spark, path, topic, REPLAY_FROM_US, end), target)
    return report("fleet.position", "fleet.replay").unionByName(report("fleet.status", None))


@query(
    """SELECT arg_min(shipment_id, timestamp_us) AS key, eid AS event_id, 'fleet.replay' AS topic, min((timestamp_us + shift) // 3600000000) * 3600000000 AS hour_us
  FROM replayed WHERE eid IS NOT NULL GROUP BY eid"""
)
def replay_records(run: Run) -> DataFrame:
    """What a replay has published, read back: each event once, from the first hour that has it as its header says."""
    scanned = archive.scan(run.spark, _misfiled(run), "fleet.position", REPLAY_FROM_US, REPLAY_FROM_US + 4 * 3600 * MICROS)
    path = new_table(run.spark, "replay")
    archive.publish(archive.replay_records(scanned, "fleet.replay"), path)
    sent = run.spark.read.parquet(path)
    named = sent.select("*", F.col("headers")[0]["value"].cast("string").alias("from"))
    place = lambda part: F.regexp_extract("from", f"/{part}=([^/]+)/", 1).alias(part)
    told = named.select("topic", "key", archive.event_id_of(F.col("value")).alias("event_id"), place("dt"), place("hour"))
    return told.select("key", "event_id", "topic", archive.hour_of_directory(told).alias("hour_us"))


part(
    "log_fact",
    """SELECT 'fleet.position' AS topic, timestamp_us, cut OR event_id % 47 = 0 AS bad, 'position' AS kind FROM pos_record
  UNION ALL SELECT 'fleet.position', received_us + 60000000, event_id % 41 = 0 OR event_id % 47 = 0, 'position' FROM fixes WHERE event_id % 53 = 0
  UNION ALL SELECT 'fleet.status', received_us, false, 'status' FROM fixes WHERE temp_c IS NOT NULL
  UNION ALL SELECT 'fleet.derived', arrived_us, false, 'shipment.arrived' FROM visit
  UNION ALL SELECT 'fleet.derived', departed_us, false, 'shipment.departed' FROM visit WHERE departed_us IS NOT NULL
  UNION ALL SELECT 'fleet.exceptions', onset_us, false, 'exception.raised' FROM incidents
  UNION ALL SELECT 'fleet.exceptions', cleared_us, false, 'exception.cleared' FROM incidents WHERE cleared_us IS NOT NULL
  UNION ALL SELECT 'fleet.eta', occurred_us, false, 'eta.updated' FROM eta""",
)


@query(
    """SELECT topic, count(*) FILTER (WHERE NOT bad) AS events, count(*) FILTER (WHERE NOT bad AND kind IN ('status', 'eta.updated')) AS skipped,
    count(*) FILTER (WHERE bad) AS unreadable, max(timestamp_us) AS newest_received_us FROM log_fact GROUP BY topic"""
)
def archive_fold(run: Run) -> DataFrame:
    return archive.fold_counts(archive.decoded(_archived(run)))


@query("SELECT topic, max(timestamp_us) AS newest_us FROM log_fact GROUP BY topic UNION ALL SELECT '*', max(timestamp_us) FROM log_fact")
def topic_watermark(run: Run) -> DataFrame:
    return archive.archived_through(_archived(run).select("topic", "timestamp_us"))


@query(
    f"""SELECT shipment_id, vehicle_id, occurred_us, received_us, {up('lat', 6)} AS lat, {up('lon', 6)} AS lon, {up('speed_kph', 6)} AS speed_kph
  FROM fixes WHERE event_id % 41 <> 0 AND event_id % 47 <> 0 QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY occurred_us DESC, event_id) = 1"""
)
def public_positions(run: Run) -> DataFrame:
    return tidy(archive.fold_positions(archive.decoded(archive_fixtures.position_records(run.fixes))))


@query(
    """SELECT shipment_id, stop_id, seq, CASE WHEN ok THEN arrived_us END AS arrived_us, CASE WHEN ok AND departed_us >= arrived_us THEN departed_us END AS departed_us,
    CASE WHEN NOT ok OR arrived_us IS NULL THEN 'PENDING' WHEN departed_us IS NULL THEN 'AT' ELSE 'DEPARTED' END AS status
  FROM (SELECT *, NOT coalesce(arrived_us < first_value(arrived_us) OVER (PARTITION BY shipment_id ORDER BY seq), false) AS ok FROM stop_state)"""
)
def plan_visits(run: Run) -> DataFrame:
    facts = archive.fold_stops(archive.decoded(archive_fixtures.derived_records(geofence.visit_events(run.visits))))
    return archive.plan_visits(facts, plan.itineraries(run.shipments, run.stops))


@query("SELECT exception_id, shipment_id, severity, onset_us, cleared_us, resolution, state FROM incidents")
def raise_clear_pairs(run: Run) -> DataFrame:
    return archive.pair_incidents(archive.decoded(archive_fixtures.exception_records(conditions.incident_events(run.staged_incidents))))


@query(
    """SELECT topic, count(*) AS records FROM (SELECT 'fleet.position' AS topic, ts, 3 AS days FROM events UNION ALL SELECT 'fleet.status', ts, 30 FROM events)
  WHERE CAST(ts AS DATE) >= DATE '2024-02-05' - days::INTEGER GROUP BY topic"""
)
def retention(run: Run) -> DataFrame:
    """Archive days still kept on 5 February, when both topics hold the month of January."""
    days = run.spark.read.parquet(f"{run.sf_dir}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("dt"))
    both = days.withColumn("topic", F.explode(F.array(F.lit("fleet.position"), F.lit("fleet.status"))))
    return archive.retained(both, F.lit("2024-02-05").cast("date")).groupBy("topic").agg(F.count(F.lit(1)).alias("records"))


def _held(run: Run) -> str:
    """All topics of the log archived and folded: in three parts out of order, the middle one twice, then compacted and folded on."""
    log = _archived(run).where("topic <> 'fleet.position' OR regexp_extract(key, '([0-9]+)$', 1) % 9 <> 4")
    path, held = new_table(run.spark, "archive"), new_table(run.spark, "held")
    archive.write(log, path)
    records = run.spark.read.schema(f"record_topic string, {archive.RECORD_SCHEMA}, dt string, hour string").json(path)
    part = lambda low, high: records.where((F.col("hour") >= low) & (F.col("hour") < high))
    public.fold_into(part("04", "08"), held)
    public.fold_into(part("08", "24"), held)
    public.compact(run.spark, held, f"{_FIRST_DAY} 06")
    public.fold_into(part("00", "05"), held)
    public.fold_into(part("04", "08"), held)
    public.compact(run.spark, held, f"{_FIRST_DAY} 09")
    return held


_FIRST_DAY = "2026-09-01"
part(
    "seen_fix",
    "SELECT * FROM fixes WHERE user_id % 9 <> 4",
)
part(
    "hour_fact",
    """SELECT topic, timestamp_us, fact FROM (
    SELECT 'fleet.position' AS topic, received_us AS timestamp_us, shipment_id AS fact FROM seen_fix WHERE event_id % 41 <> 0 AND event_id % 47 <> 0
    UNION ALL SELECT 'fleet.position', received_us + 60000000, shipment_id FROM seen_fix WHERE event_id % 41 <> 0 AND event_id % 47 <> 0 AND event_id % 37 = 0
    UNION ALL SELECT 'fleet.derived', arrived_us, 'a' || shipment_id || stop_id FROM visit
    UNION ALL SELECT 'fleet.derived', departed_us, 'd' || shipment_id || stop_id FROM visit WHERE departed_us IS NOT NULL
    UNION ALL SELECT 'fleet.exceptions', onset_us, exception_id FROM incidents
    UNION ALL SELECT 'fleet.exceptions', cleared_us, exception_id FROM incidents WHERE cleared_us IS NOT NULL)""",
)
part(
    "hour_log",
    """SELECT topic, timestamp_us, bad, kind FROM (
    SELECT 'fleet.position' AS topic, received_us AS timestamp_us, event_id % 41 = 0 OR event_id % 47 = 0 AS bad, 'position' AS kind FROM seen_fix
    UNION ALL SELECT 'fleet.position', received_us + 60000000, event_id % 41 = 0 OR event_id % 47 = 0, 'position' FROM seen_fix WHERE event_id % 37 = 0)
  UNION ALL SELECT * FROM log_fact WHERE topic <> 'fleet.position'""",
)


@query(
    """SELECT topic, count(*) AS hours, CAST(sum(events) AS BIGINT) AS events, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(unreadable) AS BIGINT) AS unreadable,
    CAST(sum(coalesce(facts, 0)) AS BIGINT) AS facts, max(newest) AS newest_received_us
  FROM (SELECT topic, timestamp_us // 3600000000 AS h, count(*) FILTER (WHERE NOT bad) AS events,
      count(*) FILTER (WHERE NOT bad AND kind IN ('status', 'eta.updated')) AS skipped, count(*) FILTER (WHERE bad) AS unreadable, max(timestamp_us) AS newest
    FROM hour_log GROUP BY ALL)
  LEFT JOIN (SELECT topic, timestamp_us // 3600000000 AS h, count(DISTINCT fact) AS facts FROM hour_fact GROUP BY ALL) USING (topic, h) GROUP BY topic"""
)
def fold_merge(run: Run) -> DataFrame:
    """What the ledger of an archive folded out of order and partly twice says."""
    sums = [F.sum(c).alias(c) for c in ("events", "skipped", "unreadable", "facts")]
    counted = public.ledger(run.spark, _held(run))
    return counted.groupBy("topic").agg(F.count(F.lit(1)).alias("hours"), *sums, F.max("newest_received_us").alias("newest_received_us"))


part(
    "public_visit",
    """SELECT *, CASE WHEN NOT ok OR arrived_us IS NULL THEN 'PENDING' WHEN departed_us IS NULL THEN 'AT' ELSE 'DEPARTED' END AS status
  FROM (SELECT * EXCLUDE (status), NOT coalesce(arrived_us < first_value(arrived_us) OVER (PARTITION BY shipment_id ORDER BY seq), false) AS ok FROM stop_state)""",
)


@query(
    f"""SELECT p.shipment_id, vehicle_id, occurred_us, received_us, greatest(0, ({NOW_US} - received_us) // 1000000) AS stale_s, {up('lat', 6)} AS lat, {up('lon', 6)} AS lon,
    {up('speed_kph', 6)} AS speed_kph, CASE WHEN done = total THEN 'DELIVERED' WHEN at_stop_id IS NOT NULL THEN 'AT_STOP' WHEN speed_kph >= 5 THEN 'MOVING' ELSE 'STOPPED' END AS movement,
    at_stop_id, at_since_us, done AS stops_completed, total AS stops_total, coalesce(n, 0) AS open_incidents, coalesce(types, '') AS open_types, worst AS worst_severity
  FROM (SELECT * FROM seen_fix WHERE event_id % 41 <> 0 AND event_id % 47 <> 0 QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY occurred_us DESC, event_id) = 1) p
  JOIN (SELECT shipment_id, count(*) AS total, count(*) FILTER (WHERE status <> 'PENDING') AS done, min_by(stop_id, seq) FILTER (WHERE status = 'AT') AS at_stop_id,
      min_by(arrived_us, seq) FILTER (WHERE status = 'AT') AS at_since_us FROM public_visit GROUP BY shipment_id) v USING (shipment_id)
  LEFT JOIN (SELECT shipment_id, count(*) AS n, string_agg(type || ':' || coalesce(stop_id, '-'), ',' ORDER BY {sev_rank('severity')} DESC, onset_us, exception_id) AS types,
      {sev_name(f"max({sev_rank('severity')})")} AS worst FROM incidents WHERE cleared_us IS NULL GROUP BY shipment_id) i USING (shipment_id)"""
)
def public_summary(run: Run) -> DataFrame:
    """One marker per shipment that the archive has shown a position of."""
    held = public.held_facts(run.spark, _held(run))
    itineraries = run.shipments.select("shipment_id", "lane").join(run.plans.select("lane", "stops"), "lane")
    return tidy(public.summary(held, itineraries, F.lit(NOW_US).cast("bigint"), run.params))


@query(
    f"""SELECT exception_id, shipment_id, type, stop_id, severity, raised_detail AS detail, {up('raised_value', 6)} AS observed_value, {up('threshold_value', 6)} AS threshold_value,
    onset_us, cleared_us, resolution, state FROM incidents"""
)
def public_incidents(run: Run) -> DataFrame:
    """Every incident of the archive, with type, stop and detail."""
    return tidy(public.incidents(public.held_facts(run.spark, _held(run))))


@query(
    """SELECT (SELECT count(DISTINCT shipment_id) FROM seen_fix WHERE event_id % 41 <> 0 AND event_id % 47 <> 0) AS tracked,
    (SELECT count(*) FROM incidents WHERE cleared_us IS NULL) AS open_incidents, 'archive' AS source, (SELECT max(timestamp_us) FROM hour_log) AS through_us"""
)
def public_meta(run: Run) -> DataFrame:
    path = _held(run)
    return public.meta(public.held_facts(run.spark, path), public.ledger(run.spark, path))


# --- reconciliation and measures -----------------------------------------------------------------


def _two_sides(run: Run) -> tuple[DataFrame, DataFrame]:
    """Produced ids (some twice) and persisted ids (some lost, some twice, some unknown)."""
    e = F.col("event_id")
    made = run.fixes.select("event_id")
    produced = made.union(made.where(e % 37 == 0))
    persisted = made.where(e % 1000 != 7).union(made.where(e % 500 == 3)).union(made.where(e % 2000 == 1).select(-e - 1))
    return produced, persisted


part("kept_id", "SELECT event_id FROM fixes WHERE event_id % 1000 <> 7 UNION ALL SELECT event_id FROM fixes WHERE event_id % 500 = 3 UNION ALL SELECT -event_id - 1 FROM fixes WHERE event_id % 2000 = 1")


@query(
    """SELECT (SELECT count(*) + count(*) FILTER (WHERE event_id % 37 = 0) FROM fixes) AS records, (SELECT count(*) FROM fixes) AS distinct_produced,
    (SELECT count(DISTINCT event_id) FROM kept_id) AS distinct_persisted, (SELECT count(*) FROM fixes WHERE event_id NOT IN (SELECT event_id FROM kept_id)) AS missing,
    (SELECT count(*) FROM kept_id WHERE event_id < 0) AS unexpected, (SELECT count(*) FROM (SELECT event_id FROM kept_id GROUP BY event_id HAVING count(*) > 1)) AS stored_twice,
    (SELECT count(*) FROM fixes WHERE event_id % 41 = 0) AS dead_lettered, false AS passed"""
)
def reconcile_ids(run: Run) -> DataFrame:
    produced, persisted = _two_sides(run)
    return reconcile.reconcile(produced, persisted, run.fixes.where("event_id % 41 = 0"))


@query("SELECT event_id FROM fixes WHERE event_id NOT IN (SELECT event_id FROM kept_id)")
def except_ids(run: Run) -> DataFrame:
    return reconcile.except_ids(*_two_sides(run))


@query("SELECT event_id, count(*) AS times FROM kept_id GROUP BY event_id HAVING count(*) > 1")
def repeated_ids(run: Run) -> DataFrame:
    return reconcile.repeated_ids(_two_sides(run)[1])


@query("SELECT DISTINCT event_id FROM kept_id")
def distinct_ids(run: Run) -> DataFrame:
    return reconcile.distinct_ids(_two_sides(run)[1])


_STORED = "received_us + (event_id * event_id % 400000) * 1000"
_MS = f"(({_STORED} - received_us) // 1000)"
_BOUNDS = " ".join(f"WHEN ms <= {b} THEN {b}" for b in reconcile.LATENCY_BOUNDS_MS)
part(
    "histogram",
    f"""SELECT CAST(CASE {_BOUNDS} ELSE 2147483648 END AS BIGINT) AS le_ms, count(*) AS records
  FROM (SELECT {_MS} AS ms FROM fixes) GROUP BY 1""",
)


def _stored(run: Run) -> DataFrame:
    e = F.col("event_id")
    return run.fixes.withColumn("stored_us", F.col("received_us") + (e * e % 400000) * 1000)


@query("SELECT * FROM histogram")
def latency_histogram(run: Run) -> DataFrame:
    return reconcile.latency_histogram(_stored(run))


@query(
    """SELECT max(CASE WHEN q = 50 THEN t END) AS p50_ms, max(CASE WHEN q = 99 THEN t END) AS p99_ms FROM (
    SELECT q, CASE WHEN min(le_ms) = 2147483648 THEN '>300000' ELSE CAST(min(le_ms) AS VARCHAR) END AS t FROM (
      SELECT le_ms, sum(records) OVER (ORDER BY le_ms) AS upto, sum(records) OVER () AS total FROM histogram), (VALUES (50), (99)) AS v(q)
    WHERE upto >= total * q / 100.0::DOUBLE GROUP BY q)"""
)
def latency_percentiles(run: Run) -> DataFrame:
    return reconcile.histogram_percentiles(reconcile.latency_histogram(_stored(run)))


@query(
    f"""SELECT {up('quantile_cont(ms, 0.5)', 6)} AS p50_ms, {up('quantile_cont(ms, 0.99)', 6)} AS p99_ms, CAST(max(ms) AS BIGINT) AS max_ms
  FROM (SELECT CAST({_MS} AS DOUBLE) AS ms FROM fixes)"""
)
def latency_exact(run: Run) -> DataFrame:
    """Exact percentiles of the time from arrival to store, interpolated between neighbours."""
    return tidy(reconcile.exact_percentiles(_stored(run)))


@query("SELECT le_ms, CAST(sum(records) AS BIGINT) AS records FROM histogram GROUP BY le_ms")
def latency_delta(run: Run) -> DataFrame:
    """Difference of two cumulative snapshots equals the histogram of what came between."""
    stored = stage(_stored(run).select("event_id", "received_us", "stored_us"), "stored")
    first = stored.where("event_id % 2 = 0")
    both = reconcile.latency_histogram(stored.union(first))
    return reconcile.histogram_delta(reconcile.latency_histogram(first), both)


@query(
    f"""SELECT received_us // 60000000 * 60000000 AS window_us, count(*) AS records, {up('count(*) / 60.0::DOUBLE', 6)} AS per_second,
    max((received_us - occurred_us) // 1000000) AS max_lag_s FROM fixes GROUP BY 1"""
)
def throughput(run: Run) -> DataFrame:
    return tidy(reconcile.throughput(run.fixes, "received_us"))


@query(
    f"""SELECT lane AS operation, count(*) FILTER (WHERE event_id % 2 = 1) AS operations, {up(f"sum({_MS}) FILTER (WHERE event_id % 2 = 1) / CAST(count(*) FILTER (WHERE event_id % 2 = 1) AS DOUBLE)", 3)} AS avg_ms
  FROM fixes GROUP BY lane"""
)
def average_latency(run: Run) -> DataFrame:
    """Mean latency between two snapshots of cumulative counters."""

    def snapshot(df: DataFrame) -> DataFrame:
        spent = int_div(F.col("stored_us") - F.col("received_us"), 1000).cast("double")
        return df.groupBy(F.col("lane").alias("operation")).agg(F.sum(spent).alias("total_ms"), F.count(F.lit(1)).alias("operations"))

    stored = stage(_stored(run).select("event_id", "lane", "received_us", "stored_us"), "stored")
    return tidy(reconcile.average_between(snapshot(stored.where("event_id % 2 = 0")), snapshot(stored)), 3)


@query(
    """SELECT (SELECT count(*) FROM fixes) AS stored, (SELECT count(*) FROM fixes WHERE event_id % 37 = 0) AS duplicates, (SELECT count(*) FROM visit) AS arrivals,
    (SELECT count(departed_us) FROM visit) AS departures, (SELECT count(*) FROM eta) AS estimates, (SELECT count(*) FROM incidents) AS raised,
    (SELECT count(cleared_us) FROM incidents) AS cleared, (SELECT CAST(coalesce(sum(restated), 0) AS BIGINT) FROM incidents) AS restated,
    (SELECT count(*) FROM fixes WHERE lane NOT IN (SELECT lane FROM lane_stop)) AS unplanned, (SELECT count(*) FROM dead) AS dead_letters,
    (SELECT floor((SELECT count(*) FROM eta) / CAST((SELECT count(*) FROM track) AS DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE) AS published_share"""
)
def processing_counters(run: Run) -> DataFrame:
    """What the services count while they run, as one row."""
    count = lambda df, cond=F.lit(True): df.agg(F.count_if(cond).alias("n")).scalar()
    repeats = run.fixes.unionByName(run.fixes.where("event_id % 37 = 0")).groupBy("event_id").agg((F.count(F.lit(1)) - 1).alias("extra"))
    found, visited = run.staged_incidents, run.staged_visits
    return repeats.agg(F.count(F.lit(1)).alias("stored"), F.sum("extra").alias("duplicates")).withColumns(
        {
            "arrivals": count(visited),
            "departures": count(visited, F.col("departed_us").isNotNull()),
            "estimates": count(run.estimates),
            "raised": count(found),
            "cleared": count(found, F.col("cleared_us").isNotNull()),
            "restated": found.agg(F.coalesce(F.sum("restated"), F.lit(0)).cast("bigint").alias("n")).scalar(),
            "unplanned": count(positions.unplanned(run.staged_fixes, run.plans)),
            "dead_letters": count(ingest.dead_letters(run.feed_rows)),
            "published_share": round_half_up(count(run.staged_estimates) / count(run.staged_track).cast("double"), 6),
        }
    )


# --- reference data ------------------------------------------------------------------------------


@query(
    """SELECT vehicle_id, shipment_id, CASE WHEN user_id % 5 = 0 THEN 'new' WHEN user_id % 5 = 1 THEN 'kept' ELSE 'new' END AS version
  FROM (SELECT DISTINCT user_id, vehicle_id, shipment_id FROM fixes) WHERE user_id % 5 <> 2 OR user_id % 2 = 0"""
)
def reference_refresh(run: Run) -> DataFrame:
    """A refresh replaces its own rows, removes those it no longer produces and leaves foreign rows alone."""
    user = F.col("user_id")
    base = run.shipments.select("user_id", "vehicle_id", "shipment_id")
    old = base.select(
        F.concat("vehicle_id", F.when(user % 5 == 2, "-old").otherwise("")).alias("id"), user.alias("user_id"), "vehicle_id", "shipment_id",
        F.when(user % 5 == 1, "kept").otherwise("stale").alias("version"), (user % 5 != 1).alias("owned"),
    )
    new = base.where((user % 5 != 1) & ~((user % 5 == 2) & (user % 2 != 0))).select(
        F.col("vehicle_id").alias("id"), "user_id", "vehicle_id", "shipment_id", F.lit("new").alias("version"), F.lit(True).alias("owned")
    )
    return reference.refresh(old, new, "id").select("vehicle_id", "shipment_id", "version")


@query(
    """SELECT shipment_id, 'm' || (user_id % 3) AS movement, CASE WHEN user_id % 4 <> 1 THEN user_id * 2 END AS seen FROM
  (SELECT DISTINCT user_id, shipment_id FROM fixes) WHERE user_id % 7 <> 0"""
)
def snapshot_sync(run: Run) -> DataFrame:
    """A full snapshot replaces the table but keeps the locally observed column of rows present before."""
    user = F.col("user_id")
    old = run.shipments.where(user % 4 != 1).select("shipment_id", F.lit("old").alias("movement"), (user * 2).alias("seen"))
    snapshot = run.shipments.where(user % 7 != 0).select("shipment_id", F.concat(F.lit("m"), (user % 3).cast("string")).alias("movement"))
    return reference.replace_snapshot(old, snapshot, "shipment_id", keep=["seen"])


# --- streaming: the same answers from micro-batches ----------------------------------------------


STREAM_FILES = 4  # micro-batches
FILE_ROWS = 100_000  # a larger micro-batch is several files


def _in_batches(rows: DataFrame, by: str, low: int, width: int, n_rows: int, name: str) -> DataFrame:
    """``rows`` as a stream of files in the order of ``by``, in micro-batches of ``width``.

    Every micro-batch has the same number of files, so that a trigger that takes so many takes one micro-batch: about
    ``FILE_ROWS`` rows each, so that no task writes or reads a whole one. A batch of too few rows is filled with empty files.
    """
    spark = rows.sparkSession
    path, files = new_table(spark, name), max(1, -(-n_rows // (STREAM_FILES * FILE_ROWS)))
    for k in range(STREAM_FILES):
        part = rows.where((F.col(by) >= low + k * width) & (F.col(by) < low + (k + 1) * width))
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
        if files > 1:
            for _ in range(files * (k + 1) - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
                rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    return flows.file_source(spark, path, rows.schema, files_per_trigger=files)


def _as_stream(run: Run, rows: DataFrame, by: str) -> DataFrame:
    """``rows`` as a stream of files in the order of ``by``, in several micro-batches, so that state crosses batches."""
    rows = stage(rows, "stream-rows")
    low, high, n_rows = rows.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
    return _in_batches(rows, by, low, (high - low) // STREAM_FILES + 1, n_rows, "stream")


def _fix_stream(run: Run, *columns: str) -> DataFrame:
    """The fixes as a stream of files in event-time order."""
    return _as_stream(run, run.fixes.select(*columns), "occurred_us")


TRACK_COLUMNS = ("event_id", "shipment_id", "lane", "occurred_us", "lat", "lon", "speed_kph", "accuracy_m")


@query(ORACLES["geofence_events"])
def stream_geofence_events(run: Run) -> DataFrame:
    derived = flows.run_to_table(tracking.derived_events(_fix_stream(run, *TRACK_COLUMNS), run.plans, run.params), "derived")
    return derived.where("type <> 'eta.updated'").select("shipment_id", "stop_id", "type", "event_id", "occurred_us", "caused_by", "dwell_s")


@query(ORACLES["eta_updates"])
def stream_eta_updates(run: Run) -> DataFrame:
    derived = flows.run_to_table(tracking.derived_events(_fix_stream(run, *TRACK_COLUMNS), run.plans, run.params), "derived")
    return derived.where("type = 'eta.updated'").select(
        "shipment_id", "stop_id", "event_id", "caused_by", "occurred_us", "estimate_us", "previous_us", "remaining_km", "confidence"
    )


@query(
    f"""SELECT shipment_id, 'ROUTE_DEVIATION' AS rule, 'raised' AS change, onset_us, raised_us AS at_us, raised_by AS caused_by, NULL::VARCHAR AS recovery FROM astray_incident
  UNION ALL SELECT shipment_id, 'ROUTE_DEVIATION', 'cleared', onset_us, cleared_us, cleared_by, resolution FROM astray_incident WHERE cleared_us IS NOT NULL"""
)
def stream_route_deviations(run: Run) -> DataFrame:
    fixes = _fix_stream(run, *TRACK_COLUMNS).join(run.plans, "lane")
    km = positions.off_plan_km(F.col("lat"), F.col("lon"), F.col("legs"))
    usable = F.coalesce(F.col("accuracy_m") <= run.params.rule_accuracy_m, F.lit(True))
    rows = fixes.withColumn("excess", km).select(
        "shipment_id", F.lit("ROUTE_DEVIATION").alias("rule"), "occurred_us", "event_id",
        F.when(usable, F.col("excess") > run.params.corridor_km).alias("breach"),
        F.lit(run.params.deviation_seconds * MICROS).alias("hold_us"), "excess", F.lit("BACK_ON_ROUTE").alias("recovery"),
    )
    return flows.run_to_table(tracking.sustained_changes(rows), "deviations").drop("worst")


@query(
    """SELECT shipment_id, 'raised' AS change, onset_us, raised_us AS at_us, raised_by AS caused_by, NULL::VARCHAR AS resolution FROM quiet_incident
  UNION ALL SELECT shipment_id, 'cleared', onset_us, cleared_us, cleared_by, resolution FROM quiet_incident WHERE cleared_us IS NOT NULL"""
)
def stream_signal_loss(run: Run) -> DataFrame:
    """Silences by event-time timers, with the final arrival ending the watch; the batch form has the same oracle."""
    over = run.completions.select("shipment_id", F.col("completed_us").alias("occurred_us"), F.lit(True).alias("completed"))
    seen = run.staged_sightings.select("shipment_id", "occurred_us", "event_id").join(over, ["shipment_id", "occurred_us"], "left")
    sightings = _as_stream(run, seen.withColumn("completed", F.coalesce("completed", F.lit(False))), "occurred_us")
    return flows.run_to_table(tracking.silence_changes(sightings, "0 seconds", run.params), "silence")


@query(ORACLES["dedup_events"])
def stream_dedup(run: Run) -> DataFrame:
    fixes = run.fixes.select("event_id", "shipment_id", "received_us")
    repeats = fixes.where("event_id % 37 = 0")
    return flows.run_to_table(flows.dedup_stream(_as_stream(run, fixes.unionByName(repeats), "received_us")), "dedup")


@query(ORACLES["current_position"])
def stream_current_position(run: Run) -> DataFrame:
    stream = _fix_stream(run, *run.fixes.columns)
    current = flows.current_positions(stream)
    path = new_table(run.spark, "current")
    flows.run_batches(current, "current", flows.upsert_current(path, current.schema), "update")
    return tidy(flows.latest_version(run.spark, path, current.schema).select(*run.fixes.columns))


@query(ORACLES["archive_layout"])
def stream_archive(run: Run) -> DataFrame:
    """The hourly archive written from a stream of log records."""
    records = archive_fixtures.position_records(run.fixes)
    path = new_table(run.spark, "archive")
    flows.archive_stream(_as_stream(run, records, "timestamp_us"), path).awaitTermination()
    schema = f"record_topic string, {archive.RECORD_SCHEMA}, dt string, hour string"
    return run.spark.read.schema(schema).json(path).groupBy("topic", "dt", "hour").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("partition").alias("partitions")
    )


part(
    "heard_position",
    """SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY heard_us) AS rn FROM (SELECT * FROM (
    SELECT shipment_id, occurred_us, vehicle_id, timestamp_us AS heard_us, event_id + CASE WHEN copy = 0 THEN 0 ELSE 1000000000000 END AS place
    FROM pos_record WHERE NOT cut AND event_id % 47 <> 0
    UNION ALL SELECT shipment_id, occurred_us, vehicle_id, received_us + 60000000, event_id + 1000000000000 FROM fixes
      WHERE event_id % 53 = 0 AND event_id % 41 <> 0 AND event_id % 47 <> 0)
  QUALIFY row_number() OVER (PARTITION BY shipment_id, heard_us ORDER BY place) = 1)""",
)
part(
    "let_through",
    """RECURSIVE let_through AS (
    SELECT shipment_id, occurred_us, vehicle_id, heard_us, rn, true AS kept, heard_us AS held FROM heard_position WHERE rn = 1
    UNION ALL
    SELECT r.shipment_id, r.occurred_us, r.vehicle_id, r.heard_us, r.rn, r.heard_us - g.held >= 900000000,
      CASE WHEN r.heard_us - g.held >= 900000000 THEN r.heard_us ELSE g.held END
    FROM let_through g JOIN heard_position r ON r.shipment_id = g.shipment_id AND r.rn = g.rn + 1)""",
)


@query(
    """SELECT 'position' AS type, shipment_id, occurred_us AS at_us, vehicle_id AS what FROM let_through WHERE kept
  UNION ALL SELECT 'status', shipment_id, occurred_us, 'TEMPERATURE_READING' FROM fixes WHERE temp_c IS NOT NULL
  UNION ALL SELECT 'estimate', shipment_id, occurred_us, stop_id FROM eta
  UNION ALL SELECT 'arrived', shipment_id, arrived_us, stop_id FROM visit
  UNION ALL SELECT 'departed', shipment_id, departed_us, stop_id FROM visit WHERE departed_us IS NOT NULL
  UNION ALL SELECT 'exception.raised', shipment_id, onset_us, exception_id FROM incidents
  UNION ALL SELECT 'exception.cleared', shipment_id, cleared_us, exception_id FROM incidents WHERE cleared_us IS NOT NULL"""
)
def stream_live_feed(run: Run) -> DataFrame:
    """Updates of all seven kinds over all topics; positions at most one per shipment and quarter hour of hearing."""
    feed = flows.run_to_table(flows.thinned_feed(_as_stream(run, _archived(run), "timestamp_us"), 900_000), "live")
    told = lambda field: F.get_json_object("payload", f"$.{field}")
    named = {"position": told("vehicleId"), "status": told("status"), "exception.raised": told("exceptionId"), "exception.cleared": told("exceptionId")}
    what = told("stopId")
    for kind, value in named.items():
        what = F.when(F.col("type") == kind, value).otherwise(what)
    return feed.select("type", "shipment_id", "at_us", what.alias("what"))


def _live_updates(run: Run) -> DataFrame:
    """Positions, visits, estimates and incidents as typed updates."""
    none = lambda kind: F.lit(None).cast(kind)
    columns = lambda kind, at, speed, stop, eta_us, exc: [
        "shipment_id", kind.alias("type"), at.alias("at_us"), speed.alias("speed_kph"), stop.alias("stop_id"), eta_us.alias("estimate_us"), exc.alias("exception_id"),
    ]
    c, s, d, b = F.col, none("string"), none("double"), none("bigint")
    stops = geofence.visit_events(run.staged_visits)
    word = F.when(c("type") == "shipment.arrived", "arrived").otherwise("departed")
    told = conditions.incident_events(run.staged_incidents)
    return (
        run.staged_track.select(*columns(F.lit("position"), c("occurred_us"), c("speed_kph"), s, b, s))
        .union(stops.select(*columns(word, c("occurred_us"), d, c("stop_id"), b, s)))
        .union(run.staged_estimates.select(*columns(F.lit("estimate"), c("occurred_us"), d, c("stop_id"), c("estimate_us"), s)))
        .union(told.select(*columns(c("event_type"), c("occurred_us"), d, s, b, c("exception_id"))))
    )


@query(
    """SELECT s.shipment_id, CASE WHEN p.at_us IS NOT NULL AND (v.at_us IS NULL OR p.at_us > v.at_us) THEN CASE WHEN v.word = 'arrived' THEN 'AT_STOP' WHEN p.speed_kph >= 5 THEN 'MOVING' ELSE 'STOPPED' END
      WHEN v.word = 'arrived' THEN 'AT_STOP' ELSE 'STOPPED' END AS movement,
    least(z.total, coalesce(v.arrivals, 0)) AS stops_completed, e.estimate_us, coalesce(i.open_incidents, 0) AS open_incidents,
    p.n + coalesce(v.n, 0) + coalesce(e.n, 0) + coalesce(i.n, 0) AS applied
  FROM (SELECT shipment_id, any_value(lane) AS lane FROM fixes GROUP BY shipment_id) s JOIN (SELECT lane, s AS total FROM lane_size) z USING (lane)
  JOIN (SELECT lane, stop_id AS origin FROM lane_stop WHERE seq = 1) o USING (lane)
  JOIN (SELECT shipment_id, count(*) AS n, max(occurred_us) AS at_us, arg_max(speed_kph, occurred_us) AS speed_kph FROM track GROUP BY shipment_id) p USING (shipment_id)
  LEFT JOIN (SELECT shipment_id, count(*) AS n, count(*) FILTER (WHERE word = 'arrived') AS arrivals, max(at_us) AS at_us, arg_max(word, at_us) AS word FROM (
      SELECT shipment_id, arrived_us AS at_us, 'arrived' AS word FROM visit UNION ALL SELECT shipment_id, departed_us, 'departed' FROM visit WHERE departed_us IS NOT NULL) GROUP BY shipment_id) v USING (shipment_id)
  LEFT JOIN (SELECT shipment_id, count(*) AS n, arg_max(estimate_us, occurred_us) AS estimate_us FROM eta JOIN (SELECT stop_id FROM lane_stop WHERE seq = 1) USING (stop_id) GROUP BY shipment_id) e USING (shipment_id)
  LEFT JOIN (SELECT shipment_id, count(*) + count(cleared_us) AS n, count(*) FILTER (WHERE cleared_us IS NULL) AS open_incidents FROM incidents GROUP BY shipment_id) i USING (shipment_id)"""
)
def live_fold(run: Run) -> DataFrame:
    """A day's updates folded into an empty snapshot whose next stop is the second of the plan."""
    second = run.stops.where("seq = 1").select("lane", F.col("stop_id").alias("next_stop_id"))
    sizes = run.plans.select("lane", F.size("stops").cast("bigint").alias("stops_total"))
    snapshot = run.shipments.join(second, "lane").join(sizes, "lane").select(
        "shipment_id", F.lit("STOPPED").alias("movement"), F.lit(0).cast("bigint").alias("stops_completed"), "stops_total", "next_stop_id"
    )
    return live.fold(snapshot, stage(_live_updates(run), "updates"), run.params)


@query("SELECT exception_id, shipment_id, cleared_us AS at_us FROM incidents WHERE cleared_us IS NOT NULL ORDER BY cleared_us DESC, exception_id LIMIT 40")
def resolved_incidents(run: Run) -> DataFrame:
    return live.resolved(_live_updates(run))


# --- streams of every rule, histories, and what a run reports -------------------------------------


DELAY_S = 600  # how late the simulated topics may be
LATENESS_S = {"fixes": 30, "statuses": 540, "estimates": 120, "arrivals": 480, "departures": 60}


def _topics(run: Run, **events: DataFrame) -> dict[str, DataFrame]:
    """Each kind of event as a topic of its own: files in the order of hearing, every event late by its own hash.

    The batches of all topics cover the same times. The last one carries a row that moves the clocks to the end.
    """
    heard = {
        name: stage(
            df.withColumn("event_id", F.col("event_id").cast("string"))
            .withColumn("heard_us", F.col("occurred_us") + F.pmod(F.xxhash64("event_id"), F.lit(LATENESS_S[name])) * MICROS),
            name,
        )
        for name, df in events.items()
    }
    spans = [df.agg(F.min("heard_us"), F.max("heard_us"), F.max("occurred_us"), F.count(F.lit(1))).first() for df in heard.values()]
    low, high = min(s[0] for s in spans if s[0]), max(s[1] for s in spans if s[1])
    newest = max(s[2] for s in spans if s[2])
    width = (high - low) // STREAM_FILES + 1
    out = {}
    for (name, df), (*_, n_rows) in zip(heard.items(), spans):
        clock = {"occurred_us": newest + DELAY_S * MICROS, "heard_us": high}
        mark = run.spark.range(1).select(*(F.lit(clock.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema))
        stream = _in_batches(df.unionByName(mark), "heard_us", low, width, n_rows, name)
        out[name] = incidents.topic(stream, f"{DELAY_S} seconds")
    return out


def _incidents_of(run: Run, changes: DataFrame, name: str) -> DataFrame:
    """The incident table that a stream of changes leaves behind."""
    path = new_table(run.spark, name)
    flows.run_batches(changes, name, incidents.upsert(path, changes.schema))
    held = incidents.held_incidents(run.spark, path, changes.schema)
    fleet = run.staged_sightings.agg(F.max("occurred_us")).scalar() if "silence" in name else F.lit(None).cast("bigint")
    return incidents.incident_rows(held, fleet)


def _estimate_topic(run: Run) -> DataFrame:
    columns = ("shipment_id", "stop_id", "occurred_us", "event_id", "estimate_us", "remaining_km", "confidence")
    return run.staged_estimates.select(*columns).withColumn("lane", lane_code(F.col("shipment_id")))


def _visit_topic(run: Run, kind: str) -> DataFrame:
    told = geofence.visit_events(run.staged_visits).where(F.col("type") == f"shipment.{kind}")
    return told.select("shipment_id", "stop_id", "occurred_us", "event_id").withColumn("lane", lane_code(F.col("shipment_id")))


@query(f"SELECT {INCIDENT_SELECT} FROM incidents")
def stream_incidents(run: Run) -> DataFrame:
    """All five rules over five topics of different lateness: the batch table, built up by upserts."""
    p, terms = run.params, run.staged_terms
    columns = ("event_id", "shipment_id", "lane", "occurred_us", "lat", "lon", "speed_kph", "accuracy_m", "temp_c", "setpoint_c")
    topics = _topics(
        run, fixes=run.staged_track.select(*columns), statuses=run.statuses, estimates=_estimate_topic(run),
        arrivals=_visit_topic(run, "arrived"), departures=_visit_topic(run, "departed"),
    )
    changes = incidents.incident_changes(
        incidents.fix_signals(topics["fixes"], run.plans, terms, p),
        incidents.deadline_signals(topics["estimates"], False, terms, run.finals, p),
        incidents.deadline_signals(topics["arrivals"], True, terms, run.finals, p),
        incidents.sighting_signals(topics["statuses"]),
        incidents.sighting_signals(topics["departures"]),
        params=p,
    )
    return tidy(_incidents_of(run, changes, "silence-and-all"))


@query(f"SELECT {INCIDENT_SELECT} FROM late_incident")
def stream_late_arrivals(run: Run) -> DataFrame:
    """Late arrivals from two topics: estimates and arrivals meet in event-time order, the delivery windows are a table."""
    p, terms = run.params, run.staged_terms
    topics = _topics(run, estimates=_estimate_topic(run), arrivals=_visit_topic(run, "arrived"))
    changes = incidents.incident_changes(
        incidents.deadline_signals(topics["estimates"], False, terms, run.finals, p),
        incidents.deadline_signals(topics["arrivals"], True, terms, run.finals, p),
        params=p, silences=False,
    )
    return tidy(_incidents_of(run, changes, "late"))


@query("SELECT strftime(make_timestamp(occurred_us), '%Y-%m-%d') AS dt, count(*) AS rows, count(DISTINCT shipment_id) AS shipments FROM fixes GROUP BY 1")
def stream_history(run: Run) -> DataFrame:
    """Position history by event day; arrival order decides the batches, so late rows come in later ones and are kept."""
    stream = _as_stream(run, run.fixes.select("event_id", "shipment_id", "occurred_us", "received_us", "lat", "lon"), "received_us")
    path = new_table(run.spark, "history")
    flows.history_sink(stream, path, f"{path}-checkpoint").awaitTermination()
    held = run.spark.read.parquet(path)
    return held.groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("shipment_id").alias("shipments"))


@query(
    f"""SELECT k AS batch_id, count(*) AS input_rows, {STREAM_FILES} - 1 - k AS lag, count(*) FILTER (WHERE speed_kph >= 5) AS moving,
    count(DISTINCT shipment_id) AS shipments
  FROM (SELECT *, (occurred_us - low) // width AS k FROM fixes, (SELECT min(occurred_us) AS low, (max(occurred_us) - min(occurred_us)) // {STREAM_FILES} + 1 AS width FROM fixes))
  GROUP BY k"""
)
def stream_drain(run: Run) -> DataFrame:
    """A backlog being worked off: for each batch what it read, what was observed in it, and what is still ahead."""
    stream = _fix_stream(run, "event_id", "shipment_id", "occurred_us", "speed_kph")
    moving = F.col("speed_kph") >= run.params.moving_kph
    counted = stream.observe("fixes", F.count_if(moving).alias("moving"))
    path = new_table(run.spark, "drain")
    progress = flows.run_batches(counted, "drain", flows.batch_folders(path))
    told = flows.progress_table(run.spark, progress).where("input_rows > 0")
    stored = run.spark.read.parquet(path).groupBy(F.col("batch").cast("bigint").alias("batch_id")).agg(F.count_distinct("shipment_id").alias("shipments"))
    return told.join(stored, "batch_id").select("batch_id", "input_rows", "lag", F.col("observed")["moving"].alias("moving"), "shipments")


@query(
    """SELECT shipment_id, seq, stop_id, arrived_us, departed_us FROM (SELECT DISTINCT shipment_id, lane FROM fixes) JOIN lane_stop USING (lane)
  LEFT JOIN visit USING (shipment_id, stop_id)"""
)
def shipment_stops(run: Run) -> DataFrame:
    """Planned stops of every shipment in plan order, with the visit of each."""
    visited = run.visits.select("shipment_id", "stop_id", "arrived_us", "departed_us")
    planned = run.shipments.select("shipment_id", "lane").join(run.stops.select("lane", "seq", "stop_id"), "lane")
    return planned.join(visited, ["shipment_id", "stop_id"], "left").select(
        "shipment_id", F.col("seq").cast("bigint").alias("seq"), "stop_id", "arrived_us", "departed_us"
    ).orderBy("shipment_id", "seq")


@query("SELECT shipment_id, exception_id, type, severity, state, onset_us, cleared_us FROM incidents")
def shipment_incidents(run: Run) -> DataFrame:
    """All incidents of every shipment, newest onset first."""
    columns = ("shipment_id", "exception_id", "type", "severity", "state", "onset_us", "cleared_us")
    return run.incidents.select(*columns).orderBy("shipment_id", F.desc("onset_us"), "exception_id")


@query(pick("trail_point", "shipment_id event_id occurred_us", "lat lon"))
def shipment_trail(run: Run) -> DataFrame:
    """The trail of every shipment, oldest point first."""
    return positions.in_track_order(tidy(positions.trail(run.fixes, run.params).drop("slice")))


# --- closed files of the archive ------------------------------------------------------------------

CLOSE_POLICY = closing.Policy(max_file_bytes=20_000, max_open_bytes=10_000)

part(
    "log_line",
    """SELECT *, (heard_us - min(heard_us) OVER ()) // ((max(heard_us) OVER () - min(heard_us) OVER ()) // 4 + 1) AS k FROM (
    SELECT topic, received_us // 3600000000 * 3600000000 AS hour_us, received_us + user_id % 3 * 1800000000 AS heard_us, event_id % 53 = 0 AS replay,
      strlen(shipment_id) + strlen('{"eventId":"e-' || event_id || '"}') AS bytes
    FROM fixes, (VALUES ('fleet.position'), ('fleet.status')) AS t(topic) WHERE topic = 'fleet.position' OR temp_c IS NOT NULL)""",
)
for _k in range(STREAM_FILES + 1):
    _carried = f"SELECT topic, hour_us, file, records, bytes, last_us FROM closing_{_k - 1} WHERE reason IS NULL UNION ALL" if _k else ""
    _before = " UNION ALL ".join(f"SELECT topic, hour_us, file FROM closing_{j} WHERE reason IS NOT NULL" for j in range(_k))
    _number = f"coalesce((SELECT max(file) + 1 FROM ({_before}) c WHERE c.topic = l.topic AND c.hour_us = l.hour_us), 0)" if _k else "0"
    _last = "'shutdown'" if _k == STREAM_FILES else "NULL::VARCHAR"
    part(
        f"closing_{_k}",
        f"""SELECT topic, hour_us, file, records, bytes, last_us, CASE WHEN own IS NOT NULL THEN own WHEN sum(CASE WHEN own IS NULL THEN bytes ELSE 0 END) OVER
      (ORDER BY hour_us, topic, file ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > {CLOSE_POLICY.max_open_bytes} THEN 'buffer' ELSE {_last} END AS reason FROM (
    SELECT *, CASE WHEN hour_us + 3600000000 <= now_us AND last_us + 60000000 <= now_us THEN 'quiet' WHEN bytes >= {CLOSE_POLICY.max_file_bytes} THEN 'size' END AS own
    FROM (SELECT topic, hour_us, file, sum(records) AS records, sum(bytes) AS bytes, max(last_us) AS last_us FROM ({_carried}
      SELECT topic, hour_us, {_number} AS file, count(*) AS records, sum(bytes) AS bytes, max(heard_us) AS last_us FROM log_line l WHERE k = {_k} AND NOT replay GROUP BY topic, hour_us)
      GROUP BY topic, hour_us, file), (SELECT max(heard_us) AS now_us FROM log_line WHERE k <= {_k}))""",
    )


@query(
    " UNION ALL ".join(
        f"SELECT topic, hour_us, CAST(file AS BIGINT) AS file, {k}::BIGINT AS batch, reason, CAST(bytes AS BIGINT) AS bytes, CAST(records AS BIGINT) AS records FROM closing_{k} WHERE reason IS NOT NULL"
        for k in range(STREAM_FILES + 1)
    )
)
def stream_archive_files(run: Run) -> DataFrame:
    """The files that four batches of two topics and a shutdown close, why, and the records found in them."""
    e, topics = F.col("event_id"), F.array(F.lit("fleet.position"), F.when(F.col("temp_c").isNotNull(), "fleet.status"))
    header = F.array(F.struct(F.lit(archive.REPLAY_HEADER).alias("key"), F.lit("x").cast("binary").alias("value")))
    records = run.fixes.withColumn("topic", F.explode(F.array_compact(topics))).select(
        "topic", (F.col("user_id") % 12).cast("int").alias("partition"), e.alias("offset"), F.col("received_us").alias("timestamp_us"),
        F.col("shipment_id").alias("key"), F.concat(F.lit('{"eventId":"e-'), e.cast("string"), F.lit('"}')).alias("value"),
        F.when(e % 53 == 0, header).otherwise(F.array().cast("array<struct<key:string,value:binary>>")).alias("headers"),
        (F.col("received_us") + F.col("user_id") % 3 * (1800 * MICROS)).alias("heard_us"),
    )
    path = new_table(run.spark, "closing")
    closer = closing.ArchiveCloser(path, CLOSE_POLICY)
    flows.run_batches(_as_stream(run, records, "heard_us"), "closing", closer)
    closer.shut_down(run.spark, STREAM_FILES - 1)
    schema = f"record_topic string, {archive.RECORD_SCHEMA}, dt string, hour string"
    files = run.spark.read.schema(schema).json(f"{path}/files")
    hour_us = archive.hour_of_directory(files).alias("hour_us")
    found = files.groupBy("topic", hour_us, F.col("batch").cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("records"))
    told = closer.closed(run.spark, STREAM_FILES + 1).drop("records")
    return told.join(found, ["topic", "hour_us", "batch"]).select(
        "topic", "hour_us", F.col("file").cast("bigint").alias("file"), "batch", "reason", "bytes", "records"
    )
