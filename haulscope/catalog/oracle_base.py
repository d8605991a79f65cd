"""SQL twins of the fleet tables and operators, written with plain windows for an ANSI engine.

``compose`` puts in front of a statement exactly those named parts it mentions.
"""

from __future__ import annotations

import re

from haulscope.sources.plan import COLUMNS, values_sql

PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def compose(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                if name in visiting:
                    continue
                visiting.add(name)
                visit(PARTS[name])
                if name not in needed:
                    needed.append(name)

    visiting: set[str] = set()
    visit(sql)
    if not needed:
        return sql.strip()
    heads = []
    for n in needed:
        body = PARTS[n]
        heads.append(f"{n} AS MATERIALIZED (\n{body}\n)" if "RECURSIVE" not in body else body.replace("RECURSIVE ", "", 1))
    return "WITH RECURSIVE " + ",\n".join(heads) + "\n" + sql.strip()


def up(expr: str, places: int) -> str:
    scale = "1" + "0" * places + ".0::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale})"


def uuid3(*parts: str) -> str:
    name = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    h = f"md5({name})"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-3' || substr({h},14,3) || '-' || "
        f"substr('89ab', CAST((strpos('0123456789abcdef', substr({h},17,1)) - 1) % 4 + 1 AS BIGINT), 1) || substr({h},18,3) "
        f"|| '-' || substr({h},21,12))"
    )


def instant(us: str) -> str:
    return f"regexp_replace(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.%f') || 'Z', '(\\.000000|000)Z$', 'Z')"


def dist(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2.0::DOUBLE * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


def brg(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"atan2(sin(radians({lon2} - {lon1})) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - "
        f"sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1})))"
    )


def sev_rank(col: str) -> str:
    return f"CASE {col} WHEN 'INFO' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'CRITICAL' THEN 2 ELSE -1 END"


def sev_name(rank: str) -> str:
    return f"CASE {rank} WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'CRITICAL' END"


part("lane_stop", f"SELECT * FROM (VALUES {values_sql()}) AS t({COLUMNS})")
part("lane_size", "SELECT lane, count(*) AS s FROM lane_stop GROUP BY lane")
part("lane_final", "SELECT lane, arg_max(stop_id, seq) AS stop_id FROM lane_stop GROUP BY lane")
part(
    "lane_leg",
    """SELECT * FROM (SELECT lane, seq, lat AS lat_a, lon AS lon_a,
    lead(lat) OVER (PARTITION BY lane ORDER BY seq) AS lat_b, lead(lon) OVER (PARTITION BY lane ORDER BY seq) AS lon_b
  FROM lane_stop) WHERE lat_b IS NOT NULL""",
)
part(
    "fix_base",
    """SELECT event_id, user_id, value, epoch_us(ts) AS us,
    CASE user_id % 4 WHEN 0 THEN 'DEL' WHEN 1 THEN 'HYD' WHEN 2 THEN 'BLR' ELSE 'BOM' END AS lane,
    CASE WHEN length(CAST(user_id AS VARCHAR)) >= 4 THEN CAST(user_id AS VARCHAR) ELSE lpad(CAST(user_id AS VARCHAR), 4, '0') END AS pad,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
    count(*) OVER (PARTITION BY user_id) AS n
  FROM events""",
)
part(
    "fix_leg",
    """SELECT b.*, s, CAST(floor(f) AS BIGINT) AS j, f - floor(f) AS u
  FROM (SELECT fb.*, ls.s, CAST((k - 1) * ls.s AS DOUBLE) / CAST(n AS DOUBLE) AS f
        FROM fix_base fb JOIN lane_size ls USING (lane)) b""",
)
part(
    "fixes",
    """SELECT event_id, user_id, l.lane, 'SHP-' || l.lane || '-' || pad AS shipment_id, 'VEH-' || pad AS vehicle_id,
    'TLM-' || pad AS tracker_id, 'DEV-' || pad AS probe_id,
    (1788220800 + (us - 1704067200000000) // 60000000) * 1000000 AS occurred_us,
    (1788220800 + (us - 1704067200000000) // 60000000 + event_id % 97) * 1000000 AS received_us,
    a.lat + (coalesce(b.lat, a.lat) - a.lat) * t + CAST(event_id * 7919 % 1000 - 500 AS DOUBLE) / 500.0::DOUBLE * 0.002::DOUBLE
      + CASE WHEN user_id % 7 = 3 AND j = 1 AND t > 0.2::DOUBLE AND t < 0.8::DOUBLE THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS lat,
    a.lon + (coalesce(b.lon, a.lon) - a.lon) * t AS lon,
    CASE WHEN still THEN 0.0::DOUBLE ELSE 20.0::DOUBLE + value / 5.0::DOUBLE END AS speed_kph,
    CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 50 * 3 AS DOUBLE) END AS accuracy_m,
    CASE WHEN l.lane = 'HYD' THEN 4.0::DOUBLE + CAST(event_id % 7 AS DOUBLE) / 10.0::DOUBLE
      + CASE WHEN user_id % 3 = 1 AND k >= hot_k AND k < hot_k + 8 THEN 9.0::DOUBLE ELSE 0.0::DOUBLE END END AS temp_c,
    CASE WHEN l.lane = 'HYD' THEN 4.0::DOUBLE END AS setpoint_c
  FROM (SELECT q.*,
      CASE WHEN parked THEN 0.0::DOUBLE WHEN halted THEN 0.5::DOUBLE ELSE (u - 0.4::DOUBLE) / 0.6::DOUBLE END AS t,
      parked OR halted AS still, CASE WHEN user_id % 8 = 5 THEN n - 7 ELSE n // 3 END AS hot_k
    FROM (SELECT *, (u < 0.4::DOUBLE OR j = s - 1) AS parked, (user_id % 5 = 2 AND j = 1 AND u < 0.8::DOUBLE) AS halted FROM fix_leg) q) l
  JOIN lane_stop a ON a.lane = l.lane AND a.seq = l.j
  LEFT JOIN lane_stop b ON b.lane = l.lane AND b.seq = l.j + 1""",
)
part(
    "track",
    "SELECT * FROM fixes QUALIFY row_number() OVER (PARTITION BY shipment_id, occurred_us ORDER BY event_id) = 1",
)
part(
    "pair_label",
    f"""SELECT shipment_id, stop_id, seq, occurred_us, event_id, usable,
    CASE WHEN NOT usable THEN NULL WHEN m < radius_m THEN 'in' WHEN m > radius_m * 1.25::DOUBLE THEN 'out' END AS label
  FROM (SELECT t.shipment_id, s.stop_id, s.seq, t.occurred_us, t.event_id, s.radius_m,
      coalesce(t.accuracy_m <= s.radius_m * 0.25::DOUBLE, true) AS usable,
      {dist('t.lat', 't.lon', 's.lat', 's.lon')} AS m
    FROM track t JOIN lane_stop s USING (lane))""",
)
part(
    "pair_side",
    """SELECT *, sum(turn) OVER (PARTITION BY shipment_id, stop_id ORDER BY occurred_us) AS run FROM (
    SELECT *, CASE WHEN side <> lag(side, 1, 'out') OVER (PARTITION BY shipment_id, stop_id ORDER BY occurred_us) THEN 1 ELSE 0 END AS turn
    FROM (SELECT *, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY shipment_id, stop_id ORDER BY occurred_us), 'out') AS side
      FROM pair_label))""",
)
part(
    "pair_run",
    """SELECT shipment_id, stop_id, side, run, start_us, min(occurred_us) AS proof_us, min_by(event_id, occurred_us) AS proof_id FROM (
    SELECT *, min(occurred_us) OVER (PARTITION BY shipment_id, stop_id, run) AS start_us FROM pair_side WHERE run > 0)
  WHERE usable AND occurred_us - start_us >= 180000000 GROUP BY ALL""",
)
part(
    "visit",
    """SELECT a.shipment_id, a.stop_id, a.start_us AS arrived_us, a.proof_us AS arrival_proof_us, a.proof_id AS arrival_caused_by,
    d.start_us AS departed_us, d.proof_us AS departure_proof_us, d.proof_id AS departure_caused_by,
    (d.start_us - a.start_us) // 1000000 AS dwell_s
  FROM (SELECT * FROM pair_run WHERE side = 'in' QUALIFY row_number() OVER (PARTITION BY shipment_id, stop_id ORDER BY run) = 1) a
  LEFT JOIN (SELECT r.* FROM pair_run r JOIN (SELECT shipment_id, stop_id, min(run) AS r0 FROM pair_run WHERE side = 'in' GROUP BY ALL) f
      USING (shipment_id, stop_id) WHERE side = 'out' AND run > r0
      QUALIFY row_number() OVER (PARTITION BY shipment_id, stop_id ORDER BY run) = 1) d
    ON a.shipment_id = d.shipment_id AND a.stop_id = d.stop_id""",
)

part(
    "learned",
    """RECURSIVE learned AS (
    SELECT *, CASE WHEN moving THEN speed_kph END AS learned_kph, 0::BIGINT AS moving_s,
      CASE WHEN moving THEN occurred_us END AS last_moving_us, 0.0::DOUBLE AS gap_s
    FROM numbered_track WHERE rn = 1
    UNION ALL
    SELECT t.*,
      CASE WHEN NOT t.moving THEN l.learned_kph WHEN l.learned_kph IS NULL THEN t.speed_kph
        ELSE l.learned_kph + (1 - pow(2.0::DOUBLE, -((t.occurred_us - l.occurred_us) / 1000000.0::DOUBLE) / 300.0::DOUBLE)) * (t.speed_kph - l.learned_kph) END,
      CASE WHEN t.moving THEN least(900, l.moving_s + (t.occurred_us - l.occurred_us) // 1000000) ELSE l.moving_s END,
      CASE WHEN t.moving THEN t.occurred_us ELSE l.last_moving_us END,
      (t.occurred_us - l.occurred_us) / 1000000.0::DOUBLE
    FROM learned l JOIN numbered_track t ON t.shipment_id = l.shipment_id AND t.rn = l.rn + 1)""",
)
part(
    "numbered_track",
    """SELECT shipment_id, lane, occurred_us, event_id, lat, lon, speed_kph, accuracy_m,
    coalesce(speed_kph >= 5.0::DOUBLE, false) AS moving,
    row_number() OVER (PARTITION BY shipment_id ORDER BY occurred_us) AS rn FROM track""",
)
part(
    "ahead",
    """SELECT s.shipment_id, s.occurred_us,
    bool_or(s.side = 'in' AND coalesce(s.occurred_us < v.departure_proof_us, true)) AS at_a_stop,
    arg_min(s.stop_id, s.seq) FILTER (WHERE NOT coalesce(v.arrival_proof_us <= s.occurred_us, false)) AS stop_id
  FROM pair_side s LEFT JOIN visit v USING (shipment_id, stop_id) GROUP BY s.shipment_id, s.occurred_us""",
)
part(
    "candidate",
    f"""SELECT *, row_number() OVER (PARTITION BY shipment_id, stop_id ORDER BY occurred_us) AS cn,
    occurred_us + CAST(floor(km / greatest(5.0::DOUBLE, coalesce(learned_kph, 60.0::DOUBLE)) * 3600.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) * 1000000 AS estimate_us
  FROM (SELECT l.*, a.stop_id, {dist('l.lat', 'l.lon', 's.lat', 's.lon')} / 1000.0::DOUBLE * 1.30::DOUBLE AS km
    FROM learned l JOIN ahead a USING (shipment_id, occurred_us)
    JOIN lane_stop s ON s.lane = l.lane AND s.stop_id = a.stop_id WHERE NOT at_a_stop)""",
)
part(
    "chain",
    """RECURSIVE chain AS (
    SELECT *, true AS kept, NULL::BIGINT AS previous_us, estimate_us AS held_us FROM candidate WHERE cn = 1
    UNION ALL
    SELECT c.*, abs(c.estimate_us - h.held_us) >= 120000000, h.held_us,
      CASE WHEN abs(c.estimate_us - h.held_us) >= 120000000 THEN c.estimate_us ELSE h.held_us END
    FROM chain h JOIN candidate c ON c.shipment_id = h.shipment_id AND c.stop_id = h.stop_id AND c.cn = h.cn + 1)""",
)
part(
    "eta",
    f"""SELECT shipment_id, lane, stop_id, {uuid3("'ETA'", 'shipment_id', 'stop_id', 'event_id')} AS event_id,
    CAST(event_id AS VARCHAR) AS caused_by, occurred_us, estimate_us, previous_us, {up('km', 3)} AS remaining_km,
    {up("""least(1.0::DOUBLE, greatest(0.05::DOUBLE, (0.2::DOUBLE + 0.8::DOUBLE * least(1.0::DOUBLE, moving_s / 900.0::DOUBLE))
      * exp(-gap_s / 900.0::DOUBLE)
      * exp(-greatest(0.0::DOUBLE, coalesce((occurred_us - last_moving_us) / 1000000.0::DOUBLE, 0.0::DOUBLE)) / 1800.0::DOUBLE)
      * CASE WHEN accuracy_m IS NULL THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - accuracy_m / 500.0::DOUBLE) END))""", 2)} AS confidence
  FROM chain WHERE kept""",
)

NULLS = {"s": "NULL::VARCHAR", "b": "NULL::BIGINT", "d": "NULL::DOUBLE"}


def islands(name: str, source: str) -> None:
    """Runs of breach rows of ``source`` (breach, hold_us, excess, recovery, ... per fix), one row per proven run."""
    part(
        f"{name}_side",
        f"""SELECT *, sum(turn) OVER (PARTITION BY shipment_id ORDER BY occurred_us) AS run FROM (
    SELECT *, CASE WHEN breach <> lag(breach, 1, false) OVER (PARTITION BY shipment_id ORDER BY occurred_us) THEN 1 ELSE 0 END AS turn
    FROM {source} WHERE breach IS NOT NULL)""",
    )
    part(
        f"{name}_run",
        f"""SELECT b.*, e.cleared_us, e.cleared_by, e.recovery FROM (
    SELECT shipment_id, run, min(onset_us) AS onset_us, min(occurred_us) FILTER (WHERE proven) AS raised_us,
      max(occurred_us) FILTER (WHERE proven) AS last_us, count(*) FILTER (WHERE proven) AS findings,
      arg_min(event_id, occurred_us) FILTER (WHERE proven) AS raised_by,
      arg_min(excess, occurred_us) FILTER (WHERE proven) AS first_excess, arg_max(excess, occurred_us) FILTER (WHERE proven) AS last_excess,
      arg_min(observed, occurred_us) FILTER (WHERE proven) AS first_observed, arg_max(observed, occurred_us) FILTER (WHERE proven) AS last_observed,
      arg_min(threshold, occurred_us) FILTER (WHERE proven) AS first_threshold,
      arg_min(severity, occurred_us) FILTER (WHERE proven) AS severity,
      greatest(max(excess) FILTER (WHERE NOT proven), arg_min(excess, occurred_us) FILTER (WHERE proven)) AS raise_worst, max(excess) AS worst
    FROM (SELECT *, occurred_us - onset_us >= hold_us AS proven FROM
      (SELECT *, min(occurred_us) OVER (PARTITION BY shipment_id, run) AS onset_us FROM {name}_side WHERE breach))
    GROUP BY shipment_id, run) b
  LEFT JOIN (SELECT shipment_id, run, arg_min(event_id, occurred_us) AS cleared_by, min(occurred_us) AS cleared_us,
      arg_min(recovery, occurred_us) AS recovery FROM {name}_side WHERE NOT breach GROUP BY shipment_id, run) e
    ON e.shipment_id = b.shipment_id AND e.run = b.run + 1
  WHERE raised_us IS NOT NULL""",
    )


def incident(kind: str, source: str, stop: str, columns: str) -> str:
    return f"""SELECT {uuid3("'INCIDENT'", f"'{kind}'", 'shipment_id', 'stop_id', instant('onset_us'))} AS exception_id, '{kind}' AS type,
    *, CASE WHEN cleared_us IS NULL THEN 'OPEN' ELSE 'CLEARED' END AS state,
    CASE WHEN cleared_us IS NOT NULL THEN greatest(0, (cleared_us - onset_us) // 1000000) END AS open_s
  FROM (SELECT shipment_id, {stop} AS stop_id, {columns} FROM {source})"""


def minutes(us: str) -> str:
    return f"(({us}) // 60000000)"


part(
    "terms",
    """SELECT shipment_id, lane, user_id,
    CASE WHEN full_body AND lane = 'HYD' THEN 2.0::DOUBLE END AS min_c,
    CASE WHEN full_body AND lane = 'HYD' THEN CASE WHEN fault = 3 THEN 99.0::DOUBLE ELSE 8.0::DOUBLE END END AS max_c,
    CASE WHEN full_body AND lane = 'HYD' THEN 1800 END::BIGINT AS tolerance_s,
    CASE WHEN full_body AND lane = 'DEL' THEN 1788220800000000 END::BIGINT AS opens_us,
    CASE WHEN full_body AND lane = 'DEL' THEN last_us - (user_id % 5) * 1200000000 END AS closes_us,
    full_body AND lane = 'HYD' AS cold_chain, customer_id, mode, schema_version, created_us, fault, full_body
  FROM manifest_fact""",
)
part(
    "manifest_fact",
    """SELECT user_id, shipment_id, lane, last_us, fault, user_id % 29 <> 7 AS full_body,
    CASE WHEN fault = 4 THEN 'NOBODY' ELSE CASE lane WHEN 'HYD' THEN 'MEDIVAULT' WHEN 'DEL' THEN 'VISTAMART' WHEN 'BLR' THEN 'SOUTHERN-FREIGHT' ELSE 'QUICKSHIP' END END AS customer_id,
    CASE lane WHEN 'HYD' THEN 'PHARMA_COLD_CHAIN' WHEN 'DEL' THEN 'RETAIL_REPLENISHMENT' WHEN 'BLR' THEN 'LTL' ELSE 'PARCEL' END AS mode,
    CASE WHEN user_id % 23 <> 5 THEN '1' END AS schema_version, (1788220800 + user_id % 1000) * 1000000 AS created_us
  FROM (SELECT user_id, any_value(shipment_id) AS shipment_id, any_value(lane) AS lane, max(occurred_us) AS last_us,
      CASE WHEN user_id % 9 = 4 THEN (user_id // 9) % 5 ELSE -1 END AS fault FROM fixes GROUP BY user_id)""",
)
part(
    "reading",
    """SELECT t.shipment_id, t.occurred_us, t.event_id, NOT (temp_c BETWEEN low AND high) AS breach, hold_us,
    greatest(temp_c - high, low - temp_c, 0.0::DOUBLE) AS excess, temp_c AS observed,
    CASE WHEN temp_c > high THEN high WHEN temp_c < low THEN low END AS threshold,
    CASE WHEN agreed THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'RECOVERED' AS recovery
  FROM (SELECT t.*, m.min_c IS NOT NULL AS agreed, coalesce(m.min_c, setpoint_c - 3) AS low, coalesce(m.max_c, setpoint_c + 3) AS high,
      CASE WHEN m.min_c IS NOT NULL THEN coalesce(m.tolerance_s, 1200) ELSE 1200 END * 1000000 AS hold_us
    FROM track t LEFT JOIN terms m USING (shipment_id) WHERE temp_c IS NOT NULL) t""",
)
part(
    "standing",
    f"""SELECT shipment_id, occurred_us, event_id,
    CASE WHEN coalesce(accuracy_m <= 150.0::DOUBLE, true) AND speed_kph IS NOT NULL THEN speed_kph < 5.0::DOUBLE AND NOT expected END AS breach,
    1200000000 AS hold_us, km AS excess, NULL::DOUBLE AS observed, 20.0::DOUBLE AS threshold,
    CASE WHEN cold_chain THEN 'CRITICAL' ELSE 'WARNING' END AS severity, CASE WHEN speed_kph >= 5.0::DOUBLE THEN 'RESUMED' ELSE 'RECOVERED' END AS recovery
  FROM (SELECT t.shipment_id, t.occurred_us, t.event_id, any_value(t.accuracy_m) AS accuracy_m, any_value(t.speed_kph) AS speed_kph,
      bool_or({dist('t.lat', 't.lon', 's.lat', 's.lon')} <= s.radius_m * 2.0::DOUBLE) AS expected,
      min({dist('t.lat', 't.lon', 's.lat', 's.lon')}) / 1000.0::DOUBLE AS km
    FROM track t JOIN lane_stop s USING (lane) GROUP BY ALL) LEFT JOIN terms USING (shipment_id)""",
)
part(
    "leg_fact",
    f"""SELECT event_id, shipment_id, occurred_us, accuracy_m, min(CASE WHEN leg < 1.0::DOUBLE THEN least(to_a, to_b) WHEN cos(turn) < 0 THEN to_a
      WHEN acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, cos(to_a / 6371008.8::DOUBLE) / cos(xt)))) * 6371008.8::DOUBLE > leg THEN to_b
      ELSE abs(xt) * 6371008.8::DOUBLE END) / 1000.0::DOUBLE AS km
  FROM (SELECT *, asin(sin(to_a / 6371008.8::DOUBLE) * sin(turn)) AS xt FROM (
    SELECT t.event_id, t.shipment_id, t.occurred_us, t.accuracy_m, {dist('lat_a', 'lon_a', 't.lat', 't.lon')} AS to_a, {dist('lat_b', 'lon_b', 't.lat', 't.lon')} AS to_b,
      {dist('lat_a', 'lon_a', 'lat_b', 'lon_b')} AS leg, {brg('lat_a', 'lon_a', 't.lat', 't.lon')} - {brg('lat_a', 'lon_a', 'lat_b', 'lon_b')} AS turn
    FROM track t JOIN lane_leg g USING (lane)))
  GROUP BY event_id, shipment_id, occurred_us, accuracy_m""",
)
part(
    "off_plan",
    """SELECT shipment_id, occurred_us, event_id, CASE WHEN coalesce(accuracy_m <= 150.0::DOUBLE, true) THEN km > 12.0::DOUBLE END AS breach,
    900000000 AS hold_us, km AS excess, km AS observed, 12.0::DOUBLE AS threshold, 'WARNING' AS severity, 'BACK_ON_ROUTE' AS recovery
  FROM leg_fact""",
)
islands("hot", "reading")
islands("idle", "standing")
islands("astray", "off_plan")


def _sustained(obs_first: str, obs_last: str, detail_first: str, detail_last: str) -> str:
    return f"""severity, onset_us, raised_us, last_us AS last_seen_us, cleared_us, findings - 1 AS restated,
    CAST(raised_by AS VARCHAR) AS raised_by, CAST(cleared_by AS VARCHAR) AS cleared_by, {detail_first} AS raised_detail, {detail_last} AS detail,
    {obs_first} AS raised_value, {obs_last} AS observed_value, first_threshold AS threshold_value, worst, recovery AS resolution"""


def _hot(obs: str, worst: str, at: str) -> str:
    return (
        f"printf('%.1fC is outside ', {obs}) || CASE WHEN severity = 'CRITICAL' THEN printf('the agreed %.1f to %.1fC band', min_c, max_c) "
        f"ELSE 'its reported setpoint' END || printf(', peaking at %.1fC outside it, and has been for %d minutes', {worst}, {minutes(at + ' - onset_us')})"
    )


def _idle(km: str, at: str) -> str:
    return (
        f"printf('Stationary for %d minutes %.0f km from the nearest scheduled stop.', {minutes(at + ' - onset_us')}, {km}) || "
        "CASE WHEN severity = 'CRITICAL' THEN ' The load is temperature-controlled.' ELSE '' END"
    )


def _astray(km: str, worst: str, at: str) -> str:
    return (
        f"printf('%.0f km off the planned route for %d minutes', {km}, {minutes(at + ' - onset_us')}) || "
        f"CASE WHEN {worst} <= {km} THEN '' ELSE printf(', having reached %.0f km', {worst}) END || '.'"
    )


part(
    "hot_incident",
    incident(
        "TEMPERATURE_EXCURSION", "hot_run LEFT JOIN terms USING (shipment_id)", NULLS["s"],
        _sustained("first_observed", "last_observed", _hot("first_observed", "raise_worst", "raised_us"), _hot("last_observed", "worst", "last_us")),
    ),
)
part(
    "idle_incident",
    incident(
        "UNPLANNED_STOP", "idle_run", NULLS["s"],
        _sustained(
            f"CAST({minutes('raised_us - onset_us')} AS DOUBLE)", f"CAST({minutes('last_us - onset_us')} AS DOUBLE)",
            _idle("first_excess", "raised_us"), _idle("last_excess", "last_us"),
        ),
    ),
)
part(
    "astray_incident",
    incident(
        "ROUTE_DEVIATION", "astray_run", NULLS["s"],
        _sustained("first_observed", "last_observed", _astray("first_excess", "raise_worst", "raised_us"), _astray("last_excess", "worst", "last_us")),
    ),
)
part(
    "late_row",
    f"""SELECT r.*, m.closes_us, estimate_us - closes_us AS late_us, NOT arrived AND estimate_us - closes_us > 900000000 AS breach FROM (
    SELECT shipment_id, stop_id, occurred_us, event_id, estimate_us, remaining_km, confidence, false AS arrived FROM eta
    UNION ALL
    SELECT shipment_id, stop_id, arrived_us, {uuid3("'ARRIVED'", 'shipment_id', 'stop_id', instant('arrived_us'))}, arrived_us, NULL, NULL, true FROM visit) r
  JOIN (SELECT stop_id FROM lane_final) USING (stop_id) JOIN terms m USING (shipment_id) WHERE closes_us IS NOT NULL""",
)
part(
    "late_side",
    """SELECT *, sum(turn) OVER (PARTITION BY shipment_id ORDER BY occurred_us) AS run, arrived AND late_us > 0 AS late FROM (
    SELECT *, coalesce(lag(breach) OVER (PARTITION BY shipment_id ORDER BY occurred_us), false) AS was,
      CASE WHEN breach <> lag(breach, 1, false) OVER (PARTITION BY shipment_id ORDER BY occurred_us) THEN 1 ELSE 0 END AS turn FROM late_row)""",
)
part(
    "late_text",
    f"""SELECT s.*, CASE WHEN arrived THEN printf('Arrived %d minutes after the delivery window closed.', {minutes('late_us')})
    ELSE printf('Projected to arrive %d minutes after the delivery window closes at %s, %.0f km still to run (confidence %.0f%%).',
      {minutes('late_us')}, {instant('closes_us')}, floor(remaining_km + 0.5::DOUBLE), floor(confidence * 100 + 0.5::DOUBLE)) END AS detail,
    CASE WHEN breach THEN run WHEN was THEN run - 1 ELSE -1 END AS island,
    CASE WHEN NOT arrived THEN 'BACK_WITHIN_WINDOW' WHEN late THEN 'ARRIVED_LATE' ELSE 'ARRIVED_ON_TIME' END AS how
  FROM late_side s WHERE breach OR was OR late""",
)
part(
    "late_incident",
    incident(
        "LATE_ARRIVAL", "late_group", "stop_id AS stop0, stop0",
        """severity, onset_us, raised_us, last_seen_us, cleared_us, restated, raised_by, cleared_by, raised_detail, detail, raised_value,
    observed_value, threshold_value, NULL::DOUBLE AS worst, resolution""",
    ).replace("stop_id AS stop0, stop0 AS stop_id", "stop_id"),
)
part(
    "late_group",
    f"""SELECT shipment_id, stop_id, coalesce(min(occurred_us) FILTER (WHERE breach), min(closes_us)) AS onset_us,
    CASE WHEN bool_or(late) THEN 'CRITICAL' ELSE 'WARNING' END AS severity, min(occurred_us) FILTER (WHERE breach OR late) AS raised_us,
    max(occurred_us) FILTER (WHERE breach OR late) AS last_seen_us, min(occurred_us) FILTER (WHERE NOT breach) AS cleared_us,
    count(*) FILTER (WHERE breach OR late) - 1 AS restated, arg_min(event_id, occurred_us) FILTER (WHERE breach OR late) AS raised_by,
    arg_min(event_id, occurred_us) FILTER (WHERE NOT breach) AS cleared_by,
    arg_min(detail, occurred_us) FILTER (WHERE breach OR late) AS raised_detail, arg_max(detail, occurred_us) FILTER (WHERE breach OR late) AS detail,
    CAST(arg_min({minutes('late_us')}, occurred_us) FILTER (WHERE breach OR late) AS DOUBLE) AS raised_value,
    CAST(arg_max({minutes('late_us')}, occurred_us) FILTER (WHERE breach OR late) AS DOUBLE) AS observed_value,
    arg_min(CASE WHEN arrived THEN 0.0::DOUBLE ELSE 15.0::DOUBLE END, occurred_us) FILTER (WHERE breach OR late) AS threshold_value,
    arg_min(how, occurred_us) FILTER (WHERE NOT breach) AS resolution
  FROM late_text GROUP BY shipment_id, stop_id, island""",
)
part(
    "completion",
    "SELECT shipment_id, arrived_us AS completed_us FROM visit JOIN (SELECT stop_id FROM lane_final) USING (stop_id)",
)
part(
    "sighting",
    f"""SELECT shipment_id, occurred_us, min(event_id) AS event_id FROM (
    SELECT shipment_id, occurred_us, CAST(event_id AS VARCHAR) AS event_id FROM track
    UNION ALL SELECT shipment_id, occurred_us, event_id FROM feed_event WHERE type = 'status'
    UNION ALL SELECT shipment_id, arrived_us, {uuid3("'ARRIVED'", 'shipment_id', 'stop_id', instant('arrived_us'))} FROM visit
    UNION ALL SELECT shipment_id, departed_us, {uuid3("'DEPARTED'", 'shipment_id', 'stop_id', instant('departed_us'))} FROM visit WHERE departed_us IS NOT NULL
    UNION ALL SELECT shipment_id, occurred_us, event_id FROM eta) GROUP BY shipment_id, occurred_us""",
)
part(
    "quiet",
    """SELECT shipment_id, onset_us, cleared_us, raised_by, cleared_by, cleared_us - onset_us AS quiet_us,
    CASE WHEN cleared_us = completed_us THEN 'SHIPMENT_COMPLETED' ELSE 'REPORTING_AGAIN' END AS resolution FROM (
    SELECT shipment_id, completed_us, occurred_us AS cleared_us, event_id AS cleared_by, lag(occurred_us) OVER w AS onset_us, lag(event_id) OVER w AS raised_by
    FROM sighting LEFT JOIN completion USING (shipment_id) WHERE completed_us IS NULL OR occurred_us <= completed_us
    WINDOW w AS (PARTITION BY shipment_id ORDER BY occurred_us)) WHERE cleared_us - onset_us >= 1800000000
  UNION ALL
  SELECT shipment_id, last_us, NULL, last_id, NULL, fleet_us - last_us, NULL FROM (
    SELECT shipment_id, max(occurred_us) AS last_us, arg_max(event_id, occurred_us) AS last_id FROM sighting
    WHERE shipment_id NOT IN (SELECT shipment_id FROM completion) GROUP BY shipment_id), (SELECT max(occurred_us) AS fleet_us FROM sighting)
  WHERE fleet_us - last_us >= 1800000000""",
)
_quiet_text = f"printf('No events of any kind for %d minutes; last heard from at %s.', {minutes('quiet_us')}, {instant('onset_us')})"
part(
    "quiet_incident",
    incident(
        "SIGNAL_LOSS", "quiet LEFT JOIN (SELECT shipment_id, cold_chain FROM terms) USING (shipment_id)", NULLS["s"],
        f"""CASE WHEN cold_chain THEN 'CRITICAL' ELSE 'WARNING' END AS severity, onset_us, onset_us + 1800000000 AS raised_us,
    onset_us + 1800000000 AS last_seen_us, cleared_us, 0::BIGINT AS restated, CAST(raised_by AS VARCHAR) AS raised_by,
    CAST(cleared_by AS VARCHAR) AS cleared_by, {_quiet_text} AS raised_detail, {_quiet_text} AS detail, NULL::DOUBLE AS raised_value,
    NULL::DOUBLE AS observed_value, NULL::DOUBLE AS threshold_value, NULL::DOUBLE AS worst, resolution""",
    ),
)
INCIDENT_COLUMNS = (
    "exception_id, type, shipment_id, stop_id, severity, state, onset_us, raised_us, last_seen_us, cleared_us, open_s, restated, "
    "raised_by, cleared_by, raised_detail, detail, raised_value, observed_value, threshold_value, worst, resolution"
)
part(
    "incidents",
    "\n  UNION ALL ".join(
        f"SELECT {INCIDENT_COLUMNS} FROM {n}_incident" for n in ("hot", "idle", "astray", "late", "quiet")
    ),
)
