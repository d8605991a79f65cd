"""SQL twins of the feed normalization, computed from the structured columns and not from the texts."""

from __future__ import annotations

from haulscope.catalog.oracle_base import part, uuid3

part(
    "asg",
    """SELECT shipment_id, tracker_id, probe_id, CASE WHEN second AND k = 1 THEN 'VEH-' || CAST(user_id + 500000 AS VARCHAR) ELSE vehicle_id END AS vehicle_id,
    CASE WHEN second AND k IN (1, 3) THEN mid WHEN second THEN mid + half ELSE beg END AS from_us,
    CASE WHEN k = 3 AND second THEN mid + half WHEN k IN (1, 2) AND NOT second THEN mid ELSE 4611686018427387904 END AS to_us
  FROM (SELECT *, user_id % 10 AS k, 1788220800000000 AS beg, 1788242400000000 AS mid, 1800000000 AS half
      FROM (SELECT DISTINCT user_id, shipment_id, vehicle_id, tracker_id, probe_id FROM fixes), (VALUES (false), (true)) AS v(second))
  WHERE NOT second OR k IN (1, 2, 3)""",
)
part(
    "asg_key",
    """SELECT 'vehicle' AS key_kind, vehicle_id AS key, shipment_id, vehicle_id, from_us, to_us FROM asg
  UNION ALL SELECT 'shipment', shipment_id, shipment_id, vehicle_id, from_us, to_us FROM asg
  UNION ALL SELECT 'device', tracker_id, shipment_id, vehicle_id, from_us, to_us FROM asg
  UNION ALL SELECT 'device', probe_id, shipment_id, vehicle_id, from_us, to_us FROM asg""",
)


def asof(kind: str, key: str) -> str:
    """Identity per fix by one kind of key: exactly one covering assignment or nothing."""
    return f"""SELECT f.event_id, CASE WHEN count(a.key) = 1 THEN any_value(a.shipment_id) END AS as_shipment,
    CASE WHEN count(a.key) = 1 THEN any_value(a.vehicle_id) END AS as_vehicle
  FROM fixes f LEFT JOIN asg_key a ON a.key_kind = '{kind}' AND a.key = f.{key} AND a.from_us <= f.occurred_us AND f.occurred_us < a.to_us
  GROUP BY f.event_id"""


part(
    "feed_fact",
    """SELECT f.*, event_id % 41 = 0 OR event_id % 43 = 0 AS broken, event_id % 59 = 0 AS wild,
    CASE WHEN event_id % 59 = 0 THEN 95.0::DOUBLE ELSE lat END AS m_lat FROM fixes f WHERE event_id % 4 <> 3""",
)
part(
    "tele_fact",
    """SELECT *, CASE WHEN event_id % 13 = 0 THEN received_us ELSE occurred_us END AS at_us, event_id % 5 AS un FROM feed_fact WHERE event_id % 4 = 0""",
)
part(
    "mob_fact",
    """SELECT *, occurred_us AS at_us, CASE (event_id // 4) % 6 WHEN 0 THEN 'ping' WHEN 1 THEN 'arrive' WHEN 2 THEN 'depart' WHEN 3 THEN 'delivered'
    WHEN 4 THEN 'ping' ELSE 'teleport' END AS word FROM feed_fact WHERE event_id % 4 = 1""",
)
part(
    "reef_fact",
    """SELECT *, CASE WHEN event_id % 3 = 0 THEN occurred_us + 123456 ELSE occurred_us END AS at_us FROM feed_fact WHERE event_id % 4 = 2""",
)
part(
    "edi_fact",
    """SELECT f.*, event_id // 40 AS number, (event_id // 40) % 8 AS kind, (event_id % 40) // 4 + 1 AS pos,
    occurred_us // 60000000 * 60000000 AS at_us,
    ['X3','AF','X1','CD','X4','AG','SD','ZZ'][(event_id // 4) % 8 + 1] AS code,
    max(received_us) OVER (PARTITION BY event_id // 40) AS m_received, count(*) OVER (PARTITION BY event_id // 40) AS n,
    row_number() OVER (PARTITION BY event_id // 40 ORDER BY event_id) AS set_no
  FROM fixes f WHERE event_id % 4 = 3""",
)
part(
    "ident",
    """SELECT k.event_id, CASE WHEN count(a.key) = 1 THEN any_value(a.shipment_id) END AS as_shipment,
    CASE WHEN count(a.key) = 1 THEN any_value(a.vehicle_id) END AS as_vehicle FROM (
      SELECT event_id, 'vehicle' AS key_kind, vehicle_id AS key, at_us FROM tele_fact
      UNION ALL SELECT event_id, 'shipment', shipment_id, at_us FROM mob_fact
      UNION ALL SELECT event_id, 'device', probe_id, at_us FROM reef_fact
      UNION ALL SELECT event_id, 'shipment', shipment_id, at_us FROM edi_fact) k
  LEFT JOIN asg_key a ON a.key_kind = k.key_kind AND a.key = k.key AND a.from_us <= k.at_us AND k.at_us < a.to_us GROUP BY k.event_id""",
)
_TEXT = "strftime(make_timestamp(at_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN nano THEN '.123456789Z' ELSE 'Z' END"
_EMPTY = "CASE WHEN event_id % 41 = 0 OR event_id % 43 = 0 THEN 'unreadable JSON' "
part(
    "tele_row",
    """SELECT 'm-' || event_id AS message_id, 'TELEMATICS' AS source, 0 AS set_no, received_us AS m_received, at_us, false AS nano,
    CASE WHEN broken THEN 'MALFORMED_PAYLOAD' WHEN event_id % 31 = 0 THEN 'MISSING_FIELD' WHEN as_vehicle IS NULL THEN 'UNRESOLVED_IDENTITY'
      WHEN un = 3 THEN 'INVALID_VALUE' END AS reason,
    CASE WHEN broken THEN 'unreadable JSON' WHEN event_id % 31 = 0 THEN 'vehicle.id' WHEN as_vehicle IS NULL THEN 'no load assigned to vehicle ' || vehicle_id
      WHEN un = 3 THEN 'unknown odometer unit: furlong' END AS detail,
    CASE WHEN wild THEN 'position.latitude must be less than or equal to 90.0' END AS violation,
    'position' AS type, tracker_id AS reporter, '' AS discriminator, as_shipment AS shipment_id, as_vehicle AS vehicle_id, tracker_id AS device_id,
    m_lat AS lat, lon, speed_kph, CAST((event_id % 720 + 180) % 360 AS DOUBLE) AS heading_deg,
    CASE WHEN un IN (0, 2) THEN event_id * 1.5::DOUBLE * 1.609344::DOUBLE WHEN un = 1 THEN event_id * 1.5::DOUBLE END AS odometer_km,
    accuracy_m, NULL::VARCHAR AS status, NULL::VARCHAR AS stop_id, NULL::VARCHAR AS reason_code, NULL::DOUBLE AS temp_c, NULL::DOUBLE AS setpoint_c,
    NULL::VARCHAR AS city, NULL::VARCHAR AS state, NULL::VARCHAR AS country
  FROM tele_fact JOIN ident USING (event_id)""",
)
part(
    "mob_row",
    """SELECT 'm-' || event_id AS message_id, 'MOBILE_APP' AS source, 0 AS set_no, received_us AS m_received, at_us, false AS nano,
    CASE WHEN broken THEN 'MALFORMED_PAYLOAD' WHEN event_id % 31 = 0 THEN 'MISSING_FIELD' WHEN as_vehicle IS NULL THEN 'UNRESOLVED_IDENTITY'
      WHEN word = 'teleport' THEN 'INVALID_VALUE' END AS reason,
    CASE WHEN broken THEN 'unreadable JSON' WHEN event_id % 31 = 0 THEN 'sid' WHEN as_vehicle IS NULL THEN 'no vehicle assigned to shipment ' || shipment_id
      WHEN word = 'teleport' THEN 'unknown evt: teleport' END AS detail,
    CASE WHEN wild THEN 'position.latitude must be less than or equal to 90.0' END AS violation,
    CASE WHEN word = 'ping' THEN 'position' ELSE 'status' END AS type, shipment_id AS reporter, word AS discriminator, shipment_id, as_vehicle AS vehicle_id,
    NULL::VARCHAR AS device_id, m_lat AS lat, lon, CASE WHEN word = 'ping' THEN speed_kph END AS speed_kph,
    CASE WHEN word = 'ping' THEN CAST((event_id % 720 + 180) % 360 AS DOUBLE) END AS heading_deg, NULL::DOUBLE AS odometer_km,
    CASE WHEN word = 'ping' THEN accuracy_m END AS accuracy_m,
    CASE word WHEN 'arrive' THEN 'ARRIVED_AT_STOP' WHEN 'depart' THEN 'DEPARTED_STOP' WHEN 'delivered' THEN 'DELIVERED' END AS status,
    CASE WHEN word <> 'ping' THEN 'stop-' || (event_id % 9) END AS stop_id, NULL::VARCHAR AS reason_code, NULL::DOUBLE AS temp_c, NULL::DOUBLE AS setpoint_c,
    NULL::VARCHAR AS city, NULL::VARCHAR AS state, NULL::VARCHAR AS country
  FROM mob_fact JOIN ident USING (event_id)""",
)
part(
    "reef_row",
    """SELECT 'm-' || event_id AS message_id, 'REEFER_SENSOR' AS source, 0 AS set_no, received_us AS m_received, at_us, event_id % 3 = 0 AS nano,
    CASE WHEN broken THEN 'MALFORMED_PAYLOAD' WHEN event_id % 31 = 0 THEN 'MISSING_FIELD' WHEN as_vehicle IS NULL THEN 'UNRESOLVED_IDENTITY' END AS reason,
    CASE WHEN broken THEN 'unreadable JSON' WHEN event_id % 31 = 0 THEN 'tempC' WHEN as_vehicle IS NULL THEN 'no shipment assigned to device ' || probe_id END AS detail,
    CASE WHEN wild THEN 'temperature.celsius must be less than or equal to 60.0' END AS violation,
    'status' AS type, probe_id AS reporter, '' AS discriminator, as_shipment AS shipment_id, as_vehicle AS vehicle_id, probe_id AS device_id,
    NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, NULL::DOUBLE AS speed_kph, NULL::DOUBLE AS heading_deg, NULL::DOUBLE AS odometer_km, NULL::DOUBLE AS accuracy_m,
    'TEMPERATURE_READING' AS status, NULL::VARCHAR AS stop_id, CASE WHEN event_id % 17 = 0 THEN 'DOOR_OPEN' END AS reason_code,
    CASE WHEN wild THEN 77.0::DOUBLE ELSE coalesce(temp_c, 5.0::DOUBLE) END AS temp_c, 4.0::DOUBLE AS setpoint_c,
    NULL::VARCHAR AS city, NULL::VARCHAR AS state, NULL::VARCHAR AS country
  FROM reef_fact JOIN ident USING (event_id)""",
)
part(
    "edi_row",
    """SELECT 'x-' || number AS message_id, 'EDI_214' AS source, set_no, m_received, at_us, false AS nano,
    CASE WHEN kind = 3 AND pos = 1 THEN 'MALFORMED_PAYLOAD' WHEN kind = 4 AND pos = 10 THEN 'MALFORMED_PAYLOAD' WHEN code = 'ZZ' THEN 'INVALID_VALUE'
      WHEN as_vehicle IS NULL THEN 'UNRESOLVED_IDENTITY' END AS reason,
    'transaction set ' || set_no || ': ' || CASE WHEN kind = 3 AND pos = 1 THEN 'SE control number 9999 does not match ST 0001'
      WHEN kind = 4 AND pos = 10 THEN 'truncated before SE terminator' WHEN code = 'ZZ' THEN 'unknown shipment status code ZZ'
      WHEN as_vehicle IS NULL THEN 'no vehicle assigned to shipment ' || shipment_id END AS detail,
    CASE WHEN event_id % 59 = 0 AND event_id % 5 <> 0 THEN 'location.stateOrProvince size must be between 0 and 3' END AS violation,
    'status' AS type, shipment_id AS reporter, code AS discriminator, shipment_id, as_vehicle AS vehicle_id, NULL::VARCHAR AS device_id,
    NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, NULL::DOUBLE AS speed_kph, NULL::DOUBLE AS heading_deg, NULL::DOUBLE AS odometer_km, NULL::DOUBLE AS accuracy_m,
    CASE code WHEN 'AF' THEN 'PICKED_UP' WHEN 'CD' THEN 'DEPARTED_STOP' WHEN 'X4' THEN 'DELIVERED' WHEN 'AG' THEN 'IN_TRANSIT' WHEN 'SD' THEN 'DELAY_REPORTED'
      ELSE 'ARRIVED_AT_STOP' END AS status, NULL::VARCHAR AS stop_id, CASE WHEN event_id % 6 = 0 THEN 'A1' END AS reason_code, NULL::DOUBLE AS temp_c,
    NULL::DOUBLE AS setpoint_c, CASE WHEN event_id % 5 <> 0 THEN 'BENGALURU' END AS city,
    CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 59 = 0 THEN 'KARNATAKA' ELSE 'KA' END END AS state, CASE WHEN event_id % 5 <> 0 THEN 'IN' END AS country
  FROM edi_fact JOIN ident USING (event_id) WHERE kind <> 2""",
)
part(
    "edi_whole",
    """SELECT DISTINCT 'x-' || number AS message_id, m_received, CASE kind WHEN 2 THEN 'expected an ISA header, found <HTML>NO'
    WHEN 1 THEN 'GE declares ' || (n + 1) || ' transaction sets, found ' || n WHEN 0 THEN 'interchange truncated: no IEA footer' END AS detail
  FROM edi_fact WHERE kind IN (0, 1, 2)""",
)
part(
    "feed_row",
    "SELECT * FROM tele_row UNION ALL SELECT * FROM mob_row UNION ALL SELECT * FROM reef_row UNION ALL SELECT * FROM edi_row",
)
part(
    "feed_event",
    f"""SELECT message_id, {uuid3('source', 'reporter', _TEXT, 'discriminator')} AS event_id, type, source, shipment_id, vehicle_id, device_id,
    at_us AS occurred_us, {_TEXT} AS occurred_text, m_received AS received_us, lat, lon, speed_kph, heading_deg, odometer_km, accuracy_m, status, stop_id,
    reason_code, temp_c, setpoint_c, city, state, country FROM feed_row WHERE reason IS NULL AND violation IS NULL""".replace(
        _TEXT, _TEXT
    ),
)
part(
    "dead",
    """SELECT message_id, source, reason, detail, NULL::VARCHAR AS routing_key, m_received AS received_us FROM feed_row WHERE reason IS NOT NULL AND source <> 'EDI_214'
  UNION ALL
  SELECT message_id, 'EDI_214', CASE WHEN bool_or(reason = 'MALFORMED_PAYLOAD') THEN 'MALFORMED_PAYLOAD' ELSE arg_max(reason, set_no) END,
    string_agg(detail, '; ' ORDER BY set_no), NULL, max(m_received) FROM (
    SELECT message_id, set_no, reason, detail, m_received FROM edi_row WHERE reason IS NOT NULL
    UNION ALL SELECT message_id, 1000000, 'MALFORMED_PAYLOAD', detail, m_received FROM edi_whole) GROUP BY message_id
  UNION ALL
  SELECT message_id, source, 'INVALID_VALUE', violation, shipment_id, m_received FROM feed_row WHERE reason IS NULL AND violation IS NOT NULL""",
)
