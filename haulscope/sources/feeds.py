"""The four source feeds, each parsed into one row layout of candidate events.

Input messages: message_id, source, content_type, body, received_us. A feed is a function from
messages to candidates; ``FEEDS`` maps the source name to it, and a new feed is a new entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from haulscope.functions.timeparts import canonical_instant, instant_text, instant_us

KM_PER_MILE = 1.609344
MPS_TO_KPH = 3.6
HDOP_METERS = 5.0
MALFORMED, MISSING, INVALID, UNRESOLVED, UNSUPPORTED = (
    "MALFORMED_PAYLOAD", "MISSING_FIELD", "INVALID_VALUE", "UNRESOLVED_IDENTITY", "UNSUPPORTED_FEED",
)

CANDIDATE = {
    "set_no": "int", "key_kind": "string", "key": "string", "at_us": "bigint", "early_reason": "string",
    "early_detail": "string", "late_reason": "string", "late_detail": "string", "unresolved_detail": "string",
    "type": "string", "reporter": "string", "discriminator": "string", "occurred_text": "string",
    "device_id": "string", "lat": "double", "lon": "double", "speed_kph": "double", "heading_deg": "double",
    "odometer_km": "double", "accuracy_m": "double", "status": "string", "stop_id": "string",
    "reason_code": "string", "temp_c": "double", "setpoint_c": "double", "city": "string", "state": "string",
    "country": "string",
}
MESSAGE = ["message_id", "source", "content_type", "body", "received_us"]

TELEMATICS_SCHEMA = (
    "deviceId string, vehicle struct<id:string,unitNumber:string,make:string>, gps struct<lat:double,lon:double,"
    "speedMph:double,headingDeg:double,satellites:int,hdop:double,fixTime:string>, odometer struct<value:double,"
    "unit:string>, sentAt string, schemaVersion string, _corrupt string"
)
MOBILE_SCHEMA = (
    "sid string, ts bigint, lat double, lng double, acc double, spd double, hdg int, bat int, evt string, stop string, "
    "seq bigint, app string, _corrupt string"
)
REEFER_SCHEMA = (
    "probe string, model string, readingUtc string, tempC double, setpointC double, returnAirC double, "
    "supplyAirC double, door string, batteryV double, alarm string, _corrupt string"
)
# Mobile event words and the status each reports.
MOBILE_STATUS = {"ping": None, "arrive": "ARRIVED_AT_STOP", "depart": "DEPARTED_STOP", "delivered": "DELIVERED"}


def candidates(messages: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Message columns plus every candidate column, null where the feed has none."""
    filled = [columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in CANDIDATE.items()]
    return messages.select(*MESSAGE, *filled)


def _decoded(messages: DataFrame, source: str, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "false"}
    return messages.where(F.col("source") == source).withColumn("p", F.from_json("body", schema, options))


def _first_problem(*checks: tuple[Column, str, str]) -> tuple[Column, Column]:
    """Reason and detail of the first condition that holds."""
    reason = detail = F.lit(None).cast("string")
    for condition, why, what in reversed(checks):
        reason = F.when(condition, why).otherwise(reason)
        detail = F.when(condition, what).otherwise(detail)
    return reason, detail


def _malformed(*instants: str) -> list[tuple[Column, str, str]]:
    unreadable = F.col("p").isNull() | F.col("p._corrupt").isNotNull()
    for name in instants:
        unreadable = unreadable | (F.col(name).isNotNull() & instant_us(F.col(name)).isNull())
    empty = F.coalesce(F.trim("body"), F.lit("")) == ""
    return [(empty, MALFORMED, "empty body"), (unreadable, MALFORMED, "unreadable JSON")]


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def wrap_heading(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def telematics(messages: DataFrame) -> DataFrame:
    """Nested JSON in imperial units, keyed by vehicle."""
    df = _decoded(messages, "TELEMATICS", TELEMATICS_SCHEMA)
    when = F.coalesce("p.gps.fixTime", "p.sentAt")
    reason, detail = _first_problem(
        *_malformed("p.gps.fixTime", "p.sentAt"),
        (F.col("p.gps").isNull(), MISSING, "gps"),
        (F.col("p.gps.lat").isNull() | F.col("p.gps.lon").isNull(), MISSING, "gps.lat/gps.lon"),
        (when.isNull(), MISSING, "gps.fixTime/sentAt"),
        (_blank(F.col("p.vehicle.id")), MISSING, "vehicle.id"),
    )
    unit = F.lower(F.trim(F.coalesce("p.odometer.unit", F.lit(""))))
    value = F.col("p.odometer.value")
    miles = unit.isin("mi", "mile", "miles")
    km = unit.isin("km", "kilometre", "kilometres", "kilometer", "kilometers")
    bad_unit = value.isNotNull() & ~miles & ~km
    # The names of units and the texts of rejections in this module.
    return candidates(
        df,
        {
            "set_no": F.lit(0),
            "key_kind": F.lit("vehicle"),
            "key": F.col("p.vehicle.id"),
            "at_us": instant_us(when),
            "early_reason": reason,
            "early_detail": detail,
            "late_reason": F.when(bad_unit, INVALID),
            "late_detail": F.when(bad_unit, F.concat(F.lit("unknown odometer unit: "), F.coalesce("p.odometer.unit", F.lit("null")))),
            "unresolved_detail": F.concat(F.lit("no load assigned to vehicle "), F.col("p.vehicle.id")),
            "type": F.lit("position"),
            "reporter": F.col("p.deviceId"),
            "discriminator": F.lit(""),
            "occurred_text": canonical_instant(when),
            "device_id": F.col("p.deviceId"),
            "lat": F.col("p.gps.lat"),
            "lon": F.col("p.gps.lon"),
            "speed_kph": F.col("p.gps.speedMph") * KM_PER_MILE,
            "heading_deg": wrap_heading(F.col("p.gps.headingDeg")),
            "odometer_km": F.when(miles, value * KM_PER_MILE).when(km, value),
            "accuracy_m": F.col("p.gps.hdop") * HDOP_METERS,
        },
    )


def mobile(messages: DataFrame) -> DataFrame:
    """Abbreviated JSON from the driver's phone, keyed by shipment."""
    df = _decoded(messages, "MOBILE_APP", MOBILE_SCHEMA)
    reason, detail = _first_problem(
        *_malformed(),
        (_blank(F.col("p.sid")), MISSING, "sid"),
        (F.col("p.ts").isNull(), MISSING, "ts"),
        (F.col("p.lat").isNull() | F.col("p.lng").isNull(), MISSING, "lat/lng"),
    )
    word = F.when(_blank(F.col("p.evt")), F.lit("ping")).otherwise(F.lower(F.trim("p.evt")))
    known = word.isin(*MOBILE_STATUS)
    status = F.lit(None).cast("string")
    for name, code in MOBILE_STATUS.items():
        if code:
            status = F.when(word == name, code).otherwise(status)
    ping = word == "ping"
    us = F.col("p.ts") * 1000
    return candidates(
        df,
        {
            "set_no": F.lit(0),
            "key_kind": F.lit("shipment"),
            "key": F.col("p.sid"),
            "at_us": us,
            "early_reason": reason,
            "early_detail": detail,
            "late_reason": F.when(~known, INVALID),
            "late_detail": F.when(~known, F.concat(F.lit("unknown evt: "), F.col("p.evt"))),
            "unresolved_detail": F.concat(F.lit("no vehicle assigned to shipment "), F.col("p.sid")),
            "type": F.when(ping, "position").otherwise("status"),
            "reporter": F.col("p.sid"),
            "discriminator": word,
            "occurred_text": instant_text(us),
            "lat": F.col("p.lat"),
            "lon": F.col("p.lng"),
            "speed_kph": F.when(ping, F.col("p.spd") * MPS_TO_KPH),
            "heading_deg": F.when(ping, wrap_heading(F.col("p.hdg").cast("double"))),
            "accuracy_m": F.when(ping, F.col("p.acc")),
            "status": status,
            "stop_id": F.when(~ping, F.col("p.stop")),
        },
    )


def reefer(messages: DataFrame) -> DataFrame:
    """Temperature probe JSON, keyed by device."""
    df = _decoded(messages, "REEFER_SENSOR", REEFER_SCHEMA)
    reason, detail = _first_problem(
        *_malformed("p.readingUtc"),
        (_blank(F.col("p.probe")), MISSING, "probe"),
        (F.col("p.readingUtc").isNull(), MISSING, "readingUtc"),
        (F.col("p.tempC").isNull(), MISSING, "tempC"),
    )
    return candidates(
        df,
        {
            "set_no": F.lit(0),
            "key_kind": F.lit("device"),
            "key": F.col("p.probe"),
            "at_us": instant_us(F.col("p.readingUtc")),
            "early_reason": reason,
            "early_detail": detail,
            "unresolved_detail": F.concat(F.lit("no shipment assigned to device "), F.col("p.probe")),
            "type": F.lit("status"),
            "reporter": F.col("p.probe"),
            "discriminator": F.lit(""),
            "occurred_text": canonical_instant(F.col("p.readingUtc")),
            "device_id": F.col("p.probe"),
            "status": F.lit("TEMPERATURE_READING"),
            "temp_c": F.col("p.tempC"),
            "setpoint_c": F.col("p.setpointC"),
            "reason_code": F.col("p.alarm"),
        },
    )


def edi214(messages: DataFrame) -> DataFrame:
    from haulscope.sources.edi import shipment_statuses

    return shipment_statuses(messages.where(F.col("source") == "EDI_214"))


FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "TELEMATICS": telematics,
    "MOBILE_APP": mobile,
    "REEFER_SENSOR": reefer,
    "EDI_214": edi214,
}


def unsupported(messages: DataFrame) -> DataFrame:
    """Messages of a feed nobody handles become rejected candidates."""
    df = messages.where(~F.coalesce(F.col("source").isin(*FEEDS), F.lit(False)))
    detail = F.concat(F.lit("no normalizer for "), F.coalesce("source", F.lit("null")))
    return candidates(df, {"set_no": F.lit(0), "early_reason": F.lit(UNSUPPORTED), "early_detail": detail})


def union_feeds(messages: DataFrame) -> DataFrame:
    """Candidates of all feeds in one layout."""
    out = unsupported(messages)
    for parse in FEEDS.values():
        out = out.unionByName(parse(messages))
    return out


def read_json_lines(spark, path: str, source: str, received_us: int) -> DataFrame:
    """A feed captured one message per line."""
    lines = spark.read.text(path)
    return lines.select(
        F.concat_ws("#", F.col("_metadata.file_path"), F.md5("value")).alias("message_id"),
        F.lit(source).alias("source"),
        F.lit("application/json").alias("content_type"),
        F.col("value").alias("body"),
        F.lit(received_us).cast("bigint").alias("received_us"),
    )


