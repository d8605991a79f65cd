"""Canonical events as keyed log records: JSON value without nulls, key, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haulscope.functions.timeparts import instant_text


def iso_duration(seconds: Column) -> Column:
    """ISO-8601 text of whole seconds, hours as the largest unit (PT26H3M4S)."""
    h, m, s = (F.call_function("div", seconds, F.lit(3600)), F.call_function("div", F.pmod(seconds, F.lit(3600)), F.lit(60)), F.pmod(seconds, F.lit(60)))
    unit = lambda n, u: F.when(n != 0, F.concat(n.cast("string"), F.lit(u))).otherwise("")
    return F.when(seconds == 0, "PT0S").otherwise(F.concat(F.lit("PT"), unit(h, "H"), unit(m, "M"), unit(s, "S")))


def record(topic: str, source: Column, kind: Column, value: Column, key: Column) -> list[Column]:
    """topic, key, value and headers as a Kafka sink takes them."""
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value"))
    return [
        F.lit(topic).alias("topic"),
        key.alias("key"),
        F.to_json(value, {"ignoreNullFields": "true"}).alias("value"),
        F.array(header("source", source), header("event-type", kind)).alias("headers"),
    ]


def position_value(event_id: Column) -> Column:
    return F.struct(
        event_id.alias("eventId"),
        F.lit("position").alias("type"),
        F.col("shipment_id").alias("shipmentId"),
        F.col("vehicle_id").alias("vehicleId"),
        instant_text(F.col("occurred_us")).alias("occurredAt"),
        instant_text(F.col("received_us")).alias("receivedAt"),
        F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("position"),
        F.col("speed_kph").alias("speedKph"),
        F.col("accuracy_m").alias("accuracyMeters"),
    )


def status_value(event_id: Column) -> Column:
    return F.struct(
        event_id.alias("eventId"),
        F.lit("status").alias("type"),
        F.col("shipment_id").alias("shipmentId"),
        F.col("vehicle_id").alias("vehicleId"),
        instant_text(F.col("occurred_us")).alias("occurredAt"),
        F.lit("TEMPERATURE_READING").alias("status"),
        F.struct(F.col("temp_c").alias("celsius"), F.col("setpoint_c").alias("setpointCelsius")).alias("temperature"),
    )


def visit_value() -> Column:
    """shipment.arrived / shipment.departed from the rows of geofence.visit_events."""
    return F.struct(
        F.col("event_id").alias("eventId"),
        F.col("type"),
        F.col("shipment_id").alias("shipmentId"),
        instant_text(F.col("occurred_us")).alias("occurredAt"),
        F.col("caused_by").alias("causedBy"),
        F.col("stop_id").alias("stopId"),
        iso_duration(F.col("dwell_s")).alias("dwell"),
    )


def incident_value() -> Column:
    """exception.raised / exception.cleared from the rows of conditions.incident_events."""
    raised = F.col("event_type") == "exception.raised"
    return F.struct(
        F.col("event_id").alias("eventId"),
        F.col("event_type").alias("type"),
        F.col("shipment_id").alias("shipmentId"),
        instant_text(F.col("occurred_us")).alias("occurredAt"),
        F.col("caused_by").alias("causedBy"),
        F.col("exception_id").alias("exceptionId"),
        F.col("type").alias("exceptionType"),
        F.when(raised, F.col("severity")).alias("severity"),
        F.col("detail"),
        F.when(raised, F.col("stop_id")).alias("stopId"),
        F.col("observed_value").alias("observedValue"),
        F.col("threshold_value").alias("thresholdValue"),
        instant_text(F.col("since_us")).alias("raisedAt"),
        iso_duration(F.col("open_s")).alias("openFor"),
        F.col("resolution"),
    )


def estimate_value() -> Column:
    """eta.updated from the rows of eta.estimates."""
    return F.struct(
        F.col("event_id").alias("eventId"),
        F.lit("eta.updated").alias("type"),
        F.col("shipment_id").alias("shipmentId"),
        instant_text(F.col("occurred_us")).alias("occurredAt"),
        F.col("caused_by").cast("string").alias("causedBy"),
        F.col("stop_id").alias("stopId"),
        instant_text(F.col("estimate_us")).alias("estimatedArrival"),
        instant_text(F.col("previous_us")).alias("previousEstimate"),
        F.col("remaining_km").alias("remainingKm"),
        F.col("confidence"),
    )


def feed_event_value() -> Column:
    """A canonical source event as produced by plans.ingest.events."""
    position = F.when(F.col("lat").isNotNull(), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")))
    temperature = F.when(F.col("temp_c").isNotNull(), F.struct(F.col("temp_c").alias("celsius"), F.col("setpoint_c").alias("setpointCelsius")))
    place = F.when(
        F.coalesce("city", "state", "country").isNotNull(),
        F.struct("city", F.col("state").alias("stateOrProvince"), F.col("country").alias("countryCode")),
    )
    return F.struct(
        F.col("event_id").alias("eventId"),
        F.col("type"),
        F.col("shipment_id").alias("shipmentId"),
        F.col("vehicle_id").alias("vehicleId"),
        F.col("device_id").alias("deviceId"),
        F.col("occurred_text").alias("occurredAt"),
        instant_text(F.col("received_us")).alias("receivedAt"),
        position.alias("position"),
        F.col("speed_kph").alias("speedKph"),
        F.col("heading_deg").alias("headingDegrees"),
        F.col("odometer_km").alias("odometerKm"),
        F.col("accuracy_m").alias("accuracyMeters"),
        F.col("status"),
        place.alias("location"),
        temperature.alias("temperature"),
        F.col("stop_id").alias("stopId"),
        F.col("reason_code").alias("reasonCode"),
    )


def feed_records(events: DataFrame) -> DataFrame:
    """Positions and statuses to their topics, keyed by shipment."""
    topic = F.concat(F.lit("fleet."), F.col("type"))
    columns = record("", F.col("source"), F.col("type"), feed_event_value(), F.col("shipment_id"))
    return events.select(topic.alias("topic"), *columns[1:], "event_id", "shipment_id", "type", "source")

