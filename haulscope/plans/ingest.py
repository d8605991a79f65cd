"""Raw feed messages to canonical events and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haulscope.functions import ids
from haulscope.functions.timeparts import instant_us
from haulscope.functions.text import blank_to_null
from haulscope.operators import asof
from haulscope.sources import feeds
from haulscope.sources.edi import ENVELOPE_SET

EVENT_COLUMNS = (
    "event_id", "type", "source", "shipment_id", "vehicle_id", "device_id", "occurred_us", "occurred_text",
    "received_us", "lat", "lon", "speed_kph", "heading_deg", "odometer_km", "accuracy_m", "status", "stop_id",
    "reason_code", "temp_c", "setpoint_c", "city", "state", "country",
)


def _range(column: str, path: str, low: float | None, high: float | None, open_high: bool = False) -> list[Column]:
    checks = []
    value = F.col(column)
    if low is not None:
        text = "0" if low == 0.0 and path in ("speedKph", "odometerKm", "accuracyMeters") else str(low)
        checks.append(F.when(value < low, f"{path} must be greater than or equal to {text}"))
    if high is not None:
        breach = value >= high if open_high else value > high
        checks.append(F.when(breach, f"{path} must be less than {'' if open_high else 'or equal to '}{high}"))
    return checks


def violations() -> Column:
    """Sorted 'path message' list of broken constraints, null when there are none."""
    # The texts and bounds of violations, here and in _range.
    checks = [
        F.when(blank_to_null(F.col("shipment_id")).isNull(), "shipmentId must not be blank"),
        F.when(blank_to_null(F.col("vehicle_id")).isNull(), "vehicleId must not be blank"),
        *_range("lat", "position.latitude", -90.0, 90.0),
        *_range("lon", "position.longitude", -180.0, 180.0),
        *_range("speed_kph", "speedKph", 0.0, 250.0),
        *_range("heading_deg", "headingDegrees", 0.0, 360.0, open_high=True),
        *_range("odometer_km", "odometerKm", 0.0, None),
        *_range("accuracy_m", "accuracyMeters", 0.0, None),
        *_range("temp_c", "temperature.celsius", -60.0, 60.0),
        *_range("setpoint_c", "temperature.setpointCelsius", -60.0, 60.0),
        F.when(F.length("state") > 3, "location.stateOrProvince size must be between 0 and 3"),
        F.when(F.length("country") != 2, "location.countryCode size must be between 2 and 2"),
    ]
    return blank_to_null(F.concat_ws("; ", F.array_sort(F.array_compact(F.array(*checks)))))


def judged(messages: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every candidate with its identity, and either a rejection, a violation, or neither."""
    resolved = asof.resolve(feeds.union_feeds(messages), asof.unambiguous_periods(assignments))
    by_shipment = F.col("key_kind") == "shipment"
    known = F.col("as_vehicle").isNotNull()
    reason = F.coalesce(
        "early_reason", F.when(~known, feeds.UNRESOLVED), "late_reason"
    )
    detail = F.when(F.col("early_reason").isNotNull(), F.col("early_detail")).otherwise(
        F.when(~known, F.col("unresolved_detail")).otherwise(F.col("late_detail"))
    )
    df = resolved.withColumns(
        {
            "reason": reason,
            "detail": detail,
            "shipment_id": F.when(by_shipment, F.col("key")).otherwise(F.col("as_shipment")),
            "vehicle_id": F.col("as_vehicle"),
            "occurred_us": F.col("at_us"),
        }
    )
    return df.withColumn("violation", F.when(F.col("reason").isNull(), violations()))


def events(rows: DataFrame) -> DataFrame:
    """Canonical events."""
    good = rows.where("reason IS NULL AND violation IS NULL")
    event_id = ids.source_event_id(F.col("source"), F.col("reporter"), F.col("occurred_text"), F.col("discriminator"))
    return good.withColumn("event_id", event_id).select("message_id", *EVENT_COLUMNS)


def dead_letters(rows: DataFrame) -> DataFrame:
    """Rejected messages with the original body; an interchange is dead-lettered once for all its bad sets."""
    columns = ["message_id", "source", "content_type", "reason", "detail", "routing_key", "received_us", "body"]
    none = F.lit(None).cast("string")
    rejected = rows.where("reason IS NOT NULL").withColumn("routing_key", none)
    single = rejected.where("source IS NULL OR source <> 'EDI_214'").select(*columns)
    numbered = F.when(F.col("set_no") == ENVELOPE_SET, F.col("detail")).otherwise(
        F.format_string("transaction set %d: %s", F.col("set_no"), F.col("detail"))
    )
    # one interchange is one input row, so its problems are bounded by its own text
    interchanges = (
        rejected.where("source = 'EDI_214'")
        .groupBy("message_id")
        .agg(
            *[F.first(c).alias(c) for c in ("source", "content_type", "routing_key", "received_us", "body")],
            F.max(F.when(F.col("reason") == feeds.MALFORMED, F.col("reason"))).alias("_worst"),
            F.max_by("reason", "set_no").alias("_latest"),
            F.array_sort(F.collect_list(F.struct("set_no", numbered.alias("text")))).alias("_all"),
        )
        .withColumn("reason", F.coalesce("_worst", "_latest"))
        .withColumn("detail", F.concat_ws("; ", F.transform("_all", lambda p: p["text"])))
        .select(*columns)
    )
    violated = rows.where("violation IS NOT NULL").select(
        "message_id", "source", "content_type", F.lit(feeds.INVALID).alias("reason"), F.col("violation").alias("detail"),
        F.col("shipment_id").alias("routing_key"), "received_us", "body",
    )
    return single.unionByName(interchanges).unionByName(violated)


def verdicts(rows: DataFrame) -> DataFrame:
    """Per message: published and dead-lettered counts and the verdict."""
    bad_set = F.col("reason").isNotNull()
    counted = rows.groupBy("message_id", "source").agg(
        F.count_if(~bad_set & F.col("violation").isNull()).alias("published"),
        (F.count_if(F.col("violation").isNotNull()) + F.max(bad_set.cast("bigint"))).alias("dead_lettered"),
    )
    verdict = (
        F.when(F.col("dead_lettered") == 0, "ACCEPTED").when(F.col("published") == 0, "DEAD_LETTERED").otherwise("PARTIAL")
    )
    return counted.withColumn("verdict", verdict)


def outcomes(rows: DataFrame) -> DataFrame:
    """Per feed: how many events were published, and dead letters by reason."""
    good = rows.where("reason IS NULL AND violation IS NULL").select("source", F.lit("PUBLISHED").alias("outcome"))
    bad = dead_letters(rows).select("source", F.col("reason").alias("outcome"))
    return good.unionByName(bad).groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("messages"))


def first_missing() -> Column:
    """First field a consumer finds missing, in its order of checks; null for a complete event."""
    return (
        F.when(F.col("shipment_id").isNull(), "shipmentId")
        .when(F.col("occurred_us").isNull(), "occurredAt")
        .when(F.col("lat").isNull() | F.col("lon").isNull(), "position")
    )


# Header names of records a consumer sets aside.
DEAD_REASON, DEAD_DETAIL, DEAD_ORIGIN = "fleet.dlq.reason", "fleet.dlq.detail", "fleet.dlq.origin"


def consumer_dead_letters(records: DataFrame) -> DataFrame:
    """Log records of positions that no consumer can use, with key and value as they were and headers that say why and
    from where (topic-partition@offset): values that are no JSON object, and events that lack a field."""
    v = F.from_json("value", "shipmentId string, occurredAt string, position struct<latitude:double,longitude:double>")
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    df = records.withColumn("v", v).withColumns(
        {
            "shipment_id": F.col("v.shipmentId"), "occurred_us": instant_us(F.col("v.occurredAt")),
            "lat": F.col("v.position.latitude"), "lon": F.col("v.position.longitude"),
        }
    )
    df = df.withColumn("reason", F.when(~readable, "UNPARSEABLE").when(first_missing().isNotNull(), "INCOMPLETE")).where("reason IS NOT NULL")
    detail = F.when(~readable, "unreadable JSON").otherwise(F.concat(F.lit("missing "), first_missing()))
    origin = F.format_string("%s-%d@%d", "topic", "partition", "offset")
    headers = F.array(
        *[
            F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))
            for name, value in ((DEAD_REASON, F.col("reason")), (DEAD_DETAIL, detail), (DEAD_ORIGIN, origin))
        ]
    )
    return df.select("reason", detail.alias("detail"), origin.alias("origin"), "key", "value", headers.alias("headers"))


def write_dead_letters(letters: DataFrame, path: str) -> None:
    """Dead letters of either kind, a folder for each reason; a run that is repeated replaces what it had written."""
    letters.write.mode("overwrite").partitionBy("reason").parquet(path)
