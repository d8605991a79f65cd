"""The event archive: hourly layout, scan, replay check, fold to newest facts, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.functions.timeparts import HOUR_US, day_text, hour_start_us, hour_text, instant_us

REPLAY_HEADER = "fleet.replayed-from"
RECORD_SCHEMA = "topic string, `partition` int, `offset` bigint, timestamp_us bigint, `key` string, value string"
# Days an archived topic is kept; any other topic 30.
RETENTION_DAYS = {"fleet.position": 3}
DEFAULT_RETENTION_DAYS = 30
VALUE_SCHEMA = (
    "eventId string, type string, shipmentId string, occurredAt string, stopId string, dwell string, estimatedArrival string, "
    "exceptionId string, severity string, openFor string, resolution string, raisedAt string, "
    "position struct<latitude:double,longitude:double>, speedKph double, vehicleId string, receivedAt string, status string, detail string, "
    "exceptionType string, observedValue double, thresholdValue double, previousEstimate string, remainingKm double, confidence double"
)


def skip_replayed(records: DataFrame) -> DataFrame:
    """Records carrying the replay header are not archived a second time."""
    return records.where(~F.coalesce(F.exists("headers", lambda h: h["key"] == REPLAY_HEADER), F.lit(False)))


def layout(records: DataFrame) -> DataFrame:
    """Adds the partition columns: UTC day and hour of the record timestamp."""
    return records.withColumns({"dt": day_text(F.col("timestamp_us")), "hour": hour_text(F.col("timestamp_us"))})


def slim(records: DataFrame) -> DataFrame:
    """The columns of a file; the topic is kept beside its folder's name."""
    return records.select(
        "topic", "dt", "hour", "partition", "offset", "timestamp_us", "key", "value", F.col("topic").alias("record_topic")
    )


def write(records: DataFrame, path: str, max_records: int = 2_000_000) -> None:
    """Archive everything that is not itself a replay, each record under the hour it was recorded in."""
    write_laid_out(layout(skip_replayed(records)), path, max_records)


def write_laid_out(records: DataFrame, path: str, max_records: int = 2_000_000) -> None:
    """gzip NDJSON under topic=/dt=/hour=; one hour may be many files, so a hot topic is not one task."""
    (
        slim(records)
        .write.mode("append")
        .partitionBy("topic", "dt", "hour")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max_records)
        .json(path)
    )


def scan(spark: SparkSession, path: str, topic: str, from_us: int, to_us: int | None = None) -> DataFrame:
    """One topic's records of the hours [from, to), one hour by default; only those directories are read."""
    start = from_us - from_us % HOUR_US
    end = start + HOUR_US if to_us is None else to_us - to_us % HOUR_US
    schema = f"record_topic string, {RECORD_SCHEMA}, dt string, hour string"
    df = spark.read.schema(schema).json(path)
    first, last = (F.timestamp_micros(F.lit(us).cast("bigint")) for us in (start, end))
    stamp = F.concat_ws(" ", "dt", "hour")
    return df.where(
        (F.col("topic") == topic)
        & (stamp >= F.date_format(first, "yyyy-MM-dd HH"))
        & (stamp < F.date_format(last, "yyyy-MM-dd HH"))
    ).withColumns({"file": F.col("_metadata.file_path"), "written_ms": written_ms(F.col("_metadata.file_path"), F.col("_metadata.file_modification_time"))})


def file_name(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+)$", 1)


def written_ms(file: Column, modified: Column | None = None) -> Column:
    """When a file was written: the millis at the end of its name, or else when it was last modified."""
    named = F.regexp_extract(file_name(file), r"-(\d+)\.ndjson\.gz$", 1).try_cast("bigint")
    return named if modified is None else F.coalesce(named, F.unix_millis(modified))


def event_id_of(value: Column) -> Column:
    """The eventId of a record value, null when it is missing or not a string."""
    v = F.try_parse_json(value)
    found = F.try_variant_get(v, "$.eventId", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, "$.eventId", "string"))


def hour_of_directory(df: DataFrame) -> Column:
    return F.unix_micros(F.try_to_timestamp(F.concat_ws(" ", "dt", "hour"), F.lit("yyyy-MM-dd HH")))


def replay_report(scanned: DataFrame, target: str | None = None) -> DataFrame:
    """Lines, distinct and repeated ids, misplaced lines and lines without id, per topic, and what goes to ``target``.

    Counting repeats as (lines with id - distinct ids) needs no order over the files. Without a target nothing is
    published.
    """
    rows = scanned.select(
        "topic",
        "file",
        event_id_of(F.col("value")).alias("event_id"),
        (
            (hour_start_us(F.col("timestamp_us")) != hour_of_directory(scanned))
            | (F.col("record_topic") != F.col("topic"))
        ).alias("misplaced"),
    )
    ids_seen = rows.where("event_id IS NOT NULL").groupBy("topic", "event_id").agg(F.count(F.lit(1)).alias("times"))
    distinct = ids_seen.groupBy("topic").agg(
        F.count(F.lit(1)).alias("distinct_ids"), F.sum(F.col("times") - 1).alias("duplicates")
    )
    files = rows.groupBy("topic", "file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if("misplaced").alias("misplaced"),
        F.count_if(F.col("event_id").isNull()).alias("without_event_id"),
    )
    totals = files.groupBy("topic").agg(
        F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("lines", "misplaced", "without_event_id")]
    )
    joined = totals.join(distinct, "topic", "left").fillna(0, ["distinct_ids", "duplicates"])
    return joined.withColumn("published", F.col("distinct_ids") if target else F.lit(0).cast("bigint")).withColumn(
        "ok", (F.col("files") > 0) & (F.col("misplaced") == 0) & (F.col("without_event_id") == 0)
    )


def replay_records(scanned: DataFrame, target: str) -> DataFrame:
    """Each distinct event once, in the form a Kafka sink takes, with a header naming its file.

    Of the lines of an event the first counts: hours in turn, in each the files by when they were written, then by name.
    """
    named = scanned.withColumn("event_id", event_id_of(F.col("value"))).where("event_id IS NOT NULL")
    turn = F.struct(hour_of_directory(scanned).alias("hour"), "written_ms", file_name(F.col("file")).alias("name"), "file", "offset")
    first = named.groupBy("event_id").agg(F.min_by(F.struct("key", "value", "file"), turn).alias("r"))
    header = F.array(F.struct(F.lit(REPLAY_HEADER).alias("key"), F.col("r.file").cast("binary").alias("value")))
    return first.select(F.lit(target).alias("topic"), "r.key", "r.value", header.alias("headers"))


def publish(records: DataFrame, path: str) -> None:
    """A replay as files, one folder for each topic it goes to; a run that is repeated replaces what it had written."""
    records.write.mode("overwrite").partitionBy("topic").parquet(path)


def in_replay_order(scanned: DataFrame) -> DataFrame:
    """Files of a scan in the order of their replay: by hour, when they were written, and name."""
    written = F.col("written_ms") if "written_ms" in scanned.columns else written_ms(F.col("file"))
    hour = hour_of_directory(scanned) if "hour" in scanned.columns else F.lit(None).cast("bigint")
    files = scanned.groupBy(hour.alias("hour_us"), written.alias("written_ms"), "file").agg(F.count(F.lit(1)).alias("lines"))
    return files.select("file", "lines", "hour_us", "written_ms").orderBy("hour_us", F.col("written_ms").asc_nulls_first(), file_name(F.col("file")), "file")


def retained(records: DataFrame, today: Column) -> DataFrame:
    """Drop archive days past their topic's retention; partition columns only, so whole directories."""
    days = F.lit(DEFAULT_RETENTION_DAYS)
    for topic, n in RETENTION_DAYS.items():
        days = F.when(F.col("topic") == topic, F.lit(n)).otherwise(days)
    return records.where(F.to_date("dt") >= F.date_sub(today, days))


# --- fold ----------------------------------------------------------------------------------------


def decoded(records: DataFrame) -> DataFrame:
    """Record values decoded once into a wide struct, classified by type and, without one, by shape."""
    v = F.from_json("value", VALUE_SCHEMA, {"mode": "PERMISSIVE"})
    df = records.withColumn("v", v)
    shape = (
        F.when(F.col("v.type").isNotNull(), F.col("v.type"))
        .when(F.col("v.estimatedArrival").isNotNull(), "eta.updated")
        .when(F.col("v.dwell").isNotNull(), "shipment.departed")
        .when(F.col("v.openFor").isNotNull(), "exception.cleared")
        .when(F.col("v.exceptionId").isNotNull(), "exception.raised")
        .when(F.col("v.stopId").isNotNull(), "shipment.arrived")
    )
    readable = F.col("v.shipmentId").isNotNull() & F.col("v.eventId").isNotNull()
    return df.withColumn("kind", F.when(readable, shape)).withColumn("at_us", instant_us(F.col("v.occurredAt")))


# Event types the fold keeps nothing of.
SKIPPED = ("eta.updated", "status")


def fold_counts(events: DataFrame) -> DataFrame:
    """Events, skipped and unreadable records and the newest record instant per topic."""
    return events.groupBy("topic").agg(
        F.count_if(F.col("kind").isNotNull()).alias("events"),
        F.count_if(F.col("kind").isin(*SKIPPED)).alias("skipped"),
        F.count_if(F.col("kind").isNull()).alias("unreadable"),
        F.max("timestamp_us").alias("newest_received_us"),
    )


def fold_positions(events: DataFrame) -> DataFrame:
    """Newest position per shipment. Folding hours first and then their results gives the same."""
    fact = F.struct(
        F.col("v.vehicleId").alias("vehicle_id"), F.col("at_us").alias("occurred_us"), F.col("v.position.latitude").alias("lat"),
        F.col("v.position.longitude").alias("lon"), F.col("v.speedKph").alias("speed_kph"), F.col("timestamp_us").alias("received_us"),
    )
    rows = events.where("kind = 'position'").select(F.col("v.shipmentId").alias("shipment_id"), fact.alias("f"), "offset")
    return (
        rows.groupBy("shipment_id")
        .agg(F.max_by("f", F.struct("f.occurred_us", -F.col("offset"))).alias("f"))
        .select("shipment_id", "f.*")
    )


def fold_stops(events: DataFrame) -> DataFrame:
    """Newest arrival and newest departure per shipment and stop."""
    return (
        events.where("kind IN ('shipment.arrived', 'shipment.departed')")
        .groupBy(F.col("v.shipmentId").alias("shipment_id"), F.col("v.stopId").alias("stop_id"))
        .agg(
            F.max(F.when(F.col("kind") == "shipment.arrived", F.col("at_us"))).alias("arrived_us"),
            F.max(F.when(F.col("kind") == "shipment.departed", F.col("at_us"))).alias("departed_us"),
        )
    )


def pair_incidents(events: DataFrame) -> DataFrame:
    """Raise and clear of each incident in one row; either may come alone or first, one shuffle for both."""
    raised, cleared = F.col("kind") == "exception.raised", F.col("kind") == "exception.cleared"
    fact = F.struct(F.col("at_us").alias("at_us"), F.col("v.severity").alias("severity"), F.col("v.resolution").alias("resolution"))
    return (
        events.where(raised | cleared)
        .groupBy(F.col("v.exceptionId").alias("exception_id"))
        .agg(
            F.max(F.col("v.shipmentId")).alias("shipment_id"),
            F.max(F.when(raised, fact)).alias("r"),
            F.max(F.when(cleared, fact)).alias("c"),
        )
        .select(
            "exception_id",
            "shipment_id",
            F.col("r.severity").alias("severity"),
            F.col("r.at_us").alias("onset_us"),
            F.col("c.at_us").alias("cleared_us"),
            F.col("c.resolution").alias("resolution"),
            F.when(F.col("c").isNull(), "OPEN").otherwise("CLEARED").alias("state"),
        )
    )


def plan_visits(stop_facts: DataFrame, itineraries: DataFrame) -> DataFrame:
    """Visits of the current journey: what precedes the origin's arrival belongs to an earlier one."""
    origin = (
        itineraries.groupBy("shipment_id")
        .agg(F.min_by("stop_id", "seq").alias("stop_id"))
        .join(stop_facts, ["shipment_id", "stop_id"])
        .select("shipment_id", F.col("arrived_us").alias("journey_us"))
    )
    df = (
        itineraries.select("shipment_id", "stop_id", "seq")
        .join(stop_facts, ["shipment_id", "stop_id"], "left")
        .join(origin, "shipment_id", "left")
    )
    arrived = F.when(~F.coalesce(F.col("arrived_us") < F.col("journey_us"), F.lit(False)), F.col("arrived_us"))
    df = df.withColumn("arrived_us", arrived)
    departed = F.when(F.col("departed_us") >= F.col("arrived_us"), F.col("departed_us"))
    df = df.withColumn("departed_us", departed)
    return df.select(
        "shipment_id", "stop_id", "seq", "arrived_us", "departed_us",
        F.when(F.col("arrived_us").isNull(), "PENDING").when(F.col("departed_us").isNull(), "AT").otherwise("DEPARTED").alias("status"),
    )


def archived_through(events: DataFrame) -> DataFrame:
    """Newest record per topic and over all topics."""
    per_topic = events.groupBy("topic").agg(F.max("timestamp_us").alias("newest_us"))
    return per_topic.unionByName(per_topic.agg(F.lit("*").alias("topic"), F.max("newest_us").alias("newest_us")))
