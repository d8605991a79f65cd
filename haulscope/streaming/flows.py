"""Sources, sinks and stateless or built-in-state streaming flows."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from haulscope.functions.timeparts import int_div
from haulscope.plans import archive
from haulscope.session import new_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def kafka_source(spark: SparkSession, servers: str, topics: str, per_trigger: int = 500_000) -> DataFrame:
    """Keyed topics as a stream (needs the Kafka connector on the classpath)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_trigger)
        .option("includeHeaders", True)
        .load()
    )


def kafka_sink(records: DataFrame, servers: str, checkpoint: str):
    """topic, key, value, headers to Kafka."""
    return (
        records.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def file_source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available and return the result table; state and offsets are checkpointed."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = new_table(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """Sink with a folder for each batch: one that is run again after a crash replaces what it had written."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None):
    """foreachBatch over everything available; returns the progress records. With ``checkpoint`` it goes on from there."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint or f"{new_table(spark, name)}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query.recentProgress


def dedup_stream(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """First sighting of every event id, remembered as long as the watermark allows repeats."""
    return (
        events.withColumn("received_at", F.timestamp_micros("received_us"))
        .withWatermark("received_at", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .drop("received_at")
    )


def current_positions(fixes: DataFrame) -> DataFrame:
    """Newest fix per shipment, kept by a streaming aggregation (update mode)."""
    rest = [c for c in fixes.columns if c != "shipment_id"]
    newest = F.max_by(F.struct(*rest), F.struct("occurred_us", -F.col("event_id")))
    return fixes.groupBy("shipment_id").agg(newest.alias("r")).select("shipment_id", "r.*")


def upsert_current(path: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """Sink of ``current_positions``: the held table merged with each batch, a row moving only forwards.

    Two slots take turns. A batch reads the slot of the batch before it and replaces its own, so a batch that is
    run again after a crash writes the same, and the folder never holds more than two versions.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*schema.names)
        if batch_id:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/slot={(batch_id - 1) % 2}"))
        current_positions(rows).select(*schema.names).write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")

    return write


def latest_version(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Newest row per shipment of the two slots; one of them is whole at any time."""
    return current_positions(spark.read.schema(schema).parquet(path).select(*schema.names))


def history_sink(fixes: DataFrame, path: str, checkpoint: str):
    """Append-only position history partitioned by event day; late rows are kept."""
    dated = fixes.withColumn("dt", F.date_format(F.timestamp_micros("occurred_us"), "yyyy-MM-dd"))
    return (
        dated.writeStream.format("parquet")
        .partitionBy("dt")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def archive_stream(records: DataFrame, path: str, max_records: int = 2_000_000):
    """Hourly archive files from a stream of log records.

    The file sink's own log says which files count, so a batch that is repeated after a crash is read once.
    """
    slim = archive.slim(archive.layout(archive.skip_replayed(records)))
    return (
        slim.writeStream.format("json")
        .partitionBy("topic", "dt", "hour")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max_records)
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def windowed_throughput(fixes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Records per minute of arrival, emitted when the watermark closes the window."""
    timed = fixes.withColumn("received_at", F.timestamp_micros("received_us")).withWatermark("received_at", delay)
    lag = F.max(int_div(F.col("received_us") - F.col("occurred_us"), 1_000_000))
    return (
        timed.groupBy(F.window("received_at", "1 minute"))
        .agg(F.count(F.lit(1)).alias("records"), lag.alias("max_lag_s"))
        .select(F.unix_micros("window.start").alias("window_us"), "records", "max_lag_s")
    )


def live_feed(records: DataFrame) -> DataFrame:
    """Typed live updates for viewers from position, status, estimate, derived and exception records; unreadable ones go."""
    events = archive.decoded(records)
    update = (
        F.when(F.col("kind") == "shipment.arrived", "arrived")
        .when(F.col("kind") == "shipment.departed", "departed")
        .when(F.col("kind") == "eta.updated", "estimate")
        .otherwise(F.col("kind"))
    )
    payload = F.struct(
        "v.vehicleId", "v.position", "v.speedKph", "v.status", "v.stopId", "v.dwell", "v.estimatedArrival", "v.previousEstimate",
        "v.remainingKm", "v.confidence", "v.exceptionId", "v.exceptionType", "v.severity", "v.detail", "v.observedValue",
        "v.thresholdValue", "v.raisedAt", "v.openFor", "v.resolution",
    )
    # a position without coordinates cannot be drawn
    usable = F.col("kind").isNotNull() & ((F.col("kind") != "position") | F.col("v.position.latitude").isNotNull())
    return events.where(usable).select(
        update.alias("type"),
        F.col("v.shipmentId").alias("shipment_id"),
        "at_us",
        F.col("timestamp_us").alias("heard_us"),
        "offset",
        F.to_json(payload, {"ignoreNullFields": "true"}).alias("payload"),
    )


FEED_SCHEMA = "type string, shipment_id string, at_us bigint, heard_us bigint, payload string"


class GateProcessor(StatefulProcessor):
    """Lets every update of a shipment through but positions within ``gate_us`` of the last one let through.

    The gate's clock is the instant a record was heard, so a repeated batch decides alike. Its state expires once the
    watermark of that clock is a gate ahead: a silent shipment costs nothing, and its next position passes in any case.
    """

    def __init__(self, gate_us: int):
        self.gate = gate_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "heard_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (held,) = self.last.get() or (None,)
        last = held
        for r in sorted(rows, key=lambda r: (r.heard_us, r.offset)):
            if r.type == "position":
                if last is not None and r.heard_us - last < self.gate:
                    continue
                last = r.heard_us
            yield Row(type=r.type, shipment_id=key[0], at_us=r.at_us, heard_us=r.heard_us, payload=r.payload)
        if last != held:
            self.last.update((last,))
            if held is not None:  # a held gate has its timer: when that fires, both are gone
                self.handle.deleteTimer(self._expiry(held))
            self.handle.registerTimer(self._expiry(last))

    def _expiry(self, last: int) -> int:
        return (last + self.gate) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())


def thinned_feed(records: DataFrame, gate_millis: int, delay: str = "10 minutes") -> DataFrame:
    """The live feed with positions thinned to one per shipment and ``gate_millis`` of hearing."""
    heard = live_feed(records).withColumn("heard_at", F.timestamp_micros("heard_us")).withWatermark("heard_at", delay)
    return heard.groupBy("shipment_id").transformWithState(
        statefulProcessor=GateProcessor(gate_millis * 1000), outputStructType=FEED_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


PROGRESS_SCHEMA = (
    "batch_id bigint, input_rows bigint, rows_per_second double, state_rows bigint, duration_ms bigint, committed bigint, newest bigint, "
    "lag bigint, observed map<string,bigint>"
)


def position_of(offset) -> int:
    """How far an offset reaches: records over all partitions of a log, or entries of a file source's log."""
    parsed = ast.literal_eval(offset) if isinstance(offset, str) else offset
    if parsed is None:
        return 0
    if isinstance(parsed, dict):
        return sum(position_of(v) for v in parsed.values())
    return int(parsed)


def progress_table(spark: SparkSession, progress: list) -> DataFrame:
    """Progress records of a query (one per batch) as rows: what is read, how fast, the state held, how far the batch
    committed, how far the sources go and the lag between, and the metrics observed on the way.

    A log tells its newest offset; a file source only that of the batch, so at least what the run came to was ahead.
    """
    rows = []
    ends = [sum(position_of(s["endOffset"]) for s in p["sources"]) for p in progress]
    for p, committed in zip(progress, ends):
        newest = max(max(ends), sum(position_of(s["latestOffset"]) for s in p["sources"]))
        observed = {k: int(v or 0) for row in (p["observedMetrics"] or {}).values() for k, v in row.asDict().items()}
        rows.append(
            (
                p["batchId"], p["numInputRows"], float(p["processedRowsPerSecond"] or 0.0), sum(o["numRowsTotal"] for o in p["stateOperators"]),
                p["durationMs"].get("triggerExecution", 0), committed, newest, newest - committed, observed,
            )
        )
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)
