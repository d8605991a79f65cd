"""Archived log records of the fleet: positions, temperatures, visits and silences, with flaws.

Positions: repeated when event_id % 37 = 0, cut in half when % 41 = 0, without an id when % 47 = 0,
and once more as a replayed copy when % 53 = 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulscope.model.params import MICROS
from haulscope.plans import archive, events as ev

REPEAT_OFFSET = 1_000_000_000_000


def position_records(fixes: DataFrame) -> DataFrame:
    e = F.col("event_id")
    event_id = F.when(e % 47 != 0, F.concat(F.lit("e-"), e.cast("string")))
    text = F.to_json(ev.position_value(event_id), {"ignoreNullFields": "true"})
    value = F.when(e % 41 == 0, F.substring(text, 1, 40)).otherwise(text)
    copy = lambda kind, when: F.when(when, F.lit(kind))
    copies = F.array_compact(F.array(F.lit("first"), copy("repeat", e % 37 == 0), copy("replay", e % 53 == 0)))
    header = F.struct(F.lit(archive.REPLAY_HEADER).alias("key"), F.lit("x").cast("binary").alias("value"))
    empty = F.array().cast("array<struct<key:string,value:binary>>")
    return fixes.withColumn("copy", F.explode(copies)).select(
        F.lit("fleet.position").alias("topic"),
        (F.col("user_id") % 12).cast("int").alias("partition"),
        (e + F.when(F.col("copy") == "first", 0).otherwise(REPEAT_OFFSET)).alias("offset"),
        (F.col("received_us") + F.when(F.col("copy") == "first", 0).otherwise(60 * MICROS)).alias("timestamp_us"),
        F.col("shipment_id").alias("key"),
        value.alias("value"),
        F.when(F.col("copy") == "replay", F.array(header)).otherwise(empty).alias("headers"),
    )


def status_records(fixes: DataFrame) -> DataFrame:
    value = F.to_json(ev.status_value(F.concat(F.lit("t-"), F.col("event_id").cast("string"))))
    return _records(fixes.where("temp_c IS NOT NULL"), "fleet.status", "received_us", value)


def derived_records(visit_events: DataFrame) -> DataFrame:
    value = F.to_json(ev.visit_value(), {"ignoreNullFields": "true"})
    return _records(visit_events, "fleet.derived", "occurred_us", value)


def estimate_records(estimates: DataFrame) -> DataFrame:
    value = F.to_json(ev.estimate_value(), {"ignoreNullFields": "true"})
    return _records(estimates, "fleet.eta", "occurred_us", value)


def exception_records(incident_events: DataFrame) -> DataFrame:
    value = F.to_json(ev.incident_value(), {"ignoreNullFields": "true"})
    return _records(incident_events, "fleet.exceptions", "occurred_us", value)


def _records(df: DataFrame, topic: str, at: str, value) -> DataFrame:
    return df.select(
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.xxhash64("event_id").alias("offset"),
        F.col(at).alias("timestamp_us"),
        F.col("shipment_id").alias("key"),
        value.alias("value"),
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"),
    )
