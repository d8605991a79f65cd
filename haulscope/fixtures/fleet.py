"""Fleet tables computed from the ``events`` table, so every query grows with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.functions.timeparts import int_div, ntz_micros
from haulscope.model.params import DEFAULT, MICROS
from haulscope.operators import slices
from haulscope.sources import plan

EPOCH_S = 1_788_220_800  # first simulated second
SOURCE_US = 1_704_067_200_000_000  # first instant of the events table
DAY_S = 86_400


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def lane_of(user: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in ("DEL", "HYD", "BLR", "BOM")]), F.pmod(user, F.lit(4)).cast("int"))


def padded(user: Column) -> Column:
    return F.lpad(user.cast("string"), F.greatest(F.length(user.cast("string")), F.lit(4)), F.lit("0"))


def fleet_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position fix per event: a truck of lane ``user_id % 4`` on its way along the lane."""
    raw = events(spark, sf_dir).select("event_id", "user_id", "value", ntz_micros(F.col("ts")).alias("us"))
    ranked = slices.numbered(
        slices.bounded(raw, ["user_id"], "us", DAY_S, DEFAULT.slice_rows), ["user_id"], ["us", "event_id"], "k", "n"
    ).drop(slices.SLICE)
    lanes = plan.lane_plans(spark).select("lane", "stops")
    user, event = F.col("user_id"), F.col("event_id")
    df = ranked.withColumn("lane", lane_of(user)).join(lanes, "lane")
    df = df.withColumn("f", (F.col("k") - 1) * F.size("stops") / F.col("n").cast("double"))
    df = df.withColumn("j", F.floor("f").cast("int")).withColumn("u", F.col("f") - F.col("j"))
    last = F.col("j") == F.size("stops") - 1
    halted = (user % 5 == 2) & (F.col("j") == 1) & (F.col("u") < 0.8)
    parked = (F.col("u") < 0.4) | last
    df = df.withColumn("t", F.when(parked, 0.0).when(halted, 0.5).otherwise((F.col("u") - 0.4) / 0.6))
    here = F.get("stops", F.col("j"))
    there = F.coalesce(F.get("stops", F.col("j") + 1), here)
    wobble = (event * 7919 % 1000 - 500) / F.lit(500.0) * 0.002
    detour = (user % 7 == 3) & (F.col("j") == 1) & (F.col("t") > 0.2) & (F.col("t") < 0.8)
    number = padded(user)
    occurred_s = F.lit(EPOCH_S) + int_div(F.col("us") - SOURCE_US, 60 * MICROS)
    # eight warm readings after a third of the track, or at its end so that the incident stays open
    warm_from = F.when(user % 8 == 5, F.col("n") - 7).otherwise(int_div(F.col("n"), 3))
    hot = (user % 3 == 1) & (F.col("k") >= warm_from) & (F.col("k") < warm_from + 8)
    return df.select(
        "event_id",
        "user_id",
        "lane",
        F.concat(F.lit("SHP-"), F.col("lane"), F.lit("-"), number).alias("shipment_id"),
        F.concat(F.lit("VEH-"), number).alias("vehicle_id"),
        F.concat(F.lit("TLM-"), number).alias("tracker_id"),
        F.concat(F.lit("DEV-"), number).alias("probe_id"),
        (occurred_s * MICROS).alias("occurred_us"),
        ((occurred_s + event % 97) * MICROS).alias("received_us"),
        (here["lat"] + (there["lat"] - here["lat"]) * F.col("t") + wobble + F.when(detour, 0.3).otherwise(0.0)).alias("lat"),
        (here["lon"] + (there["lon"] - here["lon"]) * F.col("t")).alias("lon"),
        F.when(parked | halted, 0.0).otherwise(F.lit(20.0) + F.col("value") / 5.0).alias("speed_kph"),
        F.when(event % 11 != 0, (event % 50 * 3).cast("double")).alias("accuracy_m"),
        F.when(
            F.col("lane") == "HYD", F.lit(4.0) + (event % 7) / F.lit(10.0) + F.when(hot, 9.0).otherwise(0.0)
        ).alias("temp_c"),
        F.when(F.col("lane") == "HYD", F.lit(4.0)).alias("setpoint_c"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = events(spark, sf_dir).select("user_id").distinct()
    lane, number = lane_of(F.col("user_id")), padded(F.col("user_id"))
    return users.select(
        "user_id",
        lane.alias("lane"),
        F.concat(F.lit("SHP-"), lane, F.lit("-"), number).alias("shipment_id"),
        F.concat(F.lit("VEH-"), number).alias("vehicle_id"),
        F.concat(F.lit("TLM-"), number).alias("tracker_id"),
        F.concat(F.lit("DEV-"), number).alias("probe_id"),
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shipment a vehicle carried when; one open period per user, but for
    ``% 10 = 1`` the vehicle changes at mid-period, ``= 2`` a gap of 30 minutes, ``= 3`` two overlapping rows.
    """
    begin, middle, half = EPOCH_S * MICROS, (EPOCH_S + 21_600) * MICROS, 1800 * MICROS
    kind = F.col("user_id") % 10
    other = F.concat(F.lit("VEH-"), padded(F.col("user_id") + 500_000))
    own = F.col("vehicle_id")

    def period(vehicle, start, end):
        end_col = F.lit(None).cast("bigint") if end is None else F.lit(end).cast("bigint")
        return F.struct(vehicle.alias("vehicle_id"), F.lit(start).cast("bigint").alias("from_us"), end_col.alias("to_us"))

    periods = (
        F.when(kind == 1, F.array(period(own, begin, middle), period(other, middle, None)))
        .when(kind == 2, F.array(period(own, begin, middle), period(own, middle + half, None)))
        .when(kind == 3, F.array(period(own, begin, None), period(own, middle, middle + half)))
        .otherwise(F.array(period(own, begin, None)))
    )
    return shipments(spark, sf_dir).select(
        "shipment_id", F.array("tracker_id", "probe_id").alias("device_ids"), F.inline(periods)
    )
