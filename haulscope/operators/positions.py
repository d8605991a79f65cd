"""Position history: latest state, trails, duplicates, late rows, distances to the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from haulscope.functions import geo
from haulscope.functions.timeparts import int_div
from haulscope.model.params import DEFAULT, Params
from haulscope.operators import slices
from haulscope.operators.slices import SLICE


def one_per_instant(fixes: DataFrame, params: Params = DEFAULT, key: str = "shipment_id") -> DataFrame:
    """Drop fixes that are not strictly newer than one already applied: per instant the lowest id stays.

    The result carries ``slice`` and is partitioned by (key, slice), which every track operator reuses.
    """
    w = Window.partitionBy(key, SLICE).orderBy("occurred_us", "event_id")
    sliced = slices.bounded(fixes, [key], "occurred_us", params.slice_seconds, params.slice_rows)
    before = F.lag("occurred_us").over(w)
    return sliced.withColumn("_before", before).where(
        F.col("_before").isNull() | (F.col("_before") != F.col("occurred_us"))
    ).drop("_before")


def current_position(fixes: DataFrame) -> DataFrame:
    """Newest fix of each shipment in event time; among equal instants the one seen first."""
    rest = [c for c in fixes.columns if c != "shipment_id"]
    order = F.struct("occurred_us", -F.col("event_id"))
    return fixes.groupBy("shipment_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("shipment_id", "_r.*")


def with_plan(df: DataFrame, plans: DataFrame) -> DataFrame:
    """Attach the lane's stops and legs; rows without a plan keep nulls."""
    return df.join(plans.select("lane", "stops", "legs"), "lane", "left")


def unplanned(fixes: DataFrame, plans: DataFrame) -> DataFrame:
    return fixes.join(plans, "lane", "left_anti")


def stop_distances(lat: Column, lon: Column, stops: Column) -> Column:
    """array<struct<meters, stop_id, radius_m>> over the planned stops; no row is multiplied."""
    return F.transform(
        stops,
        lambda s: F.struct(
            geo.haversine_m(lat, lon, s["lat"], s["lon"]).alias("meters"),
            s["stop_id"].alias("stop_id"),
            s["radius_m"].alias("radius_m"),
        ),
    )


def nearest_stop(df: DataFrame) -> DataFrame:
    """Adds ``nearest_stop_id`` and ``nearest_m`` (NaN without a plan)."""
    nearest = F.array_min(stop_distances(F.col("lat"), F.col("lon"), F.col("stops")))
    return (
        df.withColumn("_near", nearest)
        .withColumn("nearest_stop_id", F.col("_near")["stop_id"])
        .withColumn("nearest_m", F.coalesce(F.col("_near")["meters"], F.lit(float("nan"))))
        .drop("_near")
    )


def off_plan_km(lat: Column, lon: Column, legs: Column) -> Column:
    """Distance to the nearest leg of the plan; null with fewer than two stops."""
    return F.array_min(geo.segment_distances_m(lat, lon, legs)) / 1000.0


def movement(speed: Column, plan_size: Column, arrived: Column, at_stop: Column, params: Params = DEFAULT) -> Column:
    return (
        F.when((plan_size > 0) & (arrived == plan_size), F.lit("DELIVERED"))
        .when(at_stop, F.lit("AT_STOP"))
        .when(speed >= params.moving_kph, F.lit("MOVING"))
        .otherwise(F.lit("STOPPED"))
    )


def movement_after_fix(previous: Column, speed: Column, params: Params = DEFAULT) -> Column:
    """A bare fix does not end a delivery or a stop."""
    return (
        F.when(previous.isin("DELIVERED", "AT_STOP"), previous)
        .when(speed >= params.moving_kph, F.lit("MOVING"))
        .otherwise(F.lit("STOPPED"))
    )


def stale_seconds(received_us: Column, now_us: Column) -> Column:
    return F.when(received_us.isNotNull(), F.greatest(F.lit(0).cast("bigint"), int_div(now_us - received_us, 1_000_000)))


def fleet_bounds(current: DataFrame) -> DataFrame:
    return current.agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
    )


def fleet_speed(current: DataFrame, params: Params = DEFAULT) -> DataFrame:
    moving = F.col("speed_kph") >= params.moving_kph
    return current.agg(
        F.count_if(moving).alias("moving"),
        F.count(F.lit(1)).alias("vehicles"),
        F.avg(F.when(moving, F.col("speed_kph"))).alias("avg_moving_kph"),
    )


def last_n(df: DataFrame, n: int, key: str = "shipment_id") -> DataFrame:
    """Newest ``n`` rows per key. Spark trims to n per key before the shuffle as well as after it."""
    w = Window.partitionBy(key).orderBy(F.desc("occurred_us"), F.desc("event_id"))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def in_track_order(df: DataFrame, key: str = "shipment_id") -> DataFrame:
    """Rows of each key together, oldest first."""
    return df.orderBy(key, "occurred_us", "event_id")


def trail(fixes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Last points of each track after collapsing runs of the same point."""
    track = one_per_instant(fixes, params).select("shipment_id", SLICE, "occurred_us", "event_id", "lat", "lon")
    moved = slices.previous(track, ["shipment_id"], "occurred_us", {"_lat": "lat", "_lon": "lon"}).where(
        ~(F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon")))
    )
    return last_n(moved.drop("_lat", "_lon"), params.trail_points)


def linestrings(points: DataFrame) -> DataFrame:
    """Ordered point list per shipment, for inputs already bounded per shipment (trail, last n)."""
    line = F.transform(
        F.array_sort(F.collect_list(F.struct("occurred_us", "event_id", "lon", "lat"))),
        lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")),
    )
    return points.groupBy("shipment_id").agg(line.alias("points")).where(F.size("points") >= 2)


def dedup(events: DataFrame) -> DataFrame:
    """First sighting of every event id. Aggregation, so repeats shrink before the shuffle."""
    rest = [c for c in events.columns if c != "event_id"]
    first = F.min_by(F.struct(*rest), F.col("received_us"))
    return events.groupBy("event_id").agg(first.alias("_r")).select("event_id", "_r.*").select(*events.columns)


def late_rows(fixes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Rows that arrive after a fix at least as new: kept in history, ignored by state."""
    sliced = slices.bounded(fixes, ["shipment_id"], "received_us", params.slice_seconds, params.slice_rows)
    seen = slices.running_max(sliced, ["shipment_id"], ["received_us", "event_id"], "occurred_us", "seen_us")
    return seen.where(F.col("occurred_us") <= F.col("seen_us")).drop(SLICE)


def thin(fixes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """At most one forwarded fix per shipment and gate interval of arrival time."""
    arrivals = slices.bounded(fixes, ["shipment_id"], "received_us", params.slice_seconds, params.slice_rows)
    w = Window.partitionBy("shipment_id", SLICE).orderBy("received_us", "event_id")
    # several fixes in one arrival instant: only the first can pass
    firsts = arrivals.withColumn("_b", F.lag("received_us").over(w)).where(
        F.col("_b").isNull() | (F.col("_b") != F.col("received_us"))
    ).drop("_b")
    kept = slices.greedy_chain(firsts, ["shipment_id"], "received_us", "received_us", params.gate_millis * 1000)
    return kept.where("kept").drop("kept", "kept_before", SLICE)
