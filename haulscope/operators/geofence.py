"""Geofence visits: hysteresis, dwell confirmation, arrivals and departures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from haulscope.functions import geo, ids
from haulscope.functions.timeparts import int_div
from haulscope.model.params import DEFAULT, MICROS, Params
from haulscope.operators import slices
from haulscope.operators.slices import SLICE

VISIT_KEYS = ["shipment_id", "stop_id"]


def fix_stop_sides(track: DataFrame, stops: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Every fix against every stop of its plan, with the side of the fence the shipment is on.

    ``track`` comes from ``one_per_instant``; an inaccurate fix leaves the side as it was.
    """
    pairs = track.select("shipment_id", "lane", SLICE, "occurred_us", "event_id", "lat", "lon", "accuracy_m").join(
        stops.select("lane", "stop_id", "seq", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "radius_m"),
        "lane",
    )
    meters = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    usable = F.coalesce(F.col("accuracy_m") <= F.col("radius_m") * params.fence_accuracy_ratio, F.lit(True))
    label = F.when(
        usable,
        F.when(F.col("meters") < F.col("radius_m"), F.lit("in")).when(
            F.col("meters") > F.col("radius_m") * params.exit_ratio, F.lit("out")
        ),
    )
    labelled = (
        pairs.withColumn("meters", meters)
        .withColumn("usable", usable)
        .withColumn("label", label)
        .select(*VISIT_KEYS, SLICE, "seq", "occurred_us", "event_id", "usable", "label")
    )
    return slices.label_runs(labelled, VISIT_KEYS, "occurred_us", "label", "out")


def visits(sides: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """First confirmed stay and the first confirmed absence after it, per shipment and stop."""
    held = F.col("occurred_us") - F.col("run_start") >= params.dwell_seconds * MICROS
    confirmed = (
        sides.where(F.col("usable") & held)
        .groupBy(*VISIT_KEYS, "side", "run_start")
        .agg(F.min(F.struct("occurred_us", "event_id")).alias("proof"))
    )
    entered = F.min(F.when(F.col("side") == "in", F.col("run_start"))).over(Window.partitionBy(*VISIT_KEYS))
    run = F.struct("run_start", "proof")
    found = (
        confirmed.withColumn("entered", entered)
        .groupBy(*VISIT_KEYS)
        .agg(
            F.min(F.when(F.col("side") == "in", run)).alias("a"),
            F.min(F.when((F.col("side") == "out") & (F.col("run_start") > F.col("entered")), run)).alias("d"),
        )
        .where("a IS NOT NULL")
    )
    return found.select(
        *VISIT_KEYS,
        F.col("a.run_start").alias("arrived_us"),
        F.col("a.proof.occurred_us").alias("arrival_proof_us"),
        F.col("a.proof.event_id").alias("arrival_caused_by"),
        F.col("d.run_start").alias("departed_us"),
        F.col("d.proof.occurred_us").alias("departure_proof_us"),
        F.col("d.proof.event_id").alias("departure_caused_by"),
        int_div(F.col("d.run_start") - F.col("a.run_start"), MICROS).alias("dwell_s"),
    )


def visit_events(visited: DataFrame) -> DataFrame:
    """shipment.arrived and shipment.departed events with ids that repeat on redelivery."""
    ship, stop = F.col("shipment_id"), F.col("stop_id")
    arrived = F.struct(
        F.lit("shipment.arrived").alias("type"),
        ids.arrival_id(ship, stop, F.col("arrived_us")).alias("event_id"),
        F.col("arrived_us").alias("occurred_us"),
        F.col("arrival_caused_by").cast("string").alias("caused_by"),
        F.lit(None).cast("bigint").alias("dwell_s"),
    )
    departed = F.struct(
        F.lit("shipment.departed").alias("type"),
        ids.departure_id(ship, stop, F.col("departed_us")).alias("event_id"),
        F.col("departed_us").alias("occurred_us"),
        F.col("departure_caused_by").cast("string").alias("caused_by"),
        F.col("dwell_s").alias("dwell_s"),
    )
    both = F.array_compact(F.array(arrived, F.when(F.col("departed_us").isNotNull(), departed)))
    return visited.select("shipment_id", "stop_id", F.inline(both))


def visits_of_track(track: DataFrame, stops: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return visits(fix_stop_sides(track, stops, params), params)
