"""Fleet read models: one row per shipment joining position, plan, visits, estimate and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haulscope.functions import geo
from haulscope.functions.text import lane_code, severity_of_rank, severity_rank
from haulscope.functions.timeparts import int_div
from haulscope.model.params import DEFAULT, MICROS, Params
from haulscope.operators import positions


def latest_estimates(estimates: DataFrame) -> DataFrame:
    return estimates.groupBy("shipment_id").agg(
        F.max_by(F.struct(F.col("stop_id").alias("eta_stop_id"), "estimate_us", "confidence"), "occurred_us").alias("e")
    ).select("shipment_id", "e.*")


def visit_maps(visits: DataFrame) -> DataFrame:
    """Visits of a shipment as one array; bounded by the stops of its plan."""
    return visits.groupBy("shipment_id").agg(
        F.collect_list(F.struct("stop_id", "arrived_us", "departed_us")).alias("visits")
    )


def open_by_shipment(incidents: DataFrame) -> DataFrame:
    """Open incidents of a shipment; at most one per rule and stop can be open."""
    rank = severity_rank(F.col("severity"))
    entry = F.struct((-rank).alias("order"), "onset_us", "exception_id", "type")
    return incidents.where("state = 'OPEN'").groupBy("shipment_id").agg(
        F.array_sort(F.collect_list(entry)).alias("open"), F.max(rank).alias("worst_rank")
    )


def _visit(stop_id: Column, field: str) -> Column:
    return F.get(F.filter("visits", lambda v: v["stop_id"] == stop_id), F.lit(0))[field]


def through(lat: Column, lon: Column, stops: Column) -> Column:
    """Metres from a point through the stops in order."""
    start = F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(0.0).alias("m"))
    end = F.aggregate(
        stops,
        start,
        lambda acc, s: F.struct(
            s["lat"].alias("lat"),
            s["lon"].alias("lon"),
            (acc["m"] + geo.haversine_m(acc["lat"], acc["lon"], s["lat"], s["lon"])).alias("m"),
        ),
    )
    return end["m"]


def with_stops(current: DataFrame, plans: DataFrame, visits: DataFrame) -> DataFrame:
    """Current positions with the planned stops and what happened at each (array ``planned``)."""
    df = (
        current.withColumn("lane", lane_code(F.col("shipment_id")))
        .join(plans.select("lane", "stops"), "lane", "left")
        .join(visit_maps(visits), "shipment_id", "left")
    )
    planned = F.transform(
        F.coalesce("stops", F.array().cast(plans.schema["stops"].dataType)),
        lambda s: F.struct(
            s["seq"].alias("seq"),
            s["stop_id"].alias("stop_id"),
            s["name"].alias("name"),
            s["city"].alias("city"),
            s["state"].alias("state"),
            s["lat"].alias("lat"),
            s["lon"].alias("lon"),
            s["radius_m"].alias("radius_m"),
            s["kind"].alias("kind"),
            _visit(s["stop_id"], "arrived_us").alias("arrived_us"),
            _visit(s["stop_id"], "departed_us").alias("departed_us"),
        ),
    )
    return df.withColumn("planned", planned).drop("stops", "visits")


def summary(
    current: DataFrame, plans: DataFrame, visits: DataFrame, estimates: DataFrame, incidents: DataFrame, now_us: Column,
    params: Params = DEFAULT,
) -> DataFrame:
    """The fleet view: every input is reduced to one row per shipment before the joins."""
    df = (
        with_stops(current, plans, visits)
        .join(latest_estimates(estimates), "shipment_id", "left")
        .join(open_by_shipment(incidents), "shipment_id", "left")
    )
    df = df.withColumns(
        {
            "ahead": F.filter("planned", lambda s: s["arrived_us"].isNull()),
            "here": F.get(
                F.filter("planned", lambda s: s["arrived_us"].isNotNull() & s["departed_us"].isNull()), F.lit(0)
            ),
        }
    )
    total, left = F.size("planned"), F.size("ahead")
    df = df.withColumn("next", F.get("ahead", F.lit(0))).withColumn(
        "movement", positions.movement(F.col("speed_kph"), total, total - left, F.col("here").isNotNull(), params)
    )
    pending = F.when(
        F.col("next").isNotNull(),
        F.when(F.col("movement") == "AT_STOP", "AT_A_STOP")
        .when(F.col("estimate_us").isNull() | F.col("eta_stop_id").isNull(), "NO_ESTIMATE_YET")
        .when(F.col("eta_stop_id") != F.col("next.stop_id"), "SUPERSEDED"),
    )
    shown = F.col("next").isNotNull() & F.col("estimate_pending").isNull()
    left_km = geo.road_km(through(F.col("lat"), F.col("lon"), F.col("ahead")), params.circuity)
    first = F.get("planned", F.lit(0))
    route_km = geo.road_km(through(first["lat"], first["lon"], F.col("planned")), params.circuity)
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("left_km") / F.col("route_km")))
    return (
        df.withColumn("estimate_pending", pending)
        .withColumn("left_km", left_km)
        .withColumn("route_km", F.when(total >= 2, route_km))
        .select(
            "shipment_id",
            "vehicle_id",
            "occurred_us",
            "received_us",
            positions.stale_seconds(F.col("received_us"), now_us).alias("stale_s"),
            "lat",
            "lon",
            "speed_kph",
            "accuracy_m",
            "movement",
            F.col("here.stop_id").alias("at_stop_id"),
            F.col("here.arrived_us").alias("at_stop_since_us"),
            F.col("next.stop_id").alias("next_stop_id"),
            geo.road_km(
                geo.haversine_m(F.col("lat"), F.col("lon"), F.col("next.lat"), F.col("next.lon")), params.circuity
            ).alias("next_stop_km"),
            F.when(shown, F.col("estimate_us")).alias("estimate_us"),
            F.when(shown, F.col("confidence")).alias("confidence"),
            "estimate_pending",
            (total - left).cast("bigint").alias("stops_completed"),
            total.cast("bigint").alias("stops_total"),
            F.when(F.col("route_km") > 0, done).alias("fraction_complete"),
            F.when(total > 0, F.when(left == 0, 0.0).otherwise(F.col("left_km"))).alias("remaining_km"),
            F.coalesce(F.size("open"), F.lit(0)).cast("bigint").alias("open_incidents"),
            F.array_join(F.transform("open", lambda o: o["type"]), ",").alias("open_types"),
            severity_of_rank(F.col("worst_rank")).alias("worst_severity"),
        )
    )


def planned_stops(current: DataFrame, plans: DataFrame, visits: DataFrame) -> DataFrame:
    """Every planned stop with PENDING, AT or DEPARTED and the time spent there."""
    return with_stops(current, plans, visits).select("shipment_id", F.inline("planned")).withColumns(
        {
            "status": F.when(F.col("arrived_us").isNull(), "PENDING").when(F.col("departed_us").isNull(), "AT").otherwise("DEPARTED"),
            "dwell_s": int_div(F.col("departed_us") - F.col("arrived_us"), MICROS),
        }
    )


def in_fleet_order(summaries: DataFrame) -> DataFrame:
    """Worst severity first, then shipment id."""
    return summaries.orderBy(severity_rank(F.col("worst_severity")).desc(), "shipment_id")


def drawn(summaries: DataFrame, selected: str | None = None) -> DataFrame:
    """Delivered shipments are hidden, but for a selected one; ``stale`` marks those to be drawn faded."""
    keep = F.col("movement") != "DELIVERED"
    if selected is not None:
        keep = keep | (F.col("shipment_id") == selected)
    return summaries.where(keep)


def status(summaries: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Shipments by movement (all four always present), hidden and stale counts, incident totals."""
    of = lambda m: F.count_if(F.col("movement") == m)
    return summaries.agg(
        of("MOVING").alias("moving"),
        of("STOPPED").alias("stopped"),
        of("AT_STOP").alias("at_stop"),
        of("DELIVERED").alias("delivered"),
        F.count_if(F.col("stale_s") > params.stale_seconds).alias("stale"),
        F.coalesce(F.sum("open_incidents"), F.lit(0)).alias("open_incidents"),
        F.count_if(F.col("worst_severity") == "CRITICAL").alias("critical_shipments"),
    )


def meta(current: DataFrame, incidents: DataFrame) -> DataFrame:
    """Tracked shipments and open incidents, as one row from one aggregation."""
    tracked = current.select(F.lit(1).alias("shipment"), F.lit(0).alias("opened"))
    opened = incidents.select(F.lit(0), F.when(F.col("state") == "OPEN", 1).otherwise(0))
    return tracked.union(opened).agg(
        F.coalesce(F.sum("shipment"), F.lit(0)).alias("tracked_shipments"),
        F.coalesce(F.sum("opened"), F.lit(0)).alias("open_exceptions"),
    )


def detail(
    summaries: DataFrame, stops: DataFrame, manifests: DataFrame, incidents: DataFrame, trail: DataFrame
) -> DataFrame:
    """Summary plus manifest envelope, planned stops, incident count and newest incident, trail length.

    The incident and trail rows themselves stay in their own tables: a list of all incidents of one
    shipment has no bound.
    """
    stop_text = F.concat_ws("|", F.col("seq").cast("string"), "stop_id", "status")
    visited = stops.groupBy("shipment_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", stop_text.alias("t")))), lambda s: s["t"]), ";").alias("stops")
    )
    counted = incidents.groupBy("shipment_id").agg(
        F.count(F.lit(1)).alias("incidents"), F.max_by("exception_id", F.struct("onset_us", "exception_id")).alias("newest_incident")
    )
    points = trail.groupBy("shipment_id").agg(F.count(F.lit(1)).alias("trail_points"))
    return (
        summaries.select("shipment_id", "movement", "next_stop_id", "worst_severity")
        .join(manifests.select("shipment_id", "customer_id", "mode", "schema_version", "created_us"), "shipment_id", "left")
        .join(visited, "shipment_id", "left")
        .join(counted, "shipment_id", "left")
        .join(points, "shipment_id", "left")
        .select(
            "shipment_id", "movement", "next_stop_id", "worst_severity", "customer_id", "mode", "schema_version", "created_us", "stops",
            F.coalesce("incidents", F.lit(0)).alias("incidents"), "newest_incident", F.coalesce("trail_points", F.lit(0)).alias("trail_points"),
        )
    )
