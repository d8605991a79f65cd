"""Spherical geometry as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_008.8


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.least(F.lit(1.0), F.sqrt(chord))) * (2.0 * EARTH_RADIUS_M)


def bearing_rad(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlon = F.radians(lon2 - lon1)
    a1, a2 = F.radians(lat1), F.radians(lat2)
    east = F.sin(dlon) * F.cos(a2)
    north = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(dlon)
    return F.atan2(east, north)


def initial_bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Compass bearing at the start of the great circle, in [0, 360)."""
    wrapped = F.pmod(F.degrees(bearing_rad(lat1, lon1, lat2, lon2)), F.lit(360.0))
    return F.when(wrapped >= 360.0, F.lit(0.0)).otherwise(wrapped)


def destination(lat: Column, lon: Column, bearing_deg: Column, meters: Column) -> Column:
    """Point reached from (lat, lon) on a bearing; longitude wrapped to [-180, 180)."""
    arc = meters / EARTH_RADIUS_M
    theta, phi = F.radians(bearing_deg), F.radians(lat)
    sin_lat = F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(theta)
    out_lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_lat)))
    shift = F.atan2(F.sin(theta) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * sin_lat)
    out_lon = F.pmod(lon + F.degrees(shift) + 180.0, F.lit(360.0)) - 180.0
    return F.struct(F.degrees(out_lat).alias("latitude"), out_lon.alias("longitude"))


def segment_distances_m(lat: Column, lon: Column, legs: Column) -> Column:
    """Distance from a point to each great-circle leg (lat_a, lon_a, lat_b, lon_b), ends included.

    Three passes over the short array, so that each quantity is computed once per leg.
    """
    ends = F.transform(
        legs,
        lambda g: F.struct(
            haversine_m(g["lat_a"], g["lon_a"], lat, lon).alias("to_a"),
            haversine_m(g["lat_b"], g["lon_b"], lat, lon).alias("to_b"),
            haversine_m(g["lat_a"], g["lon_a"], g["lat_b"], g["lon_b"]).alias("leg"),
            (bearing_rad(g["lat_a"], g["lon_a"], lat, lon) - bearing_rad(g["lat_a"], g["lon_a"], g["lat_b"], g["lon_b"])).alias("turn"),
        ),
    )
    crossed = F.transform(
        ends,
        lambda e: F.struct(
            e["to_a"].alias("to_a"),
            e["to_b"].alias("to_b"),
            e["leg"].alias("leg"),
            F.cos(e["turn"]).alias("ahead"),
            F.cos(e["to_a"] / EARTH_RADIUS_M).alias("cos_arc"),
            F.asin(F.sin(e["to_a"] / EARTH_RADIUS_M) * F.sin(e["turn"])).alias("cross"),
        ),
    )
    # the turn exceeds a right angle exactly when its cosine is negative
    return F.transform(
        crossed,
        lambda c: F.when(c["leg"] < 1.0, F.least(c["to_a"], c["to_b"]))
        .when(c["ahead"] < 0.0, c["to_a"])
        .when(
            F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c["cos_arc"] / F.cos(c["cross"])))) * EARTH_RADIUS_M > c["leg"],
            c["to_b"],
        )
        .otherwise(F.abs(c["cross"]) * EARTH_RADIUS_M),
    )


def road_km(meters: Column, circuity: float) -> Column:
    return meters / 1000.0 * F.lit(circuity)


def ring(lat: Column, lon: Column, radius_m: Column, points: int = 32) -> Column:
    """Closed polygon of ``points`` vertices around a stop, as array<struct<latitude,longitude>>."""
    meters_per_degree = 111_320.0
    return F.transform(
        F.sequence(F.lit(0), F.lit(points)),
        lambda i: F.struct(
            (lat + F.sin(i * (6.283185307179586 / points)) * radius_m / meters_per_degree).alias("latitude"),
            (
                lon
                + F.cos(i * (6.283185307179586 / points)) * radius_m / (F.cos(F.radians(lat)) * meters_per_degree)
            ).alias("longitude"),
        ),
    )
