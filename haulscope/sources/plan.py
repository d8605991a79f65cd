"""Lane catalogue and the plan of a shipment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.functions import geo
from haulscope.functions.text import lane_code

LANE_SCHEMA = (
    "code string, routeId string, name string, stops array<struct<stopId:string, seq:bigint, name:string, "
    "city:string, state:string, latitude:double, longitude:double, radiusMeters:double, kind:string, "
    "dwellSeconds:bigint>>"
)

# The lane catalogue (lane, route, stop, seq, name, city, state, lat, lon, radius m, kind, dwell s).
LANE_STOPS = """
DEL | del-bom-nh48  | del-okhla      | 0 | Okhla DC                | Delhi         | DL | 28.5355 | 77.273  | 400 | PICKUP   | 4500
DEL | del-bom-nh48  | jai-vki        | 1 | Jaipur VKI depot        | Jaipur        | RJ | 26.9124 | 75.7873 | 400 | DELIVERY | 3000
DEL | del-bom-nh48  | amd-aslali     | 2 | Aslali crossdock        | Ahmedabad     | GJ | 23.0225 | 72.5714 | 400 | DELIVERY | 3900
DEL | del-bom-nh48  | bom-bhiwandi   | 3 | Bhiwandi DC             | Bhiwandi      | MH | 19.2813 | 73.0483 | 400 | DELIVERY | 5400
HYD | hyd-blr-cold  | hyd-genome     | 0 | Genome Valley depot     | Hyderabad     | TG | 17.61   | 78.58   | 400 | PICKUP   | 6000
HYD | hyd-blr-cold  | knl-clinic     | 1 | Kurnool clinic dock     | Kurnool       | AP | 15.8281 | 78.0373 | 120 | DELIVERY | 2100
HYD | hyd-blr-cold  | blr-hosp       | 2 | Bengaluru hospital dock | Bengaluru     | KA | 12.9716 | 77.5946 | 120 | DELIVERY | 2400
BLR | blr-maa-ltl   | blr-peenya     | 0 | Peenya terminal         | Bengaluru     | KA | 13.0287 | 77.52   | 400 | PICKUP   | 3600
BLR | blr-maa-ltl   | hsr-cust       | 1 | Hosur customer          | Hosur         | TN | 12.7409 | 77.8253 | 120 | DELIVERY | 1500
BLR | blr-maa-ltl   | vlr-cust       | 2 | Vellore customer        | Vellore       | TN | 12.9165 | 79.1325 | 120 | DELIVERY | 1800
BLR | blr-maa-ltl   | spr-cust       | 3 | Sriperumbudur customer  | Sriperumbudur | TN | 12.9675 | 79.943  | 120 | DELIVERY | 1500
BLR | blr-maa-ltl   | maa-madhavaram | 4 | Madhavaram terminal     | Chennai       | TN | 13.1477 | 80.235  | 400 | DELIVERY | 3300
BOM | bom-pnq-dray  | bom-jnpt       | 0 | Nhava Sheva port gate   | Navi Mumbai   | MH | 18.949  | 72.949  | 400 | PICKUP   | 7200
BOM | bom-pnq-dray  | pnv-fuel       | 1 | Panvel fuel stop        | Panvel        | MH | 18.9894 | 73.1175 | 400 | WAYPOINT | 1200
BOM | bom-pnq-dray  | pnq-chakan     | 2 | Chakan bonded warehouse | Chakan        | MH | 18.7606 | 73.8636 | 400 | DELIVERY | 3600
"""


def lane_rows() -> list[tuple]:
    rows = []
    for line in LANE_STOPS.strip().splitlines():
        c = [part.strip() for part in line.split("|")]
        rows.append((c[0], c[1], c[2], int(c[3]), c[4], c[5], c[6], float(c[7]), float(c[8]), float(c[9]), c[10], int(c[11])))
    return rows


def values_sql() -> str:
    """The catalogue as a VALUES list that both Spark and an ANSI engine accept."""

    return ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in lane_rows())


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value + "'"
    return f"CAST({value} AS DOUBLE)" if isinstance(value, float) else f"CAST({value} AS BIGINT)"


COLUMNS = "lane, route_id, stop_id, seq, name, city, state, lat, lon, radius_m, kind, dwell_s"


def lane_stops(spark: SparkSession) -> DataFrame:
    """One row per stop of the catalogue; a local relation, so its exact size decides the join."""
    return spark.sql(f"SELECT * FROM VALUES {values_sql()} AS t({COLUMNS})")


def read_lanes(spark: SparkSession, path: str) -> DataFrame:
    """Lane catalogue from its JSON document, one row per stop."""
    document = spark.read.schema(f"lanes array<struct<{_struct_ddl()}>>").option("multiLine", True).json(path)
    return document.select(F.inline("lanes")).select("code", "routeId", F.inline("stops")).toDF(
        *[c.strip() for c in COLUMNS.split(",")]
    )


def _struct_ddl() -> str:
    return LANE_SCHEMA.replace("code string", "code:string").replace("routeId string", "routeId:string").replace(
        ", name string, stops ", ", name:string, stops:"
    )


STOP_FIELDS = ("seq", "stop_id", "name", "city", "state", "lat", "lon", "radius_m", "kind", "dwell_s")


def lane_plans(spark: SparkSession) -> DataFrame:
    """One row per lane of the catalogue: ordered stops and the legs between them as arrays."""
    by_lane: dict[str, list[tuple]] = {}
    for row in lane_rows():
        by_lane.setdefault(row[0], []).append(row)

    def stop(row: tuple) -> str:
        values = (row[3], row[2], *row[4:])
        return "named_struct(" + ", ".join(f"'{f}', {_literal(v)}" for f, v in zip(STOP_FIELDS, values)) + ")"

    rows = ", ".join(
        f"('{lane}', '{stops[0][1]}', array({', '.join(stop(r) for r in sorted(stops, key=lambda r: r[3]))}))"
        for lane, stops in by_lane.items()
    )
    return with_legs(spark.sql(f"SELECT * FROM VALUES {rows} AS t(lane, route_id, stops)"))


def lane_arrays(stops: DataFrame) -> DataFrame:
    stop = F.struct(*[F.col(c) for c in STOP_FIELDS])
    return stops.groupBy("lane").agg(
        F.first("route_id").alias("route_id"), F.array_sort(F.collect_list(stop)).alias("stops")
    )


def with_legs(plans: DataFrame) -> DataFrame:
    legs = F.zip_with(
        F.slice("stops", F.lit(1), F.greatest(F.size("stops") - 1, F.lit(0))),
        F.slice("stops", F.lit(2), F.greatest(F.size("stops") - 1, F.lit(0))),
        lambda a, b: F.struct(
            a["lat"].alias("lat_a"), a["lon"].alias("lon_a"), b["lat"].alias("lat_b"), b["lon"].alias("lon_b")
        ),
    )
    return plans.withColumn("legs", legs)


def itineraries(shipments: DataFrame, stops: DataFrame) -> DataFrame:
    """Planned stops of each shipment: the lane in its id, expanded. Unknown lanes yield nothing."""
    return shipments.select("shipment_id", lane_code(F.col("shipment_id")).alias("lane")).join(stops, "lane")


def final_stops(stops: DataFrame) -> DataFrame:
    return stops.groupBy("lane").agg(F.max_by("stop_id", "seq").alias("stop_id"))


def route_totals(stops: DataFrame, circuity: float) -> DataFrame:
    """Length of each lane and the time planned at its stops."""
    plans = with_legs(lane_arrays(stops))
    leg_m = F.transform("legs", lambda l: geo.haversine_m(l["lat_a"], l["lon_a"], l["lat_b"], l["lon_b"]))
    total = F.aggregate(leg_m, F.lit(0.0), lambda acc, x: acc + x)
    return plans.select(
        "lane",
        F.size("stops").cast("bigint").alias("stops"),
        total.alias("route_m"),
        geo.road_km(total, circuity).alias("road_km"),
        F.aggregate("stops", F.lit(0).cast("bigint"), lambda acc, s: acc + s["dwell_s"]).alias("planned_dwell_s"),
    )
