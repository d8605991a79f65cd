"""As-of resolution of identifiers against assignments with half-open validity periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KEYS = ["key_kind", "key"]
OPEN_END = 2**62


def keyed_assignments(assignments: DataFrame) -> DataFrame:
    """One row per identifier an assignment can be found by: vehicle, each device, shipment."""
    found_by = F.concat(
        F.array(
            F.struct(F.lit("vehicle").alias("key_kind"), F.col("vehicle_id").alias("key")),
            F.struct(F.lit("shipment").alias("key_kind"), F.col("shipment_id").alias("key")),
        ),
        F.transform("device_ids", lambda d: F.struct(F.lit("device").alias("key_kind"), d.alias("key"))),
    )
    return assignments.select(
        F.inline(found_by),
        "shipment_id",
        "vehicle_id",
        "from_us",
        F.coalesce("to_us", F.lit(OPEN_END)).alias("to_us"),
    ).where("from_us < to_us")


def unambiguous_periods(assignments: DataFrame) -> DataFrame:
    """Disjoint periods per identifier in which exactly one assignment holds.

    Contradictory (overlapping) stretches are cut out here, on the dimension, so the fact side needs
    no aggregation afterwards: an as-of join against the result matches at most one row.
    """
    numbered = Window.partitionBy(*KEYS).orderBy("from_us", "to_us", "shipment_id", "vehicle_id")
    dim = keyed_assignments(assignments).withColumn("number", F.row_number().over(numbered))
    edges = dim.select(
        *KEYS,
        F.inline(
            F.array(
                F.struct(F.col("from_us").alias("at_us"), F.lit(1).alias("step"), F.col("number").alias("who")),
                F.struct(F.col("to_us").alias("at_us"), F.lit(-1).alias("step"), (-F.col("number")).alias("who")),
            )
        ),
    )
    w = Window.partitionBy(*KEYS).orderBy("at_us")
    # while one assignment holds, the sum of the numbers that began less those that ended is its number
    stretches = (
        edges.groupBy(*KEYS, "at_us")
        .agg(F.sum("step").alias("step"), F.sum("who").alias("who"))
        .withColumn("holding", F.sum("step").over(w))
        .withColumn("number", F.sum("who").over(w))
        .withColumn("end_us", F.lead("at_us").over(w))
        .where("holding = 1 AND end_us IS NOT NULL")
        .select(*KEYS, "number", F.col("at_us").alias("start_us"), "end_us")
    )
    return stretches.join(dim, [*KEYS, "number"]).select(
        *KEYS, "start_us", "end_us", F.col("shipment_id").alias("as_shipment"), F.col("vehicle_id").alias("as_vehicle")
    )


def resolve(facts: DataFrame, periods: DataFrame, at: str = "at_us") -> DataFrame:
    """Left as-of join on (key_kind, key) and the period; adds as_shipment and as_vehicle."""
    f, p = facts.alias("f"), periods.alias("p")
    return f.join(
        p,
        (F.col("f.key_kind") == F.col("p.key_kind"))
        & (F.col("f.key") == F.col("p.key"))
        & (F.col("p.start_us") <= F.col(f"f.{at}"))
        & (F.col(f"f.{at}") < F.col("p.end_us")),
        "left",
    ).select("f.*", "p.as_shipment", "p.as_vehicle")
