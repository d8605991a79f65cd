"""Service terms and filters over manifests: typed envelope, untyped JSON body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haulscope.functions.timeparts import instant_us

# Freight modes an envelope may carry.
MODES = ("PHARMA_COLD_CHAIN", "RETAIL_REPLENISHMENT", "LTL", "PARCEL")


def parsed(manifests: DataFrame) -> DataFrame:
    return manifests.withColumn("v", F.try_parse_json("body"))


def _number(body: str, path: str) -> Column:
    """The value at a path, but only when it is a JSON number."""
    kind = F.schema_of_variant(F.try_variant_get(body, path, "variant"))
    numeric = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    return F.when(numeric, F.try_variant_get(body, path, "double"))


def _text(body: str, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(body, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(body, path, "string"))


def sla_terms(manifests: DataFrame) -> DataFrame:
    """Temperature band and delivery window from the two reserved paths of a body."""
    raw = parsed(manifests).select(
        "shipment_id",
        "customer_id",
        "mode",
        _number("v", "$.temperature.minC").alias("min_c"),
        _number("v", "$.temperature.maxC").alias("max_c"),
        _number("v", "$.temperature.excursionToleranceMinutes").alias("tolerance"),
        instant_us(_text("v", "$.deliveryWindow.opensAt")).alias("opens_us"),
        instant_us(_text("v", "$.deliveryWindow.closesAt")).alias("closes_us"),
    )
    band = F.col("min_c").isNotNull() & F.col("max_c").isNotNull()
    return raw.select(
        "shipment_id",
        "customer_id",
        "mode",
        F.when(band, F.col("min_c")).alias("min_c"),
        F.when(band, F.col("max_c")).alias("max_c"),
        F.when(band, F.col("tolerance").cast("bigint") * 60).alias("tolerance_s"),
        F.when(F.col("closes_us").isNotNull(), F.col("opens_us")).alias("opens_us"),
        "closes_us",
        band.alias("cold_chain"),
    )


def by_customer(manifests: DataFrame, customer: str) -> DataFrame:
    """A customer's manifests, newest first."""
    return manifests.where(F.col("customer_id") == customer).orderBy(F.desc("created_us"), "shipment_id")


def by_mode(manifests: DataFrame, mode: str) -> DataFrame:
    return manifests.where(F.col("mode") == mode)


def by_body_field(manifests: DataFrame, path: str, value: str) -> DataFrame:
    return parsed(manifests).where(F.try_variant_get("v", f"$.{path}", "string") == value).drop("v")


def census(manifests: DataFrame) -> DataFrame:
    """Manifests per (customer, mode) and the lowest shipment id of each."""
    return manifests.groupBy("customer_id", "mode").agg(
        F.count(F.lit(1)).alias("manifests"), F.min("shipment_id").alias("first_shipment_id")
    )


def envelope_problems(manifests: DataFrame) -> DataFrame:
    """Rows whose envelope lacks a field or names an unknown mode; the body only has to be an object."""
    df = parsed(manifests)
    wanted = ["shipment_id", "customer_id", "mode", "schema_version", "created_us", "body"]
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in wanted]
    checks.append(F.when(~F.col("mode").isin(*MODES), F.lit("mode is not one of the known modes")))
    object_body = F.schema_of_variant("v").startswith("OBJECT")
    checks.append(F.when(F.col("body").isNotNull() & ~F.coalesce(object_body, F.lit(False)), F.lit("body must be an object")))
    problems = F.concat_ws("; ", F.array_sort(F.array_compact(F.array(*checks))))
    return df.withColumn("problems", problems).where("problems <> ''").select("shipment_id", "problems")
