"""One manifest per shipment, derived from ``events``; every ninth breaks its contract in some way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.fixtures import fleet
from haulscope.functions.timeparts import instant_text, ntz_micros
from haulscope.model.params import MICROS

CUSTOMER = {"HYD": "MEDIVAULT", "DEL": "VISTAMART", "BLR": "SOUTHERN-FREIGHT", "BOM": "QUICKSHIP"}
MODE = {"HYD": "PHARMA_COLD_CHAIN", "DEL": "RETAIL_REPLENISHMENT", "BLR": "LTL", "BOM": "PARCEL"}


def _by_lane(values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for lane, value in values.items():
        out = F.when(F.col("lane") == lane, F.lit(value)).otherwise(out)
    return out


def _fill(template: str, **parts: Column) -> Column:
    """The template with each @name@ replaced by a column."""
    pieces: list[Column] = []
    for i, piece in enumerate(template.split("@")):
        pieces.append(parts[piece].cast("string") if i % 2 else F.lit(piece))
    return F.concat(*pieces)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = (
        fleet.events(spark, sf_dir)
        .groupBy("user_id")
        .agg(F.max(ntz_micros(F.col("ts"))).alias("us"))
        .withColumn(
            "last_us",
            (F.lit(fleet.EPOCH_S) + fleet.int_div(F.col("us") - fleet.SOURCE_US, 60 * MICROS)) * MICROS,
        )
        .select("user_id", "last_us")
    )
    df = fleet.shipments(spark, sf_dir).join(last, "user_id")
    n = F.col("user_id")
    # 0 undeclared key, 1 missing key, 2 pattern or enum, 3 range, 4 no contract on file
    fault = F.when(n % 9 == 4, F.pmod(fleet.int_div(n, 9), F.lit(5))).otherwise(-1)
    df = df.withColumn("fault", fault)
    is_fault = lambda k: F.col("fault") == k
    extra = F.when(is_fault(0), ',"surprise":1').otherwise("")
    closes = F.col("last_us") - (n % 5) * (20 * 60 * MICROS)
    hyd = _fill(
        '{"drugLicenceNo":"@licence@","temperature":{"minC":2,"maxC":@max@,"excursionToleranceMinutes":30},'
        '"consignment":{"batchNo":"MV@batch@","expiryDate":"2028-02-01","units":@units@,"controlledSubstance":false,'
        '"productName":"Vaccine"}@custody@@extra@}',
        licence=F.when(is_fault(2), "tg/28").otherwise("TG/28/2019"),
        max=F.when(is_fault(3), "99").otherwise("8"),
        batch=n + 240000,
        units=n % 7 * 120 + 400,
        custody=F.when(is_fault(1), "").otherwise(',"custody":[{"party":"Genome Valley","handedOverAt":"2026-08-31T22:00:00Z"}]'),
        extra=extra,
    )
    deliver = _fill(
        '{"dcCode":"@dc@","asnNumber":"ASN@asn@","purchaseOrders":[{"poNumber":"PO@po@","lineCount":@lines@,'
        '"valueInr":180000,"department":"Grocery"},{"poNumber":"PO@po2@","lineCount":4,"valueInr":60000.5}],'
        '"deliveryWindow":{"opensAt":"2026-09-01T00:00:00Z","closesAt":"@closes@","dockNumber":3}@pallets@,'
        '"temperatureControlled":false@extra@}',
        dc=F.when(is_fault(2), "DC-1").otherwise("DC-BHW-01"),
        asn=n + 880000,
        po=n + 50000000,
        po2=n + 50000001,
        lines=n % 40 + 12,
        closes=instant_text(closes),
        pallets=F.when(is_fault(1), "").otherwise(
            F.concat(F.lit(',"pallets":'), F.when(is_fault(3), F.lit(0).cast("bigint")).otherwise(n % 14 + 8).cast("string"))
        ),
        extra=extra,
    )
    ltl = _fill(
        '{"ewayBillNo":"@bill@","freightClass":"@class@","pieces":[{"description":"Components","weightKg":@kg@,'
        '"dimensionsCm":{"length":120,"width":80,"height":95},"hazmat":false}]@billto@,"accessorials":["LIFTGATE"]@extra@}',
        bill=n + 391000000000,
        **{"class": F.when(is_fault(2), "999").otherwise("85")},
        kg=F.when(is_fault(3), F.lit(0).cast("bigint")).otherwise(n % 9 * 15 + 210),
        billto=F.when(is_fault(1), "").otherwise(',"billTo":{"party":"Peenya Traders","gstin":"29AABCU9603R1ZX"}'),
        extra=extra,
    )
    parcel = _fill(
        '{"trackingNumber":"QS@track@IN","serviceLevel":"@level@","weightKg":@kg@@recipient@,"signatureRequired":true,'
        '"declaredValueInr":@value@,"codAmountInr":0@extra@}',
        track=n + 7000000000,
        level=F.when(is_fault(2), "EXPRESS").otherwise("STANDARD"),
        kg=F.when(is_fault(3), "50").otherwise("1.5"),
        recipient=F.when(is_fault(1), "").otherwise(',"recipient":{"name":"Consignee","pincode":"411001","phone":"9820000007"}'),
        value=n % 20 * 450 + 1500,
        extra=extra,
    )
    body = F.when(F.col("lane") == "HYD", hyd).when(F.col("lane") == "DEL", deliver).when(F.col("lane") == "BLR", ltl).otherwise(parcel)
    return df.select(
        "shipment_id",
        F.when(is_fault(4), "NOBODY").otherwise(_by_lane(CUSTOMER)).alias("customer_id"),
        _by_lane(MODE).alias("mode"),
        F.when(n % 23 != 5, "1").alias("schema_version"),
        ((F.lit(fleet.EPOCH_S) + n % 1000) * MICROS).alias("created_us"),
        F.when(n % 29 == 7, "[]").otherwise(body).alias("body"),
    )
