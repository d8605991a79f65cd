"""Raw feed messages written from the fleet fixes: event_id % 4 picks the feed, some are broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.fixtures import fleet
from haulscope.functions.timeparts import int_div, instant_text
from haulscope.model.params import MICROS



def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _json_messages(fixes: DataFrame) -> DataFrame:
    e = F.col("event_id")
    at = instant_text(F.col("occurred_us"))
    vehicle = F.when(e % 31 == 0, F.lit("")).otherwise(_cat('"vehicle":{"id":"', F.col("vehicle_id"), '","make":"Tata"},'))
    unit = F.get(F.array(*[F.lit(u) for u in ("mi", "km", "Miles ", "furlong")]), (e % 5).cast("int"))
    odometer = F.when(e % 5 == 4, F.lit("")).otherwise(_cat('"odometer":{"value":', e * 1.5, ',"unit":"', unit, '"},'))
    fix_time = F.when(e % 13 == 0, F.lit("")).otherwise(_cat(',"fixTime":"', at, '"'))
    lat = F.when(e % 59 == 0, F.lit(95.0)).otherwise(F.col("lat"))
    hdop = F.coalesce(_cat(',"hdop":', F.col("accuracy_m") / 5.0), F.lit(""))
    telematics = _cat(
        '{"deviceId":"', F.col("tracker_id"), '",', vehicle, '"gps":{"lat":', lat, ',"lon":', F.col("lon"), ',"speedMph":',
        F.col("speed_kph") / 1.609344, ',"headingDeg":', (e % 720 - 180).cast("double"), hdop, fix_time, "},", odometer,
        '"sentAt":"', instant_text(F.col("received_us")), '","schemaVersion":"2.3"}',
    )
    word = F.get(F.array(*[F.lit(w) for w in ("ping", "ARRIVE", "depart", "delivered", "", "teleport")]), (int_div(e, 4) % 6).cast("int"))
    sid = F.when(e % 31 == 0, F.lit("")).otherwise(_cat('"sid":"', F.col("shipment_id"), '",'))
    acc = F.coalesce(_cat(',"acc":', F.col("accuracy_m")), F.lit(""))
    mobile = _cat(
        "{", sid, '"ts":', int_div(F.col("occurred_us"), 1000), ',"lat":', lat, ',"lng":', F.col("lon"), acc, ',"spd":',
        F.col("speed_kph") / 3.6, ',"hdg":', e % 720 - 180, ',"evt":"', word, '","stop":"stop-', e % 9, '","seq":', e, ',"app":"3.4.1"}',
    )
    reading = F.when(e % 3 == 0, F.concat(F.substring(at, 1, 19), F.lit(".123456789Z"))).otherwise(at)
    temp = F.when(e % 59 == 0, F.lit(77.0)).otherwise(F.coalesce("temp_c", F.lit(5.0)))
    temp_part = F.when(e % 31 == 0, F.lit("")).otherwise(_cat(',"tempC":', temp))
    alarm = F.when(e % 17 == 0, F.lit(',"alarm":"DOOR_OPEN"')).otherwise("")
    reefer = _cat(
        '{"probe":"', F.col("probe_id"), '","model":"CX7","readingUtc":"', reading, '"', temp_part, ',"setpointC":4.0', alarm, ',"door":"SHUT"}'
    )
    body = F.when(e % 4 == 0, telematics).when(e % 4 == 1, mobile).otherwise(reefer)
    body = F.when(e % 41 == 0, F.substring(body, F.lit(1), int_div(F.length(body).cast("bigint"), 2).cast("int"))).when(
        e % 43 == 0, F.lit("<html><body>502 Bad Gateway</body></html>")
    ).otherwise(body)
    source = F.get(F.array(F.lit("TELEMATICS"), F.lit("MOBILE_APP"), F.lit("REEFER_SENSOR")), (e % 4).cast("int"))
    return fixes.where(e % 4 != 3).select(
        _cat("m-", e).alias("message_id"),
        source.alias("source"),
        F.lit("application/json").alias("content_type"),
        body.alias("body"),
        "received_us",
    )


def _interchanges(fixes: DataFrame) -> DataFrame:
    """Ten or fewer shipment statuses per interchange: those of 40 consecutive event ids."""
    e = F.col("event_id")
    number = int_div(e, 40)
    position = int_div(e % 40, 4) + 1
    kind = number % 8
    control = F.lpad(position.cast("string"), 4, "0")
    code = F.get(F.array(*[F.lit(c) for c in ("X3", "AF", "X1", "CD", "X4", "AG", "SD", "ZZ")]), (int_div(e, 4) % 8).cast("int"))
    zone = F.get(F.array(F.lit("UT"), F.lit("ES"), F.lit("")), (e % 3).cast("int"))
    local = F.timestamp_micros(F.col("occurred_us") - F.when(zone == "ES", 5 * 3600 * MICROS).otherwise(0))
    why = F.when(e % 6 == 0, "A1").otherwise("NS")
    place = F.when(e % 5 == 0, F.lit("")).otherwise(
        _cat("MS1*BENGALURU*", F.when(e % 59 == 0, "KARNATAKA").otherwise("KA"), "*IN~\n")
    )
    segments = F.when(e % 5 == 0, 5).otherwise(6)
    trailer = F.when((kind == 4) & (position == 10), F.lit("")).otherwise(
        _cat("SE*", segments, "*", F.when((kind == 3) & (position == 1), "9999").otherwise(control), "~\n")
    )
    text = _cat(
        "ST*214*", control, "~\nB10*", e, "*", F.col("shipment_id"), "*CARR~\nLX*1~\nAT7*", code, "*", why, "***",
        F.date_format(local, "yyyyMMdd"), "*", F.date_format(local, "HHmm"), "*", zone, "~\n", place, trailer,
    )
    grouped = (
        fixes.where(e % 4 == 3)
        .select(number.alias("number"), e.alias("event_id"), text.alias("text"), "received_us")
        .groupBy("number")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "text"))), lambda s: s["text"]), "").alias("sets"),
            F.count(F.lit(1)).alias("n"),
            F.max("received_us").alias("received_us"),
        )
    )
    kind = F.col("number") % 8
    body = _cat(
        "ISA*00*          *00*          *02*CARRIER01      *ZZ*RECEIVER01     *260903*2048*U*00401*", F.col("number"),
        "*0*P*>~\nGS*QM*CARRIER01*RECEIVER01*20260903*2048*101*X*004010~\n", F.col("sets"), "GE*",
        F.when(kind == 1, F.col("n") + 1).otherwise(F.col("n")), "*101~\n",
        F.when(kind == 0, F.lit("")).otherwise(_cat("IEA*1*", F.col("number"), "~\n")),
    )
    return grouped.select(
        _cat("x-", F.col("number")).alias("message_id"),
        F.lit("EDI_214").alias("source"),
        F.lit("application/edi-x12").alias("content_type"),
        F.when(kind == 2, "<html>no*edi</html>").otherwise(body).alias("body"),
        "received_us",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = fleet.fleet_fixes(spark, sf_dir)
    return _json_messages(fixes).unionByName(_interchanges(fixes))
