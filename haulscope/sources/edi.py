"""X12 214 shipment status interchanges, taken apart with array functions: no shuffle, no UDF.

An interchange is one row. Its text is split at '~' into segments, and the segments are cut at
every ST into transaction sets, which become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.functions.text import abbreviate, blank_to_null, safe_int
from haulscope.functions.timeparts import instant_text
from haulscope.sources import feeds

# AT7 status codes.
STATUS_CODES = {
    "X3": "ARRIVED_AT_STOP", "AF": "PICKED_UP", "X1": "ARRIVED_AT_STOP", "CD": "DEPARTED_STOP",
    "X4": "DELIVERED", "AG": "IN_TRANSIT", "SD": "DELAY_REPORTED",
}
# AT7 time zone codes, hours from UTC.
ZONE_HOURS = {"UT": 0, "GM": 0, "ED": -4, "ES": -5, "CD": -5, "CS": -6, "MD": -6, "MS": -7, "PD": -7, "PS": -8}
ENVELOPE_SET = 2_000_000_000


def _lookup(key: Column, table: dict, kind: str) -> Column:
    pairs = [F.lit(x) for entry in table.items() for x in entry]
    return F.try_element_at(F.create_map(*pairs), key).cast(kind)


def _element(segment: Column, position: int) -> Column:
    """Stripped element of a split segment, '' beyond its end; null for a missing segment."""
    return F.when(segment.isNotNull(), F.coalesce(F.trim(F.get(segment, F.lit(position))), F.lit("")))


def _tag(segment: Column) -> Column:
    return F.upper(F.get(segment, F.lit(0)))


def _last(segments: Column, tag: str) -> Column:
    found = F.filter(segments, lambda s: _tag(s) == tag)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def read_interchanges(spark: SparkSession, path: str, received_us: int) -> DataFrame:
    """Each file is one interchange message."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("message_id"),
        F.lit("EDI_214").alias("source"),
        F.lit("application/edi-x12").alias("content_type"),
        F.col("value").alias("body"),
        F.lit(received_us).cast("bigint").alias("received_us"),
    )


def segmented(messages: DataFrame) -> DataFrame:
    """Adds ``segs`` (array of split segments) and ``starts`` (positions of ST)."""
    texts = F.filter(
        F.transform(F.split("body", "~", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != ""
    )
    return messages.withColumn("segs", F.transform(texts, lambda s: F.split(s, r"\*", -1))).withColumn(
        "starts",
        F.filter(
            F.transform("segs", lambda s, i: F.when(_tag(s) == "ST", i)), lambda i: i.isNotNull()
        ),
    )


def _sets(segs: Column, starts: Column) -> Column:
    """array<struct<set_no, cut_by_next, body: segments from ST up to the next ST>>."""
    return F.transform(
        starts,
        lambda at, n: F.struct(
            (n + 1).alias("set_no"),
            (n + 1 < F.size(starts)).alias("cut_by_next"),
            F.slice(segs, at + 1, F.coalesce(F.get(starts, n + 1), F.size(segs)) - at).alias("parts"),
        ),
    )


def _envelope_problem(segs: Column, sets_found: Column) -> Column:
    ge = _last(segs, "GE")
    declared = safe_int(_element(ge, 1))
    # The texts of rejections in this module.
    return (
        F.when(~F.exists(segs, lambda s: _tag(s) == "GS"), "no GS functional group header")
        .when(ge.isNull(), "interchange truncated: no GE footer")
        .when(
            (declared > 0) & (declared != sets_found),
            F.format_string("GE declares %d transaction sets, found %d", declared, sets_found),
        )
        .when(~F.exists(segs, lambda s: _tag(s) == "IEA"), "interchange truncated: no IEA footer")
    )


def shipment_statuses(messages: DataFrame) -> DataFrame:
    """Candidate events: one per transaction set, plus one rejected row per interchange-level problem."""
    df = segmented(messages)
    first_tag = _tag(F.get("segs", F.lit(0)))
    no_interchange = (
        F.when(F.size("segs") == 0, "no X12 segments")
        .when(first_tag != "ISA", F.concat(F.lit("expected an ISA header, found "), abbreviate(first_tag)))
    )
    df = df.withColumn("_bad", no_interchange)
    envelope = _envelope_problem(F.col("segs"), F.size("starts"))
    whole = (
        F.when(F.col("_bad").isNotNull(), F.struct(F.lit(feeds.MALFORMED).alias("r"), F.col("_bad").alias("d")))
        .when(envelope.isNotNull(), F.struct(F.lit(feeds.MALFORMED).alias("r"), envelope.alias("d")))
        .when(
            F.size("starts") == 0,
            F.struct(F.lit(feeds.MISSING).alias("r"), F.lit("interchange contains no transaction sets").alias("d")),
        )
    )
    none = F.lit(None).cast("string")
    blank_set = F.struct(
        F.lit(ENVELOPE_SET).alias("set_no"),
        F.lit(False).alias("cut_by_next"),
        F.array().cast("array<array<string>>").alias("parts"),
        F.col("_whole.r").alias("whole_reason"),
        F.col("_whole.d").alias("whole_detail"),
    )
    per_set = F.transform(
        _sets(F.col("segs"), F.col("starts")),
        lambda s: F.struct(
            s["set_no"].alias("set_no"),
            s["cut_by_next"].alias("cut_by_next"),
            s["parts"].alias("parts"),
            none.alias("whole_reason"),
            none.alias("whole_detail"),
        ),
    )
    rows = F.concat(
        F.when(F.col("_bad").isNull(), per_set).otherwise(F.array().cast(_SET_TYPE)),
        F.when(F.col("_whole").isNotNull(), F.array(blank_set)).otherwise(F.array().cast(_SET_TYPE)),
    )
    df = df.withColumn("_whole", whole).select(*feeds.MESSAGE, F.inline(rows))
    return _statuses(df)


_SET_TYPE = (
    "array<struct<set_no:int,cut_by_next:boolean,parts:array<array<string>>,whole_reason:string,whole_detail:string>>"
)


def _statuses(df: DataFrame) -> DataFrame:
    ends = F.filter(F.transform("parts", lambda s, i: F.when(_tag(s) == "SE", i)), lambda i: i.isNotNull())
    df = df.withColumn("_end", F.get(ends, F.lit(0)))
    df = df.withColumns(
        {
            "st": F.get("parts", F.lit(0)),
            "se": F.get("parts", F.col("_end")),
            "_inner": F.when(F.col("_end").isNotNull(), F.slice("parts", F.lit(1), F.col("_end"))).otherwise(F.col("parts")),
        }
    ).withColumns({"b10": _last(F.col("_inner"), "B10"), "at7": _last(F.col("_inner"), "AT7"), "ms1": _last(F.col("_inner"), "MS1")})
    control, declared, actual = _element(F.col("st"), 2), safe_int(_element(F.col("se"), 1)), F.col("_end") + 1
    shipment, code = _element(F.col("b10"), 2), F.upper(_element(F.col("at7"), 1))
    date, clock, zone = (_element(F.col("at7"), i) for i in (5, 6, 7))
    status = _lookup(code, STATUS_CODES, "string")
    zone_code = F.when(zone == "", "UT").otherwise(F.upper(zone))
    hours = _lookup(zone_code, ZONE_HOURS, "int")
    digits = date.rlike(r"^\d{8}$") & clock.rlike(r"^\d{4}")
    local = F.when(digits, F.try_to_timestamp(F.concat(date, clock.substr(1, 4)), F.lit("yyyyMMddHHmm")))
    us = F.unix_micros(local) - hours.cast("bigint") * 3_600_000_000
    checks: list[tuple[Column, Column, Column]] = [
        (F.col("whole_reason").isNotNull(), F.col("whole_reason"), F.col("whole_detail")),
        (
            _element(F.col("st"), 1) != "214",
            F.lit(feeds.UNSUPPORTED),
            F.concat(F.lit("expected transaction set 214, found "), _element(F.col("st"), 1)),
        ),
        (F.col("_end").isNull() & F.col("cut_by_next"), F.lit(feeds.MALFORMED), F.lit("no SE terminator")),
        (F.col("_end").isNull(), F.lit(feeds.MALFORMED), F.lit("truncated before SE terminator")),
        (
            control != _element(F.col("se"), 2),
            F.lit(feeds.MALFORMED),
            F.format_string("SE control number %s does not match ST %s", _element(F.col("se"), 2), control),
        ),
        (
            (declared > 0) & (declared != actual),
            F.lit(feeds.MALFORMED),
            F.format_string("SE declares %d segments, found %d", declared, actual),
        ),
        (F.col("b10").isNull(), F.lit(feeds.MISSING), F.lit("no B10 segment, so no shipment id")),
        (shipment == "", F.lit(feeds.MISSING), F.lit("B10 carries no shipment id")),
        (F.col("at7").isNull(), F.lit(feeds.MISSING), F.lit("no AT7 segment, so no status or time")),
        (
            status.isNull(),
            F.lit(feeds.INVALID),
            F.concat(F.lit("unknown shipment status code "), _element(F.col("at7"), 1)),
        ),
        ((date == "") | (clock == ""), F.lit(feeds.INVALID), F.lit("AT7 carries no event date or time")),
        (hours.isNull(), F.lit(feeds.INVALID), F.concat(F.lit("unusable AT7 time zone code "), zone)),
        (us.isNull(), F.lit(feeds.INVALID), F.format_string("unreadable AT7 date/time %s %s", date, clock)),
    ]
    reason = detail = F.lit(None).cast("string")
    for condition, why, what in reversed(checks):
        reason = F.when(condition, why).otherwise(reason)
        detail = F.when(condition, what).otherwise(detail)
    why_not = _element(F.col("at7"), 2)
    return feeds.candidates(
        df,
        {
            "set_no": F.col("set_no"),
            "key_kind": F.lit("shipment"),
            "key": shipment,
            "at_us": us,
            "early_reason": reason,
            "early_detail": detail,
            "unresolved_detail": F.concat(F.lit("no vehicle assigned to shipment "), shipment),
            "type": F.lit("status"),
            "reporter": shipment,
            "discriminator": code,
            "occurred_text": instant_text(us),
            "status": status,
            "reason_code": F.when((why_not != "") & (F.upper(why_not) != "NS"), why_not),
            "city": blank_to_null(_element(F.col("ms1"), 1)),
            "state": blank_to_null(_element(F.col("ms1"), 2)),
            "country": blank_to_null(_element(F.col("ms1"), 3)),
        },
    )
