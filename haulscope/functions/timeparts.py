"""Instants as epoch micros (bigint) and their text forms. The session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from haulscope.model.params import MICROS

HOUR_US = 3600 * MICROS


def instant_text(us: Column) -> Column:
    """ISO-8601 text with 0, 3 or 6 fraction digits, whichever is the shortest exact one."""
    full = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.regexp_replace(full, r"(\.000000|000)Z$", "Z")


def canonical_instant(text: Column) -> Column:
    """The same shortest form for source text that may carry up to nine fraction digits.

    Identifiers hash this text, so the nanoseconds a Spark timestamp would drop must survive in it.
    """
    whole = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.\d{1,9})?Z$", 1)
    digits = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})Z$", 1), 9, "0")
    tail = (
        F.when(digits == "000000000", F.lit("Z"))
        .when(digits.endswith("000000"), F.concat(F.lit("."), digits.substr(1, 3), F.lit("Z")))
        .when(digits.endswith("000"), F.concat(F.lit("."), digits.substr(1, 6), F.lit("Z")))
        .otherwise(F.concat(F.lit("."), digits, F.lit("Z")))
    )
    return F.when(whole == "", instant_text(instant_us(text))).otherwise(F.concat(whole, tail))


def instant_us(text: Column) -> Column:
    """Epoch micros of ISO-8601 text, null when it is not an instant (date, time and zone)."""
    instant = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})$")
    micros = F.regexp_replace(text, r"(\.\d{6})\d{1,3}", "$1")
    return F.when(instant, F.unix_micros(F.try_to_timestamp(micros)))


def hour_start_us(us: Column) -> Column:
    return us - F.pmod(us, F.lit(HOUR_US))


def day_text(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def hour_text(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "HH")


def whole_minutes(us: Column) -> Column:
    return int_div(us, 60 * MICROS)


def int_div(a: Column, b: int) -> Column:
    """Integer division of a bigint (towards zero)."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def ntz_micros(ts: Column) -> Column:
    """Epoch micros of a zone-less timestamp read as UTC (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))
