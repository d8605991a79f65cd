"""Small text and number helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Severities in rising order.
SEVERITIES = ("INFO", "WARNING", "CRITICAL")


def severity_rank(severity: Column) -> Column:
    """Position in the rising order; unknown or missing ranks below all."""
    rank = F.lit(-1)
    for position, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, F.lit(position)).otherwise(rank)
    return rank


def severity_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank)


def blank_to_null(value: Column) -> Column:
    stripped = F.trim(value)
    return F.when(stripped != "", stripped)


def round_half_up(value: Column, places: int) -> Column:
    """floor(x * 10^p + 0.5) / 10^p, so ties go up for negatives too."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5).cast("double") / scale


def lane_code(shipment_id: Column) -> Column:
    """Middle part of SHP-<CODE>-<number>; null when the id has another shape."""
    code = F.regexp_extract(shipment_id, r"^SHP-(.+)-[^-]*$", 1)
    return F.when(code != "", code)


def safe_int(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(0))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def abbreviate(text: Column, limit: int = 40) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))


# Units that a key's name ends in, first match first.
UNIT_SUFFIXES = (("(?i)inr$", "INR"), ("(?i)kg$", "kg"), ("(?i)cm$", "cm"), ("[a-z0-9]C$", "°C"), ("(?i)minutes$", "min"), ("(?i)hours$", "h"))


def unit_of_key(key: Column, parent: Column) -> Column:
    """Unit that a key names by its ending, or else the key around it; null where neither does."""
    unit = F.lit(None).cast("string")
    for name in (parent, key):
        for pattern, word in reversed(UNIT_SUFFIXES):
            unit = F.when(name.rlike(pattern), word).otherwise(unit)
    return unit
