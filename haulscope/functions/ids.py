"""Name-based (MD5, version 3) identifiers over facts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from haulscope.functions.timeparts import instant_text


def uuid3(*parts: Column) -> Column:
    """UUID of the parts joined by '|'; a null part counts as the empty string."""
    name = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    text = lambda h: F.concat_ws(
        "-",
        h.substr(1, 8),
        h.substr(9, 4),
        F.concat(F.lit("3"), h.substr(14, 3)),
        F.concat(F.translate(h.substr(17, 1), "0123456789abcdef", "89ab" * 4), h.substr(18, 3)),
        h.substr(21, 12),
    )
    # bound once: the name may be a large expression
    return F.get(F.transform(F.array(F.md5(name.cast("binary"))), text), F.lit(0))


def source_event_id(source: Column, reporter: Column, instant: Column, discriminator: Column) -> Column:
    return uuid3(source, reporter, instant, discriminator)


def arrival_id(shipment: Column, stop: Column, at_us: Column) -> Column:
    return uuid3(F.lit("ARRIVED"), shipment, stop, instant_text(at_us))


def departure_id(shipment: Column, stop: Column, at_us: Column) -> Column:
    return uuid3(F.lit("DEPARTED"), shipment, stop, instant_text(at_us))


def estimate_id(shipment: Column, stop: Column, caused_by: Column) -> Column:
    return uuid3(F.lit("ETA"), shipment, stop, caused_by)


def incident_id(kind: Column, shipment: Column, stop: Column, onset_us: Column) -> Column:
    return uuid3(F.lit("INCIDENT"), kind, shipment, stop, instant_text(onset_us))


def raised_id(incident: Column) -> Column:
    return uuid3(F.lit("RAISED"), incident)


def cleared_id(incident: Column) -> Column:
    return uuid3(F.lit("CLEARED"), incident)
