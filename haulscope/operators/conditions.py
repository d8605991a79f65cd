"""Service rules: conditions that must hold for a while, late arrivals, silence; all yield incidents.

Every rule returns the same incident columns, see ``COLUMNS``. One incident covers the time from the
first breach (onset) to the first recovery; it exists once the breach has been held long enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haulscope.functions import ids
from haulscope.functions.text import severity_of_rank, severity_rank
from haulscope.functions.timeparts import int_div, instant_text, whole_minutes
from haulscope.model.params import DEFAULT, MICROS, Params
from haulscope.operators import positions, slices
from haulscope.operators.slices import SLICE

SHIP = ["shipment_id"]
COLUMNS = (
    "exception_id", "type", "shipment_id", "stop_id", "severity", "state", "onset_us", "raised_us", "last_seen_us",
    "cleared_us", "open_s", "restated", "raised_by", "cleared_by", "raised_detail", "detail", "raised_value",
    "observed_value", "threshold_value", "worst", "resolution",
)


def finish(df: DataFrame, kind: str | Column) -> DataFrame:
    """Identifiers, state and how long the incident was open, for rows that carry the other columns."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    onset, cleared = F.col("onset_us"), F.col("cleared_us")
    open_s = F.when(cleared.isNotNull(), F.greatest(F.lit(0).cast("bigint"), int_div(cleared - onset, MICROS)))
    return (
        df.withColumn("type", kind)
        .withColumn("exception_id", ids.incident_id(F.col("type"), F.col("shipment_id"), F.col("stop_id"), onset))
        .withColumn("state", F.when(cleared.isNull(), "OPEN").otherwise("CLEARED"))
        .withColumn("open_s", open_s)
        .select(*COLUMNS)
    )


def sustained(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Runs of breach rows, one row each, once held for ``hold_us``.

    ``df`` (one row per instant, with slice) carries breach (null = unusable row, skipped), hold_us,
    excess (what "worst" is the maximum of), observed, threshold, severity and recovery (the word a
    clearing row clears with).
    """
    labelled = df.withColumn(
        "label", F.when(F.col("breach"), F.lit("breach")).when(~F.col("breach"), F.lit("ok"))
    )
    runs = slices.label_runs(labelled, SHIP, "occurred_us", "label", "ok")
    usable = F.col("label").isNotNull()
    breaching = usable & (F.col("side") == "breach")
    clearing = usable & (F.col("side") == "ok") & (F.col("prev_side") == "breach")
    rows = runs.where(breaching | clearing).withColumns(
        {
            "_clearing": F.col("side") == "ok",
            "onset_us": F.when(F.col("side") == "ok", F.col("prev_run_start")).otherwise(F.col("run_start")),
        }
    )
    held = F.col("occurred_us") - F.col("onset_us")
    proven = ~F.col("_clearing") & (held >= F.col("hold_us"))
    fact = F.struct("occurred_us", "event_id", "excess", "observed", "threshold", "severity", held.alias("held"))
    start = F.struct("occurred_us", *[c for c in ("start_value",) if c in df.columns])
    return (
        rows.groupBy("shipment_id", "onset_us")
        .agg(
            F.min(F.when(proven, fact)).alias("first"),
            F.max(F.when(proven, fact)).alias("last"),
            F.max(F.when(~F.col("_clearing") & ~proven, F.col("excess"))).alias("early_worst"),
            F.max(F.when(~F.col("_clearing"), F.col("excess"))).alias("worst"),
            F.count_if(proven).alias("findings"),
            F.min(F.when(F.col("_clearing"), F.struct("occurred_us", "event_id", "recovery"))).alias("end"),
            F.min(start).alias("start"),
        )
        .where("first IS NOT NULL")
        .withColumn("raise_worst", F.greatest(F.col("early_worst"), F.col("first.excess")))
    )


def _incidents(runs: DataFrame, kind: str, detail) -> DataFrame:
    return finish(
        runs.select(
            "shipment_id",
            F.lit(None).cast("string").alias("stop_id"),
            F.col("first.severity").alias("severity"),
            "onset_us",
            F.col("first.occurred_us").alias("raised_us"),
            F.col("last.occurred_us").alias("last_seen_us"),
            F.col("end.occurred_us").alias("cleared_us"),
            (F.col("findings") - 1).alias("restated"),
            F.col("first.event_id").cast("string").alias("raised_by"),
            F.col("end.event_id").cast("string").alias("cleared_by"),
            detail(F.col("first"), F.col("raise_worst")).alias("raised_detail"),
            detail(F.col("last"), F.col("worst")).alias("detail"),
            F.col("first.observed").alias("raised_value"),
            F.col("last.observed").alias("observed_value"),
            F.col("first.threshold").alias("threshold_value"),
            "worst",
            F.col("end.recovery").alias("resolution"),
        ),
        kind,
    )


def with_terms(track: DataFrame, terms: DataFrame) -> DataFrame:
    """Attach the shipment's service terms. Joined per (shipment, slice), so a hot shipment stays spread."""
    return track.join(slices.spread(terms, track, SHIP), [*SHIP, SLICE], "left")


def band_of(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Adds the band a reading is judged by (low, high, agreed), its deviation and how far it is outside."""
    agreed = F.col("min_c").isNotNull() & F.col("max_c").isNotNull()
    low = F.when(agreed, F.col("min_c")).otherwise(F.col("setpoint_c") - params.setpoint_tolerance_c)
    high = F.when(agreed, F.col("max_c")).otherwise(F.col("setpoint_c") + params.setpoint_tolerance_c)
    c = F.col("temp_c")
    return df.withColumns({"low": low, "high": high, "agreed": agreed}).withColumns(
        {
            "deviation": c - F.col("setpoint_c"),
            "breach": ~c.between(F.col("low"), F.col("high")),
            "excess": F.greatest(c - F.col("high"), F.col("low") - c, F.lit(0.0)),
            "threshold": F.when(c > F.col("high"), F.col("high")).when(c < F.col("low"), F.col("low")),
        }
    )


def judged_readings(readings: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Readings that carry min_c, max_c and tolerance_s of their terms, with what ``sustained`` needs."""
    hold = F.when(F.col("agreed"), F.coalesce("tolerance_s", F.lit(params.excursion_seconds))).otherwise(F.lit(params.excursion_seconds))
    return band_of(readings, params).withColumns(
        {
            "hold_us": hold.cast("bigint") * MICROS,
            "observed": F.col("temp_c"),
            "severity": F.when(F.col("agreed"), "CRITICAL").otherwise("WARNING"),
            "recovery": F.lit("RECOVERED"),
            "start_value": band_text(),
        }
    )


# The sentences of incidents. A fact is a breach (excess, observed, severity, held); worst is the worst so far.


def band_text() -> Column:
    """What a reading is held against, on a row of ``judged_readings``."""
    band = F.format_string("the agreed %.1f to %.1fC band", F.col("min_c"), F.col("max_c"))
    return F.when(F.col("agreed"), band).otherwise("its reported setpoint")


def excursion_text(fact: Column, worst: Column, against: Column) -> Column:
    return F.concat(
        F.format_string("%.1fC is outside ", fact["observed"]),
        against,
        F.format_string(", peaking at %.1fC outside it, and has been for %d minutes", worst, whole_minutes(fact["held"])),
    )


def rest_text(fact: Column) -> Column:
    where = F.when(F.isnan(fact["excess"]), "with no scheduled stops on file").otherwise(
        F.format_string("%.0f km from the nearest scheduled stop", fact["excess"])
    )
    cargo = F.when(fact["severity"] == "CRITICAL", " The load is temperature-controlled.").otherwise("")
    return F.concat(F.format_string("Stationary for %d minutes ", whole_minutes(fact["held"])), where, F.lit("."), cargo)


def deviation_text(fact: Column, worst: Column) -> Column:
    peak = F.when(worst <= fact["excess"], "").otherwise(F.format_string(", having reached %.0f km", worst))
    off = F.format_string("%.0f km off the planned route for %d minutes", fact["excess"], whole_minutes(fact["held"]))
    return F.concat(off, peak, F.lit("."))


def lateness_text(late_us: Column, arrived: Column) -> Column:
    """On a row that carries closes_us, remaining_km and confidence."""
    minutes = whole_minutes(late_us)
    projected = F.concat(
        F.format_string("Projected to arrive %d minutes after the delivery window closes at %s", minutes, instant_text(F.col("closes_us"))),
        F.coalesce(F.format_string(", %.0f km still to run", F.col("remaining_km")), F.lit("")),
        F.coalesce(F.format_string(" (confidence %.0f%%)", F.col("confidence") * 100), F.lit("")),
        F.lit("."),
    )
    return F.when(arrived, F.format_string("Arrived %d minutes after the delivery window closed.", minutes)).otherwise(projected)


def silence_text(quiet_us: Column, since_us: Column) -> Column:
    return F.format_string("No events of any kind for %d minutes; last heard from at %s.", whole_minutes(quiet_us), instant_text(since_us))


def temperature_excursions(readings: DataFrame, terms: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Readings outside the agreed band, or outside setpoint +- tolerance where no band was agreed."""
    df = judged_readings(with_terms(readings, terms.select("shipment_id", "min_c", "max_c", "tolerance_s")), params)

    detail = lambda fact, worst: excursion_text(fact, worst, F.col("start.start_value"))
    return _incidents(sustained(df, params), "TEMPERATURE_EXCURSION", detail)


def judged_rests(track: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Fixes that carry the stops of their plan, with breach (still, away from every stop), excess and recovery."""
    distances = positions.stop_distances(F.col("lat"), F.col("lon"), F.col("stops"))
    df = track.withColumn("_d", distances)
    expected = F.coalesce(F.exists("_d", lambda d: d["meters"] <= d["radius_m"] * params.stop_margin_ratio), F.lit(False))
    nearest_km = F.coalesce(F.array_min(F.transform("_d", lambda d: d["meters"])), F.lit(float("nan"))) / 1000.0
    usable = F.col("speed_kph").isNotNull() & F.coalesce(F.col("accuracy_m") <= params.rule_accuracy_m, F.lit(True))
    moving = F.col("speed_kph") >= params.moving_kph
    return df.withColumns(
        {
            "breach": F.when(usable, ~moving & ~expected),
            "excess": nearest_km,
            "observed": F.lit(None).cast("double"),
            "threshold": F.lit(float(params.unplanned_stop_seconds // 60)),
            "hold_us": F.lit(params.unplanned_stop_seconds * MICROS).cast("bigint"),
            "recovery": F.when(moving, "RESUMED").otherwise("RECOVERED"),
        }
    ).drop("_d")


def cargo_severity() -> Column:
    """On a row that carries cold_chain."""
    return F.when(F.col("cold_chain"), "CRITICAL").otherwise("WARNING")


def unplanned_stops(track: DataFrame, plans: DataFrame, terms: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Standing still away from every planned stop."""
    df = judged_rests(positions.with_plan(track, plans), params).select(
        "shipment_id", SLICE, "occurred_us", "event_id", "breach", "excess", "observed", "threshold", "hold_us", "recovery"
    )
    df = with_terms(df, terms.select("shipment_id", "cold_chain")).withColumn("severity", cargo_severity())

    minutes = lambda fact: whole_minutes(F.col(f"{fact}.held")).cast("double")
    runs = sustained(df, params)
    out = _incidents(
        runs.withColumn("first", F.col("first").withField("observed", minutes("first"))).withColumn(
            "last", F.col("last").withField("observed", minutes("last"))
        ),
        "UNPLANNED_STOP",
        lambda fact, worst: rest_text(fact),
    )
    return out


def judged_courses(track: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Fixes that carry the legs of their plan, with what ``sustained`` needs."""
    usable = F.coalesce(F.col("accuracy_m") <= params.rule_accuracy_m, F.lit(True))
    km = positions.off_plan_km(F.col("lat"), F.col("lon"), F.col("legs"))
    return track.withColumn("excess", km).withColumns(
        {
            "breach": F.when(usable, F.col("excess") > params.corridor_km),
            "observed": F.col("excess"),
            "threshold": F.lit(params.corridor_km),
            "hold_us": F.lit(params.deviation_seconds * MICROS).cast("bigint"),
            "severity": F.lit("WARNING"),
            "recovery": F.lit("BACK_ON_ROUTE"),
        }
    )


def route_deviations(track: DataFrame, plans: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Too far from every leg of the plan for too long."""
    columns = ("shipment_id", SLICE, "occurred_us", "event_id", "breach", "excess", "observed", "threshold", "hold_us", "severity", "recovery")
    df = judged_courses(positions.with_plan(track, plans), params).select(*columns)
    return _incidents(sustained(df, params), "ROUTE_DEVIATION", deviation_text)


def late_arrivals(
    estimates: DataFrame, arrivals: DataFrame, terms: DataFrame, final_stops: DataFrame, params: Params = DEFAULT
) -> DataFrame:
    """Projected past the delivery window plus grace, or arrived past it, at the final stop only.

    ``arrivals``: shipment_id, stop_id, occurred_us, event_id. Both inputs carry ``lane``.
    """
    due = terms.where("closes_us IS NOT NULL").select("shipment_id", "closes_us")
    projected = estimates.select(
        "shipment_id", "lane", "stop_id", "occurred_us", "event_id", "estimate_us", "remaining_km", "confidence",
        F.lit(False).alias("arrived"),
    )
    reached = arrivals.select(
        "shipment_id", "lane", "stop_id", "occurred_us", "event_id", F.col("occurred_us").alias("estimate_us"),
        F.lit(None).cast("double").alias("remaining_km"), F.lit(None).cast("double").alias("confidence"),
        F.lit(True).alias("arrived"),
    )
    at_final = projected.unionByName(reached).join(final_stops, ["lane", "stop_id"], "left_semi")
    rows = slices.bounded(at_final, SHIP, "occurred_us", params.slice_seconds, params.slice_rows)
    rows = rows.join(slices.spread(due, rows, SHIP), [*SHIP, SLICE])
    late_us = F.col("estimate_us") - F.col("closes_us")
    breach = ~F.col("arrived") & (late_us > params.late_grace_seconds * MICROS)
    rows = rows.withColumn("late_us", late_us).withColumn("label", F.when(breach, "breach").otherwise("ok"))
    runs = slices.label_runs(rows, SHIP, "occurred_us", "label", "ok")
    late = F.col("arrived") & (F.col("late_us") > 0)
    clearing = (F.col("side") == "ok") & (F.col("prev_side") == "breach")
    fresh = late & (F.col("prev_side") == "ok")  # arrives late with nothing open: raised and cleared at once
    onset = (
        F.when(F.col("side") == "breach", F.col("run_start"))
        .when(clearing, F.col("prev_run_start"))
        .otherwise(F.col("closes_us"))
    )
    resolution = F.when(~F.col("arrived"), "BACK_WITHIN_WINDOW").when(late, "ARRIVED_LATE").otherwise("ARRIVED_ON_TIME")
    minutes = whole_minutes(F.col("late_us"))
    finding = F.struct(
        "occurred_us",
        "event_id",
        minutes.cast("double").alias("observed"),
        lateness_text(F.col("late_us"), F.col("arrived")).alias("detail"),
        F.when(F.col("arrived"), 2).otherwise(1).alias("rank"),
        F.when(F.col("arrived"), 0.0).otherwise(float(params.late_grace_seconds // 60)).alias("threshold"),
    )
    found = (F.col("side") == "breach") | late
    grouped = (
        runs.where((F.col("side") == "breach") | clearing | fresh)
        .withColumn("onset_us", onset)
        .groupBy("shipment_id", "stop_id", "onset_us")
        .agg(
            F.min(F.when(found, finding)).alias("first"),
            F.max(F.when(found, finding)).alias("last"),
            F.count_if(found).alias("findings"),
            F.min(F.when(clearing | fresh, F.struct("occurred_us", "event_id", resolution.alias("resolution")))).alias("end"),
            F.max(F.when(found, F.when(F.col("arrived"), 2).otherwise(1))).alias("rank"),
        )
    )
    return finish(
        grouped.select(
            "shipment_id",
            "stop_id",
            severity_of_rank(F.col("rank")).alias("severity"),
            "onset_us",
            F.col("first.occurred_us").alias("raised_us"),
            F.col("last.occurred_us").alias("last_seen_us"),
            F.col("end.occurred_us").alias("cleared_us"),
            (F.col("findings") - 1).alias("restated"),
            F.col("first.event_id").alias("raised_by"),
            F.col("end.event_id").alias("cleared_by"),
            F.col("first.detail").alias("raised_detail"),
            F.col("last.detail").alias("detail"),
            F.col("first.observed").alias("raised_value"),
            F.col("last.observed").alias("observed_value"),
            F.col("first.threshold").alias("threshold_value"),
            F.lit(None).cast("double").alias("worst"),
            F.col("end.resolution").alias("resolution"),
        ),
        "LATE_ARRIVAL",
    )


def signal_loss(
    sightings: DataFrame, completions: DataFrame, terms: DataFrame, params: Params = DEFAULT
) -> DataFrame:
    """Gaps of silence in event time; the last one stays open unless the shipment is complete.

    ``sightings``: one row per (shipment, instant) with slice. ``completions``: shipment_id and the
    instant its final stop was reached; later rows are not watched. Silence is judged per shipment,
    so no global order is needed; only the newest instant of the whole fleet enters, as one number.
    """
    ends = completions.select("shipment_id", "completed_us")
    rows = sightings.select("shipment_id", SLICE, "occurred_us", "event_id")
    watched = rows.join(slices.spread(ends, rows, SHIP), [*SHIP, SLICE], "left").where(
        F.col("completed_us").isNull() | (F.col("occurred_us") <= F.col("completed_us"))
    )
    threshold = params.silence_seconds * MICROS
    over = F.col("occurred_us") == F.col("completed_us")
    gaps = (
        slices.previous(watched, SHIP, "occurred_us", {"onset_us": "occurred_us", "raised_by": "event_id"})
        .where(F.col("occurred_us") - F.col("onset_us") >= threshold)
        .select(
            "shipment_id",
            "onset_us",
            F.col("occurred_us").alias("cleared_us"),
            F.col("raised_by").cast("string").alias("raised_by"),
            F.col("event_id").cast("string").alias("cleared_by"),
            F.when(over, "SHIPMENT_COMPLETED").otherwise("REPORTING_AGAIN").alias("resolution"),
            (F.col("occurred_us") - F.col("onset_us")).alias("quiet_us"),
        )
    )
    newest = rows.agg(F.max("occurred_us").alias("fleet_us")).scalar()
    tails = (
        rows.groupBy("shipment_id")
        .agg(F.max(F.struct("occurred_us", "event_id")).alias("l"))
        .join(ends, "shipment_id", "left_anti")
        .withColumn("fleet_us", newest)
        .where(F.col("fleet_us") - F.col("l.occurred_us") >= threshold)
        .select(
            "shipment_id",
            F.col("l.occurred_us").alias("onset_us"),
            F.lit(None).cast("bigint").alias("cleared_us"),
            F.col("l.event_id").cast("string").alias("raised_by"),
            F.lit(None).cast("string").alias("cleared_by"),
            F.lit(None).cast("string").alias("resolution"),
            (F.col("fleet_us") - F.col("l.occurred_us")).alias("quiet_us"),
        )
    )
    found = gaps.unionByName(tails).join(terms.select("shipment_id", "cold_chain"), "shipment_id", "left")
    text = silence_text(F.col("quiet_us"), F.col("onset_us"))
    return finish(
        found.select(
            "shipment_id",
            F.lit(None).cast("string").alias("stop_id"),
            F.when(F.col("cold_chain"), "CRITICAL").otherwise("WARNING").alias("severity"),
            "onset_us",
            (F.col("onset_us") + threshold).alias("raised_us"),
            (F.col("onset_us") + threshold).alias("last_seen_us"),
            "cleared_us",
            F.lit(0).cast("bigint").alias("restated"),
            "raised_by",
            "cleared_by",
            text.alias("raised_detail"),
            text.alias("detail"),
            F.lit(None).cast("double").alias("raised_value"),
            F.lit(None).cast("double").alias("observed_value"),
            F.lit(None).cast("double").alias("threshold_value"),
            F.lit(None).cast("double").alias("worst"),
            "resolution",
        ),
        "SIGNAL_LOSS",
    )


def sightings(*kinds: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Events of every kind as "heard from": one row per shipment and instant, the lowest id of each.

    Each input has shipment_id, occurred_us and event_id. Aggregated before any window, so repeats
    of one instant shrink map-side.
    """
    rows = None
    for df in kinds:
        part = df.select("shipment_id", "occurred_us", F.col("event_id").cast("string").alias("event_id"))
        rows = part if rows is None else rows.unionByName(part)
    sliced = slices.bounded(rows, SHIP, "occurred_us", params.slice_seconds, params.slice_rows)
    return sliced.groupBy("shipment_id", SLICE, "occurred_us").agg(F.min("event_id").alias("event_id"))


def incident_events(incidents: DataFrame) -> DataFrame:
    """exception.raised and exception.cleared events of an incident table."""
    raised = F.struct(
        F.lit("exception.raised").alias("event_type"),
        ids.raised_id(F.col("exception_id")).alias("event_id"),
        F.col("onset_us").alias("occurred_us"),
        F.col("raised_by").alias("caused_by"),
        F.col("raised_detail").alias("detail"),
        F.col("raised_value").alias("observed_value"),
        F.col("threshold_value").alias("threshold_value"),
        F.lit(None).cast("bigint").alias("since_us"),
        F.lit(None).cast("bigint").alias("open_s"),
        F.lit(None).cast("string").alias("resolution"),
    )
    cleared = F.struct(
        F.lit("exception.cleared").alias("event_type"),
        ids.cleared_id(F.col("exception_id")).alias("event_id"),
        F.col("cleared_us").alias("occurred_us"),
        F.col("cleared_by").alias("caused_by"),
        F.lit(None).cast("string").alias("detail"),
        F.lit(None).cast("double").alias("observed_value"),
        F.lit(None).cast("double").alias("threshold_value"),
        F.col("onset_us").alias("since_us"),
        F.col("open_s").alias("open_s"),
        F.col("resolution").alias("resolution"),
    )
    both = F.array_compact(F.array(raised, F.when(F.col("cleared_us").isNotNull(), cleared)))
    return incidents.select("exception_id", "type", "shipment_id", "stop_id", "severity", F.inline(both))


def worst_severity(incidents: DataFrame) -> DataFrame:
    """Most severe open incident per shipment."""
    ranked = incidents.where("state = 'OPEN'").groupBy("shipment_id").agg(
        F.max(severity_rank(F.col("severity"))).alias("rank"), F.count(F.lit(1)).alias("open_incidents")
    )
    return ranked.select("shipment_id", severity_of_rank(F.col("rank")).alias("worst_severity"), "open_incidents")


def incident_counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("type", "state").agg(F.count(F.lit(1)).alias("incidents"))


def open_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.where("state = 'OPEN'").orderBy(
        severity_rank(F.col("severity")).desc(), F.col("onset_us").asc_nulls_last(), "exception_id"
    )


def recent_incidents(incidents: DataFrame, limit: int | None = None, params: Params = DEFAULT) -> DataFrame:
    """Newest onset first; the limit is clamped to 1..1000."""
    wanted = min(1000, max(1, limit if limit is not None else params.incident_limit))
    return incidents.orderBy(F.col("onset_us").desc_nulls_last(), "exception_id").limit(wanted)
