"""Arrival estimates: learned speed, remaining road, confidence, and when an estimate is worth publishing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from haulscope.functions import geo, ids
from haulscope.functions.text import round_half_up
from haulscope.functions.timeparts import int_div
from haulscope.model.params import DEFAULT, MICROS, Params
from haulscope.operators import slices
from haulscope.operators.slices import SLICE
from haulscope.session import stage

SHIP = ["shipment_id"]
# a slice may span this many half-lives: 2 to that power, by which its speeds are weighed, is still a double
MOST_HALVES = 900


def learn(track: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Adds gap_s, learned_kph, moving_s and last_moving_us to the fixes of ``one_per_instant``.

    The learned speed is s' = s + w (r - s) on each moving fix, an affine map of s. A slice is the
    composition of its maps, so slices fold in parallel and chain through (age, pull) pairs. The
    first fix of a slice is applied while chaining, as its gap reaches back into the slice before.
    """
    narrow = int(MOST_HALVES * params.half_life_seconds)
    if params.slice_seconds > narrow:
        # learn in slices that are narrow enough and give the rows their own slice back
        start = F.greatest(F.col(SLICE), slices.slice_start("occurred_us", narrow))
        finer = track.withColumn("_wide", F.col(SLICE)).withColumn(SLICE, start)
        learned = learn(finer, params.but(slice_seconds=narrow))
        return learned.withColumn(SLICE, F.col("_wide")).drop("_wide")
    w = Window.partitionBy(*SHIP, SLICE).orderBy("occurred_us")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    moving, gap = F.col("_moving"), F.col("_gap")
    later = moving & gap.isNotNull()
    df = (
        track.withColumn("_moving", F.coalesce(F.col("speed_kph") >= params.moving_kph, F.lit(False)))
        .withColumn("_gap", (F.col("occurred_us") - F.lag("occurred_us").over(w)) / float(MICROS))
        .withColumn("_halves", F.when(later, gap / params.half_life_seconds).otherwise(0.0))
        .withColumn("_age", F.sum("_halves").over(upto))
        .withColumn(
            "_pull",
            F.sum(
                F.when(
                    later, (1.0 - F.pow(F.lit(2.0), -F.col("_halves"))) * F.col("speed_kph") * F.pow(F.lit(2.0), F.col("_age"))
                ).otherwise(0.0)
            ).over(upto),
        )
        .withColumn("_seed", F.first(F.when(later, F.col("speed_kph")), True).over(upto))
        .withColumn("_moved_s", F.sum(F.when(later, F.floor("_gap")).otherwise(0)).over(upto))
        .withColumn("_moved_us", F.last(F.when(moving, F.col("occurred_us")), True).over(upto))
    )
    last = F.struct("occurred_us", "_age", "_pull", "_seed", "_moved_s", "_moved_us")
    first = F.struct(F.col("occurred_us").alias("first_us"), F.when(moving, F.col("speed_kph")).alias("first_kph"))
    ends = (
        df.groupBy(*SHIP, SLICE)
        .agg(F.min_by(first, "occurred_us").alias("f"), F.max_by(last, "occurred_us").alias("e"))
        .select(*SHIP, SLICE, "f.*", "e.*")
    )
    half_life = params.half_life_seconds

    def chain(batches):
        current, last_us, speed, moved_s, moved_us = None, None, None, 0, None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in ends_columns]):
                ship, piece, first_us, first_kph, end_us, age, pull, seed, m_s, m_us = row
                if ship != current:
                    current, last_us, speed, moved_s, moved_us = ship, None, None, 0, None
                gap_s = 0.0 if last_us is None else (first_us - last_us) / MICROS
                if first_kph is not None:
                    weight = 1.0 - 2.0 ** (-gap_s / half_life)
                    speed = first_kph if speed is None else speed + weight * (first_kph - speed)
                    moved_s += int(gap_s)
                out.append((ship, piece, gap_s, speed, moved_s, moved_us))
                start = seed if speed is None else speed
                speed = None if start is None else 2.0**-age * (start + pull)
                moved_s, moved_us, last_us = moved_s + m_s, moved_us if m_us is None else m_us, end_us
            types = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types],
                names=["shipment_id", SLICE, "_gap1", "_in", "_in_s", "_in_us"],
            )

    ends_columns = ends.columns
    starts = ends.repartition(*SHIP).sortWithinPartitions(*SHIP, SLICE).mapInArrow(
        chain, f"shipment_id string, {SLICE} bigint, _gap1 double, _in double, _in_s bigint, _in_us bigint"
    )
    start = F.coalesce("_in", "_seed")
    return (
        df.join(starts, [*SHIP, SLICE])
        .withColumn("gap_s", F.coalesce("_gap", "_gap1"))
        .withColumn("learned_kph", F.when(start.isNotNull(), F.pow(F.lit(2.0), -F.col("_age")) * (start + F.col("_pull"))))
        .withColumn("moving_s", F.least(F.lit(params.warm_seconds).cast("bigint"), F.col("_in_s") + F.col("_moved_s")))
        .withColumn("last_moving_us", F.coalesce("_moved_us", "_in_us"))
        .select(*track.columns, "gap_s", "learned_kph", "moving_s", "last_moving_us")
    )


def progress(track: DataFrame, sides: DataFrame, visited: DataFrame) -> DataFrame:
    """Per fix: is the shipment inside any fence, and which stop comes next.

    A stop counts as reached from the fix that confirmed it, and its fence is ignored from the fix
    that confirmed the departure.
    """
    known = visited.select("shipment_id", "stop_id", "arrival_proof_us", "departure_proof_us")
    per_slice = slices.spread(known, track, SHIP)
    judged = sides.join(per_slice, ["shipment_id", "stop_id", SLICE], "left")
    at = F.col("occurred_us")
    inside = (F.col("side") == "in") & F.coalesce(at < F.col("departure_proof_us"), F.lit(True))
    reached = F.coalesce(F.col("arrival_proof_us") <= at, F.lit(False))
    return judged.groupBy("shipment_id", SLICE, "occurred_us").agg(
        F.bool_or(inside).alias("at_a_stop"),
        F.min(F.when(~reached, F.struct("seq", "stop_id"))).alias("next"),
    )


def confidence(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    warmth = params.cold_warmth + (1 - params.cold_warmth) * F.least(
        F.lit(1.0), F.col("moving_s") / float(params.warm_seconds)
    )
    still_s = F.coalesce((F.col("occurred_us") - F.col("last_moving_us")) / float(MICROS), F.lit(0.0))
    # greatest() skips nulls, so the missing accuracy is decided first
    accuracy = F.when(F.col("accuracy_m").isNull(), 1.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.col("accuracy_m") / params.accuracy_floor_m)
    )
    product = (
        warmth
        * F.exp(-F.col("gap_s") / params.freshness_seconds)
        * F.exp(-F.greatest(F.lit(0.0), still_s) / params.stillness_seconds)
        * accuracy
    )
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(params.min_confidence), product))
    return df.withColumn("confidence", round_half_up(bounded, 2))


def estimates(track: DataFrame, sides: DataFrame, visited: DataFrame, stops: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The published estimates: the first of each leg, then each one that moved far enough."""
    learned = learn(
        track.select("shipment_id", "lane", SLICE, "occurred_us", "event_id", "lat", "lon", "speed_kph", "accuracy_m"),
        params,
    )
    ahead = progress(track, sides, visited).where(~F.col("at_a_stop") & F.col("next").isNotNull())
    target = stops.select("lane", "stop_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    df = (
        learned.join(
            ahead.select("shipment_id", SLICE, "occurred_us", F.col("next.stop_id").alias("stop_id")),
            ["shipment_id", SLICE, "occurred_us"],
        )
        .join(target, ["lane", "stop_id"])
        .withColumn(
            "road_km",
            geo.road_km(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")), params.circuity),
        )
    )
    speed = F.greatest(F.lit(params.moving_kph), F.coalesce("learned_kph", F.lit(params.nominal_kph)))
    seconds = F.floor(F.col("road_km") / speed * 3600.0 + 0.5)
    df = confidence(df.withColumn("estimate_us", F.col("occurred_us") + seconds * MICROS), params)
    slim = df.select(
        "shipment_id", "stop_id", SLICE, "occurred_us", "event_id", "estimate_us",
        round_half_up(F.col("road_km"), 3).alias("remaining_km"), "confidence",
    )
    # the chain reads its input twice
    chained = slices.greedy_chain(
        stage(slim, "eta-candidates"), ["shipment_id", "stop_id"], "occurred_us", "estimate_us", params.publish_seconds * MICROS
    )
    return chained.where("kept").select(
        "shipment_id",
        "stop_id",
        ids.estimate_id(F.col("shipment_id"), F.col("stop_id"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("event_id").cast("string").alias("caused_by"),
        "occurred_us",
        "estimate_us",
        F.col("kept_before").alias("previous_us"),
        "remaining_km",
        "confidence",
    )
