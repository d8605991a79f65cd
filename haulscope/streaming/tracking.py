"""Keyed streaming state: geofences with estimates, sustained conditions, and silence.

What needs no state is a column before the state or after it: sides and road distances of a fix come in as arrays
over the planned stops, identifiers and confidence are computed on what comes out. The state of a shipment is a few
numbers per stop. Rows older than the last applied one are ignored, as in the batch forms.

A micro-batch brings few rows of each of very many shipments, so what counts is the cost of a shipment: one read and one
write of its state, and no data frame of its own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from haulscope.functions import geo, ids
from haulscope.functions.text import round_half_up
from haulscope.model.params import DEFAULT, MICROS, Params
from haulscope.operators import eta, positions

CHANGES = (
    "shipment_id string, stop_id string, type string, occurred_us bigint, caused_by string, dwell_s bigint, "
    "estimate_us bigint, previous_us bigint, road_km double, gap_s double, moving_s bigint, last_moving_us bigint, accuracy_m double"
)
COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
# sides of a fence as the batch form labels them; UNUSABLE fixes prove nothing, BETWEEN keeps the side
IN, OUT, BETWEEN, UNUSABLE = 1, -1, 0, 9
BEFORE = -(1 << 62)  # run start of a side that was held from the beginning


def _rows(frames: Iterator[pd.DataFrame]) -> list[dict]:
    """All new rows of a key in event-time order; among equal instants the lowest id comes first."""
    records = [r for frame in frames for r in frame.to_dict("records")]
    return sorted(records, key=lambda r: (r["occurred_us"], r["event_id"]))


def label_runs(at: np.ndarray, label: np.ndarray, side: int, since: int) -> tuple[np.ndarray, np.ndarray]:
    """Side after each row and the instant its run began, carried on from ``side`` held since ``since``."""
    order = np.arange(len(at))
    decided = np.maximum.accumulate(np.where((label == IN) | (label == OUT), order, -1))
    after = np.where(decided >= 0, label[decided], side)
    changed = after != np.concatenate([[side], after[:-1]])
    began = np.maximum.accumulate(np.where(changed, order, -1))
    return after, np.where(began >= 0, at[began], since)


class Stay:
    """Visit of one stop: the first confirmed run inside, then the first confirmed run outside after it."""

    FIELDS = "side int, since_us bigint, arrived_us bigint, departed boolean"

    def __init__(self, side: int = OUT, since_us: int = BEFORE, arrived_us: int | None = None, departed: bool = False):
        self.side, self.since, self.arrived, self.departed = side, since_us, arrived_us, departed

    def advance(self, at: np.ndarray, label: np.ndarray, hold_us: int) -> tuple[np.ndarray, np.ndarray, list[tuple[str, int, int, int | None]]]:
        """(inside, reached) of each row and the events (type, instant, row that proves it, dwell seconds)."""
        n = len(at)
        if self.departed:
            return np.zeros(n, bool), np.ones(n, bool), []
        after, began = label_runs(at, label, self.side, self.since)
        proven = (label != UNUSABLE) & (at - began >= hold_us)
        events = []
        reached = np.full(n, self.arrived is not None)
        if self.arrived is None and (hits := np.flatnonzero(proven & (after == IN))).size:
            row = int(hits[0])
            self.arrived = int(began[row])
            reached[row:] = True
            events.append(("shipment.arrived", self.arrived, row, None))
        inside = after == IN
        if self.arrived is not None and (hits := np.flatnonzero(proven & (after == OUT) & (began > self.arrived))).size:
            row = int(hits[0])
            self.departed = True
            inside[row:] = False
            left = int(began[row])
            events.append(("shipment.departed", left, row, (left - self.arrived) // MICROS))
        self.side, self.since = int(after[-1]), int(began[-1])
        return inside, reached, events

    def state(self) -> tuple:
        return self.side, self.since, self.arrived, self.departed


class TrackProcessor(StatefulProcessor):
    """Arrivals, departures and published estimates of one shipment.

    Rows: occurred_us and ``fix``, the text of event_id, speed_kph, accuracy_m, and over the planned stops in order
    ``stops`` (ids), ``labels`` and ``road_km``. A batch's rows of a shipment are handled as arrays; only the learned
    speed and the choice of what to publish, each of which depends on its own last value, go row by row.
    """

    def __init__(self, params: Params):
        self.p = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        # stays: text of the fields of each stop's stay
        self.track = handle.getValueState(
            "track", "last_us bigint, speed double, moving_s bigint, moving_us bigint, target string, published_us bigint, stays string"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        *held, stays = self.track.get() or (None, None, 0, None, None, None, None)
        came = [(r.occurred_us, r.fix) for r in rows]
        fixes = sorted(((at, json.loads(fix)) for at, fix in came if held[0] is None or at > held[0]), key=lambda f: (f[0], f[1].get("event_id") is None, f[1].get("event_id")))
        # of equal instants the lowest id
        fixes = [f for i, f in enumerate(fixes) if not i or fixes[i - 1][0] != f[0]]
        if not fixes:
            return
        out: list[tuple] = []
        at = np.array([f[0] for f in fixes], np.int64)
        fixes = [f[1] for f in fixes]
        cause = [str(f.get("event_id")) for f in fixes]
        stops = fixes[0]["stops"]
        labels, km = np.array([f["labels"] for f in fixes], np.int64), np.array([f["road_km"] for f in fixes], float)
        stays = {stop: Stay(*v) for stop, v in json.loads(stays or "{}").items()}
        inside, reached = np.zeros(len(at), bool), np.zeros(labels.shape, bool)
        for j, stop in enumerate(stops):
            stay = stays.setdefault(stop, Stay())
            within, reached[:, j], events = stay.advance(at, labels[:, j], self.p.dwell_seconds * MICROS)
            inside |= within
            out += [(key[0], stop, kind, when, cause[row], dwell, *[None] * 7) for kind, when, row, dwell in events]
        told, track = self._estimates(key[0], fixes, at, cause, stops, km, inside, reached, held)
        self.track.update((*track, json.dumps({stop: stay.state() for stop, stay in stays.items()})))
        yield from (Row(**dict(zip(COLUMNS, r))) for r in [*out, *told])

    def _learn(self, at, speeds, held) -> tuple[np.ndarray, ...]:
        """gap_s, learned_kph (NaN while unknown), moving_s and last_moving_us (BEFORE: never) of each row, as ``eta.learn``."""
        last, speed, moving_s, moving_us, _, _ = held
        gap = np.diff(at, prepend=at[0] if last is None else last) / MICROS
        moving = np.flatnonzero(speeds >= self.p.moving_kph)
        learned = np.full(len(at), np.nan)
        for i in moving:
            weight = 1.0 - 2.0 ** (-gap[i] / self.p.half_life_seconds)
            speed = speeds[i] if speed is None else speed + weight * (speeds[i] - speed)
            learned[i] = speed
        row = np.full(len(at), -1)
        row[moving] = moving
        row = np.maximum.accumulate(row)
        steps = np.zeros(len(at))
        steps[moving] = np.floor(gap[moving])
        start = np.nan if held[1] is None else held[1]
        return (
            gap,
            np.where(row >= 0, learned[row], start),
            np.minimum(self.p.warm_seconds, moving_s + np.cumsum(steps)).astype(np.int64),
            np.where(row >= 0, at[row], BEFORE if moving_us is None else moving_us),
        )

    def _estimates(self, ship, fixes, at, cause, stops, km, inside, reached, held) -> tuple[list[tuple], tuple]:
        p = self.p
        given = lambda name: np.array([f.get(name) for f in fixes], float)  # noqa: E731  a null is NaN, as is "NaN"
        speeds, accuracy = given("speed_kph"), given("accuracy_m")
        speeds[np.isnan(speeds)] = -1.0
        gap, learned, moving_s, moving_us = self._learn(at, speeds, held)
        pace = np.maximum(p.moving_kph, np.where(np.isnan(learned), p.nominal_kph, learned))
        target, published = held[4], held[5]
        ahead = np.argmin(reached, axis=1)  # the first stop that is not reached
        out = []
        for i in np.flatnonzero(~inside & ~reached.all(axis=1)):
            stop, road = stops[ahead[i]], float(km[i, ahead[i]])
            due = int(at[i]) + math.floor(road / pace[i] * 3600.0 + 0.5) * MICROS
            previous = published if stop == target else None
            if previous is None or abs(due - previous) >= p.publish_seconds * MICROS:
                target, published = stop, due
                moved = None if moving_us[i] == BEFORE else int(moving_us[i])
                out.append(
                    (ship, stop, "eta.updated", int(at[i]), cause[i], None, due, previous, road, float(gap[i]), int(moving_s[i]), moved, float(accuracy[i]))
                )
        speed = None if math.isnan(learned[-1]) else float(learned[-1])
        moved = None if moving_us[-1] == BEFORE else int(moving_us[-1])
        return out, (int(at[-1]), speed, int(moving_s[-1]), moved, target, published)


def _label(meters: Column, radius: Column, accuracy: Column, params: Params) -> Column:
    """Side of the fence that a fix shows, as in ``geofence.fix_stop_sides``."""
    usable = F.coalesce(accuracy <= radius * params.fence_accuracy_ratio, F.lit(True))
    return (
        F.when(~usable, UNUSABLE)
        .when(meters < radius, IN)
        .when(meters > radius * params.exit_ratio, OUT)
        .otherwise(BETWEEN)
        .cast("int")
    )


def derived_events(fixes: DataFrame, plans: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Stream of shipment.arrived, shipment.departed and eta.updated events from a stream of fixes."""
    near = positions.stop_distances(F.col("lat"), F.col("lon"), F.col("stops"))
    placed = fixes.join(plans.select("lane", "stops"), "lane").withColumn("near", near)
    fix = F.struct(
        "event_id",
        "speed_kph",
        "accuracy_m",
        F.transform("near", lambda s: s["stop_id"]).alias("stops"),
        F.transform("near", lambda s: _label(s["meters"], s["radius_m"], F.col("accuracy_m"), params)).alias("labels"),
        F.transform("near", lambda s: geo.road_km(s["meters"], params.circuity)).alias("road_km"),
    )
    out = placed.select("shipment_id", "occurred_us", F.to_json(fix).alias("fix")).groupBy("shipment_id").transformWithState(
        statefulProcessor=TrackProcessor(params), outputStructType=CHANGES, outputMode="Append", timeMode="None"
    )
    # an unknown accuracy is NaN in the arrays of the state
    out = out.withColumn("accuracy_m", F.nanvl("accuracy_m", F.lit(None).cast("double")))
    ship, stop, at = F.col("shipment_id"), F.col("stop_id"), F.col("occurred_us")
    event_id = (
        F.when(F.col("type") == "shipment.arrived", ids.arrival_id(ship, stop, at))
        .when(F.col("type") == "shipment.departed", ids.departure_id(ship, stop, at))
        .otherwise(ids.estimate_id(ship, stop, F.col("caused_by")))
    )
    published = F.col("type") == "eta.updated"
    return eta.confidence(out, params).select(
        "shipment_id",
        "stop_id",
        "type",
        "occurred_us",
        "caused_by",
        "dwell_s",
        "estimate_us",
        "previous_us",
        F.when(published, round_half_up(F.col("road_km"), 3)).alias("remaining_km"),
        F.when(published, F.col("confidence")).alias("confidence"),
        event_id.alias("event_id"),
    )


CONDITION_SCHEMA = (
    "shipment_id string, rule string, change string, onset_us bigint, at_us bigint, caused_by string, worst double, recovery string"
)


class SustainedProcessor(StatefulProcessor):
    """Raises a condition once held long enough and clears it at the first recovery, per shipment and rule."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("condition", "since_us bigint, last_us bigint, worst double, raised boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since, last, worst, raised = self.state.get() if self.state.exists() else (None, None, None, False)
        out = []
        for row in _rows(rows):
            at = row["occurred_us"]
            if row["breach"] is None or (last is not None and at <= last):
                continue
            last, cause = at, str(row["event_id"])
            if row["breach"]:
                since = at if since is None else since
                worst = row["excess"] if worst is None else max(worst, row["excess"])
                if not raised and at - since >= row["hold_us"]:
                    raised = True
                    out.append((*key, "raised", since, at, cause, worst, None))
            else:
                if raised:
                    out.append((*key, "cleared", since, at, cause, worst, row["recovery"]))
                since, worst, raised = None, None, False
        self.state.update((since, last, worst, raised))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CONDITION_SCHEMA.split(", ")])


def sustained_changes(rows: DataFrame) -> DataFrame:
    """Stream of raised / cleared changes. Rows: shipment_id, rule, occurred_us, event_id, breach, hold_us, excess, recovery."""
    return rows.groupBy("shipment_id", "rule").transformWithStateInPandas(
        statefulProcessor=SustainedProcessor(), outputStructType=CONDITION_SCHEMA, outputMode="Append", timeMode="None"
    )


SILENCE_SCHEMA = "shipment_id string, change string, onset_us bigint, at_us bigint, caused_by string, resolution string"


class SilenceProcessor(StatefulProcessor):
    """Watches for absence: an event-time timer fires once the watermark is past the last sighting plus the threshold.

    A row that completes the shipment ends the watch, and a silence that it ends is resolved by it.
    """

    def __init__(self, threshold_us: int):
        self.threshold = threshold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "last_us bigint, last_id string, silent boolean, done boolean, timer_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, last_id, silent, done, timer = self.state.get() or (None, None, False, False, None)
        for at, event, completed in sorted(((r.occurred_us, r.event_id, r.completed) for r in rows), key=lambda r: r[:2]):
            if done or (last is not None and at <= last):
                continue
            event = str(event)
            if last is not None and at - last >= self.threshold and not silent:
                yield self._row(key[0], "raised", last, last + self.threshold, last_id, None)
                silent = True
            done = bool(completed)
            if silent:
                yield self._row(key[0], "cleared", last, at, event, "SHIPMENT_COMPLETED" if done else "REPORTING_AGAIN")
                silent = False
            last, last_id = at, event
        due = None if last is None or silent or done else (last + self.threshold) // 1000
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((last, last_id, silent, done, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, last_id, silent, done, _ = self.state.get()
        if not silent and not done:
            yield self._row(key[0], "raised", last, last + self.threshold, last_id, None)
        self.state.update((last, last_id, silent or not done, done, None))  # the timer is gone

    @staticmethod
    def _row(*values) -> Row:
        return Row(**dict(zip([c.split()[0] for c in SILENCE_SCHEMA.split(", ")], values)))


def silence_changes(sightings: DataFrame, delay: str = "10 minutes", params: Params = DEFAULT) -> DataFrame:
    """Stream of raised / cleared silences. ``sightings``: shipment_id, occurred_us, event_id, completed."""
    watched = sightings.select(
        "shipment_id", "occurred_us", "event_id", "completed", F.timestamp_micros("occurred_us").alias("occurred_at")
    ).withWatermark("occurred_at", delay)
    return watched.groupBy("shipment_id").transformWithState(
        statefulProcessor=SilenceProcessor(params.silence_seconds * MICROS),
        outputStructType=SILENCE_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )
