"""Incidents of all five rules from streams: one keyed state per shipment, one changelog, one table.

Events become signals (what a rule has to say about one event) by columns. The state of a shipment holds

* a reorder buffer: signals wait until the watermark, the least over all topics, has passed them, and are then applied in
  event-time order. It holds what the watermark's delay allows to be late. A signal is one text from the columns to the
  state and back, so that a value is parsed once, when its signal is applied;
* its cases, by (rule, stop): the breach being watched or the incident being open, with what its sentences need. A case
  ends with its incident and leaves the state;
* when it was last heard from, by any kind of event, and whether that is over.

Each batch gives the newest version of every incident it changed. ``upsert`` keeps those that are closed in one folder per
batch, never to be read again for an update, and rewrites only the open ones.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from haulscope.functions.text import severity_of_rank, severity_rank
from haulscope.functions.timeparts import whole_minutes
from haulscope.model.params import DEFAULT, MICROS, Params
from haulscope.operators import conditions

HOT, IDLE, ASTRAY, LATE, QUIET = "TEMPERATURE_EXCURSION", "UNPLANNED_STOP", "ROUTE_DEVIATION", "LATE_ARRIVAL", "SIGNAL_LOSS"

# a null rule only shows that the shipment is heard from; ``onset_us`` replaces the instant of the first breach
SIGNAL = (
    "shipment_id string, rule string, stop_id string, occurred_us bigint, event_id string, breach boolean, hold_us bigint, excess double, "
    "observed double, threshold double, severity int, recovery string, note string, onset_us bigint, completes boolean"
)
_SIGNAL = [c.split() for c in SIGNAL.split(", ")]
_BLANK = dict.fromkeys(n for n, _ in _SIGNAL)
_DOUBLES = [n for n, t in _SIGNAL if t == "double"]

FACT = "at_us bigint, by string, excess double, observed double, threshold double, held_us bigint, severity int, note string"
_FACT = [c.split() for c in FACT.split(", ")]
CASE = (
    "onset_us bigint, note string, worst double, raise_worst double, findings bigint, severity int, "
    + ", ".join(f"first_{n} {t}" for n, t in _FACT)
    + ", "
    + ", ".join(f"last_{n} {t}" for n, t in _FACT)
)
_CASE = [c.split()[0] for c in CASE.split(", ")]
CHANGE = f"shipment_id string, rule string, stop_id string, {CASE}, end_us bigint, end_by string, recovery string, fleet_us bigint"


def _signal(**given: Column) -> list[Column]:
    """The columns of SIGNAL after shipment_id and before the event's own."""
    return [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _SIGNAL]


def topic(events: DataFrame, delay: str) -> DataFrame:
    """A topic with its own lateness.

    Rows without shipment_id only move its clock. They go as far as the state, which ignores them: a filter would be
    pushed below the watermark and stop the clock.
    """
    return events.withColumn("occurred_at", F.timestamp_micros("occurred_us")).withWatermark("occurred_at", delay)


def fix_signals(fixes: DataFrame, plans: DataFrame, terms: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Three judgements of each fix in one pass; fixes that a rule cannot use still show that the shipment is heard from."""
    own = terms.select("shipment_id", "min_c", "max_c", "tolerance_s", "cold_chain")
    rows = fixes.join(plans, "lane", "left").join(own, "shipment_id", "left")
    kept = rows.columns
    judged = lambda rule, severity, note=F.lit(None): F.struct(
        F.lit(rule).alias("rule"), F.col("breach"), F.col("hold_us"), F.col("excess"), F.col("observed"), F.col("threshold"),
        severity.cast("int").alias("severity"), F.col("recovery"), note.cast("string").alias("note"),
    )
    rows = conditions.judged_readings(rows, params)
    rows = rows.withColumn("hot", judged(HOT, severity_rank(F.col("severity")), conditions.band_text())).select(*kept, "hot")
    rows = conditions.judged_rests(rows, params)
    rows = rows.withColumn("idle", judged(IDLE, severity_rank(conditions.cargo_severity()))).select(*kept, "hot", "idle")
    rows = conditions.judged_courses(rows, params).withColumn("astray", judged(ASTRAY, severity_rank(F.col("severity"))))
    useful = lambda j: F.when(F.col(j)["breach"].isNotNull(), F.col(j))
    # the second one always comes, so that no fix is lost as a sighting
    each = F.explode(F.array_compact(F.array(useful("hot"), F.col("idle"), useful("astray"))))
    rows = rows.select("shipment_id", "occurred_us", "event_id", "occurred_at", each.alias("j"))
    own = {n: F.col("j")[n] for n in ("rule", "breach", "hold_us", "excess", "observed", "threshold", "severity", "recovery", "note")}
    event = {n: F.col(n) for n in ("shipment_id", "occurred_us", "event_id")}
    return rows.select(*_signal(**event, **own), "occurred_at")


def deadline_signals(events: DataFrame, arrived: bool, terms: DataFrame, final_stops: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """What estimates (estimate_us, remaining_km, confidence) or arrivals say about the delivery window of the final stop."""
    due = terms.select("shipment_id", "closes_us")
    final = final_stops.select("lane", "stop_id", F.lit(True).alias("final"))
    rows = events.join(due, "shipment_id", "left").join(final, ["lane", "stop_id"], "left")
    if arrived:
        none = F.lit(None).cast("double")
        rows = rows.withColumns({"estimate_us": F.col("occurred_us"), "remaining_km": none, "confidence": none})
    late_us = F.col("estimate_us") - F.col("closes_us")
    judged = F.col("final") & F.col("closes_us").isNotNull()
    over = late_us > (0 if arrived else params.late_grace_seconds * MICROS)
    late = F.lit(arrived) & over
    recovery = F.lit("BACK_WITHIN_WINDOW") if not arrived else F.when(over, "ARRIVED_LATE").otherwise("ARRIVED_ON_TIME")
    return rows.select(
        *_signal(
            shipment_id=F.col("shipment_id"),
            rule=F.when(judged, LATE),
            stop_id=F.col("stop_id"),
            occurred_us=F.col("occurred_us"),
            event_id=F.col("event_id"),
            breach=F.when(judged, over),
            hold_us=F.lit(0),
            observed=whole_minutes(late_us),
            threshold=F.lit(0.0 if arrived else float(params.late_grace_seconds // 60)),
            severity=F.lit(2 if arrived else 1),
            # a late arrival is a finding that also ends its incident
            recovery=recovery,
            note=conditions.lateness_text(late_us, F.lit(arrived)),
            onset_us=F.when(late, F.col("closes_us")),
            completes=F.lit(arrived) & F.coalesce("final", F.lit(False)),
        ),
        "occurred_at",
    )


def sighting_signals(events: DataFrame) -> DataFrame:
    """Events that no rule judges but that show the shipment is alive: shipment_id, occurred_us, event_id."""
    event = {n: F.col(n) for n in ("shipment_id", "occurred_us", "event_id")}
    return events.select(*_signal(**event), "occurred_at")


def _line() -> Column:
    """A signal as a line: its instant, a space, and its other values."""
    rest = [F.col(n) for n, _ in _SIGNAL if n not in ("shipment_id", "occurred_us")]
    return F.concat(F.col("occurred_us").cast("string"), F.lit(" "), F.to_json(F.struct(*rest)))


def _parsed(at: int, line: str) -> dict:
    """The signal of a line; shipment_id is the key."""
    signal = _BLANK | json.loads(line[line.index(" ") :])
    signal["occurred_us"] = at
    for n in _DOUBLES:
        if isinstance(signal[n], str):  # NaN or infinite
            signal[n] = float(signal[n])
    return signal


class IncidentProcessor(StatefulProcessor):
    """Raises, restates, escalates and clears the incidents of one shipment.

    ``guard_s`` is the second clock of a silence: a shipment is reported only if nothing was heard for so long in real
    time as well, so that working through a backlog, whose event time runs ahead, raises nothing. With 0 the event time
    alone decides, and a silence is also found in hindsight.
    """

    def __init__(self, params: Params = DEFAULT, guard_s: float = 0.0, silences: bool = True):
        self.silence = params.silence_seconds * MICROS
        self.guard = guard_s
        self.silences = silences

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cases = handle.getMapState("cases", "rule string, stop_id string", CASE)
        # with the number of cases, the timer that is set, and the buffer: the lines of what waits
        self.seen = handle.getValueState(
            "seen", "last_us bigint, last_id string, heard double, silent boolean, done boolean, severity int, n_cases int, timer_ms bigint, buffer string"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        yield from self._advance(key[0], [r.signal for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key[0], [], timerValues.getCurrentWatermarkInMs(), expired=True)

    def _advance(self, shipment: str, arrived: list[str], clock_ms: int, expired: bool = False) -> Iterator[Row]:
        last, last_id, heard, silent, done, rank, n_cases, timer, buffer = self.seen.get() or (None, None, 0.0, False, False, 1, 0, None, None)
        if expired:
            timer = None  # it is gone
        if arrived:
            heard = time.time()
        lines = [(int(line[: line.index(" ")]), line) for line in [*(buffer.split("\n") if buffer else ()), *arrived]]
        # what is older than the last applied instant came later than the watermark allows
        ready = [_parsed(at, line) for at, line in lines if at // 1000 <= clock_ms and (last is None or at > last)]
        waiting = [(at, line) for at, line in lines if at // 1000 > clock_ms]
        looked = bool(n_cases and (ready or silent or not done))
        cases = {tuple(k): dict(zip(_CASE, v)) for k, v in self.cases.iterator()} if looked else {}
        before = {k: dict(v) for k, v in cases.items()}
        ended: list[tuple[tuple, dict, tuple]] = []

        def end(k: tuple, at: int, by: str, word: str) -> None:
            ended.append((k, cases.pop(k), (at, by, word)))

        ready.sort(key=lambda s: (s["occurred_us"], s["rule"] or "", s["event_id"]))
        for at, group in groupby(ready, key=lambda s: s["occurred_us"]):
            signals = list(group)
            for s in signals:
                if s["rule"] == IDLE:
                    rank = s["severity"]  # a silence is as severe as a stop of this cargo
            if self.silences and not done:
                by = min(s["event_id"] for s in signals)
                if last is not None and at - last >= self.silence and not silent and not self.guard:
                    cases[QUIET, None] = self._silence(last, last_id, rank)
                    silent = True
                done = any(s["completes"] for s in signals)
                if silent:
                    end((QUIET, None), at, by, "SHIPMENT_COMPLETED" if done else "REPORTING_AGAIN")
                    silent = False
                last_id = by
            last = at
            for s in signals:
                if s["rule"] is not None and s["breach"] is not None:
                    self._judge(cases, s, end)
        due = None
        if self.silences and last is not None and not silent and not done:
            due = (last + self.silence) // 1000
            if clock_ms >= due:
                if time.time() - heard >= self.guard:
                    cases[QUIET, None] = self._silence(last, last_id, rank)
                    silent, due = True, None
                else:
                    due = clock_ms + 1  # looked at again when the clock moves
        n_cases = n_cases + len(cases) - len(before)
        self._keep(cases, before, waiting, (last, last_id, heard, silent, done, rank, n_cases), due, timer)
        for k, case, (at, by, word) in ended:
            if case["findings"]:
                yield self._row(shipment, k, case, at, by, word, clock_ms)
        for k, case in cases.items():
            if case["findings"] and case != before.get(k):
                yield self._row(shipment, k, case, None, None, None, clock_ms)

    def _judge(self, cases: dict, s: dict, end: Callable) -> None:
        k, at = (s["rule"], s["stop_id"]), s["occurred_us"]
        if s["breach"]:
            case = cases.get(k)
            if case is None:
                case = cases[k] = dict.fromkeys(_CASE) | {"onset_us": at, "note": s["note"], "findings": 0, "severity": 0}
                if s["onset_us"] is not None:
                    case["onset_us"] = s["onset_us"]
            if s["excess"] is not None:
                case["worst"] = s["excess"] if case["worst"] is None else max(case["worst"], s["excess"])
            held = at - case["onset_us"]
            if held >= s["hold_us"] or s["onset_us"] is not None:
                fact = (at, s["event_id"], s["excess"], s["observed"], s["threshold"], held, s["severity"], s["note"])
                if not case["findings"]:
                    case["raise_worst"] = case["worst"]
                    case |= {f"first_{n}": v for (n, _), v in zip(_FACT, fact)}
                case |= {f"last_{n}": v for (n, _), v in zip(_FACT, fact)}
                case["findings"] += 1
                case["severity"] = max(case["severity"], s["severity"])  # it only rises
                cases[k] = case
            if s["onset_us"] is not None:
                end(k, at, s["event_id"], s["recovery"])
        elif k in cases:
            end(k, at, s["event_id"], s["recovery"])

    def _silence(self, since: int, by: str, rank: int) -> dict:
        fact = (since + self.silence, by, None, None, None, None, rank, None)
        case = dict.fromkeys(_CASE) | {"onset_us": since, "findings": 1, "severity": rank}
        for part in ("first", "last"):
            case |= {f"{part}_{n}": v for (n, _), v in zip(_FACT, fact)}
        return case

    def _keep(self, cases: dict, before: dict, waiting: list[tuple[int, str]], seen: tuple, due: int | None, timer: int | None) -> None:
        for k in before.keys() - cases.keys():
            self.cases.removeKey(k)
        for k, case in cases.items():
            if case != before.get(k):
                self.cases.updateValue(k, tuple(case[n] for n in _CASE))
        if waiting:
            first = min(at for at, _ in waiting) // 1000
            due = first if due is None else min(due, first)
        wanted = None if due is None else due - 1
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.seen.update((*seen, wanted, "\n".join(line for _, line in waiting) or None))

    @staticmethod
    def _row(shipment, k, case, at, by, word, clock_ms) -> Row:
        return Row(shipment_id=shipment, rule=k[0], stop_id=k[1], **case, end_us=at, end_by=by, recovery=word, fleet_us=clock_ms * 1000)


def incident_changes(*signals: DataFrame, params: Params = DEFAULT, guard_s: float = 0.0, silences: bool = True) -> DataFrame:
    """Stream of the newest versions of incidents, one row (CHANGE) for each that a batch changed."""
    rows = signals[0]
    for more in signals[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("shipment_id", _line().alias("signal"), "occurred_at")
    return rows.groupBy("shipment_id").transformWithState(
        statefulProcessor=IncidentProcessor(params, guard_s, silences), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime"
    )


def incident_rows(changes: DataFrame, fleet_us: Column) -> DataFrame:
    """Versions as rows of the incident table; an open silence has lasted until ``fleet_us``."""
    fact = lambda part: F.struct(
        F.col(f"{part}_excess").alias("excess"), F.col(f"{part}_observed").alias("observed"), F.col(f"{part}_held_us").alias("held"),
        severity_of_rank(F.col(f"{part}_severity")).alias("severity"),
    )
    quiet = conditions.silence_text(F.coalesce("end_us", fleet_us) - F.col("onset_us"), F.col("onset_us"))

    def detail(part: str, worst: str) -> Column:
        return (
            F.when(F.col("rule") == HOT, conditions.excursion_text(fact(part), F.col(worst), F.col("note")))
            .when(F.col("rule") == IDLE, conditions.rest_text(fact(part)))
            .when(F.col("rule") == ASTRAY, conditions.deviation_text(fact(part), F.col(worst)))
            .when(F.col("rule") == LATE, F.col(f"{part}_note"))
            .otherwise(quiet)
        )

    def value(part: str) -> Column:
        held = whole_minutes(F.col(f"{part}_held_us")).cast("double")
        return F.when(F.col("rule") == IDLE, held).otherwise(F.col(f"{part}_observed"))

    rows = changes.select(
        "rule",
        "shipment_id",
        "stop_id",
        severity_of_rank(F.col("severity")).alias("severity"),
        "onset_us",
        F.col("first_at_us").alias("raised_us"),
        F.col("last_at_us").alias("last_seen_us"),
        F.col("end_us").alias("cleared_us"),
        (F.col("findings") - 1).alias("restated"),
        F.col("first_by").alias("raised_by"),
        F.col("end_by").alias("cleared_by"),
        detail("first", "raise_worst").alias("raised_detail"),
        detail("last", "worst").alias("detail"),
        value("first").alias("raised_value"),
        value("last").alias("observed_value"),
        F.col("first_threshold").alias("threshold_value"),
        "worst",
        F.col("recovery").alias("resolution"),
    )
    return conditions.finish(rows, F.col("rule"))


KEY = ["shipment_id", "rule", "stop_id", "onset_us"]


def upsert(path: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """Sink of ``incident_changes``.

    Closed incidents are final: each batch writes its own to one folder of its own. Open ones, a live table of bounded
    size, take turns in two slots: a batch reads the slot of the batch before and replaces its own. A batch that is run
    again after a crash writes the same. A row without shipment in each slot tells which batch wrote it.
    """
    names = schema.names

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()  # both folders are written from it
        try:
            closed = batch.where("end_us IS NOT NULL")
            closed.select(*names).write.mode("overwrite").parquet(f"{path}/closed/batch={batch_id}")
            opened = batch.where("end_us IS NULL").select(*names)
            if batch_id:
                held = spark.read.schema(schema).parquet(f"{path}/open/slot={(batch_id - 1) % 2}").where("shipment_id IS NOT NULL")
                same = [F.col(f"h.{c}").eqNullSafe(F.col(f"n.{c}")) for c in KEY]
                held = held.alias("h").join(batch.select(*KEY).alias("n"), same, "left_anti")
                opened = opened.unionByName(held.select(*names))
            mark = spark.range(1).select(*(F.lit(batch_id if f.name == "findings" else None).cast(f.dataType).alias(f.name) for f in schema))
            opened.unionByName(mark).write.mode("overwrite").parquet(f"{path}/open/slot={batch_id % 2}")
        finally:
            batch.unpersist()

    return write


def held_incidents(spark, path: str, schema: StructType) -> DataFrame:
    """Newest version of every incident in the folders of ``upsert``."""
    slots = spark.read.schema(StructType([*schema.fields, StructField("slot", IntegerType())])).parquet(f"{path}/open")
    newest = slots.where("shipment_id IS NULL").agg(F.max("findings")).scalar()
    closed = spark.read.schema(schema).parquet(f"{path}/closed").select(*schema.names)
    return closed.unionByName(slots.where((F.col("slot") == newest % 2) & F.col("shipment_id").isNotNull()).select(*schema.names))
