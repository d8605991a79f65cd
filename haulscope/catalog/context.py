"""Inputs of a query run, built on demand; what several branches share is staged once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.fixtures import feeds as feed_fixtures, fleet, manifests as manifest_fixtures
from haulscope.functions import ids
from haulscope.functions.text import lane_code, round_half_up
from haulscope.model.params import DEFAULT, Params
from haulscope.operators import conditions, eta, geofence, manifests, positions, slices
from haulscope.plans import fleet as fleet_plan, ingest
from haulscope.session import prepare, stage
from haulscope.sources import plan

# instant the read models look from: the end of the simulated twelve hours
NOW_US = (fleet.EPOCH_S + 43_200) * 1_000_000


class Run:
    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = DEFAULT):
        self.spark, self.sf_dir, self.params = prepare(spark), sf_dir, params

    # cheap inputs
    @cached_property
    def stops(self) -> DataFrame:
        return plan.lane_stops(self.spark)

    @cached_property
    def plans(self) -> DataFrame:
        return plan.lane_plans(self.spark)

    @cached_property
    def fixes(self) -> DataFrame:
        return fleet.fleet_fixes(self.spark, self.sf_dir)

    @cached_property
    def track(self) -> DataFrame:
        return positions.one_per_instant(self.staged_fixes, self.params)

    @cached_property
    def current(self) -> DataFrame:
        return positions.current_position(self.fixes)

    @cached_property
    def shipments(self) -> DataFrame:
        return fleet.shipments(self.spark, self.sf_dir)

    @cached_property
    def manifests(self) -> DataFrame:
        return manifest_fixtures.manifests(self.spark, self.sf_dir)

    @cached_property
    def assignments(self) -> DataFrame:
        return fleet.assignments(self.spark, self.sf_dir)

    @cached_property
    def terms(self) -> DataFrame:
        return manifests.sla_terms(self.manifests)

    # inputs of several branches
    @cached_property
    def staged_fixes(self) -> DataFrame:
        return stage(self.fixes, "fixes")

    @cached_property
    def staged_track(self) -> DataFrame:
        return stage(self.track, "track")

    @cached_property
    def staged_terms(self) -> DataFrame:
        return stage(self.terms, "terms")

    @cached_property
    def staged_messages(self) -> DataFrame:
        return stage(feed_fixtures.messages(self.spark, self.sf_dir), "messages", by="source")

    @cached_property
    def feed_rows(self) -> DataFrame:
        """Messages parsed, resolved and judged once for all that is told about them."""
        return stage(ingest.judged(self.staged_messages, self.assignments), "judged")

    @cached_property
    def staged_sides(self) -> DataFrame:
        # shuffle the fixes, not the four times as many (fix, stop) pairs
        track = self.staged_track.repartition("shipment_id", slices.SLICE)
        return stage(geofence.fix_stop_sides(track, self.stops, self.params), "sides")

    @cached_property
    def staged_visits(self) -> DataFrame:
        return stage(geofence.visits(self.staged_sides, self.params), "visits")

    @cached_property
    def visits(self) -> DataFrame:
        """For plans that use visits only."""
        return geofence.visits_of_track(self.track, self.stops, self.params)

    @cached_property
    def estimates(self) -> DataFrame:
        return eta.estimates(self.staged_track, self.staged_sides, self.staged_visits, self.stops, self.params)

    @cached_property
    def staged_estimates(self) -> DataFrame:
        return stage(self.estimates, "estimates")

    @cached_property
    def finals(self) -> DataFrame:
        return plan.final_stops(self.stops)

    @cached_property
    def completions(self) -> DataFrame:
        return self.staged_visits.join(self.finals, "stop_id", "left_semi").select(
            "shipment_id", F.col("arrived_us").alias("completed_us")
        )

    # rules
    def excursions(self, track: DataFrame, terms: DataFrame) -> DataFrame:
        return conditions.temperature_excursions(track.where("temp_c IS NOT NULL"), terms, self.params)

    def idle(self, track: DataFrame, terms: DataFrame) -> DataFrame:
        return conditions.unplanned_stops(track, self.plans, terms, self.params)

    def astray(self, track: DataFrame) -> DataFrame:
        return conditions.route_deviations(track, self.plans, self.params)

    def late(self) -> DataFrame:
        ship = F.col("shipment_id")
        arrivals = self.staged_visits.select(
            ship,
            lane_code(ship).alias("lane"),
            "stop_id",
            F.col("arrived_us").alias("occurred_us"),
            ids.arrival_id(ship, F.col("stop_id"), F.col("arrived_us")).alias("event_id"),
        )
        estimates = self.staged_estimates.withColumn("lane", lane_code(ship))
        return conditions.late_arrivals(estimates, arrivals, self.staged_terms, self.finals, self.params)

    @cached_property
    def statuses(self) -> DataFrame:
        """Status events of all feeds: shipment_id, occurred_us, event_id."""
        return ingest.events(self.feed_rows).where("type = 'status'").select("shipment_id", "occurred_us", "event_id")

    @cached_property
    def staged_sightings(self) -> DataFrame:
        """When each shipment was heard from, by any kind of event."""
        visited = geofence.visit_events(self.staged_visits)
        return stage(conditions.sightings(self.staged_track, self.statuses, visited, self.staged_estimates, params=self.params), "sightings")

    def quiet(self) -> DataFrame:
        return conditions.signal_loss(self.staged_sightings, self.completions, self.staged_terms, self.params)

    @cached_property
    def incidents(self) -> DataFrame:
        track, terms = self.staged_track, self.staged_terms
        parts = [self.excursions(track, terms), self.idle(track, terms), self.astray(track), self.late(), self.quiet()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def staged_incidents(self) -> DataFrame:
        return stage(self.incidents, "incidents")

    @cached_property
    def summary(self) -> DataFrame:
        return fleet_plan.summary(
            positions.current_position(self.staged_track), self.plans, self.staged_visits, self.staged_estimates,
            self.staged_incidents, F.lit(NOW_US).cast("bigint"), self.params,
        )


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded to what two math libraries agree on."""
    return df.withColumns({c: round_half_up(F.col(c), places) for c, t in df.dtypes if t == "double"})
