"""Public view of the archive: facts folded hour by hour, held, and read as summaries.

A fact is the newest thing known of a shipment's position, of a stop (arrival and departure apart) or of an incident (raise
and clear apart; either may come alone or first). Newest means the largest (instant, tie), so combining facts is
associative, commutative and idempotent: hours may be folded in any order, together or apart, and again.

Each folded hour of a topic replaces its own partition, of facts and of a ledger with what was counted in it. ``compact``
merges all of them into a base; a reader merges the newest base with the hours from where it ends. Hours before that which
are folded again later show at the next compaction. Nothing held is ever rewritten in place, so a fold or a compaction that
dies is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.functions.text import severity_of_rank, severity_rank
from haulscope.functions.timeparts import int_div, instant_us
from haulscope.model.params import DEFAULT, MICROS, Params
from haulscope.plans import archive

HOUR = ["topic", "dt", "hour"]
FACT = ["shipment_id", "kind", "key"]
PARTS = {
    "position": "at_us bigint, tie bigint, vehicle_id string, lat double, lon double, speed_kph double, received_us bigint",
    "arrived": "at_us bigint, tie bigint",
    "departed": "at_us bigint, tie bigint",
    "raised": "at_us bigint, tie bigint, type string, stop_id string, severity string, detail string, observed double, threshold double",
    "cleared": "at_us bigint, tie bigint, type string, onset_us bigint, resolution string",
}
FACTS = "shipment_id string, kind string, key string, " + ", ".join(f"{n} struct<{s.replace(' ', ':').replace(',:', ',')}>" for n, s in PARTS.items())
LEDGER = "events bigint, skipped bigint, unreadable bigint, facts bigint, newest_received_us bigint"
PARTITIONS = ", topic string, dt string, hour string"


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The fold itself: the largest of each part."""
    return rows.groupBy(*keys).agg(*(F.max(p).alias(p) for p in PARTS))


def hour_facts(events: DataFrame) -> DataFrame:
    """Facts of each hour of a topic from decoded records (``archive.decoded``)."""
    v = lambda name: F.col(f"v.{name}")
    order = [F.col("at_us").alias("at_us"), (-F.col("offset")).alias("tie")]
    made = {
        "position": ("position", [
            v("vehicleId").alias("vehicle_id"), v("position.latitude").alias("lat"), v("position.longitude").alias("lon"),
            v("speedKph").alias("speed_kph"), F.col("timestamp_us").alias("received_us"),
        ]),
        "arrived": ("shipment.arrived", []),
        "departed": ("shipment.departed", []),
        "raised": ("exception.raised", [
            v("exceptionType").alias("type"), v("stopId").alias("stop_id"), v("severity").alias("severity"), v("detail").alias("detail"),
            v("observedValue").alias("observed"), v("thresholdValue").alias("threshold"),
        ]),
        "cleared": ("exception.cleared", [
            v("exceptionType").alias("type"), instant_us(v("raisedAt")).alias("onset_us"), v("resolution").alias("resolution"),
        ]),
    }
    kind = F.when(F.col("kind") == "position", "position").when(F.col("kind").startswith("shipment."), "stop").when(F.col("kind").startswith("exception."), "incident")
    key = F.when(kind == "stop", v("stopId")).when(kind == "incident", v("exceptionId")).otherwise("")
    rows = events.where(kind.isNotNull() & F.col("at_us").isNotNull()).select(
        *HOUR, v("shipmentId").alias("shipment_id"), kind.alias("kind"), key.alias("key"),
        *(F.when(F.col("kind") == told, F.struct(*order, *rest)).alias(part) for part, (told, rest) in made.items()),
    )
    return newest(rows, [*HOUR, *FACT])


def hour_counts(events: DataFrame, facts: DataFrame) -> DataFrame:
    """What an hour held: events, skipped and unreadable records, facts touched, newest record."""
    seen = events.groupBy(*HOUR).agg(
        F.count_if(F.col("kind").isNotNull()).alias("events"),
        F.count_if(F.col("kind").isin(*archive.SKIPPED)).alias("skipped"),
        F.count_if(F.col("kind").isNull()).alias("unreadable"),
        F.max("timestamp_us").alias("newest_received_us"),
    )
    # both halves of a stop's visit are facts of their own, an incident is one
    parts = [F.col(p).isNotNull().cast("bigint") for p in ("position", "arrived", "departed")]
    touched = facts.groupBy(*HOUR).agg(F.sum(sum(parts, (F.col("kind") == "incident").cast("bigint"))).alias("facts"))
    return seen.join(touched, HOUR, "left").fillna(0, ["facts"])


def fold_into(records: DataFrame, path: str) -> None:
    """Fold whole hours of archived records (topic, dt, hour, offset, timestamp_us, value) into the table at ``path``."""
    events = archive.decoded(records)
    replaced = lambda df, name: (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*HOUR).parquet(f"{path}/{name}")
    )
    replaced(hour_facts(events), "facts")
    held = events.sparkSession.read.schema(FACTS + PARTITIONS).parquet(f"{path}/facts")
    # what was counted goes last: an hour is folded once its ledger says so
    replaced(hour_counts(events, held.join(events.select(*HOUR).distinct(), HOUR, "left_semi")), "ledger")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER + PARTITIONS).parquet(f"{path}/ledger")


def _base(spark: SparkSession, path: str) -> tuple[int, str]:
    """Version and end of the newest whole base; (0, "") without one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bases")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return 0, ""
    row = spark.read.schema("version int, through string").parquet(f"{path}/bases").agg(F.max(F.struct("version", "through"))).first()[0]
    return (row.version, row.through) if row else (0, "")


def held_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row per fact, whenever and however often its hours were folded."""
    version, through = _base(spark, path)
    hours = spark.read.schema(FACTS + PARTITIONS).parquet(f"{path}/facts").where(F.concat_ws(" ", "dt", "hour") >= through)
    rows = hours.drop(*HOUR)
    if version:
        rows = rows.unionByName(spark.read.schema(FACTS).parquet(f"{path}/base/version={version}"))
    return newest(rows, FACT)


def compact(spark: SparkSession, path: str, through: str) -> None:
    """Merge all that is held into a new base; hours from ``through`` ('yyyy-MM-dd HH') on go on being read apart."""
    version = _base(spark, path)[0]
    every = spark.read.schema(FACTS + PARTITIONS).parquet(f"{path}/facts").drop(*HOUR)
    if version:
        every = every.unionByName(spark.read.schema(FACTS).parquet(f"{path}/base/version={version}"))
    newest(every, FACT).write.mode("overwrite").parquet(f"{path}/base/version={version + 1}")
    spark.createDataFrame([(version + 1, through)], "version int, through string").write.mode("append").parquet(f"{path}/bases")


# --- views ---------------------------------------------------------------------------------------


def incidents(held: DataFrame) -> DataFrame:
    """Every incident; a clear alone knows its onset, a raise alone is open."""
    rows = held.where("kind = 'incident'")
    return rows.select(
        F.col("key").alias("exception_id"),
        "shipment_id",
        F.coalesce("raised.type", "cleared.type").alias("type"),
        F.col("raised.stop_id").alias("stop_id"),
        F.col("raised.severity").alias("severity"),
        F.col("raised.detail").alias("detail"),
        F.col("raised.observed").alias("observed_value"),
        F.col("raised.threshold").alias("threshold_value"),
        F.coalesce("raised.at_us", "cleared.onset_us").alias("onset_us"),
        F.col("cleared.at_us").alias("cleared_us"),
        F.col("cleared.resolution").alias("resolution"),
        F.when(F.col("cleared").isNull(), "OPEN").otherwise("CLEARED").alias("state"),
    )


def recent_incidents(held: DataFrame, open_only: bool = False, limit: int | None = None, params: Params = DEFAULT) -> DataFrame:
    """Newest onset first; the limit is clamped to 1..1000."""
    wanted = min(1000, max(1, limit if limit is not None else params.incident_limit))
    rows = incidents(held)
    rows = rows.where("state = 'OPEN'") if open_only else rows
    return rows.orderBy(F.col("onset_us").desc_nulls_last(), "exception_id").limit(wanted)


def _visits(plan: Column, facts: Column) -> Column:
    """Planned stops in order with the visits of the current journey: what precedes the origin's arrival is an earlier one's."""
    started = F.get(F.transform(plan, lambda s: F.try_element_at(facts, s["stop_id"])["arrived_us"]), F.lit(0))

    def visit(s: Column) -> Column:
        f = F.try_element_at(facts, s["stop_id"])
        arrived = F.when(~F.coalesce(f["arrived_us"] < started, F.lit(False)), f["arrived_us"])
        departed = F.when(f["departed_us"] >= arrived, f["departed_us"])
        status = F.when(arrived.isNull(), "PENDING").when(departed.isNull(), "AT").otherwise("DEPARTED")
        return F.struct(s["stop_id"].alias("stop_id"), arrived.alias("arrived_us"), departed.alias("departed_us"), status.alias("status"))

    return F.transform(plan, visit)


def summary(held: DataFrame, itineraries: DataFrame, now_us: Column, params: Params = DEFAULT) -> DataFrame:
    """One row per shipment that has ever shown a position, most troubled first.

    ``itineraries``: shipment_id and ``stops`` (planned stops in order). One pass over the facts: of a shipment only its
    position, its stops and its open incidents are gathered, each bounded by its plan; closed incidents are not.
    """
    rank = severity_rank(F.col("raised.severity"))
    is_open = (F.col("kind") == "incident") & F.col("cleared").isNull()
    # most severe first, then the oldest, without an onset last
    trouble = F.struct(
        (-rank).alias("order"), F.col("raised.at_us").isNull().alias("unknown"), F.col("raised.at_us").alias("onset_us"), F.col("key").alias("exception_id"),
        F.col("raised.type").alias("type"), F.col("raised.stop_id").alias("stop_id"),
    )
    stop = F.struct(F.col("key"), F.struct(F.col("arrived.at_us").alias("arrived_us"), F.col("departed.at_us").alias("departed_us")).alias("f"))
    known = held.groupBy("shipment_id").agg(
        F.max("position").alias("p"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "stop", stop))).alias("facts"),
        F.sort_array(F.collect_list(F.when(is_open, trouble))).alias("open"),
    )
    rows = known.where("p IS NOT NULL").join(itineraries.select("shipment_id", "stops"), "shipment_id", "left")
    rows = rows.withColumn("visits", F.coalesce(_visits(F.col("stops"), F.col("facts")), F.array()))
    at = F.get(F.filter("visits", lambda s: s["status"] == "AT"), F.lit(0))
    done = F.size(F.filter("visits", lambda s: s["arrived_us"].isNotNull()))
    total = F.size("visits")
    movement = (
        F.when((total > 0) & (done == total), "DELIVERED")
        .when(at.isNotNull(), "AT_STOP")
        .when(F.col("p.speed_kph") >= params.moving_kph, "MOVING")
        .otherwise("STOPPED")
    )
    worst = F.get("open", F.lit(0))
    return rows.select(
        "shipment_id",
        "p.vehicle_id",
        F.col("p.at_us").alias("occurred_us"),
        "p.received_us",
        F.greatest(F.lit(0).cast("bigint"), int_div(now_us - F.col("p.received_us"), MICROS)).alias("stale_s"),
        "p.lat",
        "p.lon",
        "p.speed_kph",
        movement.alias("movement"),
        at["stop_id"].alias("at_stop_id"),
        at["arrived_us"].alias("at_since_us"),
        done.cast("bigint").alias("stops_completed"),
        total.cast("bigint").alias("stops_total"),
        F.size("open").cast("bigint").alias("open_incidents"),
        F.array_join(F.transform("open", lambda i: F.concat_ws(":", i["type"], F.coalesce(i["stop_id"], F.lit("-")))), ",").alias("open_types"),
        severity_of_rank(-worst["order"]).alias("worst_severity"),
    ).orderBy(F.coalesce(worst["order"], F.lit(1)), "shipment_id")


def meta(held: DataFrame, counted: DataFrame) -> DataFrame:
    """Shipments with a position, open incidents, and how far the archive goes."""
    is_open = (F.col("kind") == "incident") & F.col("cleared").isNull()
    tracked = F.count_if((F.col("kind") == "position") & F.col("position").isNotNull())
    return held.agg(tracked.alias("tracked"), F.count_if(is_open).alias("open_incidents")).withColumns(
        {"source": F.lit("archive"), "through_us": counted.agg(F.max("newest_received_us")).scalar()}
    )
