"""Comparing what was produced with what was kept, and measuring how fast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from haulscope.functions.timeparts import int_div
from haulscope.model.params import MICROS

# Upper bounds of the latency histogram, milliseconds.
LATENCY_BOUNDS_MS = (
    5, 10, 15, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750, 1000, 1500, 2000, 3000, 5000, 7500, 10000, 15000, 20000,
    30000, 60000, 120000, 300000,
)
BEYOND_MS = 2**31  # the unbounded last bucket


def distinct_ids(df: DataFrame) -> DataFrame:
    return df.select("event_id").distinct()


def repeated_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("event_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def except_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("event_id").join(right.select("event_id"), "event_id", "left_anti").distinct()


def compare_ids(produced: DataFrame, persisted: DataFrame) -> DataFrame:
    """How often every id occurs on each side: one aggregation of the union instead of a full outer join."""
    rows = produced.select("event_id", F.lit(1).alias("p"), F.lit(0).alias("s")).unionByName(
        persisted.select("event_id", F.lit(0).alias("p"), F.lit(1).alias("s"))
    )
    return rows.groupBy("event_id").agg(F.sum("p").alias("produced"), F.sum("s").alias("persisted"))


def reconcile(produced: DataFrame, persisted: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """Missing, unexpected and repeatedly stored ids; passes when nothing is missing, unexpected or dead-lettered."""
    report = compare_ids(produced, persisted).agg(
        F.coalesce(F.sum("produced"), F.lit(0)).alias("records"),
        F.count_if(F.col("produced") > 0).alias("distinct_produced"),
        F.count_if(F.col("persisted") > 0).alias("distinct_persisted"),
        F.count_if((F.col("produced") > 0) & (F.col("persisted") == 0)).alias("missing"),
        F.count_if((F.col("produced") == 0) & (F.col("persisted") > 0)).alias("unexpected"),
        F.count_if(F.col("persisted") > 1).alias("stored_twice"),
    )
    dead = dead_letters.agg(F.count(F.lit(1)).alias("n")).scalar()
    return report.withColumn("dead_lettered", dead).withColumn(
        "passed", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("dead_lettered") == 0)
    )


def latency_histogram(df: DataFrame) -> DataFrame:
    """Counts by the smallest bound the latency fits; bounds are irregular, so no width_bucket."""
    millis = F.greatest(F.lit(0).cast("bigint"), int_div(F.col("stored_us") - F.col("received_us"), 1000))
    bounds = F.array(*[F.lit(b).cast("bigint") for b in LATENCY_BOUNDS_MS])
    bound = F.coalesce(F.array_min(F.filter(bounds, lambda b: b >= millis)), F.lit(BEYOND_MS).cast("bigint"))
    return df.select(bound.alias("le_ms")).groupBy("le_ms").agg(F.count(F.lit(1)).alias("records"))


def histogram_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Difference of two snapshots, or the sum of several pods' histograms via union beforehand."""
    signed = after.unionByName(before.withColumn("records", -F.col("records")))
    return signed.groupBy("le_ms").agg(F.sum("records").alias("records"))


def histogram_percentiles(histogram: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """Upper bound of the first bucket whose cumulative count reaches the quantile, as text in ms.

    The histogram has at most 27 rows, so its order needs no partitioning.
    """
    w = Window.orderBy("le_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulative = histogram.withColumn("upto", F.sum("records").over(w)).withColumn(
        "total", F.sum("records").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    picks = [
        F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("le_ms"))).alias(f"p{round(q * 100)}") for q in quantiles
    ]
    shown = lambda c: F.when(F.col(c) == BEYOND_MS, f">{LATENCY_BOUNDS_MS[-1]}").otherwise(F.col(c).cast("string"))
    return cumulative.agg(*picks).select(*[shown(f"p{round(q * 100)}").alias(f"p{round(q * 100)}_ms") for q in quantiles])


def exact_percentiles(df: DataFrame) -> DataFrame:
    millis = int_div(F.col("stored_us") - F.col("received_us"), 1000)
    # counts per value are what the function keeps, so repeated latencies cost nothing
    return df.agg(F.percentile(millis, [0.5, 0.99]).alias("p"), F.max(millis).alias("max_ms")).select(
        F.col("p")[0].alias("p50_ms"), F.col("p")[1].alias("p99_ms"), "max_ms"
    )


def throughput(df: DataFrame, at: str, seconds: int = 60) -> DataFrame:
    """Records per tumbling window and their rate; largest lag between event and arrival."""
    start = F.col(at) - F.pmod(F.col(at), F.lit(seconds * MICROS))
    return df.groupBy(start.alias("window_us")).agg(
        F.count(F.lit(1)).alias("records"),
        (F.count(F.lit(1)) / float(seconds)).alias("per_second"),
        F.max(int_div(F.col("received_us") - F.col("occurred_us"), MICROS)).alias("max_lag_s"),
    )


def average_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean latency between two counter snapshots (operation, total_ms, operations)."""
    joined = after.alias("a").join(before.alias("b"), "operation", "left")
    ops = F.col("a.operations") - F.coalesce("b.operations", F.lit(0))
    spent = F.col("a.total_ms") - F.coalesce("b.total_ms", F.lit(0.0))
    return joined.select("operation", ops.alias("operations"), F.when(ops > 0, spent / ops).alias("avg_ms"))
