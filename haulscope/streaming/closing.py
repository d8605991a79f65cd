"""When the files of the archive are closed, as a stream.

Records land as they come, one folder for each micro-batch. What is held between batches is only how much of each topic
and hour has landed and not been written: one row per (topic, hour, partition), with the number of the file it belongs
to, bytes, records, the lowest offset and the instant of the last record. After each batch a file is closed when

* its hour is over and nothing has come for the quiet period,
* it has outgrown ``max_file_bytes``, or
* all open files together exceed ``max_open_bytes``: the oldest hours go until they no longer do.

A closed file is written from the folders of the batches it spans. A batch that brings more of one hour than a file may
hold is written as several files by several tasks, so a hot topic is not one task. The clock is the newest ``heard_us``;
a row without a topic only moves it, so a ticking source closes the files of topics that fell silent.

Every batch reads the held tables of the batch before it and replaces its own, so one that is run again after a crash
writes the same files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from haulscope.functions.timeparts import HOUR_US, hour_start_us
from haulscope.plans import archive

OPEN_SCHEMA = (
    "topic string, hour_us bigint, partition int, file int, records bigint, bytes bigint, last_us bigint, lowest bigint, "
    "first_batch bigint, last_batch bigint"
)
NEXT_SCHEMA = "topic string, partition int, next_offset bigint"
CLOSED_SCHEMA = "topic string, hour_us bigint, file int, records bigint, bytes bigint, last_us bigint, first_batch bigint, last_batch bigint, reason string"
CLOCK_SCHEMA = "now_us bigint"


@dataclass(frozen=True)
class Policy:
    # One minute of quiet, 32 MB a file, 96 MB open.
    quiet_us: int = 60_000_000
    max_file_bytes: int = 32 << 20
    max_open_bytes: int = 96 << 20


def record_bytes() -> Column:
    """Size of a record: its key and value before compression."""
    return (F.octet_length(F.coalesce("key", F.lit(""))) + F.octet_length(F.coalesce("value", F.lit("")))).cast("bigint")


def arrived(batch: DataFrame, batch_id: int) -> DataFrame:
    """What one batch adds to each topic, hour and partition; records that are replays add nothing."""
    sized = archive.skip_replayed(batch.where("topic IS NOT NULL")).withColumn("hour_us", hour_start_us(F.col("timestamp_us")))
    return sized.groupBy("topic", "hour_us", "partition").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(record_bytes()).alias("bytes"),
        F.max("heard_us").alias("last_us"),
        F.min("offset").alias("lowest"),
        F.lit(batch_id).cast("bigint").alias("first_batch"),
        F.lit(batch_id).cast("bigint").alias("last_batch"),
    )


def opened(held: DataFrame, new: DataFrame, files_before: DataFrame) -> DataFrame:
    """Open files after ``new`` rows went into them; an hour whose files are all closed gets its next number."""
    started = files_before.groupBy("topic", "hour_us").agg(F.max("file").alias("closed"))
    numbered = new.join(started, ["topic", "hour_us"], "left").withColumn("file", F.coalesce(F.col("closed") + 1, F.lit(0)))
    both = held.unionByName(numbered.select(*held.columns))
    return both.groupBy("topic", "hour_us", "partition", "file").agg(
        F.sum("records").alias("records"),
        F.sum("bytes").alias("bytes"),
        F.max("last_us").alias("last_us"),
        F.min("lowest").alias("lowest"),
        F.min("first_batch").alias("first_batch"),
        F.max("last_batch").alias("last_batch"),
    )


def judged(open_rows: DataFrame, now_us: Column, policy: Policy, shutdown: bool = False) -> DataFrame:
    """Open files with the reason to close them now, null for those that stay open.

    The order over all open files is that of a table with a row per topic and open hour, not of records.
    """
    files = open_rows.groupBy("topic", "hour_us", "file").agg(
        F.sum("records").alias("records"),
        F.sum("bytes").alias("bytes"),
        F.max("last_us").alias("last_us"),
        F.min("first_batch").alias("first_batch"),
        F.max("last_batch").alias("last_batch"),
    )
    over = (F.col("hour_us") + HOUR_US <= now_us) & (F.col("last_us") + policy.quiet_us <= now_us)
    own = F.when(over, "quiet").when(F.col("bytes") >= policy.max_file_bytes, "size")
    files = files.withColumn("own", own)
    kept = F.when(F.col("own").isNull(), F.col("bytes")).otherwise(0)
    oldest = Window.orderBy("hour_us", "topic", "file").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # bytes still open when the turn comes to this file
    files = files.withColumn("left_open", F.sum(kept).over(oldest))
    last = F.lit("shutdown" if shutdown else None).cast("string")
    reason = F.coalesce("own", F.when(F.col("left_open") > policy.max_open_bytes, "buffer"), last)
    return files.withColumn("reason", reason).drop("own", "left_open")


def next_offsets(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The offset to read next in each partition; records that are passed over count as read."""
    seen = batch.where("topic IS NOT NULL").select("topic", "partition", (F.col("offset") + 1).alias("next_offset"))
    return held.unionByName(seen).groupBy("topic", "partition").agg(F.max("next_offset").alias("next_offset"))


def committable(open_rows: DataFrame, reached: DataFrame) -> DataFrame:
    """How far everything is in closed files: the lowest offset still open, or the next to be read."""
    waiting = open_rows.groupBy("topic", "partition").agg(F.min("lowest").alias("lowest"))
    return reached.join(waiting, ["topic", "partition"], "left").select(
        "topic", "partition", F.least("next_offset", "lowest").alias("committable")
    )


class ArchiveCloser:
    """foreachBatch sink. ``path`` gets ``landing``, ``files`` (the archive), ``closed``, and two slots of held tables."""

    def __init__(self, path: str, policy: Policy = Policy()):
        self.path, self.policy = path, policy

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        landed = f"{self.path}/landing/batch={batch_id}"
        batch.write.mode("overwrite").parquet(landed)
        self._step(batch.sparkSession.read.schema(batch.schema).parquet(landed), batch_id)

    def shut_down(self, spark: SparkSession, after: int) -> None:
        """Close every file left open after batch ``after``, as its own step."""
        none = spark.read.schema("topic string, `partition` int, `offset` bigint, timestamp_us bigint, `key` string, value string, "
                                 "headers array<struct<key:string,value:binary>>, heard_us bigint").parquet(f"{self.path}/landing")  # fmt: skip
        self._step(none.where("false"), after + 1, shutdown=True)

    def held(self, spark: SparkSession, batch_id: int, table: str, schema: str) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/slot={batch_id % 2}/{table}")

    def closed(self, spark: SparkSession, before: int) -> DataFrame:
        """Files closed by the batches before ``before``, with the batch that closed each."""
        if before <= 0:
            return spark.createDataFrame([], f"{CLOSED_SCHEMA}, batch bigint")
        return spark.read.schema(f"{CLOSED_SCHEMA}, batch bigint").parquet(f"{self.path}/closed").where(F.col("batch") < before)

    def committable(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return committable(self.held(spark, batch_id, "open", OPEN_SCHEMA), self.held(spark, batch_id, "next", NEXT_SCHEMA))

    def _step(self, rows: DataFrame, batch_id: int, shutdown: bool = False) -> None:
        spark, slot = rows.sparkSession, f"{self.path}/slot={batch_id % 2}"
        before = self.held(spark, batch_id - 1, "open", OPEN_SCHEMA)
        clock = rows.select(F.max("heard_us").alias("now_us")).unionByName(self.held(spark, batch_id - 1, "clock", CLOCK_SCHEMA))
        clock.agg(F.max("now_us").alias("now_us")).coalesce(1).write.mode("overwrite").parquet(f"{slot}/clock")
        now = self.held(spark, batch_id, "clock", CLOCK_SCHEMA).select("now_us").scalar()

        held = opened(before, arrived(rows, batch_id), self.closed(spark, batch_id))
        told = f"{self.path}/judged/batch={batch_id}"
        held.write.mode("overwrite").parquet(f"{told}/rows")
        held = spark.read.schema(OPEN_SCHEMA).parquet(f"{told}/rows")
        closing = judged(held, now, self.policy, shutdown).where("reason IS NOT NULL")
        closing.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch_id}")
        closing = spark.read.schema(CLOSED_SCHEMA).parquet(f"{self.path}/closed/batch={batch_id}")
        held.join(closing, ["topic", "hour_us", "file"], "left_anti").coalesce(1).write.mode("overwrite").parquet(f"{slot}/open")
        next_offsets(self.held(spark, batch_id - 1, "next", NEXT_SCHEMA), rows).coalesce(1).write.mode("overwrite").parquet(f"{slot}/next")
        self._write_files(spark, rows.schema, closing, batch_id)

    def _write_files(self, spark: SparkSession, schema, closing: DataFrame, batch_id: int) -> None:
        """The records of the closing files: one task a file, several for an hour that holds more than a file may."""
        first = closing.agg(F.min("first_batch")).first()[0]
        if first is None:
            return
        landing = spark.read.schema(schema).parquet(f"{self.path}/landing")
        # folders before the oldest open record are not read
        rows = archive.skip_replayed(landing.where((F.col("batch") >= first) & F.col("topic").isNotNull()))
        rows = rows.withColumn("hour_us", hour_start_us(F.col("timestamp_us"))).withColumn("landed", F.col("batch").cast("bigint")).drop("batch")
        pieces = F.greatest(F.ceil(F.col("bytes") / self.policy.max_file_bytes), F.lit(1))
        wanted = closing.select("topic", "hour_us", "file", "first_batch", "last_batch", pieces.alias("pieces"))
        chosen = rows.join(wanted, ["topic", "hour_us"]).where("landed BETWEEN first_batch AND last_batch")
        piece = F.pmod(F.xxhash64("partition", "offset"), F.col("pieces"))
        dealt = archive.layout(chosen).withColumn("piece", piece).repartition("topic", "hour_us", "piece")
        (
            archive.slim(dealt)
            .write.mode("overwrite")
            .partitionBy("topic", "dt", "hour")
            .option("compression", "gzip")
            .json(f"{self.path}/files/batch={batch_id}")
        )
