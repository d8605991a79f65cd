"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r between 0 and ``CAP``: how often the mix takes it. Among all rates that give each
source its target number of words, those closest to 1 in relative entropy (with the cap as upper bound) are

    r(x) = CAP * e^(t x) / (CAP - 1 + e^(t x)),   x = words / mean words of the source,

an exponential tilt with one dual variable t per source. The dual is convex; Newton steps, kept inside a
bracket, solve it for all sources at once. As r depends on the size only, the steps run on the table of
(source, size, number of documents): that is pre-aggregated before it is shuffled, so a source with a third of
all documents costs no more than another, and no document moves during the iteration.

Rates become whole copies by error feedback: within a bounded slice of a source, in falling order of size, each
document takes the number of copies that brings the words taken closest to the words due so far, so a slice
misses its share by about half its smallest documents.

Defined results: a null text counts 0 words; a document of 0 words is taken 0 times and adds nothing; the null
source is a source of its own, last in order; a source of 0 words has target 0; equal rows are treated alike but
separately, and an empty table gives an empty result. Columns of the input are carried along untouched; those
that clash with a column made here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from haulscope.llm.common import global_rank, table, word_count
from haulscope.session import stage

CAP = 3  # a document is taken at most so often, and a source's target stops at so many times its size
WEIGHTS = (5, 2, 1)
SLICE = 4000  # documents that one rounding task sees together
STEPS = 60  # Newton steps at most; bracketed, so that many halve the bracket below double precision
CLOSE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size, more) with each source's target.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a target stops at ``cap``
    times its source's size, and the excess is shared again by weight until no target is above.
    """
    ranked = global_rank(sizes, [F.col("source").isNull(), F.col("source")], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    shares = stage(ranked.withColumn("weight", weight.cast("double")).drop("_rank"), "weights")
    level = -1.0
    while True:
        # words per unit of weight for the sources that are not at their cap at the present level
        capped = F.col("weight") * F.lit(level) > cap * F.col("source_size")
        total, fixed, free = shares.agg(
            F.sum("source_size"),
            F.sum(F.when(capped, cap * F.col("source_size")).otherwise(0)),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))),
        ).first()
        after = (total - fixed) / free if free else 0.0
        if after <= level or not free:
            break
        level = after
    target = F.least(F.col("weight") * F.lit(level), (cap * F.col("source_size")).cast("double"))
    return shares.withColumn("target", target).drop("weight")


def _rate(tilt: Column, x: Column, cap: int) -> Column:
    """The tilted rate, written so that neither sign of a large exponent overflows."""
    z = tilt * x
    return F.when(z > 0, F.lit(float(cap)) / (1 + (cap - 1) * F.exp(-z))).otherwise(
        cap * F.exp(z) / (cap - 1 + F.exp(z))
    )


def tilts(histogram: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """(source_key, mean, tilt, full) by Newton steps on the dual of (source_key, size, docs), sizes above 0.

    ``full`` marks sources whose target is the cap itself: every document is taken ``cap`` times.
    """
    means = histogram.groupBy("source_key").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"))
    dual = stage(
        targets.where("source_size > 0")
        .join(means, "source_key")
        .select(
            "source_key",
            "mean",
            "target",
            (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("tilt"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
        ),
        "dual",
    )
    points = stage(histogram, "sizes")
    x = F.col("size") / F.col("mean")
    r = _rate(F.col("tilt"), x, cap)
    for _ in range(STEPS):
        at = (
            points.join(dual.where("NOT full"), "source_key")
            .groupBy("source_key")
            .agg(
                F.sum(F.col("docs") * F.col("size") * r).alias("words"),
                F.sum(F.col("docs") * F.col("size") * x * r * (1 - r / cap)).alias("slope"),
            )
        )
        gap = F.col("words") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (low.isNull() | (step > low)) & (high.isNull() | (step < high))
        # without a bracket on one side walk outwards by doubling, else halve it
        outside = F.when(low.isNull(), 2 * high - 1).when(high.isNull(), 2 * low + 1).otherwise((low + high) / 2)
        settled = gap.isNull() | (F.abs(gap) <= CLOSE * F.col("target"))
        after = F.when(settled, F.col("tilt")).when(inside, step).otherwise(outside)
        moved = stage(
            dual.join(at, "source_key", "left").select(
                "source_key", "mean", "target", "full", after.alias("tilt"), low.alias("low"), high.alias("high"),
                settled.alias("settled"),
            ),
            "dual",
        )
        dual = moved.drop("settled")
        if moved.where("NOT settled").isEmpty():
            break
    # sums of doubles depend on the order of tasks in their last bits; rounded, reruns agree
    return dual.select("source_key", "mean", F.round("tilt", 9).alias("tilt"), "full")


def _copies(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Error feedback over slices; a partition is sorted by slice and, inside it, by size (falling)."""
    key, due, got = None, 0.0, 0
    for batch in batches:
        copies = []
        columns = (batch.column(c).to_pylist() for c in ("_slice", "size", "rate"))
        for slice_, size, rate in zip(*columns):
            if slice_ != key:
                key, due, got = slice_, 0.0, 0
            n = 0
            if size:
                due += rate * size
                n = min(cap, max(0, round((due - got) / size)))
                got += n * size
            copies.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies, pa.int32())], [*batch.schema.names, "copies"])


def mix(
    docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, slice_rows: int = SLICE
) -> DataFrame:
    """Each row of ``docs`` (doc_id, source, text) with size, source_size, target, rate (before rounding) and copies.

    Select the columns wanted before the call, as all of them travel; where ``size`` is given, ``text`` need not be
    among them.
    """
    docs = docs.withColumn("size", word_count(F.col("text")) if size is None else size)
    docs = docs.drop("source_size", "target", "rate", "copies", "source_key", "_slice")
    # null apart from every text
    docs = docs.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    histogram = stage(docs.groupBy("source", "source_key", "size").agg(F.count("*").alias("docs")), "histogram")
    sizes = histogram.groupBy("source", "source_key").agg(
        F.sum(F.col("size") * F.col("docs")).cast("long").alias("source_size"), F.sum("docs").alias("source_docs")
    )
    targets = stage(source_targets(sizes, weights, cap), "targets")
    dual = tilts(histogram.where("size > 0").select("source_key", "size", "docs"), targets, cap)
    known = stage(targets.drop("source").join(dual, "source_key", "left"), "solved")
    rate = (
        F.when(F.col("size") == 0, 0.0)
        .when(F.col("full"), float(cap))
        .otherwise(_rate(F.col("tilt"), F.col("size") / F.col("mean"), cap))
    )
    slices = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / slice_rows))
    rated = (
        docs.join(known, "source_key")
        .withColumn("rate", rate)
        .withColumn("_slice", F.concat("source_key", F.lit("/"), F.pmod(F.xxhash64("doc_id"), slices).cast("string")))
        .drop("source_docs", "mean", "tilt", "full", "source_key")
    )
    schema = T.StructType([*rated.schema.fields, T.StructField("copies", T.IntegerType())])
    return (
        rated.repartition("_slice")
        .sortWithinPartitions("_slice", F.desc("size"), F.xxhash64("doc_id"), "doc_id")
        .mapInArrow(lambda batches: _copies(batches, cap), schema)
        .drop("_slice")
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, sources weighing 5, 2, 1 in turn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mix(docs, F.col("words")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate"
    )
