"""Ordered computations over long tracks, cut into time slices.

A plain window partitioned by shipment puts a whole track into one task, and one shipment may own a
third of all rows. Every operator here works in three steps instead:

1. inside a slice (key columns + time bucket): ordinary windows, one task per slice;
2. across slices: one summary row per slice, combined in slice order. A key has at most
   (time span / slice width + rows / rows of a full slice) of these;
3. back on the rows: the state each slice starts with is joined on (key, slice), the partitioning
   the rows already have.

Results equal those of the plain window.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from haulscope.functions.timeparts import int_div
from haulscope.model.params import MICROS

SLICE = "slice"


def slice_start(at: str, seconds: int) -> Column:
    """Second at which the slice of fixed width begins; slices are named by it, whatever their width."""
    return int_div(F.col(at), seconds * MICROS) * seconds


def with_slice(df: DataFrame, at: str, seconds: int) -> DataFrame:
    return df.withColumn(SLICE, slice_start(at, seconds))


SMALL = 100_000  # crowded slices whose cuts every task may hold


def bounded(df: DataFrame, keys: Sequence[str], at: str, seconds: int, most: int) -> DataFrame:
    """Slices of at most ``seconds`` and about ``most`` rows: a slice that holds more is cut at seconds of its own.

    A first pass counts rows per key and slice. Where some are crowded, a second one counts these by second, and a slice
    ends before the second that would fill it beyond ``most``; rows of one second, and so of one instant, stay together.
    ``df`` is read again by each pass. The cuts of up to SMALL slices go to every task; beyond that they are joined.
    """
    keys = list(keys)
    sliced = with_slice(df, at, seconds)
    crowded = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n")
    found = crowded.limit(SMALL + 1).count()
    if not found:
        return sliced
    second = int_div(F.col(at), MICROS)
    counted = sliced.join(_sized(crowded, found), [*keys, SLICE], "left_semi").groupBy(*keys, SLICE, second.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    state = lambda held, starts: F.struct(held.alias("held"), starts.alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["held"] > 0) & (acc["held"] + x["_n"] > most)
        return F.when(full, state(x["_n"], F.concat(acc["starts"], F.array(x["_s"])))).otherwise(state(acc["held"] + x["_n"], acc["starts"]))

    first = state(F.lit(0).cast("bigint"), F.array().cast("array<bigint>"))
    cuts = counted.groupBy(*keys, SLICE).agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("_s", "_n"))), first, step, lambda acc: acc["starts"]).alias("_cuts")
    )
    joined = sliced.join(_sized(cuts, found), [*keys, SLICE], "left")
    own = F.array_max(F.filter("_cuts", lambda c: c <= second))
    return joined.withColumn(SLICE, F.coalesce(own, F.col(SLICE))).select(*df.columns, SLICE)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _local(keys: Sequence[str], order: Sequence[Column | str]):
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    return (
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        w.rowsBetween(Window.unboundedPreceding, -1),
    )


def _across(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def spread(dim: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One copy of each per-key row for every slice of that key.

    Joining facts to it on (key, slice) spreads a hot key over all its slices.
    """
    return facts.select(*keys, SLICE).distinct().join(dim, list(keys))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str, total: str) -> DataFrame:
    """1-based row number in ``order``, nulls last, within the keys, and the number of rows of the keys.

    Rows without a slice count, as the last ones, but do not come back.
    """
    sizes = df.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(F.col(SLICE).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(total),
    )
    w = Window.partitionBy(*keys, SLICE).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return (
        df.withColumn("_rn", F.row_number().over(w).cast("bigint"))
        .join(offsets, [*keys, SLICE])
        .withColumn(number, F.col("_rn") + F.col("_before"))
        .drop("_rn", "_before")
    )


def previous(df: DataFrame, keys: Sequence[str], at: str, columns: dict[str, str]) -> DataFrame:
    """For each ``new: old`` the value of ``old`` on the row before in ``at`` order."""
    packed = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    w = Window.partitionBy(*keys, SLICE).orderBy(at)
    ends = df.groupBy(*keys, SLICE).agg(F.max_by(packed, F.col(at)).alias("_end"))
    entering = ends.select(
        *keys, SLICE, F.lag("_end").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_enter")
    )
    out = df.withColumn("_before", F.lag(packed).over(w)).join(entering, [*keys, SLICE])
    chosen = F.coalesce(F.col("_before"), F.col("_enter"))
    return out.withColumns({new: chosen[new] for new in columns}).drop("_before", "_enter")


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Largest ``value`` on the rows strictly before, in ``order``."""
    _, before = _local(keys, order)
    tops = df.groupBy(*keys, SLICE).agg(F.max(value).alias("_top"))
    entering = tops.select(*keys, SLICE, F.max("_top").over(_across(keys)).alias("_enter"))
    return (
        df.withColumn("_seen", F.max(value).over(before))
        .join(entering, [*keys, SLICE])
        .withColumn(name, F.greatest("_seen", "_enter"))
        .drop("_seen", "_enter")
    )


def label_runs(df: DataFrame, keys: Sequence[str], at: str, label: str, initial: str) -> DataFrame:
    """Side each row is on, where a null ``label`` keeps the side of the row before.

    Adds ``side`` and ``prev_side``, and for both the instant their run began: ``run_start`` and
    ``prev_run_start``. The side before the first label is ``initial``, whose run has no start.
    ``at`` must be unique within the keys.
    """
    upto, before = _local(keys, [at])
    local = df.withColumn("_cur", F.last(label, True).over(upto)).withColumn("_prev", F.last(label, True).over(before))
    turned = F.col(label).isNotNull() & F.col("_prev").isNotNull() & (F.col(label) != F.col("_prev"))
    known = F.when(F.col(label).isNotNull(), F.col(at))
    summary = local.groupBy(*keys, SLICE).agg(
        F.min_by(label, known).alias("_first"),
        F.min(known).alias("_first_at"),
        F.max_by(label, known).alias("_last"),
        F.max(F.when(turned, F.col(at))).alias("_turn_at"),
    )
    across = _across(keys)
    entering = (
        summary.withColumn("_enter", F.coalesce(F.last("_last", True).over(across), F.lit(initial)))
        .withColumn(
            "_start",
            F.coalesce("_turn_at", F.when(F.col("_first") != F.col("_enter"), F.col("_first_at"))),
        )
        .withColumn("_enter_start", F.last("_start", True).over(across))
        .select(*keys, SLICE, "_enter", "_enter_start")
    )
    return (
        local.join(entering, [*keys, SLICE])
        .withColumn("side", F.coalesce("_cur", "_enter"))
        .withColumn("prev_side", F.coalesce("_prev", "_enter"))
        .withColumn("_turn", F.when(F.col("side") != F.col("prev_side"), F.col(at)))
        .withColumn("run_start", F.coalesce(F.last("_turn", True).over(upto), F.col("_enter_start")))
        .withColumn("prev_run_start", F.coalesce(F.last("_turn", True).over(before), F.col("_enter_start")))
        .drop("_cur", "_prev", "_enter", "_enter_start", "_turn")
    )


# --- greedy chains -------------------------------------------------------------------------------
#
# "Keep a row when its value lies at least `threshold` from the value last kept" depends on every
# earlier decision. As a function of the value kept before a slice, though, what a slice does is a
# short table: the entering values split into ranges, each with the value kept last when the slice
# ends; a middle range is left alone by all rows. Those tables are computed per slice, chained in
# slice order, and each slice is then decided with its true entering value.


def _chain_table(values: np.ndarray, threshold: int):
    """Ranges (from, to, leaving value) of entering values, and the leaving value where nothing was kept before."""
    values = values.tolist()
    n = len(values)
    leaving = [0] * n
    # Of the rows behind i, only those that exceed all between can be the first at or above a bound, and only those below
    # all between the first at or below one. Both are stacks with the nearest row on top, in order of value.
    above, above_at = [], []  # falling towards the top, held as negative numbers
    under, under_at = [], []  # rising towards the top
    for i in range(n - 1, -1, -1):
        v = values[i]
        over = bisect_right(above, -(v + threshold)) - 1
        below = bisect_right(under, v - threshold) - 1
        first = min(above_at[over] if over >= 0 else n, under_at[below] if below >= 0 else n)
        leaving[i] = leaving[first] if first < n else v
        while above and -above[-1] <= v:
            above.pop()
            above_at.pop()
        above.append(-v)
        above_at.append(i)
        while under and under[-1] >= v:
            under.pop()
            under_at.pop()
        under.append(v)
        under_at.append(i)
    low, high = -(2**62), 2**62
    pieces: list[tuple[int, int, int]] = []
    for i in range(n):
        inner_low, inner_high = values[i] - threshold + 1, values[i] + threshold - 1
        if low < inner_low:
            pieces.append((low, min(high, inner_low - 1), leaving[i]))
            low = inner_low
        if high > inner_high and low <= high:
            pieces.append((max(low, inner_high + 1), high, leaving[i]))
            high = inner_high
        if low > high:
            break
    return pieces, leaving[0]


def _record_batch(rows: list[tuple], kind: T.StructType) -> pa.RecordBatch:
    names = [f.name for f in kind.fields]
    types = [_ARROW[f.dataType.simpleString()] for f in kind.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}


def _runs_of_keys(batches, keys: Sequence[str], value: str):
    """(key, values) per group of sorted Arrow batches; a group may cross batch borders."""
    held_key, held = None, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        values = batch.column(value).to_numpy(zero_copy_only=False)
        ids = list(zip(*columns))
        start = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[start]:
                if held and ids[start] != held_key:
                    yield held_key, np.concatenate(held)
                    held = []
                held_key = ids[start]
                held.append(values[start:i])
                start = i
    if held:
        yield held_key, np.concatenate(held)


def greedy_chain(df: DataFrame, keys: Sequence[str], order: str, value: str, threshold: int) -> DataFrame:
    """Adds ``kept`` and ``kept_before`` (value kept last before this row, null on the first).

    The first row of each key is kept. ``value`` is a bigint, ``order`` unique within the keys.
    """
    keys = list(keys)
    within = [*keys, SLICE]
    key_fields = [df.schema[k] for k in within]
    longs = T.ArrayType(T.LongType())
    summary_type = T.StructType(
        [*key_fields, *[T.StructField(n, longs) for n in ("lo", "hi", "out")], T.StructField("first_out", T.LongType())]
    )

    def tables(batches):
        rows = []
        for key, values in _runs_of_keys(batches, within, value):
            pieces, first = _chain_table(values, threshold)
            rows.append((*key, [p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], first))
            if len(rows) >= 2000:
                yield _record_batch(rows, summary_type)
                rows = []
        if rows:
            yield _record_batch(rows, summary_type)

    def entering(batches):
        current, state = None, None
        for batch in batches:
            ids = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            ranges = zip(*[batch.column(c).to_pylist() for c in ("lo", "hi", "out")])
            enter = []
            for key, (lows, highs, outs), first in zip(ids, ranges, batch.column("first_out").to_pylist()):
                if key != current:
                    current, state = key, None
                enter.append(state)
                if state is None:
                    state = first
                else:
                    state = next((out for lo, hi, out in zip(lows, highs, outs) if lo <= state <= hi), state)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in within], pa.array(enter, pa.int64())], names=[*within, "_enter"]
            )

    def decide(batches):
        current, state = None, None
        for batch in batches:
            ids = list(zip(*[batch.column(k).to_pylist() for k in within]))
            values = batch.column(value).to_pylist()
            enters = batch.column("_enter").to_pylist()
            kept, before = [], []
            for key, v, enter in zip(ids, values, enters):
                if key != current:
                    current, state = key, enter
                before.append(state)
                fires = state is None or abs(v - state) >= threshold
                kept.append(fires)
                if fires:
                    state = v
            columns = [batch.column(c) for c in passed]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.bool_()), pa.array(before, pa.int64())],
                names=[*passed, "kept", "kept_before"],
            )

    passed = df.columns
    summary = (
        df.select(*within, order, value)
        .repartition(*within)
        .sortWithinPartitions(*within, order)
        .select(*within, value)
        .mapInArrow(tables, summary_type)
    )
    starts = (
        summary.repartition(*keys)
        .sortWithinPartitions(*keys, SLICE)
        .mapInArrow(entering, T.StructType([*key_fields, T.StructField("_enter", T.LongType())]))
    )
    return (
        df.join(starts, within)
        .repartition(*within)
        .sortWithinPartitions(*within, order)
        .mapInArrow(
            decide,
            T.StructType([*df.schema.fields, T.StructField("kept", T.BooleanType()), T.StructField("kept_before", T.LongType())]),
        )
    )
