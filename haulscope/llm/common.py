"""What several operators of this subpackage share: tables, text statistics, global ranks, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from haulscope.session import prepare, stage

# the contract's white space is ASCII: space and U+0009 to U+000D
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings for operators that hand long texts to Python: batches bounded in bytes as well as rows."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Pack a stream of dictionaries of equally long lists into Arrow batches."""
    for columns in rows:
        n = len(next(iter(columns.values())))
        for at in range(0, n, size):
            part = {k: v[at : at + size] for k, v in columns.items()}
            yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in schema], schema=schema)


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by ``key``: each table holds one or more complete groups.

    Only the last group of a batch is held back, so memory is that of a batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held:
            last = held[-1]
            if any(last.column(k)[last.num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in key):
                yield pa.Table.from_batches(held)
                held = []
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, int(change[-1]))])
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows of ``df`` from 0 in ``order`` without bringing them into one task.

    Rows are dealt by range, numbered inside each range, and shifted by the sizes of the ranges before it.
    """
    dealt = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").count()
    # one row for each range: as many as shuffle partitions, however many rows they hold
    before = sizes.withColumn(
        "_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (
        dealt.withColumn("_inside", inside)
        .join(before.select("_range", "_before"), "_range")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_range", "_before", "_inside")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); component is the smallest node reachable.

    Each round merges every node into the neighbour that a fresh hash ranks lowest (itself included) and relabels
    the edges, so a constant share of the nodes disappears per round whatever the shape of the graph. Only node
    ids move: no neighbour list is ever gathered, and labels, edges and components stay tables.
    """
    spark = edges.sparkSession
    current = stage(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    nodes = current.select(F.col("a").alias("node")).union(current.select(F.col("b").alias("node"))).distinct()
    labels = nodes.withColumn("label", F.col("node"))
    if current.isEmpty():
        return spark.createDataFrame([], "node long, component long")
    for turn in range(200):
        both = current.select("a", "b").union(current.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("v"))
        best = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        parent = stage(best.select(F.col("a").alias("v"), F.least("m", rank(F.col("a"))).getField("v").alias("p")), "parents")
        labels = stage(
            labels.join(parent, labels.label == parent.v, "left").select("node", F.coalesce("p", "label").alias("label")),
            "labels",
        )
        left = parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        current = stage(
            current.join(left, "a")
            .join(right, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
        if current.isEmpty():
            smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
            return labels.join(smallest, "label").select("node", "component")
    raise RuntimeError("components did not settle")


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow column of strings; a null has no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows with about ``most`` bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, at = flat_bytes(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until it is none of the columns of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and the next stage's need it too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = ends - starts
    out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    todo, done = np.arange(len(starts)), 0
    while len(todo):
        part = np.ascontiguousarray(eight[starts[todo] + done]).view("<u8").reshape(-1)
        left = np.minimum(length[todo] - done, 8).astype(np.uint64)
        part = part & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) * np.uint64(8)))
        out[todo] = mixed(out[todo] ^ part)
        done += 8
        todo = todo[length[todo] > done]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(column: pa.Array, strip: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of every row) with A-Z lower-cased; ``strip`` bytes go from the ends of a word."""
    data, at = flat_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.searchsorted(starts, at[1:]) - np.searchsorted(starts, at[:-1])
    if strip:
        odd = np.zeros(256, bool)
        odd[list(strip)] = True
        for _ in range(4):
            starts = starts + (odd[data[starts]] & (ends - starts > 1))
            ends = ends - (odd[data[ends - 1]] & (ends - starts > 1))
    return hash_spans(data, starts, ends), counts
