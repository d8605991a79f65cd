"""Hard-negative mining: for each anchor and each of its positives, the best rows of another label in a score window.

A positive of score p asks for the first rows with ``low`` * p <= score <= ``high`` * p (in hundredths). The windows of an
anchor overlap, so one ranking per window would keep and merge the same rows several times. Instead the positives' upper
limits cut the scores into disjoint slots: slot j holds what lies above the next lower upper limit, up to limit j. A window
then is a suffix of the slots, read downwards from its own and ended by its lower limit, and its first n rows are among
the first n of each of its slots, merged in that order.

Rows become integers, floor(scale * x), and lie in chunks bounded in rows and bytes. Two passes bring every chunk
together with every block of anchors, in numbered lanes, so a task sees one chunk and one block at a time:

1. positives: products only between rows of one label, the first few of each anchor;
2. negatives: a combiner in each task keeps the first n of each (anchor, slot) and drops what lies below the n-th it has
   seen; window functions with a group limit before the shuffle do the same across tasks.

So (anchors x positives x n) rows per chunk leave a task at most, whatever the sizes of labels and windows. A label
with a third of all rows changes nothing, as chunks are dealt by number.

Defined results: rows without id or label, without a vector or with a null or non-finite component take no part; a
shorter vector counts as padded with zeros, an empty one as zeros; ties go to the smaller vec_id; rows with equal ids are
ranked as separate rows and are never each other's positives or negatives; of anchors with equal ids the one smallest by
label, length and bytes is asked; a window whose positive scores below zero is empty; extra columns are not carried; an
empty table gives an empty result. Scores are exact while they fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from haulscope.functions.timeparts import int_div
from haulscope.llm.common import table
from haulscope.session import stage

POSITIVES, NEGATIVES = 5, 10
SCALE, LOW, HIGH = 256, 30, 90
ANCHOR_BLOCK = 1024
CHUNK, CHUNK_BYTES = 16384, 8 << 20
TILE = 2048  # candidates scored at once
POOL = 200_000  # hits gathered before they are cut to the first of each slot

ROWS = "vec_id long, label int, dim int, v binary"
CHUNKS = "chunk long, dim int, ids binary, labels binary, vectors binary"
BLOCKS = "a_dim int, a_ids binary, a_labels binary, a_vectors binary, a_uppers binary, a_least binary"
FOUND = "anchor_id long, slot int, vec_id long, score long"
NOTHING = np.iinfo(np.int64).min


def _integers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) to integer vectors as bytes of int64; rows that take no part are left out."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for i, label, vector in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding")):
            if i is None or label is None or not vector.is_valid or vector.values.null_count:
                continue
            x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                for column, value in zip(out, (i, label, len(x), np.floor(scale * x).astype(np.int64).tobytes())):
                    column.append(value)
        kinds = pa.int64(), pa.int32(), pa.int32(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["vec_id", "label", "dim", "v"])


def _matrix(vectors: list[bytes], dims: list[int]) -> np.ndarray:
    """One row for each vector, the shorter ones padded with zeros."""
    out = np.zeros((len(vectors), max(dims, default=0)), np.int64)
    for row, v, n in zip(out, vectors, dims):
        row[:n] = np.frombuffer(v, np.int64)
    return out


def _bytes(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def _packed(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in chunks of at most ``rows`` rows and about ``size`` bytes, in order of label."""
    context = pyspark.TaskContext.get()
    made = (context.partitionId() if context else 0) << 32
    held: list[tuple[int, int, int, bytes]] = []
    width = 0

    def chunk() -> pa.RecordBatch:
        held.sort(key=lambda r: r[1])
        ids, labels, dims, vectors = zip(*held)
        m = _matrix(vectors, dims)
        return pa.RecordBatch.from_arrays(
            [pa.array([made], pa.int64()), pa.array([m.shape[1]], pa.int32()), *_bytes(np.array(ids, np.int64), np.array(labels, np.int64), m)],
            ["chunk", "dim", "ids", "labels", "vectors"],
        )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            width = max(width, row[2])
            if len(held) >= rows or len(held) * width * 8 >= size:
                yield chunk()
                made, held, width = made + 1, [], 0
    if held:
        yield chunk()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in blocks, with the upper limits of their slots and the least score that any window takes."""
    for batch in batches:
        for at in range(0, batch.num_rows, ANCHOR_BLOCK):
            column = {n: batch.column(n).slice(at, ANCHOR_BLOCK).to_pylist() for n in batch.schema.names}
            m = _matrix(column["v"], column["dim"])
            # equal limits make empty slots
            most = max(len(u) for u in column["uppers"])
            uppers = np.array([[*u, *[u[-1]] * (most - len(u))] for u in column["uppers"]], np.int64) if most else np.zeros((len(m), 0))
            rest = (np.array(column[n], np.int64) for n in ("vec_id", "label"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([m.shape[1]], pa.int32()), *_bytes(*rest, m, uppers.astype(np.int64), np.array(column["least"], np.int64))],
                [c.split()[0] for c in BLOCKS.split(", ")],
            )


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, through the widest floating-point product that is exact for them."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * float(max(1, np.abs(a).max())) * float(max(1, np.abs(b).max()))
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return a.astype(kind, copy=False) @ b.astype(kind, copy=False).T


def _even(a: np.ndarray, dim: int) -> np.ndarray:
    return a[:, :dim] if a.shape[1] >= dim else np.pad(a, ((0, 0), (0, dim - a.shape[1])))


def first_of(key: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` of each key by falling score, then id; in that order."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < n]


class Pool:
    """The combiner: the first ``n`` rows of each key seen so far, and for each key the score a further row must reach."""

    def __init__(self, keys: int, n: int):
        self.n = n
        self.need = np.full(keys, NOTHING)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        self.parts.append((key, score, at))
        self.size += len(key)

    def cut(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the first of each key; (key, score, position) of what is held, keys together, best first."""
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none, none
        key, score, at = (np.concatenate(x) for x in zip(*self.parts))
        left = first_of(key, score, ids[at], self.n)
        key, score, at = key[left], score[left], at[left]
        full = np.flatnonzero((np.arange(len(key)) >= self.n - 1) & (key == np.roll(key, self.n - 1)))
        self.need[key[full]] = score[full]
        self.parts, self.size = [(key, score, at)], 0
        return key, score, at


def _tiles(n: int) -> Iterator[slice]:
    """Slices of 0 to n, the first ones small: what they leave in a pool keeps most of the rest out."""
    low, width = 0, 64
    while low < n:
        yield slice(low, min(n, low + width))
        low, width = low + width, min(TILE, width * 2)


def positives_of(a_ids, a_labels, anchors, ids, labels, vectors, n: int) -> tuple[np.ndarray, ...]:
    """(anchor number, candidate number, score): the first ``n`` other rows of each anchor's label in a chunk."""
    pool = Pool(len(a_ids), n)
    for label in np.intersect1d(a_labels, labels):
        rows, columns = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
        for part in _tiles(len(columns)):
            tile = columns[part]
            score = _product(anchors[rows], vectors[tile])
            need = pool.need[rows].astype(score.dtype)
            i, j = np.nonzero((score >= need[:, None]) & (a_ids[rows][:, None] != ids[tile][None, :]))
            pool.add(rows[i], score[i, j].astype(np.int64), tile[j])
            pool.cut(ids)
    key, score, at = pool.cut(ids)
    return key, at, score


def negatives_of(a_ids, a_labels, anchors, uppers, least, ids, labels, vectors, n: int) -> tuple[np.ndarray, ...]:
    """(anchor number, slot, candidate number, score): the first ``n`` rows of other labels in each slot of each anchor."""
    slots = uppers.shape[1]
    pool = Pool(len(a_ids) * slots, n)
    # a slot begins above the next limit, the last one at the least score
    begins = np.concatenate([np.maximum(uppers[:, 1:] + 1, least[:, None]), least[:, None]], axis=1)
    for part in _tiles(len(ids)):
        score = _product(anchors, vectors[part])
        # rows of the anchor's label and rows with its id lie in no slot
        other = (a_labels[:, None] != labels[part][None, :]) & (a_ids[:, None] != ids[part][None, :])
        # limits that the type of the scores cannot hold lie beyond all of them, rounded or not
        need = np.maximum(begins, pool.need.reshape(-1, slots)).astype(score.dtype)
        ends = uppers.astype(score.dtype)
        for j in range(slots):
            a, c = np.nonzero((score >= need[:, j : j + 1]) & (score <= ends[:, j : j + 1]) & other)
            pool.add(a * slots + j, score[a, c].astype(np.int64), part.start + c)
        if part.start == 0 or pool.size > POOL:
            pool.cut(ids)
    key, score, at = pool.cut(ids)
    return key // max(1, slots), key % max(1, slots), at, score


def _met(batches: Iterator[pa.RecordBatch], n: int, second: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ints = {name: np.frombuffer(batch.column(name)[row].as_buffer(), np.int64) for name in batch.schema.names if not name.endswith("dim")}
            dim, a_dim = batch.column("dim")[row].as_py(), batch.column("a_dim")[row].as_py()
            ids, a_ids = ints["ids"], ints["a_ids"]
            wide = max(dim, a_dim)
            vectors = _even(ints["vectors"].reshape(len(ids), dim), wide)
            anchors = _even(ints["a_vectors"].reshape(len(a_ids), a_dim), wide)
            mine = a_ids, ints["a_labels"], anchors
            if second:
                a, slot, at, score = negatives_of(*mine, ints["a_uppers"].reshape(len(a_ids), -1), ints["a_least"], ids, ints["labels"], vectors, n)
            else:
                a, at, score = positives_of(*mine, ids, ints["labels"], vectors, n)
                slot = np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a_ids[a]), pa.array(slot.astype(np.int32)), pa.array(ids[at]), pa.array(score.astype(np.int64))],
                [c.split()[0] for c in FOUND.split(", ")],
            )


def _meet(chunks: DataFrame, blocks: DataFrame, n: int, second: bool) -> DataFrame:
    """The first ``n`` of every (anchor, slot) over all chunks; chunks are dealt to numbered lanes, blocks go to each lane.

    The copies are never broadcast: their size is estimated without the lanes, and together they would not fit the driver.
    """
    lanes = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.withColumn("lane", F.pmod(F.xxhash64("chunk"), F.lit(lanes))).drop("chunk")
    copied = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    found = dealt.join(copied.hint("merge"), "lane").drop("lane").mapInArrow(lambda batches: _met(batches, n, second), FOUND)
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n).drop("place")


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows``.

    ``rows`` has vec_id, label and embedding; ``low`` and ``high`` are hundredths of a positive's score.
    """
    kept = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "embedding")
    whole = lambda df: df.mapInArrow(lambda batches: _integers(batches, scale), ROWS)
    chunks = stage(whole(kept).mapInArrow(lambda batches: _packed(batches, CHUNK, CHUNK_BYTES), CHUNKS), "chunks")
    one = F.min(F.struct("label", "dim", "v")).alias("r")
    anchors = stage(whole(kept.where(is_anchor)).groupBy("vec_id").agg(one).select("vec_id", "r.*"), "anchors")

    no_limits = anchors.select("*", F.array().cast("array<long>").alias("uppers"), F.lit(0).cast("long").alias("least"))
    first = stage(_meet(chunks, no_limits.mapInArrow(_blocks, BLOCKS), positives, False).drop("slot"), "positives")

    # windows of positives below zero are empty
    limits = (
        first.where("score >= 0")
        .groupBy("anchor_id")
        .agg(F.sort_array(F.collect_list(int_div(F.col("score") * high, 100)), asc=False).alias("uppers"), F.min("score").alias("least"))
        .select(F.col("anchor_id").alias("vec_id"), "uppers", int_div(F.col("least") * low + 99, 100).alias("least"))
    )
    bounded = anchors.join(limits, "vec_id").mapInArrow(_blocks, BLOCKS)
    slots = _meet(chunks, stage(bounded, "blocks"), negatives, True)

    # the slots of an anchor follow each other downwards: a window is a suffix of their rows, ended by its lower limit
    merged = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("falling"), "vec_id"))).alias("held"))
    inside = F.filter("held", lambda r: (-r["falling"] * 100 >= F.col("score") * low) & (-r["falling"] * 100 <= F.col("score") * high))
    return (
        first.where("score >= 0")
        .join(merged, "anchor_id")
        .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(F.slice(inside, 1, negatives)))
        .select(
            "anchor_id",
            "positive_id",
            (F.col("pos") + 1).alias("rank"),
            F.col("col.vec_id").alias("negative_id"),
            "positive_score",
            (-F.col("col.falling")).alias("negative_score"),
        )
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every vector whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
