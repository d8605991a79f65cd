"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a document: every step shifts it by one bit and adds a fixed random number for
the byte, so it depends on the last 32 bytes only. Where its top ``BITS`` bits are 0 a chunk ends. Chunk ends follow
the content, so text inserted before a passage moves them along with it and the passage keeps its chunks.

A chunk is a repeat if an equal one (128-bit digest) occurs earlier: in a smaller doc_id, or before it in the same
document. Runs of repeats that follow one another and make at least ``LEAST`` bytes are removed; shorter ones are
chance. The first occurrence always stays.

Only digests and places move, packed in columns. A task keeps the earliest of equal chunks it meets and settles the
others itself, so a chunk in a third of all documents sends one entry per task. No pairs are formed.

Defined results: a null text is empty; an empty text has no chunk; rows equal in doc_id and text are one document
and lose the same bytes; rows with equal doc_id and different text come in the order of a hash of the text; a null
doc_id comes first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.llm.common import by_bytes, flat_bytes, hash_spans, mixed, runs, table
from haulscope.llm.suffixes import _FIRST_ID, CUT, cut_batch, cut_out, packed, unpacked, versioned
from haulscope.session import stage

BITS = 5  # chunks of 32 bytes on average
LEAST = 100  # bytes in a run of repeated chunks
WINDOW = 32
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)  # any fixed numbers will do

FOUND = "shard int, n int, marks binary, id long, version long, chunk int"


def chunk_ends(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, end) of all chunks of texts data[at[i]:at[i+1]]; an end is a place in ``data``."""
    rows = len(at) - 1
    owner = np.repeat(np.arange(rows), np.diff(at))
    if not len(data):
        return owner, owner
    # zeros between texts, so that no hash reaches into the one before
    place = np.arange(len(data)) + owner * WINDOW
    h = np.zeros(len(data) + rows * WINDOW, np.uint32)
    h[place] = GEAR[data]
    reach = 1
    while reach < WINDOW:
        # the sum over the last 2 x reach bytes, each shifted by its age
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    last = np.zeros(len(data), bool)
    last[at[1:][np.diff(at) > 0] - 1] = True
    ends = np.flatnonzero((h[place] >> np.uint32(32 - bits) == 0) | last)
    return owner[ends], ends + 1


def digests(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, ...]:
    """(row, number in its text, start, end, first and second half of the digest) of all chunks."""
    row, end = chunk_ends(data, at, bits)
    counts = np.bincount(row, minlength=len(at) - 1)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.where(number == 0, at[row], np.concatenate([[0], end[:-1]]) if len(end) else end)
    one = hash_spans(data, start, end)
    # a second hash of the same bytes, taken from another view of them
    other = hash_spans(np.bitwise_xor(data, np.uint8(0xA5)), start, end)
    return row, number, start, end, one, mixed(other ^ np.uint64(0x5851F42D4C957F2D))


def _earliest(one: np.ndarray, two: np.ndarray, place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each chunk is the first with its digest in the order of ``place``, and whether it is a repeat of that:
    at the same place it is the same chunk, of a row equal in id and text, and neither."""
    order = np.lexsort((*place[::-1], two, one))
    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = np.any([p[order] != p[order[head]] for p in place], axis=0)
    first, again = np.empty(len(one), bool), np.empty(len(one), bool)
    first[order], again[order] = new, later
    return first, again


def _marked(batches: Iterator[pa.RecordBatch], shards: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Documents to the chunks that are first in this task, packed by shard, and the repeats of those."""

    def settled(ids, versions, numbers) -> pa.RecordBatch:
        none = pa.nulls(len(ids), pa.int32())
        return pa.RecordBatch.from_arrays(
            [none, none, pa.nulls(len(ids), pa.binary()), pa.array(ids), pa.array(versions), pa.array(numbers)],
            ["shard", "n", "marks", "id", "version", "chunk"],
        )

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        one, two, ids, numbers, versions = (np.concatenate(c) for c in zip(*held))
        first, again = _earliest(one, two, (ids, versions, numbers))
        for low in range(0, int(again.sum()), 50_000):
            cut = np.flatnonzero(again)[low : low + 50_000]
            yield settled(ids[cut], versions[cut], numbers[cut])
        shard = (one % np.uint64(shards)).astype(np.int64)
        keep = np.flatnonzero(first)
        keep = keep[np.argsort(shard[keep], kind="stable")]
        bounds = np.searchsorted(shard[keep], np.arange(shards + 1))
        out = []
        for s in range(shards):
            k = keep[bounds[s] : bounds[s + 1]]
            if len(k):
                out.append((s, len(k), packed([one[k], two[k], ids[k], numbers[k], versions[k]])))
        n = len(out)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))),
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
            ],
            ["shard", "n", "marks", "id", "version", "chunk"],
        )

    held, size = [], 0
    for batch in batches:
        for part in by_bytes(batch, "text"):
            data, at = flat_bytes(part.column("text"))
            row, number, _, _, one, two = digests(data, at, bits)
            if len(row):
                ids = part.column("id").to_numpy().astype(np.int64)
                versions = part.column("version").to_numpy().astype(np.int64)
                held.append((one, two, ids[row], number.astype(np.int32), versions[row]))
                size += len(row)
            if size > 1_000_000:
                yield from flush(held)
                held, size = [], 0
    if held:
        yield from flush(held)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shards to the chunks that another document or task has earlier: (id, version, chunk)."""
    for group in runs(batches, ["shard"]):
        shard, n, values = group.column("shard").to_numpy(), group.column("n").to_numpy(), group.column("marks")
        for s in np.unique(shard):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for i in np.flatnonzero(shard == s):
                raw, k = unpacked(values[int(i)].as_py()), int(n[i])
                for c, (kind, low) in zip(cols, (("<u8", 0), ("<u8", 8), ("<i8", 16), ("<i4", 24), ("<i8", 28))):
                    c.append(np.frombuffer(raw, kind, k, low * k))
            one, two, ids, numbers, versions = (np.concatenate(c) for c in cols)
            again = np.flatnonzero(_earliest(one, two, (ids, versions, numbers))[1])
            for low in range(0, len(again), 50_000):
                k = again[low : low + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[k]), pa.array(versions[k]), pa.array(numbers[k])], ["id", "version", "chunk"]
                )


def repeated_runs(data: np.ndarray, at: np.ndarray, chunks: list[list[int] | None], bits: int, least: int) -> list[list[tuple[int, int]]]:
    """For each text the bytes (from its start) of runs of the given chunks with ``least`` bytes or more."""
    row, end = chunk_ends(data, at, bits)
    low = np.searchsorted(row, np.arange(len(at)))
    out = []
    for r, some in enumerate(chunks):
        spans: list[tuple[int, int]] = []
        if some:
            ends = end[low[r] : low[r + 1]] - at[r]
            starts = np.concatenate([[0], ends[:-1]])
            k = np.unique(np.array(some))
            breaks = np.flatnonzero(np.diff(k) > 1) + 1
            for run in np.split(k, breaks):
                a, b = int(starts[run[0]]), int(ends[run[-1]])
                if b - a >= least:
                    spans.append((a, b))
        out.append(spans)
    return out


def _cut(batches: Iterator[pa.RecordBatch], bits: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_bytes(batch, "text"):
            data, at = flat_bytes(part.column("text"))
            spans = repeated_runs(data, at, part.column("chunks").to_pylist(), bits, least)
            columns = (part.column(c).to_pylist() for c in ("doc_id", "text"))
            yield cut_batch([cut_out(d, t.encode(), s) for d, t, s in zip(*columns, spans)])


def drop_repeated_chunks(docs: DataFrame, bits: int = BITS, least: int = LEAST, shards: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for every document."""
    rows = versioned(docs).withColumn("id", F.coalesce("doc_id", F.lit(_FIRST_ID).cast("long")))
    shards = shards or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = stage(rows.mapInArrow(lambda b: _marked(b, shards, bits), FOUND), "chunks")
    key = "id long, version long, chunk int"
    met = (
        marks.where("shard IS NOT NULL").select("shard", "n", "marks").repartition("shard").sortWithinPartitions("shard").mapInArrow(_repeats, key)
    )
    again = marks.where("shard IS NULL").select("id", "version", "chunk").union(met)
    listed = again.groupBy("id", "version").agg(F.collect_set("chunk").alias("chunks"))
    joined = rows.join(listed, ["id", "version"], "left").select("doc_id", "text", "chunks")
    return joined.mapInArrow(lambda b: _cut(b, bits, least), CUT)


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when repeated runs of chunks are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_chunks(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
