"""Removal of repeated byte strings by suffix arrays over shards.

Every byte covered by a string of ``DEPTH`` bytes that also starts earlier (smaller doc_id, or same document and
earlier) is removed. Which strings repeat is found in three steps.

1. Anchors. Of every DEPTH bytes the ``GRAM``-byte string with the least hash is an anchor, so equal strings have
   equal anchors at equal places. Anchors that occur once in the corpus end here; only their hashes and places move,
   packed in columns. The text around the others (at most 2 DEPTH bytes) goes to the shard of its anchor.
2. Shards. A shard sorts the suffixes that start at its anchors, and the reversed texts before them, by refinement:
   groups of suffixes that agree so far are split by their next eight bytes, groups of one are left alone
   (Larsson and Sadakane's scheme; as only suffixes at anchors are wanted, the next bytes take the place of
   doubled ranks). Common prefixes of neighbours in that order then tell which suffixes agree to which depth, and two
   numbers (agreement to the left, agreement to the right) which strings of DEPTH bytes are equal.
3. Merging. An anchor with more than ``CROWD`` occurrences is spread over several shards. What each of them found
   first is sorted, and found in the others by binary search; the earliest of all stays.

Bytes are compared as bytes: hashes only choose anchors and route. Results are intervals, so a passage of any
length costs a few rows for each copy, and no pair of copies is ever formed.

Defined results: a null text is empty; texts shorter than DEPTH lose nothing; rows equal in doc_id and text are one
document and lose the same bytes; rows with equal doc_id and different text are documents in the order of a hash of
the text; a null doc_id comes first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.llm.common import by_bytes, flat_bytes, mixed, runs, table
from haulscope.session import stage

DEPTH = 100
GRAM = 32
CROWD = 20_000
_PLACE = np.uint64((1 << 30) - 1)
_FIRST_ID = -(2**63)  # stands for a null doc_id

_zstd = pa.Codec("zstd")


def packed(columns: list[np.ndarray]) -> bytes:
    """Arrays as one compressed value."""
    raw = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return struct.pack("<q", len(raw)) + _zstd.compress(raw, asbytes=True)


def unpacked(value: bytes) -> bytes:
    return _zstd.decompress(value[8:], decompressed_size=struct.unpack("<q", value[:8])[0], asbytes=True)


def anchors(data: np.ndarray, at: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, hash, place, first, last) of the anchors of texts data[at[i]:at[i+1]].

    ``first`` to ``last`` are the starts of the strings that chose the anchor; all three are counted from the
    start of the text.
    """
    none = np.zeros(0, np.int64)
    lengths = np.diff(at)
    if len(data) < depth or not (lengths >= depth).any():
        return none, none.astype(np.uint64), none, none, none
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    words = np.ascontiguousarray(eight).view("<u8").reshape(-1)
    m = len(data) - gram + 1
    odd = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]
    h = np.zeros(m, np.uint64)
    for k in range(gram // 8):
        h += words[8 * k : 8 * k + m] * np.uint64(odd[k % 4])
        h ^= h >> np.uint64(31)
    h = mixed(h)
    del words
    # least hash of each window of w grams: running minima of blocks from both sides
    w = depth - gram + 1
    key = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // w)
    grid = np.concatenate([key, np.full(blocks * w - m, ~np.uint64(0))]).reshape(blocks, w)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = len(data) - depth + 1
    place = (np.minimum(after[:starts], before[w - 1 : w - 1 + starts]) & _PLACE).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    long = lengths >= depth
    np.add.at(edge, at[:-1][long], 1)
    np.add.at(edge, at[1:][long] - depth + 1, -1)
    valid = np.flatnonzero(np.cumsum(edge[:starts]) > 0)
    place = place[valid]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)])
    begins = np.flatnonzero(new)
    ends = np.concatenate([begins[1:], [len(valid)]]) - 1
    place = place[begins]
    row = np.searchsorted(at, place, side="right") - 1
    return row, h[place], place - at[row], valid[begins] - at[row], valid[ends] - at[row]


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("doc_id").fill_null(_FIRST_ID).to_numpy(zero_copy_only=False)
    return ids.astype(np.int64), batch.column("version").to_numpy(zero_copy_only=False).astype(np.int64)


def distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of each group of equal entries, ascending."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    return np.sort(order[new])


def _by_shard(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): rows of shard s are order[bounds[s]:bounds[s+1]]."""
    shard = (h % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _marked(batches: Iterator[pa.RecordBatch], shards: int, depth: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Documents to the anchors of each shard, one packed value per shard and so much text: (shard, n, marks)."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, ids, versions, first = (np.concatenate(c) for c in zip(*held))
        order, bounds = _by_shard(h, shards)
        out = []
        for s in range(shards):
            some = order[bounds[s] : bounds[s + 1]]
            if len(some):
                out.append((s, len(some), packed([h[some], ids[some], first[some], versions[some]])))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], ["shard", "n", "marks"]
        )

    held, size = [], 0
    for batch in batches:
        for part in by_bytes(batch, "text"):
            data, at = flat_bytes(part.column("text"))
            row, h, _, first, _ = anchors(data, at, depth, gram)
            if len(row):
                ids, versions = _keys(part)
                held.append((h, ids[row], versions[row], first.astype(np.int32)))
                size += len(row)
            if size > 1_000_000:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def _repeated(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """Anchors of whole shards to those that occur more than once: (doc_id, version, first, parts)."""
    for group in runs(batches, ["shard"]):
        shard, n = group.column("shard").to_numpy(), group.column("n").to_numpy()
        values = group.column("marks")
        for s in np.unique(shard):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for i in np.flatnonzero(shard == s):
                raw, k = unpacked(values[int(i)].as_py()), int(n[i])
                for c, (kind, low) in zip(cols, (("<u8", 0), ("<i8", 8 * k), ("<i4", 16 * k), ("<i8", 20 * k))):
                    c.append(np.frombuffer(raw, kind, k, low))
            h, ids, first, versions = (np.concatenate(c) for c in cols)
            _, which, count = np.unique(h, return_inverse=True, return_counts=True)
            h, ids, first, versions = (x[count[which] > 1] for x in (h, ids, first, versions))
            # equal rows give the same anchors at the same places, which count once
            once = distinct(h, ids, versions, first)
            h, ids, first, versions = (x[once] for x in (h, ids, first, versions))
            _, which, count = np.unique(h, return_inverse=True, return_counts=True)
            count = count[which]
            keep = count > 1
            parts = -(-count[keep] // crowd)
            for low in range(0, int(keep.sum()), 50_000):
                cut = slice(low, low + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[keep][cut]),
                        pa.array(versions[keep][cut]),
                        pa.array(first[keep][cut]),
                        pa.array(parts[cut].astype(np.int32)),
                    ],
                    ["id", "version", "first", "parts"],
                )


def _contexts(batches: Iterator[pa.RecordBatch], shards: int, depth: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Documents with the firsts of their repeated anchors to packed contexts: (shard, part, n, bodies)."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, ids, versions, first, left, span, parts = (np.concatenate([x[k] for x in held]) for k in range(7))
        body = np.concatenate([x[7] for x in held])
        length = span.astype(np.int64) + depth
        begin = np.cumsum(length) - length
        part = (mixed(ids.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
        order, bounds = _by_shard(h, shards)
        out = []
        for s in range(shards):
            mine = order[bounds[s] : bounds[s + 1]]
            for p in np.unique(part[mine]):
                some = mine[part[mine] == p]
                total = int(length[some].sum())
                # bytes of all contexts of the shard, one after the other
                at = np.repeat(begin[some] - (np.cumsum(length[some]) - length[some]), length[some]) + np.arange(total)
                columns = [h[some], ids[some], first[some], versions[some], parts[some], left[some], span[some], body[at]]
                out.append((s, int(p), len(some), packed(columns)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["shard", "part", "n", "bodies"]
        )

    held, size = [], 0
    taken: set[tuple[int, int]] = set()  # documents in held: of equal rows one is enough
    for batch in batches:
        for piece in by_bytes(batch, "text", 1 << 20):
            data, at = flat_bytes(piece.column("text"))
            row, h, place, first, last = anchors(data, at, depth, gram)
            ids, versions = _keys(piece)
            wanted_row, wanted_first, wanted_parts = [], [], []
            for r, some in enumerate(piece.column("firsts").to_pylist()):
                doc = (int(ids[r]), int(versions[r]))
                if doc in taken:
                    continue
                taken.add(doc)
                wanted_row += [r] * len(some)
                wanted_first += [x["first"] for x in some]
                wanted_parts += [x["parts"] for x in some]
            if not wanted_row or not len(row):
                continue
            code = row * (1 << 31) + first  # rises with the anchors
            want = np.array(wanted_row, np.int64) * (1 << 31) + np.array(wanted_first, np.int64)
            at_ = np.minimum(np.searchsorted(code, want), len(code) - 1)
            good = code[at_] == want
            k, parts = at_[good], np.array(wanted_parts, np.int32)[good]
            span = last[k] - first[k]
            length = span + depth
            source = np.repeat(at[row[k]] + first[k] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            held.append(
                (h[k], ids[row[k]], versions[row[k]], first[k].astype(np.int32), (place[k] - first[k]).astype(np.uint8), span.astype(np.uint8), parts, data[source])
            )
            size += int(length.sum())
            if size > 16 << 20:
                yield from flush(held)
                held, size, taken = [], 0, set()
    if held:
        yield from flush(held)


def suffix_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows of ``keys`` (rows x chunks of eight bytes) by refinement: in each round only rows that still
    agree with another one are sorted, by their next chunk, inside their group."""
    n = len(keys)
    order = np.argsort(keys[:, 0], kind="stable")
    # group[i]: where the group of the i-th row in order starts
    same = np.concatenate([[False], keys[order[1:], 0] == keys[order[:-1], 0]])
    for k in range(1, keys.shape[1]):
        start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        open_ = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
        if not len(open_):
            break
        chunk = keys[order[open_], k]
        inner = np.lexsort((chunk, start[open_]))
        order[open_] = order[open_][inner]
        chunk = chunk[inner]
        agree = np.concatenate([[False], (chunk[1:] == chunk[:-1]) & (start[open_][1:] == start[open_][:-1])])
        same[open_] = agree
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row (of a matrix of bytes) shares with the one before it in ``order``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for low in range(1, len(order), 50_000):
        high = min(len(order), low + 50_000)
        differ = rows[order[low:high]] != rows[order[low - 1 : high - 1]]
        out[low:high] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _matrix(body: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, back: bool) -> np.ndarray:
    """Rows of ``width`` bytes from ``begin`` on, or backwards from before it; zero beyond ``length``."""
    step = np.arange(width)
    at = begin[:, None] - 1 - step if back else begin[:, None] + step
    inside = step < length[:, None]
    return np.where(inside, body[np.where(inside, at, 0)], 0).astype(np.uint8)


def repeats(
    h: np.ndarray, rank: np.ndarray, left: np.ndarray, span: np.ndarray, body: np.ndarray, depth: int
) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(least, most, firsts): for each context the offsets from its start of the first and last string that an
    earlier context of the shard has too (least > most: none); ``firsts`` lists for each offset back from the
    anchor the contexts whose string there is the earliest in the shard. ``rank`` orders contexts by position."""
    n = len(h)
    length = span.astype(np.int64) + depth
    begin = np.cumsum(length) - length
    left, span = left.astype(np.int64), span.astype(np.int64)
    middle = begin + left
    most_left, most_right = int(left.max()), int((length - left).max())
    wide = lambda x: -(-max(1, x) // 8) * 8
    sides = []
    for rows in (
        _matrix(body, middle, length - left, wide(most_right), False),
        _matrix(body, middle, left, wide(most_left), True),
    ):
        # the anchor's hash comes first, so that different anchors never agree
        keys = np.concatenate([h[:, None], rows.view(">u8").astype(np.uint64)], axis=1)
        order = suffix_order(keys)
        prefix = common_prefixes(rows, order)
        prefix[1:][h[order[1:]] != h[order[:-1]]] = -1
        prefix[0] = -1
        sides.append((order, prefix))
    by_rank = np.argsort(rank, kind="stable")
    least, most = np.full(n, 1 << 20), np.full(n, -1)
    firsts = []
    classes = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for back in range(most_left + 1):
        for to, (order, prefix), deep in zip(classes, sides, (depth - back, back)):
            to[order] = np.cumsum(prefix < deep)
        # the string that starts ``back`` bytes before the anchor, for contexts that hold it
        some = by_rank[(left[by_rank] >= back) & (left[by_rank] - back <= span[by_rank])]
        if not len(some):
            continue
        _, first = np.unique(classes[0][some] * (n + 1) + classes[1][some], return_index=True)
        later = np.ones(len(some), bool)
        later[first] = False
        hit = some[later]
        offset = left[hit] - back
        least[hit] = np.minimum(least[hit], offset)
        most[hit] = np.maximum(most[hit], offset)
        firsts.append((back, some[first]))
    return least, most, firsts


def _found(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Shards to (id, version, low, high, head): removed bytes low to high of a document, or, where the anchor is
    spread over shards, the string at ``low`` that is the earliest here."""
    for group in runs(batches, ["shard", "part"]):
        code = group.column("shard").to_numpy().astype(np.int64) * (1 << 31) + group.column("part").to_numpy()
        n, values = group.column("n").to_numpy(), group.column("bodies")
        for c in np.unique(code):
            cols: list[list[np.ndarray]] = [[] for _ in range(8)]
            for i in np.flatnonzero(code == c):
                raw, k = unpacked(values[int(i)].as_py()), int(n[i])
                kinds = (("<u8", 8), ("<i8", 8), ("<i4", 4), ("<i8", 8), ("<i4", 4), ("u1", 1), ("u1", 1))
                low = 0
                for to, (kind, wide) in zip(cols, kinds):
                    to.append(np.frombuffer(raw, kind, k, low))
                    low += wide * k
                cols[7].append(np.frombuffer(raw, np.uint8, -1, low))
            h, ids, first, versions, parts, left, span, body = (np.concatenate(x) for x in cols)
            once = distinct(h, ids, versions, first)
            if len(once) < len(h):  # rows equal in id and text, from several tasks
                length = span.astype(np.int64) + depth
                begin = (np.cumsum(length) - length)[once]
                length = length[once]
                body = body[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
                h, ids, first, versions, parts, left, span = (x[once] for x in (h, ids, first, versions, parts, left, span))
            place = first.astype(np.int64) + left
            rank = np.empty(len(h), np.int64)
            rank[np.lexsort((place, versions, ids))] = np.arange(len(h))
            least, most, firsts = repeats(h, rank, left, span, body, depth)
            hit = np.flatnonzero(most >= 0)
            yield _spans(ids[hit], versions[hit], first[hit] + least[hit], first[hit] + most[hit] + depth, [None] * len(hit))
            begin = np.cumsum(span.astype(np.int64) + depth) - span.astype(np.int64) - depth
            for back, some in firsts:
                some = some[parts[some] > 1]
                if len(some):
                    offset = left[some].astype(np.int64) - back
                    start = begin[some] + offset
                    yield _spans(
                        ids[some], versions[some], first[some] + offset, first[some] + offset + depth, [body[x : x + depth].tobytes() for x in start]
                    )


def _spans(ids: np.ndarray, versions: np.ndarray, low: np.ndarray, high: np.ndarray, heads: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(versions), pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64)), pa.array(heads, pa.binary())],
        ["id", "version", "low", "high", "head"],
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads of several shards, dealt by content: each is looked up among all by binary search, and all but the
    earliest of equals are removed."""
    for group in runs(batches, ["route"]):
        heads = np.array(group.column("head").to_pylist())
        ids, versions, low, high = (group.column(c).to_numpy() for c in ("id", "version", "low", "high"))
        order = np.lexsort((low, versions, ids))
        known, first = np.unique(heads[order], return_index=True)
        at = np.searchsorted(known, heads)
        later = order[first][at] != np.arange(len(heads))
        yield _spans(ids[later], versions[later], low[later], high[later], [None] * int(later.sum()))


CUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<low: long, high: long>>, kept binary"
_CUT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.binary())


def cut_out(doc: int | None, data: bytes, spans: list[tuple[int, int]]) -> tuple:
    """A row of CUT: the document without the bytes of ``spans``, which may overlap."""
    merged: list[list[int]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    kept, at = [], 0
    for low, high in merged:
        kept.append(data[at:low])
        at = high
    kept.append(data[at:])
    return doc, len(data), sum(b - a for a, b in merged), [{"low": a, "high": b} for a, b in merged], b"".join(kept)


def cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), _CUT_TYPES)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with intervals to CUT."""
    for batch in batches:
        for part in by_bytes(batch, "text", 4 << 20):
            columns = (part.column(c).to_pylist() for c in ("doc_id", "text", "spans"))
            yield cut_batch([cut_out(d, t.encode(), [(s["low"], s["high"]) for s in spans or []]) for d, t, spans in zip(*columns)])


def versioned(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text): ``version``, a whole 64-bit hash, tells rows with one doc_id and different texts apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("version"), text.alias("text"))


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, crowd: int = CROWD, shards: int | None = None) -> DataFrame:
    """(id, version, low, high): bytes of documents to remove; intervals of one document may overlap."""
    rows = versioned(docs)
    shards = shards or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = rows.mapInArrow(lambda b: _marked(b, shards, depth, gram), "shard int, n int, marks binary")
    anchored = stage(
        marks.repartition("shard").sortWithinPartitions("shard").mapInArrow(
            lambda b: _repeated(b, crowd), "id long, version long, first int, parts int"
        ),
        "anchors",
    )
    listed = anchored.groupBy("id", "version").agg(F.collect_list(F.struct("first", "parts")).alias("firsts"))
    keyed = rows.withColumn("id", F.coalesce("doc_id", F.lit(_FIRST_ID).cast("long")))
    joined = keyed.join(listed, ["id", "version"]).select("doc_id", "version", "text", "firsts")
    bodies = joined.mapInArrow(lambda b: _contexts(b, shards, depth, gram), "shard int, part int, n int, bodies binary")
    spans = "id long, version long, low long, high long, head binary"
    found = stage(
        bodies.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(lambda b: _found(b, depth), spans), "found"
    )
    heads = found.where("head IS NOT NULL").withColumn("route", F.xxhash64("head"))
    merged = heads.repartition("route").sortWithinPartitions("route").mapInArrow(_merged, spans)
    return found.where("head IS NULL").union(merged).drop("head")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): every document with its merged intervals and the bytes left."""
    rows = versioned(docs).withColumn("id", F.coalesce("doc_id", F.lit(_FIRST_ID).cast("long")))
    listed = spans.groupBy("id", "version").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    joined = rows.join(listed, ["id", "version"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, CUT)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document because 100 bytes around them also occur earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_spans(docs, repeated_spans(docs)).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )




ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce("text", ''))) AS h FROM documents
), places AS (
  SELECT r, doc_id, unnest(range(len(h) // 2 - 99)) AS p FROM docs WHERE len(h) >= 200
), strings AS (
  SELECT places.r, places.doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS s FROM places JOIN docs USING (r)
), repeated AS (
  SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS after, lag(p) OVER (PARTITION BY r ORDER BY p) AS before
  FROM (SELECT r, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM strings) WHERE n > 1
), runs AS (
  SELECT r, p AS low, row_number() OVER (PARTITION BY r ORDER BY p) AS k FROM repeated WHERE before IS NULL OR p - before > 100
), ends AS (
  SELECT r, p + 100 AS high, row_number() OVER (PARTITION BY r ORDER BY p) AS k FROM repeated WHERE after IS NULL OR after - p > 100
), spans AS (
  SELECT r, low, high, k, lag(high, 1, 0) OVER (PARTITION BY r ORDER BY k) AS kept_from, max(high) OVER (PARTITION BY r) AS last
  FROM runs JOIN ends USING (r, k)
), cut AS (
  SELECT spans.r, sum(high - low) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * kept_from + 1, 2 * (low - kept_from)), '' ORDER BY k) || substr(any_value(h), 2 * any_value(last) + 1) AS kept
  FROM spans JOIN docs USING (r) GROUP BY spans.r
)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
"""
