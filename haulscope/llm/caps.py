"""Embedding near-duplicates through spherical-cap filters.

A filter is a direction on the sphere; a vector belongs to it when their inner product reaches a threshold (it lies
in the direction's cap). Directions come from a random product code: the space is cut into two halves with a small
code of unit vectors each, and a direction is a pair of codewords. List decoding finds all directions that a vector
exceeds without trying all pairs: one half's products are sorted, and each codeword of the other half needs those
above the rest of the threshold. Vectors that share a direction meet there, and their cosine is computed in double
precision, so no pair below the bound is ever linked.

The number of directions grows with the number of vectors, so that a cap holds about ``OCCUPANCY`` of evenly spread
ones; the threshold is the largest at which a pair with exactly the least cosine still shares ``COMMON`` directions
on average (measured once on simulated pairs with a fixed seed). Closer pairs share more. Recall is measured in the
tests and in the README.

Exact copies are one row of the search, with their number as weight. A cap with many vectors (near copies of one
another) is split into blocks, and each pair of blocks is a task's work: every member is compared, nothing is
capped, and pairs are counted inside the task instead of being written. A pair that shares several directions is
counted in the smallest of them only. Links for the components leave a task as one edge per vector.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and
are kept; vectors of different length are never linked; rows with equal ids are separate vectors with the same id;
an empty table gives an empty result; columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.llm.common import components, runs, table
from haulscope.session import stage

COSINE = 0.9
OCCUPANCY = 64  # vectors in a cap, were they spread evenly
COMMON = 12.0  # directions that a pair with the least cosine shares on average
BLOCK = 256  # vectors in a block of a crowded cap
SALTS = 16


class Code:
    """Product code for one dimension: two halves with ``size`` codewords each, and the caps' threshold."""

    def __init__(self, dim: int, size: int, cosine: float, common: float, pairs: int = 200):
        rng = np.random.default_rng(dim * 1_000_003 + size)
        self.cut, self.size = max(1, dim // 2), size
        self.halves = [self._unit(rng, size, max(1, n)) for n in (self.cut, dim - self.cut)]
        if dim == 1:
            self.halves[1][:] = 0
        x = self._unit(rng, pairs, dim)
        other = self._unit(rng, pairs, dim)
        other -= (other * x).sum(1, keepdims=True) * x
        norm = np.linalg.norm(other, axis=1, keepdims=True)
        y = cosine * x + math.sqrt(1 - cosine**2) * other / np.where(norm > 0, norm, 1)
        low, high = 0.0, 1.5
        for _ in range(18):
            self.threshold = (low + high) / 2
            shared = 0
            for (x1, x2), (y1, y2) in zip(zip(*self._products(x)), zip(*self._products(y))):
                a, b = self._decode(x1, x2)
                shared += int(np.count_nonzero(y1[a] + y2[b] >= self.threshold))
                if shared > common * pairs:
                    break
            low, high = (self.threshold, high) if shared > common * pairs else (low, self.threshold)
        self.threshold = low

    @staticmethod
    def _unit(rng: np.random.Generator, n: int, dim: int) -> np.ndarray:
        x = rng.standard_normal((n, dim))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def _products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = x[:, self.cut :]
        second = rest @ self.halves[1].T if rest.shape[1] else np.zeros((len(x), self.size))
        return (x[:, : self.cut] @ self.halves[0].T) / math.sqrt(2), second / math.sqrt(2)

    def _decode(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of codewords whose products sum to the threshold or more."""
        order = np.argsort(-second)
        # for each codeword of the first half, how many of the second half's are large enough
        counts = np.searchsorted(-second[order], first - self.threshold, side="right")
        a = np.repeat(np.arange(self.size), counts)
        within = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        return a, order[within]

    def lists(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each unit vector the numbers of its directions, rising."""
        for first, second in zip(*self._products(x)):
            a, b = self._decode(first, second)
            yield np.sort(a * self.size + b)


@lru_cache(maxsize=16)
def code(dim: int, size: int, cosine: float, common: float) -> Code:
    return Code(dim, size, cosine, common)


def code_size(vectors: int, occupancy: int = OCCUPANCY) -> int:
    """Codewords per half. A vector lies in a dozen or so caps, so that many times the vectors are dealt to size squared caps."""
    return max(24, math.ceil(math.sqrt(12 * vectors / occupancy)))


def unit(batch_vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(batch_vectors), kind).astype(np.float64).reshape(len(batch_vectors), -1)
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _digests(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(vec_id, digest, v): digest null where the vector links with nothing."""
    for batch in batches:
        keys, out = [], []
        for vector in batch.column("embedding"):
            x = None
            if vector.is_valid and not vector.values.null_count and len(vector.values):
                x = vector.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # one zero instead of two
                if not np.isfinite(x).all() or not x.any():
                    x = None
            out.append(None if x is None else x.tobytes())
            keys.append(None if x is None else hashlib.md5(out[-1], usedforsecurity=False).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["vec_id", "digest", "v"]
        )


def _listed(batches: Iterator[pa.RecordBatch], kind: str, size: int, cosine: float, common: float) -> Iterator[pa.RecordBatch]:
    """(rep, caps): the directions of each distinct vector."""
    for batch in batches:
        vectors = batch.column("v").to_pylist()
        caps: list[np.ndarray] = [np.zeros(0, np.int64)] * len(vectors)
        sizes = np.array([len(v) for v in vectors])
        for width in np.unique(sizes):
            rows = np.flatnonzero(sizes == width)
            x = unit([vectors[i] for i in rows], kind)
            for i, found in zip(rows, code(x.shape[1], size, cosine, common).lists(x)):
                # caps of other dimensions are other caps
                caps[i] = (np.int64(x.shape[1]) << 44) + found
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), pa.array(caps, pa.list_(pa.int64()))], ["rep", "caps"]
        )


def _first_here(caps: list[np.ndarray], p: np.ndarray, q: np.ndarray, cap: int) -> np.ndarray:
    """Of pairs (p, q) that share ``cap``, whether they share none below it."""
    width = max(len(c) for c in caps)
    left = np.full((len(caps), width), -1, np.int64)
    for row, c in zip(left, caps):
        below = c[: np.searchsorted(c, cap)]
        row[: len(below)] = below
    right = np.where(left < 0, -2, left)
    width = max(1, int((left >= 0).sum(axis=1).max()))
    out = np.ones(len(p), bool)
    step = max(1, 4_000_000 // (width * width))
    for at in range(0, len(p), step):
        a, b = left[p[at : at + step], :width], right[q[at : at + step], :width]
        out[at : at + step] = ~(a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    return out


def link_cell(x: np.ndarray, weight: np.ndarray, side: np.ndarray, caps: list[np.ndarray], cap: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links counted here, position of the lowest row reachable) for the vectors of one cell.

    ``side`` is 0 throughout for a block with itself; else rows of side 0 meet rows of side 1 only.
    """
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if side.any():
        near &= side[:, None] != side[None, :]
    links = np.zeros(len(x), np.int64)
    label = np.arange(len(x))
    p, q = np.nonzero(np.triu(near))
    if len(p):
        first = _first_here(caps, p, q, cap)
        np.add.at(links, p[first], weight[q[first]])
        np.add.at(links, q[first], weight[p[first]])
        while True:
            low = label.copy()
            np.minimum.at(low, p, label[q])
            np.minimum.at(low, q, label[p])
            low = low[low]
            if (low == label).all():
                break
            label = low
    return links, label


def _linked(batches: Iterator[pa.RecordBatch], kind: str, cosine: float) -> Iterator[pa.RecordBatch]:
    """Cells, sorted by (cap, i, j), to (rep, links, root)."""
    for group in runs(batches, ["cap", "i", "j"]):
        cols = {n: group.column(n).to_numpy() for n in ("cap", "i", "j", "block", "rep", "weight")}
        change = np.any([cols[k][1:] != cols[k][:-1] for k in ("cap", "i", "j")], axis=0)
        bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [group.num_rows]])
        crowded = np.flatnonzero(np.diff(bounds) > 1)
        if not len(crowded):
            continue
        vectors, caps = group.column("v").to_pylist(), group.column("caps").to_numpy()
        reps, links, roots = [], [], []
        for c in crowded:
            at = slice(bounds[c], bounds[c + 1])
            own, root = link_cell(
                unit(vectors[at], kind), cols["weight"][at], (cols["block"][at] != cols["i"][at]).astype(np.int8),
                list(caps[at]), int(cols["cap"][bounds[c]]), cosine,
            )
            touched = np.flatnonzero((own > 0) | (root != np.arange(len(root))))
            reps.append(cols["rep"][at][touched])
            links.append(own[touched])
            roots.append(cols["rep"][at][root[touched]])
        if sum(map(len, reps)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a).astype(np.int64)) for a in (reps, links, roots)], ["rep", "links", "root"]
            )


def near_links(vectors: DataFrame, cosine: float = COSINE, occupancy: int = OCCUPANCY, common: float = COMMON, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    )
    digested = stage(rows.mapInArrow(lambda b: _digests(b, kind), "vec_id long, digest binary, v binary"), "digested")
    valid = digested.where("digest IS NOT NULL")
    classes = stage(
        valid.groupBy("digest").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("weight"), F.min("v").alias("v"))
        # ids may repeat, digests do not
        .withColumn("rep", F.xxhash64("digest")),
        "classes",
    )
    size = code_size(classes.count(), occupancy)
    lists = stage(
        classes.select("rep", "v").repartition("rep").mapInArrow(lambda b: _listed(b, kind, size, cosine, common), "rep long, caps array<long>"),
        "caps",
    )
    # a crowded cap gets blocks; its count is copied to salts, so that its members need not meet in one task for it
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS))
    members = lists.select("rep", F.explode("caps").alias("cap"))
    crowded = (
        members.groupBy("cap").count().where(F.col("count") > block).select(
            "cap",
            F.ceil(F.col("count") / block).cast("int").alias("blocks"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"),
        )
    )
    placed = (
        members.withColumn("salt", salt)
        .join(crowded, ["cap", "salt"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    )
    cells = placed.groupBy("rep").agg(F.collect_list(F.struct("cap", "blocks", "block")).alias("cells"))
    spread = (
        cells.join(classes.select("rep", "weight", "v"), "rep")
        .join(lists, "rep")
        .select("rep", "weight", "v", "caps", F.explode("cells").alias("c"))
        .select("rep", "weight", "v", "caps", "c.*")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .drop("blocks", "other")
    )
    found = stage(
        spread.repartition("cap", "i", "j").sortWithinPartitions("cap", "i", "j", "rep").mapInArrow(
            lambda b: _linked(b, kind, cosine), "rep long, links long, root long"
        ),
        "links",
    )
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = stage(
        classes.drop("v")
        .join(counts, "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "digest", "lowest", F.coalesce("component", "rep").alias("part"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")
        ),
        "known",
    )
    named = known.groupBy("part").agg(F.min("lowest").alias("component"))
    known = known.join(named, "part").select("digest", "links", "component")
    component = F.coalesce("component", "vec_id")
    return digested.drop("v").join(known, "digest", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def op10_cap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survival of every vector."""
    return near_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
