"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integers, floor(1024 x). A component is two terms, one for each sign. Candidates lie in chunks of
consecutive ids; a chunk is a row with its forward index (ids and integer vectors) cut into blocks, and for each
block the maximum of every term. For a query the sum of term maxima, weighed by the query's own terms, bounds
every score in a block. Blocks are visited in falling order of that bound and scored through the forward index
until the next bound lies below the k-th best score, so no skipped block can hold a result.

The k-th score to start from comes from a first round over every ``SEED_EVERY``-th chunk. All chunks, these
included, then meet all queries, in blocks of both: (queries / QUERY_BLOCK) x (chunks) rows, each of bounded size.
Only scores at or above the first round's k-th leave a task, so what is merged per query does not grow with the
number of chunks.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; shorter vectors
count as padded with zeros; ties go to the smaller vec_id; candidates with equal ids are ranked as separate rows, of
queries with equal ids the shortest and then bytewise smallest is asked; extra columns are not carried; with fewer
than k candidates all are returned; an empty table gives an empty result. Scores are exact while they fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from haulscope.llm.common import table
from haulscope.session import stage

K = 10
SCALE = 1024
CHUNK = 2048  # candidates in a row of the forward index
BLOCK = 64  # candidates in a block, the unit that is scored or skipped
QUERY_BLOCK = 1024
SEED_EVERY = 32

CHUNKS = "chunk long, n int, dim int, ids binary, vectors binary, maxima binary"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, dim, v): integer vectors as bytes of int64; unusable vectors are left out."""
    for batch in batches:
        ids, dims, out = [], [], []
        for i, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            if i is None or not vector.is_valid or vector.values.null_count or not len(vector.values):
                continue
            x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                ids.append(i)
                dims.append(len(x))
                out.append(np.floor(SCALE * x).astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "v"]
        )


def _matrix(vectors: list[bytes], dims: list[int]) -> np.ndarray:
    dim = max(dims)
    if min(dims) == dim:
        return np.frombuffer(b"".join(vectors), np.int64).reshape(-1, dim)
    out = np.zeros((len(vectors), dim), np.int64)
    for row, v in zip(out, vectors):
        x = np.frombuffer(v, np.int64)
        row[: len(x)] = x
    return out


def _packed(batches: Iterator[pa.RecordBatch], rows: int, block: int) -> Iterator[pa.RecordBatch]:
    """Consecutive vectors of a partition as chunk rows: forward index and block maxima of both signs."""
    import pyspark

    part = pyspark.TaskContext.get().partitionId() if pyspark.TaskContext.get() else 0
    made = 0
    held: list[tuple[int, int, bytes]] = []

    def chunk(some: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        nonlocal made
        m = _matrix([v for _, _, v in some], [d for _, d, _ in some])
        starts = np.arange(0, len(m), block)
        # the terms of a component are its positive and its negative part
        maxima = np.concatenate([np.maximum.reduceat(m, starts), np.maximum.reduceat(-m, starts)], axis=1)
        ids = np.array([i for i, _, _ in some], np.int64)
        made += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 32) + made - 1], pa.int64()),
                pa.array([len(m)], pa.int32()),
                pa.array([m.shape[1]], pa.int32()),
                *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (ids, m, maxima)),
            ],
            ["chunk", "n", "dim", "ids", "vectors", "maxima"],
        )

    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dim", "v")))
        while len(held) >= rows:
            yield chunk(held[:rows])
            held = held[rows:]
    if held:
        yield chunk(held)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T over int64, through the fast double product where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * float(max(1, np.abs(a).max())) * float(max(1, np.abs(b).max()))
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search_chunk(
    ids: np.ndarray, vectors: np.ndarray, maxima: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, block: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, score) of what may be among the k best: at or above ``floor`` and the chunk's k-th."""
    dim = vectors.shape[1]
    q = queries if queries.shape[1] >= dim else np.pad(queries, ((0, 0), (0, dim - queries.shape[1])))
    q = q[:, :dim]
    terms = np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], axis=1)
    bounds = _product(terms, maxima)
    order = np.argsort(-bounds, axis=1, kind="stable")
    nq = len(q)
    worst = -(2**62)  # below every score, and its negative fits
    best = np.full((nq, k), worst, np.int64)
    kth = floor.copy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    alive = np.arange(nq)
    for step in range(bounds.shape[1]):
        which = order[alive, step]
        # bounds fall along a query's order: once below the k-th score, all that follow are
        keep = bounds[alive, which] >= kth[alive]
        alive, which = alive[keep], which[keep]
        if not len(alive):
            break
        for b in np.unique(which):
            mine = alive[which == b]
            low, high = b * block, min((b + 1) * block, len(ids))
            score = _product(q[mine], vectors[low:high])
            own = query_ids[mine][:, None] == ids[low:high][None, :]
            hit = (score >= kth[mine][:, None]) & ~own
            i, j = np.nonzero(hit)
            out.append((mine[i], low + j, score[i, j]))
            score[own] = worst
            both = np.concatenate([best[mine], score], axis=1)
            best[mine] = -np.partition(-both, k - 1, axis=1)[:, :k]
            kth[mine] = np.maximum(kth[mine], best[mine].min(axis=1))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    qi, ci, s = (np.concatenate(x) for x in zip(*out))
    last = s >= kth[qi]
    return qi[last], ci[last], s[last]


def _scored(batches: Iterator[pa.RecordBatch], k: int, block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            at = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
            ints = lambda n: np.frombuffer(at[n], np.int64)
            ids, dim = ints("ids"), at["dim"]
            query_ids = ints("q_ids")
            floor = ints("q_floor") if at["q_floor"] is not None else np.full(len(query_ids), np.iinfo(np.int64).min)
            qi, ci, s = search_chunk(
                ids, ints("vectors").reshape(-1, dim), ints("maxima").reshape(-1, 2 * dim), query_ids,
                ints("q_vectors").reshape(-1, at["q_dim"]), floor, k, block,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[qi]), pa.array(ids[ci]), pa.array(s)], ["query_id", "vec_id", "score"]
            )


def _floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query rows in blocks: ids, integer vectors and the scores to start from."""
    for batch in batches:
        for low in range(0, batch.num_rows, QUERY_BLOCK):
            part = batch.slice(low, QUERY_BLOCK)
            m = _matrix(part.column("v").to_pylist(), part.column("dim").to_pylist())
            floor = np.array([np.iinfo(np.int64).min if f is None else f for f in part.column("floor").to_pylist()], np.int64)
            ids = np.array(part.column("vec_id").to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([m.shape[1]], pa.int32()),
                    *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (ids, m, floor)),
                ],
                ["q_dim", "q_ids", "q_vectors", "q_floor"],
            )


def _meet(chunks: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """Scores of every chunk with every block of queries.

    Chunks are dealt to as many numbered lanes as there are tasks; query blocks are copied to each lane, and a
    lane's chunks meet them there. Rows are blocks of bounded size, and a lane streams its pairs. The copies are never
    broadcast: their size is estimated without the lanes, and together they would not fit the driver.
    """
    lanes = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.withColumn("lane", F.pmod(F.xxhash64("chunk"), F.lit(lanes)))
    copied = queries.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    return (
        dealt.join(copied.hint("merge"), "lane")
        .drop("lane", "chunk", "n")
        .mapInArrow(lambda batches: _scored(batches, k, block), "query_id long, vec_id long, score long")
    )


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, rows: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best of ``candidates``, but itself.

    Both have vec_id and embedding; a query's own vec_id is never its result.
    """
    ids = "vec_id long, dim int, v binary"
    cand = candidates.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_integers, ids)
    chunks = stage(
        cand.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(lambda b: _packed(b, rows, block), CHUNKS),
        "chunks",
    )
    asked = queries.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_integers, ids)
    asked = stage(asked.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v"), "queries")
    blocks = "q_dim int, q_ids binary, q_vectors binary, q_floor binary"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    seeds = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(SEED_EVERY)) == 0)
    first = asked.withColumn("floor", F.lit(None).cast("long")).mapInArrow(_floors, blocks)
    found = _meet(seeds, first, k, block)
    # the k-th best so far; fewer than k give no bound
    floor = (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    )
    second = asked.join(floor, "vec_id", "left").select("vec_id", "dim", "v", "floor").mapInArrow(_floors, blocks)
    every = _meet(chunks, stage(second, "floors"), k, block)
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows.where("vec_id % 100 = 0"), rows)


ORACLE = """
WITH usable AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 10
"""
