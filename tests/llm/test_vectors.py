"""Operators on embeddings against brute force."""

import collections
import math

import numpy as np
import pytest

from haulscope.llm import caps, topk
from haulscope.llm.queries import QUERIES


def usable(rows, zero=False):
    out = []
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out.append((i, np.array(v, np.float64)))
    return out


def read(spark, sf_dir):
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]


def brute_top(queries, rows, k):
    out = {}
    for i, q in queries:
        scored = []
        for j, c in rows:
            n = min(len(q), len(c))
            if i != j:
                scored.append((-int(np.floor(1024 * q[:n]).astype(np.int64) @ np.floor(1024 * c[:n]).astype(np.int64)), j))
        out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("k, chunk, block", [(10, 2048, 64), (3, 16, 4), (700, 50, 7)])
def test_top_k_is_exact(spark, sf_dir, k, chunk, block, monkeypatch):
    monkeypatch.setattr(topk, "SEED_EVERY", 4)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = table.where("vec_id % 20 = 0 AND vec_id <> 700")
    rows = usable(read(spark, sf_dir), zero=True)
    want = brute_top([r for r in rows if r[0] % 20 == 0 and r[0] != 700], rows, k)
    got = collections.defaultdict(dict)
    for r in topk.top_k(queries, table, k, chunk, block).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want)
    for i, found in got.items():
        assert [found[n] for n in sorted(found)] == want[i] and sorted(found) == list(range(1, len(found) + 1))


def test_blocks_are_skipped_on_ordered_vectors():
    """On clustered vectors the bounds leave most blocks unscored."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-1000, 1000, (32, 8))
    vectors = np.repeat(centres, 64, axis=0) + rng.integers(-20, 20, (2048, 8))
    starts = np.arange(0, 2048, 64)
    maxima = np.concatenate([np.maximum.reduceat(vectors, starts), np.maximum.reduceat(-vectors, starts)], axis=1)
    scored = []
    plain = topk._product

    def counted(a, b):
        scored.append(len(a) * len(b))
        return plain(a, b)

    topk._product = counted
    try:
        topk.search_chunk(np.arange(2048), vectors, maxima, np.array([-1]), centres[:1], np.array([-(2**62)]), 10, 64)
    finally:
        topk._product = plain
    assert sum(scored[1:]) < 2048 / 4


def brute_links(rows, cosine):
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x, y = rows[a][1], rows[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[a] += 1
                links[b] += 1
                parent[find(b)] = find(a)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], links[i], least[find(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [256, 8])
def test_cap_links(spark, sf_dir, block):
    every = read(spark, sf_dir)
    rows = usable(every)
    want = collections.Counter(brute_links(rows, 0.9)) + collections.Counter((i, 0, i) for i, v in every if not usable([(i, v)]))
    result = caps.near_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), block=block).collect()
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in result)
    assert sum(got.values()) == len(every)
    assert all(r.kept == (r.vec_id == r.component_id) for r in result)
    found, true = sum(k[1] * n for k, n in got.items()), sum(k[1] * n for k, n in want.items())
    assert found <= true and found >= 0.97 * true
    assert sum((got & want).values()) >= 0.95 * len(every)


def test_recall_on_the_given_vectors(spark):
    """Pairs at and just above the bound, the hardest ones: planted among the given embeddings."""
    rng = np.random.default_rng(3)
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    for k in range(300):
        x = np.array(rows[k][1]) / np.linalg.norm(rows[k][1])
        other = rng.standard_normal(len(x))
        other -= (other @ x) * x
        rows.append((10_000 + k, (0.902 * x + math.sqrt(1 - 0.902**2) * other / np.linalg.norm(other)).tolist()))
    result = caps.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in result) >= 0.95 * 600
    assert sum(r.n_links for r in result) <= 600


def test_list_decoding_finds_every_direction():
    code = caps.Code(10, 12, 0.9, 6.0)
    x = caps.Code._unit(np.random.default_rng(1), 20, 10)
    for v, found in zip(x, code.lists(x)):
        want = [a * 12 + b for a in range(12) for b in range(12)
                if (v[:5] @ code.halves[0][a] + v[5:] @ code.halves[1][b]) / math.sqrt(2) >= code.threshold]
        assert found.tolist() == want


def test_registered_queries_run(spark, sf_dir):
    for name in ("op1_top_k", "op10_cap_links"):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_copies_of_query_blocks_are_not_broadcast(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    plan = topk.top_k(table.where("vec_id % 10 = 0"), table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [lane" in plan and "Broadcast" not in plan
