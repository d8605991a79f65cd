"""Hard negatives against brute force and their SQL."""

import collections
import math

import duckdb
import numpy as np
import pytest

from haulscope.llm import negatives
from haulscope.llm.queries import ORACLES, QUERIES
from tests.llm.test_vectors import usable

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string"


def vectors():
    """Clusters that several labels share, ties, copies, one label with a third of all rows, and every odd case."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 12))
    rows = []
    for i in range(700):
        x = centres[i % 6] * rng.uniform(0.2, 1.2) + rng.standard_normal(12) * 0.3
        rows.append((i, x.astype("f4").tolist(), 0 if i % 3 == 0 else int(rng.integers(0, 10)), "a", "b"))
    rows += [(700 + i, rows[i % 40][1], i % 10, "a", "b") for i in range(150)]
    rows += [(1000, rows[1][1], None, "a", "b"), (1100, None, 1, "a", "b"), (1200, [float("nan")] * 12, 1, "a", "b")]
    rows += [(1300, [1.0, None] * 6, 1, "a", "b"), (1400, [float("inf")] * 12, 1, "a", "b"), (1500, [0.0] * 12, 3, None, None)]
    rows += [(1600, [50.0 * v for v in rows[7][1]], 4, "a", "b"), (1700, [-v for v in rows[7][1]], 77, "a", "b"), (None, rows[3][1], 2, "a", "b")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("negatives"))
    spark.createDataFrame(vectors(), SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def brute(rows, is_anchor, positives, n, low, high, scale):
    """The rows of every window, one window at a time."""
    out = []
    for i, a, label in rows:
        if not is_anchor(i):
            continue
        scored = []
        for j, b, other in rows:
            w = min(len(a), len(b))
            if i != j:
                s = int(np.floor(scale * a[:w]).astype(np.int64) @ np.floor(scale * b[:w]).astype(np.int64))
                scored.append((-s, j, other))
        scored.sort()
        for neg, p, _ in [s for s in scored if s[2] == label][:positives]:
            found = [s for s in scored if s[2] != label and low * -neg <= 100 * -s[0] <= high * -neg][:n]
            out += [(i, p, k + 1, j, -neg, -s) for k, (s, j, _) in enumerate(found)]
    return sorted(out)


def typed(rows):
    kept = [r for r in rows if r[0] is not None and r[2] is not None]
    return [(i, v, kept_label) for (i, v), kept_label in zip(usable([(r[0], r[1]) for r in kept], zero=True), labels(kept))]


def labels(rows):
    return [r[2] for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]


@pytest.mark.parametrize(
    "positives, n, low, high, scale, chunk, block", [(5, 10, 30, 90, 256, 16384, 1024), (3, 4, 0, 100, 256, 50, 7), (9, 2, 50, 70, 4096, 300, 3)]
)
def test_mining_is_exact(spark, folder, monkeypatch, positives, n, low, high, scale, chunk, block):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", block)
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = negatives.mine(table, table.vec_id % 20 == 0, positives, n, low, high, scale).collect()
    assert sorted(tuple(r) for r in got) == brute(typed(vectors()), lambda i: i % 20 == 0, positives, n, low, high, scale)


def test_query_and_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    result = con.execute(ORACLES["op13_hard_negatives"])
    names = [d[0] for d in result.description]
    df = QUERIES["op13_hard_negatives"](spark, folder)
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(r[n] for n in names) for r in df.collect())
    assert got == sorted(result.fetchall()) and got


def test_slots_are_disjoint_and_their_suffixes_are_the_windows():
    rng = np.random.default_rng(5)
    rows, anchors = rng.integers(-90, 90, (3000, 4)), rng.integers(-90, 90, (3, 4))
    a_labels, group = np.array([0, 1, 2]), rng.integers(0, 3, 3000)
    uppers = np.array([[9000, 7000, 7000, 100], [5000, 4000, 3000, 0], [12000, 12000, 12000, 12000]])
    least = np.array([-50, 0, 11000])
    a, slot, at, score = negatives.negatives_of(np.array([-1, -2, -3]), a_labels, anchors, uppers, least, np.arange(3000), group, rows, 6)
    seen = collections.defaultdict(list)
    for x in zip(a.tolist(), slot.tolist(), score.tolist(), at.tolist()):
        seen[x[0]].append(x[1:])
    for i in range(3):
        true = sorted((-int(anchors[i] @ rows[c]), c) for c in range(3000) if group[c] != a_labels[i])
        held = sorted((-s, c) for _, s, c in seen[i])
        for upper in uppers[i]:
            window = [x for x in true if least[i] <= -x[0] <= upper][:6]
            assert [x for x in held if -x[0] <= upper][:6] == window
        assert all(max(np.append(uppers[i, j + 1 :], least[i] - 1)) < s <= uppers[i, j] or s == least[i] for j, s, _ in seen[i])


def test_repeated_ids_and_empty_table(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2), (100, [0.6, 0.0], 2), (3, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in negatives.mine(df, df.vec_id == 100).collect())
    assert got == [(100, 1, 1, 2, 65536, 32768), (100, 1, 2, 2, 65536, 32768)]
    assert negatives.mine(df.where("vec_id < 0"), df.vec_id == 100).collect() == []


def test_copies_of_anchor_blocks_are_not_broadcast(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    plan = negatives.mine(table, table.vec_id % 20 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [lane" in plan and "BroadcastHashJoin [lane" not in plan
