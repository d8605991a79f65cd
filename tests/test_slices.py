"""Slice kernels against plain loops."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulscope.operators import slices

KEYS = ["k"]


def data(spark, seed, n=400, width=50):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 4)}"
        rows.append((key, i * 1_000_000, rng.choice(["x", "y", None, None]), rng.randint(0, 1000)))
    df = spark.createDataFrame(rows, "k string, at bigint, label string, v bigint")
    return rows, slices.with_slice(df, "at", width)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_label_runs(spark, width):
    rows, df = data(spark, width, width=width)
    got = {(r.k, r["at"]): (r.side, r.prev_side, r.run_start, r.prev_run_start) for r in slices.label_runs(df, KEYS, "at", "label", "x").collect()}
    want = {}
    for key, group in groups(rows).items():
        side, start = "x", None
        for _, at, label, _ in group:
            before = (side, start)
            if label is not None and label != side:
                side, start = label, at
            want[(key, at)] = (side, before[0], start, before[1])
    assert got == want


@pytest.mark.parametrize("width", [3, 60])
def test_numbered_previous_running(spark, width):
    rows, df = data(spark, 5, width=width)
    numbered = {(r.k, r["at"]): (r.i, r.n) for r in slices.numbered(df, KEYS, ["at"], "i", "n").collect()}
    before = {(r.k, r["at"]): r.p for r in slices.previous(df, KEYS, "at", {"p": "v"}).collect()}
    top = {(r.k, r["at"]): r.m for r in slices.running_max(df, KEYS, ["at"], "v", "m").collect()}
    for key, group in groups(rows).items():
        best = None
        for i, (_, at, _, v) in enumerate(group):
            assert numbered[(key, at)] == (i + 1, len(group))
            assert before[(key, at)] == (group[i - 1][3] if i else None)
            assert top[(key, at)] == best
            best = v if best is None else max(best, v)


def test_rows_without_an_instant_are_counted_last(spark):
    df = spark.createDataFrame([("a", None, 9), ("a", 5_000_000, 2), ("a", 1_000_000, 1), ("a", 5_000_000, None), ("b", None, 1)], "k string, at bigint, v bigint")
    got = slices.numbered(slices.with_slice(df, "at", 3), KEYS, ["at", "v"], "i", "n").collect()
    assert {(r.k, r["at"], r.v): (r.i, r.n) for r in got} == {("a", 1_000_000, 1): (1, 4), ("a", 5_000_000, 2): (2, 4), ("a", 5_000_000, None): (3, 4)}


@pytest.mark.parametrize("threshold,width", [(1, 5), (150, 5), (150, 40), (600, 17), (5000, 9)])
def test_greedy_chain(spark, threshold, width):
    rows, df = data(spark, threshold + width, width=width)
    got = {(r.k, r["at"]): (r.kept, r.kept_before) for r in slices.greedy_chain(df, KEYS, "at", "v", threshold).collect()}
    want = {}
    for key, group in groups(rows).items():
        held = None
        for _, at, _, v in group:
            kept = held is None or abs(v - held) >= threshold
            want[(key, at)] = (kept, held)
            held = v if kept else held
    assert got == want


def test_chain_table_covers_every_entering_value():
    rng = random.Random(9)
    for _ in range(200):
        values = np.array([rng.randint(0, 60) for _ in range(rng.randint(1, 12))])
        threshold = rng.randint(1, 25)
        pieces, first = slices._chain_table(values, threshold)

        def leave(held):
            for v in values:
                held = v if held is None or abs(v - held) >= threshold else held
            return held

        assert first == leave(None)
        for entering in range(-40, 110):
            hit = [out for lo, hi, out in pieces if lo <= entering <= hi]
            assert len(hit) <= 1
            assert (hit[0] if hit else entering) == leave(entering)


def test_chain_table_of_a_long_slice_is_quick():
    rng = np.random.default_rng(1)
    for values in (np.arange(100_000), np.arange(100_000)[::-1], rng.integers(0, 10**9, 100_000), np.cumsum(rng.integers(-5, 6, 100_000))):
        began = time.perf_counter()
        slices._chain_table(values, 1000)
        assert time.perf_counter() - began < 2


def test_crowded_slices_are_cut(spark):
    """Of one key nearly all rows lie in one hour; ties stay together, order and results do not change."""
    rng = random.Random(3)
    at = sorted([rng.randrange(100 * 3600) for _ in range(1500)] + [50 * 3600 + rng.randrange(3000) for _ in range(3000)] + [50 * 3600 + 3001] * 400)
    rows = [("hot", t * 1_000_000 + rng.randrange(5) * (t % 2), i) for i, t in enumerate(at)] + [("k", t * 1_000_000, i) for i, t in enumerate(at[::9])]
    rows += [(None, 5_000_000, 1)]
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint").repartition(4)
    for most in (200, 10**9):
        cut = slices.bounded(df, KEYS, "at", 3600, most)
        sizes, seconds = {}, {}
        for r in cut.collect():
            name = (r.k, r[slices.SLICE])
            sizes[name] = sizes.get(name, 0) + 1
            seconds.setdefault((r.k, r["at"] // 1_000_000), set()).add(name)
            assert r[slices.SLICE] <= r["at"] // 1_000_000 < r[slices.SLICE] + 3600
        assert sum(sizes.values()) == len(rows) and all(len(s) == 1 for s in seconds.values())
        assert (sorted(sizes.values())[-1] == 400) == (most == 200)
        assert sum(n > 200 for n in sizes.values()) <= 1 or most > 200
        # slices of a key follow each other in time
        order = sorted((k, s, min(x for x in seconds if x[0] == k and seconds[x] == {(k, s)})[1]) for k, s in sizes if k)
        assert all(a[2] < b[2] for a, b in zip(order, order[1:]) if a[0] == b[0])
    plain = lambda most: sorted(
        (r.v, r.i, r.n) for r in slices.numbered(slices.bounded(df.where("k = 'hot'"), KEYS, "at", 3600, most), KEYS, ["at", "v"], "i", "n").collect()
    )
    assert plain(200) == plain(10**9)


def test_a_hot_hour_is_spread_over_tasks(spark):
    """30 % of all rows belong to one shipment and one hour; no task of the ordered part gets more than a few slices of it."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 10 < 3, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"),
        F.when(F.col("id") % 10 < 3, F.col("id") % 3600).otherwise(F.col("id") * 11).alias("s"),
        F.col("id").alias("v"),
    ).withColumn("at", F.col("s") * 1_000_000 + F.col("v") % 1000)
    cut = slices.bounded(rows, KEYS, "at", 3600, 500)
    shares = cut.repartition(50, *KEYS, slices.SLICE).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in shares) < 60_000 * 0.08
    whole = slices.with_slice(rows, "at", 3600).repartition(50, *KEYS, slices.SLICE).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in whole) > 60_000 * 0.29
