"""The pipeline's stages, each against brute force on what it is given."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from haulscope.llm import queries
from tests.llm.conftest import DE, EN, words
from tests.llm.test_text import brute_components, brute_lines, brute_targets, collected

STEPS = dict(pipeline.STAGES)


def as_rows(frame):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in collected(frame)]


def test_order_of_stages():
    assert [n for n, _ in pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]


def test_stages_keep_the_columns(spark, docs, none, sf_dir):
    for name, step in pipeline.STAGES[:-1]:
        for given in (docs, none):
            out = step(spark, given, sf_dir)
            assert out.columns == docs.columns, name
            if given is none:
                assert out.count() == 0


def test_language_stage_drops_what_has_no_letters(spark, docs, rows, sf_dir):
    left = {r[0] for r in as_rows(STEPS["language"](spark, docs, sf_dir))}
    gone = {r[0] for r in rows} - left
    assert {80, 81, 82, 84, 91} <= gone
    assert not gone & set(range(80))


def test_language_stage_keeps_what_is_too_short_to_tell(spark, docs, sf_dir):
    short = [w for v in (EN, DE) for w in (v[0], v[3] + " " + v[5], v[7][0], "Re.", "A.", "漢字", "2024-01-01 a")]
    foreign = ["".join(chr(0x0E01 + i % 40) for i in range(60)), "漢字かなカナ" * 10]
    rows = [(1000 + i, t, None, "s", len(t), "x", "y", "z") for i, t in enumerate([*short, *foreign])]
    given = docs.union(spark.createDataFrame(rows, docs.schema))
    left = {r[1] for r in as_rows(STEPS["language"](spark, given, sf_dir)) if r[0] >= 1000}
    assert left == set(short)
    # where nothing is labelled nothing is foreign
    bare = spark.createDataFrame([*rows, (1, "12 3", None, "s", 4, "x", "y", "z")], docs.schema)
    assert STEPS["language"](spark, bare, sf_dir).count() == len(rows)


def test_line_stage(spark, docs, rows, sf_dir):
    want = collections.Counter()
    for (doc, text), (left, solid, gone) in brute_lines(rows).items():
        if not gone or gone < solid:
            times = sum(1 for r in rows if (r[0], r[1]) == (doc, text))
            want[doc, left] += times
    got = as_rows(STEPS["line_dedup"](spark, docs, sf_dir))
    assert collections.Counter((r[0], r[1]) for r in got) == want
    for r in collected(STEPS["line_dedup"](spark, docs, sf_dir)):
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_line_stage_deletes_long_lines(spark, docs, sf_dir):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, None, "s", len(long), "x", "y", "z"), (2, f"a\n{long}", None, "s", 2 + len(long), "x", "y", "z")]
    got = collected(STEPS["line_dedup"](spark, spark.createDataFrame(rows, docs.schema), sf_dir))
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got) == [(1, long, len(long)), (2, "a", 1)]


def test_near_stage_keeps_one_of_each_group(spark, docs, rows, sf_dir):
    want = {k[0] for k in brute_components(rows, 5, 80, 100) if k[1] == 0 or k[0] == k[2]}
    got = [r[0] for r in as_rows(STEPS["near_dedup"](spark, docs, sf_dir))]
    assert sorted(got) == sorted(want)


def test_mix_stage(spark, docs, rows, sf_dir):
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    times = collections.Counter()
    for r in as_rows(STEPS["mix_sources"](spark, docs, sf_dir)):
        taken[r[3]] += len(words(r[1]))
        times[r[0]] += 1
    for source, target in brute_targets(sizes).items():
        largest = max(len(words(r[1])) for r in rows if r[3] == source)
        assert abs(taken[source] - target) <= max(0.02 * target, largest / 2)
    assert max(times.values()) <= 6  # 90 is there twice


def test_pipeline_on_given_documents(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(out.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    worst = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert worst <= 1024 and out.count() > 100


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(result.fetchall())
