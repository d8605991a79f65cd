"""Source divergence against brute force and its SQL."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from haulscope.llm import divergence
from haulscope.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, rank string, value string, part string"


def terms_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(rows, least, top, scale=10**9):
    docs, n = collections.Counter(), collections.Counter()
    groups = sorted({(lang or "", source or "") for _, lang, source in rows})
    for text, lang, source in rows:
        terms = terms_of(text)
        n.update((lang or "", source or "", t) for t in terms)
        n.update((lang or "", None, t) for t in terms)
        docs.update((lang or "", t) for t in set(terms))
    kept = collections.defaultdict(list)
    for (lang, t), d in docs.items():
        if d >= least:
            kept[lang].append(t)
    total = collections.Counter()
    for (lang, source, t), k in n.items():
        if docs[lang, t] >= least:
            total[lang, source] += k

    def p(lang, source, t):
        return 1 + scale * (n[lang, source, t] + 2) // (total[lang, source] + 2 * len(kept[lang]))

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    out = []
    for lang, source in groups:
        pairs = [(-sum(f(p(lang, source, t), p(lang, o, t)) for t in kept[lang]), o) for g, o in groups if g == lang and o != source]
        out += [(lang, source, "pair", o, -v, k + 1) for k, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())))]
        marks = [
            (-f(p(lang, source, t), p(lang, None, t)), t) for t in kept[lang] if n[lang, source, t] and p(lang, source, t) > p(lang, None, t)
        ]
        out += [(lang, source, "term", t, -v, k + 1) for k, (v, t) in enumerate(sorted(marks, key=lambda x: (x[0], x[1].encode()))[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdeéßñЖ漢") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = []
    for i in range(400):
        # a third of all rows in one source; each source prefers some words
        source = "s0" if i % 3 == 0 else f"s{rng.randrange(9)}"
        lean = [w for w in vocabulary if hash((source, len(w), w[0] in "abc")) % 3] if i % 2 else vocabulary
        text = rng.choice([" ", "\n", "-", "4"]).join(rng.choice(lean or vocabulary) for _ in range(rng.randint(0, 60)))
        rows.append((i, text.upper() if i % 7 == 0 else text, ["en", "de", None, "", "x"][i % 5 if i % 50 else 4], source))
    rows += [(500 + i, "tie one two three four five six seven eight nine ten eleven twelve", "ties", f"t{i % 3}") for i in range(30)]
    rows += [(600, None, "en", None), (601, "", "en", ""), (602, "1 2 3", "en", "empty"), (603, None, None, None), (604, "word", "few", "a"), (605, "word", "few", "b")]
    rows += [(700 + i, "Long" + "é" * 3000 + " \x00\x7f[]^_`{|}~@ a.b" * 20 + " Straße", "en", "s1") for i in range(12)]
    rows += [(800, "same text", "en", "s2")] * 12 + [(900, " ".join(vocabulary * 400), "en", "s3")]
    rows += [(1000 + i, "ABC abc ÀÀ", "many", f"m{i:03d}é" if i % 2 else f"m{i:03d}z") for i in range(140)]
    return [(*r, "x", "y", "z") for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("divergence"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


def columns(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_query_sql_and_brute_force(spark, folder):
    want = brute([r[1:4] for r in corpus()], 10, 10)
    df = QUERIES["op12_source_divergence"](spark, folder)
    assert columns(df) == want and {r[0] for r in want} == {"", "en", "de", "x", "ties", "few", "many"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    result = con.execute(ORACLES["op12_source_divergence"])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[names.index(c)] for c in ("lang", "source", "part", "item", "value", "rank")) for r in result.fetchall()) == want


@pytest.mark.parametrize("entries, part, side, cells, salts", [(1, 8, 3, 20, 1), (50, 1 << 20, 64, 1 << 20, 5)])
def test_bounds_change_nothing(spark, folder, monkeypatch, entries, part, side, cells, salts):
    for name, value in {"PART": part, "SIDE": side, "CELLS": cells, "SALTS": salts}.items():
        monkeypatch.setattr(divergence, name, value)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 700")
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    counts = divergence.term_counts
    monkeypatch.setattr(divergence, "term_counts", lambda rows: counts(rows, entries))
    assert columns(divergence.audit(docs, 4, 3)) == brute([r[1:4] for r in corpus() if r[0] < 700], 4, 3)


def test_parts_of_a_text_end_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PART", 5)
    for text in (b"", b"a", b"aaaaaaaaaaaaaa", b"aa bb cc dd eeeeeeeeeeee f", b"    ", b"aaaaa bbbbb ccccc"):
        parts = list(divergence._parts(text))
        assert b"".join(parts) == text and sum((p.split() for p in parts), []) == text.split()


def test_probabilities_at_the_edges():
    rng = np.random.default_rng(0)
    p, q = rng.integers(1, 10**9 + 2, 1000), rng.integers(1, 10**9 + 2, 1000)
    assert divergence._f(p, q).tolist() == [(int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p, q)]


def test_empty_table(none):
    assert divergence.audit(none).collect() == []
