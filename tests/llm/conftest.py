"""Small tables with the awkward rows that every operator must take, and brute-force helpers."""

import random
import re
import zlib

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        T.StructField("size", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("n_removed", T.StringType()),
    ]
)
EN = "the of and to in is that for was with as on be at by this had not are but from or have an they which".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def words(text, lower=True):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def prose(rng, vocabulary, n, line=9):
    out = []
    for k in range(n):
        out.append(rng.choice(vocabulary) + rng.choice(["", "", "", "s", "ing", "er"]) * (rng.random() < 0.3))
        out.append("\n" if k % line == line - 1 else " ")
    return "".join(out).strip()


def awkward(rng=None):
    """Rows of documents: prose in two languages, copies, near copies, shared passages, and every odd case."""
    rng = rng or random.Random(4)
    rows = []
    for i in range(60):
        vocabulary, lang = (EN, "en") if i % 3 else (DE, "de")
        rows.append([i, prose(rng, vocabulary, rng.randint(5, 120)), lang, f"s{i % 5}"])
    base = prose(rng, EN, 150)
    for i in range(60, 72):
        w = base.split(" ")
        for _ in range(i - 60 if i < 66 else 0):
            w[rng.randrange(len(w))] = f"changed{rng.randrange(9)}"
        rows.append([i, " ".join(w), "en", "s0"])
    passage = prose(rng, EN, 60)
    for i in range(72, 80):
        rows.append([i, f"{prose(rng, EN, 20)}\n{passage}\n{prose(rng, EN, 20)}", "en", None if i % 2 else "s1"])
    rows += [
        [80, None, None, None],
        [81, "", "en", "s1"],
        [82, " \n\t \r\n ", None, "s2"],
        [83, "one two", "en", "s2"],
        [84, "12 345 !!", "en", "s3"],
        [85, prose(rng, EN, 6000), "en", "s3"],
        [86, "x" * 5000, None, "s4"],
        [87, "漢字 かな “curly” <|endoftext|>  two  spaces é", "de", "S"],
        [88, "a\nb\nc\nd\ne", "en", "s3"],
        [89, "z\nb\nc\nd\ny", "en", "s3"],
        [90, "one two", "en", "s2"],
        [90, "one two", "en", "s2"],
        [91, None, "en", "s9"],
    ]
    return [(i, t, lang, source, None if t is None else len(t), "x", "y", "z") for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def sf_dir(spark, docs, rows, tmp_path_factory):
    """A folder with the tables of the awkward rows."""
    import numpy as np

    folder = str(tmp_path_factory.mktemp("awkward"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int(r[0] % 7 == 0)) for r in rows if r[0] < 60] + [(61, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rng = np.random.default_rng(1)
    vectors = [(int(i), v.tolist(), 1) for i, v in enumerate(rng.standard_normal((420, 16)).astype("f4"))]
    for i in range(420, 520):
        vectors.append((i, (np.array(vectors[i % 7][1]) + rng.standard_normal(16) * 0.05).astype("f4").tolist(), 1))
    vectors += [(520 + k, vectors[3][1], 1) for k in range(30)]
    vectors += [(600, None, 1), (601, [0.0] * 16, 1), (602, [None] * 16, 1), (603, [float("nan")] * 16, 1), (604, [float("inf")] * 16, 1)]
    vectors += [(605, [], 1), (606, [1.0, 2.0], None), (700, [2.0 * x for x in vectors[3][1]], 1), (700, vectors[3][1], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder
