"""Operators on text against brute force, over awkward rows."""

import collections
import hashlib
import itertools
import random
import string
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haulscope.llm import chunks, common, language, lines, mixing, packing, shingles, suffixes, toxicity
from haulscope.llm.queries import QUERIES
from tests.llm.conftest import DE, EN, held_out, prose, words


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# 2: lines


def brute_lines(rows, run=3):
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    seen, out = {}, {}
    for doc, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0], r[1] or "")):
        all_ = (text or "").split("\n")
        solid = [i for i, x in enumerate(all_) if bare(x)]
        gone = set()
        for p in range(len(solid) - run + 1):
            key = tuple(bare(all_[i]) for i in solid[p : p + run])
            if key in seen:
                gone.update(solid[p : p + run])
            seen.setdefault(key, (doc, p))
        out[doc, text] = (None if text is None else "\n".join(x for i, x in enumerate(all_) if i not in gone), len(solid), len(gone))
    return out


@pytest.mark.parametrize("run", [2, 3])
def test_line_dedup_matches_brute_force(docs, rows, run):
    want = brute_lines(rows, run)
    got = collected(lines.drop_repeats(docs.withColumn("before", F.col("text")), run))
    assert len(got) == len(rows)
    for r in got:
        assert (r["text"], r["n_lines"], r["n_removed"]) == want[r["doc_id"], r["before"]]
        assert r["size"] == "x"
    assert sum(r["n_removed"] for r in got) > 50


def test_long_lines_are_runs(spark):
    rng = random.Random(12)
    long, half, other = (prose(rng, EN, n, line=999) for n in (60, 30, 30))
    given = [
        (1, f"a\n{long}\nb"), (2, long), (3, f"c\n  {long}\nc\n{long}"),
        (4, f"{half}\n\n{other}"), (5, f"d\n{half}\n{other}"), (6, f"{other}\n{half}"), (7, half),
        (2, long), (None, long), (None, long), (8, None),
    ]
    # a null id comes first, equal rows are one document, and c with the long line is a run of two lines
    want = [
        (1, "a\nb"), (2, ""), (3, "c"), (4, f"{half}\n\n{other}"), (5, "d"), (6, f"{other}\n{half}"), (7, half),
        (2, ""), (None, long), (None, long), (8, None),
    ]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = collected(lines.drop_repeats(docs, enough=50))
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(want)
    assert {r["doc_id"] for r in got if r["emptied"]} == {2}
    plan = lines.drop_repeats(docs, enough=50)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_line_dedup_runs_on_built_in_functions_only(docs):
    plan = lines.drop_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 3: packing


def test_packing_is_gapless_and_whole(docs, rows):
    from tokenizers import Tokenizer

    path, _ = packing.vocabulary()
    tokenizer = Tokenizer.from_file(path)
    got = collected(packing.pack(docs, shard=40))
    sequences = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    total = 0
    for doc in {r[0] for r in rows}:
        texts = [r[1] for r in rows if r[0] == doc]
        ids = tokenizer.encode(texts[0] or "", add_special_tokens=False).ids + [2]
        total += len(ids) * len(texts)
        mine = sorted(pieces[doc], key=lambda r: (r["piece"], r["sequence_id"], r["offset"]))[:: len(texts)]
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert all(r["length"] == 1024 for r in mine[1:]) and sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            some = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(some) == r["ids_crc32"]
    assert len(sequences) <= -(-total // 1024) + 1 + len(got) // 40


def test_genetic_operators_keep_every_document_once():
    rng = random.Random(0)
    length = [rng.randint(1, 1024) for _ in range(300)]
    population = [packing.start(length, 1024, rng, 0.1 * k) for k in range(4)]
    after = packing.evolve(population, length, 1024, rng, 6)
    for bins, fill in after:
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert fill == [sum(length[i] for i in b) for b in bins] and max(fill) <= 1024
    assert packing.fitness(after[0][1], 1024) >= max(packing.fitness(f, 1024) for _, f in population)
    assert packing._decoded(packing._coded(after[0][0], 300)) == [sorted(b) for b in after[0][0]]


def test_word_by_word_ids_equal_the_tokenizer():
    coder = packing.words(*packing.vocabulary())
    odd = ["", " a", "a ", "a  b", None, "a <|endoftext|> b", "x\n y", "don't stop", "中 字", "a  b", "a  b", " x y ", "1 22 333", "é À ü", "a\x1c b"]
    ids, at = coder.ids(pa.array(odd), 2)
    for text, low, high in zip(odd, at, at[1:]):
        assert ids[low:high].tolist() == [*coder.whole(text or "").tolist(), 2], text


# 4: mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = [s for s in free if target[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target
        capped.update(over)


def test_mixing_meets_targets(docs, rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    got = collected(mixing.mix(docs))
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(words(r["text"])) and 0 <= r["copies"] <= 3
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["copies"] * r["size"]
    largest = {s: max(len(words(r[1])) for r in rows if r[3] == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], largest[s] / 2)
    again = {(r["doc_id"], r["text"]): r["copies"] for r in collected(mixing.mix(docs.repartition(5)))}
    # of two equal rows either may be the one that is taken more often
    assert all(again[r["doc_id"], r["text"]] == r["copies"] for r in got if r["doc_id"] != 90)


def test_rates_solve_the_dual(docs):
    for r in collected(mixing.mix(docs).groupBy("source", "target").agg(F.sum(F.col("rate") * F.col("size")).alias("due"))):
        assert r["due"] == pytest.approx(r["target"], rel=1e-6)


# 5: n-gram join


def brute_components(rows, n, p, q):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and q * both >= p * (len(sets[a]) + len(sets[b]) - both):
            parent[find(b)] = find(a)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return collections.Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("n, p, block", [(4, 85, 256), (5, 80, 2), (2, 30, 3)])
def test_ngram_join_matches_brute_force(docs, rows, n, p, block):
    got = collected(shingles.near_duplicates(docs, n, (p, 100), block))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, n, p, 100)


def test_tree_finds_links_of_any_shape():
    rng = random.Random(3)
    for _ in range(60):
        sets = [sorted(rng.sample(range(14), rng.randint(1, 9))) for _ in range(10)]
        # as in a cell, all sets begin with the cell's shingle
        tails = [np.array([0, *(x + 1 for x in s)], ">u8").tobytes() for s in sets]
        sizes = [len(s) + 1 for s in sets]
        tree = shingles.Tree(tails, sizes, np.arange(10), None, np.arange(10), (60, 100))
        parent = list(range(10))
        find = lambda x: x if parent[x] == x else find(parent[x])
        for a, b in itertools.combinations(range(10), 2):
            x, y = {-1, *sets[a]}, {-1, *sets[b]}
            if 100 * len(x & y) >= 60 * len(x | y):
                parent[find(a)] = find(b)
        want = [find(i) for i in range(10)]
        parent[:] = range(10)
        for a, b in tree.join():
            parent[find(a)] = find(b)
        got = [find(i) for i in range(10)]
        same = lambda x: [[i == j for j in x] for i in x]
        assert same(got) == same(want)


# 6: toxicity


def brute_segments(s):
    """All maximal segments: the best one, then those of what lies left and right of it."""
    best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, _, a, b = best
    return brute_segments(s[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(s[b:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(5)
    for _ in range(300):
        s = [rng.choice([-3.0, -2.0, -1.1, 0.7, 1.3, 2.9]) for _ in range(rng.randint(0, 12))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(s))] == brute_segments(s)
        assert toxicity.best_segment(np.array(s)) == pytest.approx(max([0.0, *(sum(s[a:b]) for a, b in brute_segments(s))]))


def test_toxicity_tells_held_out_rows_apart(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, EN, rng.randint(20, 200)).split(" ")
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten", "nasty"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    train = spark.createDataFrame(labels, "doc_id long, toxic int").where(~common.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, train)
    got = {r["doc_id"]: r["score"] for r in collected(toxicity.score(docs, model))}
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] < 0.3
    hits = [(got[i] >= 0.3) == bool(t) for i, t in labels if held_out(i)]
    assert len(hits) > 100 and sum(hits) / len(hits) > 0.95
    found = {r["doc_id"] for r in collected(toxicity.spans(docs, model))}
    assert len(found & {i for i, t in labels if t}) > 100


def test_toxicity_without_labels_or_rows(docs, none, spark, sf_dir):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in collected(toxicity.score(docs, toxicity.fit(docs, empty)))} == {0.0}
    assert collected(toxicity.score(none, toxicity.fit(none, empty))) == []
    assert len(collected(QUERIES["op6_toxicity"](spark, sf_dir))) == docs.count()


# 7 and 8: bytes


def brute_bytes(rows, depth):
    seen, out = set(), {}
    for doc, text in sorted({(r[0], r[1] or "") for r in rows}):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - depth + 1):
            w = data[s : s + depth]
            if w in seen:
                gone[s : s + depth] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("depth, gram, crowd", [(100, 32, 20_000), (100, 32, 2), (40, 16, 3)])
def test_suffix_dedup_matches_brute_force(docs, rows, depth, gram, crowd):
    want = brute_bytes(rows, depth)
    spans = suffixes.repeated_spans(docs, depth, gram, crowd)
    got = collected(suffixes.remove_spans(docs, spans))
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]]


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (500, 24), dtype=np.uint8)
    order = suffixes.suffix_order(rows.view(">u8").astype(np.uint64))
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(got)
    want = [0] + [next((k for k in range(24) if a[k] != b[k]), 24) for a, b in zip(got, got[1:])]
    assert suffixes.common_prefixes(rows, order).tolist() == want


def brute_chunks(rows, bits, least):
    seen, out = set(), {}
    for doc, text in sorted({(r[0], r[1] or "") for r in rows}):
        data = text.encode()
        ends, h = [], 0
        for i, b in enumerate(data):
            h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
            if h >> (32 - bits) == 0 or i == len(data) - 1:
                ends.append(i + 1)
        removed, run, low = 0, 0, 0
        for e in [*ends, None]:
            again = e is not None and data[low:e] in seen
            if again:
                run += e - low
            else:
                removed += run if run >= least else 0
                run = 0
            if e is not None:
                seen.add(data[low:e])
                low = e
        out[doc] = (len(data), removed)
    return out


@pytest.mark.parametrize("bits, least", [(5, 100), (3, 20)])
def test_chunk_dedup_matches_brute_force(docs, rows, bits, least):
    want = brute_chunks(rows, bits, least)
    got = collected(chunks.drop_repeated_chunks(docs, bits, least))
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in got} == want
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    assert any(r["n_removed"] for r in got)


def test_chunks_resist_insertions():
    rng = np.random.default_rng(7)
    body = rng.integers(97, 123, 4000, dtype=np.uint8)
    shifted = np.concatenate([rng.integers(97, 123, 13, dtype=np.uint8), body])
    digest = lambda d: set(chunks.digests(d, np.array([0, len(d)]))[4].tolist())
    assert len(digest(body) & digest(shifted)) > 0.95 * len(digest(body))


@pytest.mark.parametrize("tasks", [1, 5])
def test_equal_rows_are_one_document(spark, tasks):
    rng = random.Random(11)
    one, two = prose(rng, EN, 90), prose(rng, EN, 90)
    # equal rows with and without an id; 3 is a later copy, and so is its equal row
    given = [(None, one)] * 3 + [(1, two)] * 4 + [(2, prose(rng, EN, 90))] + [(3, two)] * 2 + [(4, one)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(tasks)
    want = sorted((d or 0, len(t.encode()), len(t.encode()) if d in (3, 4) else 0) for d, t in given)
    for out in (
        suffixes.remove_spans(docs, suffixes.repeated_spans(docs)),
        suffixes.remove_spans(docs, suffixes.repeated_spans(docs, crowd=1)),
        chunks.drop_repeated_chunks(docs),
    ):
        assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in collected(out)) == want


def test_many_texts_under_one_id(spark):
    """Texts that share an id, or have none, are told apart however many there are."""
    rng = random.Random(12)
    letters = string.ascii_lowercase
    texts = ["".join(rng.choices(letters, k=rng.randint(100, 140))) for _ in range(40_000)]
    shared = "".join(rng.choices(letters, k=300))
    for k in (5, 30_000):
        texts[k] += shared
    for doc in (7, None):
        docs = spark.createDataFrame([(doc, t) for t in texts], "doc_id long, text string").repartition(4)
        for out in (suffixes.remove_spans(docs, suffixes.repeated_spans(docs)), chunks.drop_repeated_chunks(docs)):
            got = collected(out)
            assert len(got) == len(texts) and all(len(r["kept"]) + r["n_removed"] == r["n_bytes"] for r in got)
            assert [r["n_bytes"] > 400 for r in got if r["n_removed"]] == [True]
            assert sum(r["n_removed"] for r in got) > 200


def test_segments_take_linear_time():
    for scores in (np.tile([1.0, -1.1], 100_000), np.random.default_rng(0).normal(-0.1, 1.0, 200_000)):
        began = time.perf_counter()
        assert toxicity.segments(scores)
        assert time.perf_counter() - began < 5


# 9: language


def brute_pieces(text, sample):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_pieces_are_greedy_longest_matches():
    rng = random.Random(1)
    sample = {"a": "".join(rng.choice("abc ") for _ in range(200)), "b": "".join(rng.choice("bcd ") for _ in range(200))}
    model = language.Model("abcd", {k: [" abcd".index(c) for c in v] for k, v in sample.items()})
    texts = ["".join(rng.choice("abcd e") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    coded = [np.array([" abcde".index(c) for c in t], np.uint8) for t in texts]
    want = [[brute_pieces(t, sample[k]) for k in "ab"] for t in texts]
    assert model.pieces(coded).tolist() == want


def test_pieces_with_more_letters_than_columns():
    rng = random.Random(6)
    letters = "".join(chr(0x4E00 + i) for i in range(300))
    sample = {k: "".join(rng.choice(letters[at : at + 200] + " ") for _ in range(900)) for k, at in (("a", 0), ("b", 100))}
    model = language.Model(letters, {k: [(" " + letters).index(c) for c in v] for k, v in sample.items()})
    texts = [sample[k][i : i + 30] + rng.choice(["", "x", letters[7], letters[290]]) + sample["b"][i : i + 9] for k in "ab" for i in range(0, 600, 20)]
    coded = [np.array([f" {letters}x".index(c) for c in t]) for t in texts]
    assert model.pieces(coded).tolist() == [[brute_pieces(t, sample[k]) for k in "ab"] for t in texts]


def test_languages_of_large_scripts_are_told_apart(spark):
    rng = random.Random(9)
    script = {"zh": range(0x4E00, 0x4E00 + 900), "ko": range(0xAC00, 0xAC00 + 900), "ja": range(0x3041, 0x3041 + 80)}
    vocabulary = {k: [chr(rng.choice(v)) + chr(rng.choice(v)) for _ in range(80)] for k, v in script.items()}
    text = lambda lang: "".join(rng.choice(vocabulary[lang]) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["zh", "ko", "ja"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs.where("doc_id < 150"))
    got = collected(language.identify(docs.where("doc_id >= 150"), model))
    assert all(r["lang_pred"] == r["lang"] for r in got)
    # a script that no label has meets no run of another one
    unknown = spark.createDataFrame([(1, "".join(chr(0x0E01 + i % 40) for i in range(60)))], "doc_id long, text string")
    assert collected(language.identify(unknown, model))[0]["bits"] > 11


def test_language_of_held_out_rows(spark, sf_dir, rows, none):
    got = {r["doc_id"]: r for r in collected(QUERIES["op9_language"](spark, sf_dir))}
    known = {r[0]: r for r in rows}
    for i in (80, 81, 82, 84, 91):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    judged = [i for i in range(60) if held_out(i) and len(known[i][1]) > 40]
    assert sum(got[i]["lang_pred"] == known[i][2] for i in judged) >= 0.95 * len(judged)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held_out(i) for i, r in got.items())
    assert collected(language.identify(none, language.learn(none))) == []


def test_queries_take_empty_tables(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).collect() == [], name


def test_vocabularies_of_the_tests_differ():
    assert len(set(EN) & set(DE)) < 4
