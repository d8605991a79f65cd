"""Toxicity by maximum-scoring segments of token log-odds.

Each token scores the log-odds of the toxic against the other labelled texts. Both counts carry a Dirichlet prior
from the counts of the whole corpus, and the log-odds are moved towards 0 by their standard error, so a token seen in
few labelled texts stays near 0. A text is a sequence of these scores less a drift; the segments
with the largest sums (all maximal ones, found in one pass) are its toxic passages.

How large a sum chance alone gives grows with the text: the maximum of n steps of a walk with negative drift follows
an extreme-value law, P(sum >= x) = 1 - exp(-K n e^(-lambda x)). lambda solves E[e^(lambda s)] = 1 over the token
scores of the non-toxic texts and K is fitted to their maxima. The p-value of the best segment and of all significant
segments together become a probability by a logistic curve fitted to the labelled texts.

Tokens fall into ``BUCKETS`` hash buckets, so the tables of counts and scores have a fixed size however many
different tokens there are. The prior counts every token of all documents. Only the fit uses a sample: at most
``LABELLED`` rows of either label, in the order of a hash of the id, of rows that are not held out.

Defined results: a null or empty text has no segment and gets the score of an empty one; where no labels (or one
kind only) can be learned, every text scores 0.5 times the share of toxic labels; repeated rows score alike; null
labels are not learned from; labels, lang, source and doc_id are not inputs; ``spans`` gives the passages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.llm.common import by_bytes, held_out, table, word_hashes
from haulscope.session import stage

BUCKETS = 1 << 18
SLICES = 64  # parts of the count table, each summed in a task of its own
LABELLED = 8_000
PRIOR = 2_000.0  # tokens that the corpus is worth as a prior
FLAT = 1.0  # and that each bucket is worth besides
CAUTION = 1.64  # standard deviations by which log-odds are moved towards 0
DRIFT = 0.25  # taken off every token's score
SIGNIFICANT = 1e-3  # p-value of a passage that is reported
PREDICT = 0.3
PUNCTUATION = b".,;:!?\"'()[]{}|"


def buckets(column: pa.Array) -> list[np.ndarray]:
    """Buckets of the words of each text: ASCII lower case, split at ASCII white space, less punctuation at the ends."""
    hashes, counts = word_hashes(column, PUNCTUATION)
    return np.split((hashes % np.uint64(BUCKETS)).astype(np.int32), np.cumsum(counts)[:-1])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of a task, cut into slices of the bucket table: (slice, counts)."""
    total, seen = np.zeros(BUCKETS, np.int64), False
    for batch in batches:
        for part in by_bytes(batch, "text"):
            hashes, _ = word_hashes(part.column("text"), PUNCTUATION)
            total += np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            seen = True
    if seen:
        kind = "<u4" if total.max() < 1 << 32 else "<i8"
        parts = [p.astype(kind).tobytes() for p in np.split(total, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, counts) of many tasks to one row per slice."""
    width = BUCKETS // SLICES
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            kind = "<u4" if len(counts) == 4 * width else "<i8"
            sums[k] = sums.get(k, 0) + np.frombuffer(counts, kind).astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([a.tobytes() for a in sums.values()], pa.binary())], ["slice", "counts"]
        )


def token_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of every bucket in all of ``docs``: a table of fixed size."""
    rows = (
        docs.select("text").mapInArrow(_counts, "slice int, counts binary").repartition("slice").mapInArrow(_summed, "slice int, counts binary")
    ).collect()
    total = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for r in rows:
        total[r["slice"]] = np.frombuffer(r.counts, np.int64)
    return total.reshape(-1)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, sum), left to right, in linear time.

    A candidate is kept with the sum before it and the sum after it; a new one swallows the latest candidate that
    starts lower and ends lower, with all that lie between. Each candidate knows the latest one before it that starts
    lower, so a search passes over whole stretches and visits no candidate twice.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)]).tolist()
    found: list[tuple[int, int]] = []
    lower: list[int] = []  # for each candidate the latest one before it that starts lower, or -1
    for i in np.flatnonzero(scores > 0).tolist():
        low, high = i, i + 1
        k = len(found)
        j = k - 1
        while True:
            while j >= 0 and sums[found[j][0]] >= sums[low]:
                j = lower[j]
            if j < 0 or sums[found[j][1]] >= sums[high]:
                break
            low, k = found[j][0], j
            j = lower[j]
        del found[k:], lower[k:]
        found.append((low, high))
        lower.append(j)
    return [(a, b, sums[b] - sums[a]) for a, b in found]


def best_segment(scores: np.ndarray) -> float:
    if not len(scores):
        return 0.0
    sums = np.cumsum(scores)
    before = np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))
    return max(0.0, float((sums - before).max()))


@dataclass
class Model:
    odds: np.ndarray  # score of every bucket, drift taken off
    rate: float  # lambda of the extreme-value law
    size: float  # K
    curve: tuple[float, ...]  # logistic weights: constant, best passage, all passages
    base: float  # score where nothing could be learned

    def surprise(self, best: float, n: int) -> float:
        """-log p of a best sum in a text of n tokens."""
        if n == 0 or best <= 0:
            return 0.0
        expected = self.size * n * math.exp(-min(700.0, self.rate * best))
        p = -math.expm1(-expected)
        return -math.log(max(p, 1e-300))

    def features(self, scores: np.ndarray) -> tuple[float, float]:
        """Surprise of the best passage and, in logs, of all significant ones together."""
        n = len(scores)
        first = self.surprise(best_segment(scores), n)
        if first < -math.log(SIGNIFICANT):
            return math.log1p(first), 0.0
        every = sum(s for s in (self.surprise(x, n) for _, _, x in segments(scores)) if s >= -math.log(SIGNIFICANT))
        return math.log1p(first), math.log1p(every)

    def score(self, scores: np.ndarray) -> float:
        if not self.curve:
            return self.base
        z = self.curve[0] + sum(w * f for w, f in zip(self.curve[1:], self.features(scores)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _karlin(values: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with E[e^(lambda s)] = 1 for steps of negative mean, by bisection."""
    total = weights.sum()
    if not total or not (values[weights > 0] > 0).any() or (values * weights).sum() >= 0:
        return 1.0
    over = lambda x: (np.exp(np.minimum(700.0, x * values)) * weights).sum() / total > 1
    low, high = 0.0, 1.0
    while not over(high) and high < 512:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return max(high, 1e-6)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method; a small ridge keeps separable samples finite."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _odds(corpus: np.ndarray, toxic: list[np.ndarray], clean: list[np.ndarray]) -> np.ndarray:
    """Log-odds of every bucket, moved towards 0 by their uncertainty.

    The Dirichlet prior of a side is the corpus's share of the bucket times PRIOR tokens, and FLAT tokens split
    between the sides as their sizes are, so that a bucket never seen in labelled texts scores 0.
    """
    counts = [np.bincount(np.concatenate(side), minlength=BUCKETS).astype(float) for side in (toxic, clean)]
    sizes = [max(1.0, c.sum()) for c in counts]
    share = (corpus + 1e-3) / (corpus.sum() + 1e-3 * BUCKETS)
    logs, variance = [], 0.0
    for count, size in zip(counts, sizes):
        prior = (PRIOR * share + FLAT) * size / sum(sizes)
        logs.append(np.log(count + prior) - np.log(size + prior.sum() - count - prior))
        variance = variance + 1 / (count + prior)
    # priors in proportion to the sides cancel but for the odds' denominators
    odds = logs[0] - logs[1]
    return np.sign(odds) * np.maximum(0.0, np.abs(odds) - CAUTION * np.sqrt(variance)) - DRIFT


def learn(corpus: np.ndarray, toxic: list[np.ndarray], clean: list[np.ndarray], share: float) -> Model:
    """Scores, extreme-value law and curve from the bucket counts of all documents and the labelled samples."""
    toxic, clean = [t for t in toxic if len(t)], [t for t in clean if len(t)]
    if not toxic or not clean:
        return Model(np.zeros(BUCKETS), 1.0, 1.0, (), 0.5 * share)
    odds = _odds(corpus, toxic, clean)
    # law and curve come from texts scored with the odds of the other half, which have not seen them
    halves = [_odds(corpus, toxic[k::2] or toxic, clean[k::2] or clean) for k in (1, 0)]
    scored = [(halves[i % 2][t], label) for label, part in ((1.0, toxic), (0.0, clean)) for i, t in enumerate(part)]
    steps = np.concatenate([s for s, label in scored if not label])
    rate = _karlin(steps, np.ones(len(steps)))
    # K from the mean of lambda max - log n, less Euler's constant
    logs = [rate * best_segment(s) - math.log(len(s)) for s, label in scored if not label]
    model = Model(odds, rate, math.exp(float(np.mean(logs)) - 0.5772156649), (), 0.0)
    x = np.array([(1.0, *model.features(s)) for s, _ in scored])
    model.curve = tuple(_logistic(x, np.array([label for _, label in scored])).tolist())
    return model


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """Model from the text of all ``docs`` (doc_id, text) and a bounded sample of ``labels`` (doc_id, toxic)."""
    learnable = labels.select("doc_id", "toxic").where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    share = learnable.agg(F.avg("toxic")).first()[0] or 0.0
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = None
    for label in (0, 1):
        part = learnable.where(F.col("toxic") == label).distinct().orderBy(*order).limit(labelled)
        sample = part if sample is None else sample.union(part)
    # both parts have a fixed bound, so the sample may go to every task
    chosen = docs.select("doc_id", "text").join(F.broadcast(stage(sample, "labelled")), "doc_id")
    rows = chosen.mapInArrow(_bucketed, "doc_id long, toxic int, at binary")
    toxic: list[np.ndarray] = []
    clean: list[np.ndarray] = []
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r.doc_id * 2654435761 % 2**32, r.doc_id)):
        (toxic if r.toxic else clean).append(np.frombuffer(r["at"], np.int32))
    return learn(token_counts(docs), toxic, clean, float(share))


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = [t.tobytes() for part in by_bytes(batch, "text") for t in buckets(part.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array(at, pa.binary())], ["doc_id", "toxic", "at"]
        )


def _scored(columns: Iterator[pa.Array], shared) -> Iterator[pa.Array]:
    model = shared.value
    for column in columns:
        parts = by_bytes(pa.RecordBatch.from_arrays([column], ["text"]), "text")
        yield pa.array([model.score(model.odds[t]) for part in parts for t in buckets(part.column("text"))], pa.float64())


def _spans(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        out = []
        words = (t for part in by_bytes(batch, "text") for t in buckets(part.column("text")))
        for doc, at in zip(batch.column("doc_id").to_pylist(), words):
            odds = model.odds[at]
            for low, high, total in segments(odds):
                p = math.exp(-model.surprise(total, len(odds)))
                if p <= SIGNIFICANT:
                    out.append((doc, low, high, total, p))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "first_word", "end_word", "sum", "p_value"]
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the probability that its text is toxic; a column named score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _scored(columns, shared)

    return docs.drop("score").withColumn("score", scored.asNondeterministic()("text"))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """Significant passages of every text: (doc_id, first_word, end_word, sum, p_value), words counted from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda b: _spans(b, shared), "doc_id long, first_word long, end_word long, sum double, p_value double"
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text, learned from labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted")
    )
