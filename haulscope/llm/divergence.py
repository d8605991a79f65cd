"""Source divergence audit: which sources of a language speak differently, and by which terms. Exact, by count cells.

Terms are runs of letters (ASCII ones and all bytes beyond ASCII), A-Z lower-cased. Each lang keeps the terms that occur
in at least ``least_documents`` of its documents. A group is a (lang, source); with ``count`` occurrences of a term among N
occurrences of kept terms, p = 1 + floor(scale * (count + 2) / (N + 2 V)), and f = floor((p - q)^2 / (p + q)).

f depends on two counts only, so terms are handled by cell:

* ``term``: the cell is (count in the group, count in the lang). f is evaluated once per cell, cells of equal value are
  merged, and the running number of terms over falling values tells which values reach the first ``top`` ranks. Only
  their terms are expanded, in UTF-8 order.
* ``pair``: a sum over all kept terms, also those that neither source has. With a zero count's p written p0 and q0,

      sum f(p, q) = V f(p0, q0) + sum over a's cells of f(p, q0) - f(p0, q0)
                                + sum over b's cells of f(p0, q) - f(p0, q0)
                                + sum over terms of both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

  The first three need the cells of one source each, (count, number of terms). The last is summed in tasks over dense
  blocks of sources, so a term that all sources share gives one small matrix and not a row for each pair of them.

Tasks count terms of their own texts and pass on sums, bounded in entries; a term or lang of any frequency is spread over
all tasks before the shuffle. The output holds every pair of sources of a lang, as asked; pairs are made in salted parts
of a lang and no other pairs of rows are.

Defined results: null text, lang and source count as empty strings, and an empty lang or source is a group like any other;
every row of the table is a document, also repeated ones; texts without terms count for their group, which appears in
part ``pair`` with the probabilities of zero counts; a lang without kept terms gives pairs of value 0; extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from haulscope.functions.timeparts import int_div
from haulscope.llm.common import runs, table
from haulscope.session import stage

LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP = 10
ENTRIES = 300_000  # counts a task holds before it passes them on
PART = 1 << 20  # bytes of a text that are cut into terms at once
SALTS = 16  # parts in which a lang's pairs are made
SIDE = 64  # sources on a side of a dense block
CELLS = 1 << 20  # numbers in a dense block

# every byte that is no part of a term becomes a space; the bytes of UTF-8 beyond ASCII are all parts of terms
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def _parts(data: bytes) -> Iterator[bytes]:
    """A cleaned text in parts that end between terms."""
    at = 0
    while len(data) - at > PART:
        # a term longer than a part moves the cut beyond it
        cut = data.find(b" ", at + PART)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def _counted(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, term) with occurrences and documents, added up within a task as far as ``entries`` allow."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 20_000):
                part = terms[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()),
                        pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()),
                        pa.array([docs[t] for t in part], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in batches:
        raw = batch.column("text").cast(pa.large_binary())
        for lang, source, data in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw):
            n, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            before = len(n)
            seen: set[bytes] = set()
            for part in _parts((data.as_py() or b"").translate(_LETTERS)):
                terms = part.split()
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before
            if size > entries:
                yield from passed_on()
                size = 0
    yield from passed_on()


def term_counts(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the documents it is in, by group."""
    parts = docs.select("lang", "source", "text").mapInArrow(lambda batches: _counted(batches, entries), COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column, scale: int = SCALE) -> Column:
    return 1 + int_div(scale * (count + 2), total + 2 * terms)


def divergence(p: Column, q: Column) -> Column:
    return int_div((p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shared_sums(term: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, sum) for sources a < b: over the terms they share, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0); by dense blocks.

    ``term`` and ``source`` are numbers from 0, ``p`` and ``p0`` the probabilities of each entry and of its source's zero count.
    """
    out = []
    side = min(SIDE, int(source.max(initial=0)) + 1)
    block = source // side
    for i in np.unique(block):
        for j in np.unique(block[block >= i]):
            mine, theirs = np.flatnonzero(block == i), np.flatnonzero(block == j)
            both = np.intersect1d(term[mine], term[theirs])
            total = np.zeros((side, side), np.int64)
            step = max(1, CELLS // side**2)
            for at in range(0, len(both), step):
                some = both[at : at + step]
                sides = []
                for entries, base in ((mine, i * side), (theirs, j * side)):
                    of = entries[np.isin(term[entries], some)]
                    row, column = np.searchsorted(some, term[of]), source[of] - base
                    # an absent entry has p = p0 and adds nothing
                    full, zero = np.ones((len(some), side), np.int64), np.ones((len(some), side), np.int64)
                    full[row, column], zero[row, column] = p[of], p0[of]
                    sides.append((full, zero))
                (pa_, a0), (pb, b0) = ((x[:, :, None], y[:, :, None]) if k == 0 else (x[:, None, :], y[:, None, :]) for k, (x, y) in enumerate(sides))
                total += (_f(pa_, pb) - _f(pa_, b0) - _f(a0, pb) + _f(a0, b0)).sum(axis=0)
            a, b = np.nonzero(np.triu(total, 1) if i == j else total)
            out.append((a + i * side, b + j * side, total[a, b]))
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, source, p, p0) in order of lang and term to partial sums (lang, low, high, shared) of sources low < high."""
    for some in runs(batches, ["lang", "term"]):
        langs, terms = (some.column(c).to_numpy() for c in ("lang", "term"))
        new = np.concatenate([[True], langs[1:] != langs[:-1]])
        term = np.cumsum(np.concatenate([[False], (terms[1:] != terms[:-1]) | new[1:]]))
        at = np.append(np.flatnonzero(new), len(langs))
        for low, high in zip(at[:-1], at[1:]):
            part = some.slice(low, high - low)
            sources = part.column("source").to_pylist()
            names = sorted(set(sources))
            number = {name: k for k, name in enumerate(names)}
            found = shared_sums(term[low:high], np.array([number[s] for s in sources]), part.column("p").to_numpy(), part.column("p0").to_numpy())
            for a, b, total in found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([langs[low]] * len(a), pa.string()),
                        pa.array([names[k] for k in a], pa.string()),
                        pa.array([names[k] for k in b], pa.string()),
                        pa.array(total),
                    ],
                    ["lang", "low", "high", "shared"],
                )


def ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order))


def pair_part(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) for all pairs of sources of a lang; ``groups`` has lang, source, total, terms."""
    zero = probability(F.lit(0), F.col("total"), F.col("terms"))
    some = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "total", "terms")
    # a group has at most sqrt(2 N) different counts
    cells = some.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"), F.first("total").alias("total"), F.first("terms").alias("terms"))
    cell = F.struct(probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"), F.col("m"))
    cells = cells.groupBy("lang", "source").agg(F.collect_list(cell).alias("cells"))
    sides = stage(
        groups.join(cells, ["lang", "source"], "left").select(
            "lang", "source", "terms", F.when(F.col("terms") > 0, zero).alias("p0"), F.coalesce("cells", F.array()).alias("cells")
        ),
        "sides",
    )
    shared = (
        some.select("lang", "term", "source", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"), zero.alias("p0"))
        .repartition("lang", "term")
        .sortWithinPartitions("lang", "term")
        .mapInArrow(_shared, "lang string, low string, high string, shared long")
        .groupBy("lang", "low", "high")
        .agg(F.sum("shared").alias("shared"))
    )
    one = sides.select("lang", "terms", F.struct("source", "p0", "cells").alias("a"), F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("salt"))
    two = sides.select("lang", F.struct("source", "p0", "cells").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    pairs = one.join(two, ["lang", "salt"]).where("a.source < b.source")
    a0, b0 = F.col("a.p0"), F.col("b.p0")
    none = divergence(a0, b0)

    def own(cells: str, other: Column) -> Column:
        return F.aggregate(cells, F.lit(0).cast("long"), lambda acc, c: acc + c["m"] * (divergence(c["p"], other) - none))

    apart = F.when(F.col("terms") > 0, F.col("terms") * none + own("a.cells", b0) + own("b.cells", a0)).otherwise(0)
    valued = pairs.select("lang", F.col("a.source").alias("low"), F.col("b.source").alias("high"), apart.alias("apart")).join(
        shared, ["lang", "low", "high"], "left"
    )
    turned = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    both = F.array(turned("low", "high"), turned("high", "low"))
    value = F.col("apart") + F.coalesce("shared", F.lit(0))
    return ranked(valued.select("lang", value.cast("long").alias("value"), F.inline(both)).select("lang", "source", "item", "value"))


def term_part(groups: DataFrame, kept: DataFrame, langs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) for the first ``top`` terms of each group that it uses more than its lang does.

    ``kept`` has lang, source, term, n and lang_n; ``langs`` has lang, lang_total.
    """
    totals = groups.join(langs, "lang").select("lang", "source", "total", "lang_total", "terms")
    some = kept.select("lang", "source", "term", "n", "lang_n").where("n > 0")
    p = probability(F.col("n"), F.col("total"), F.col("terms"))
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    cells = some.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("m")).join(totals, ["lang", "source"])
    cells = stage(cells.where(p > q).select("lang", "source", "n", "lang_n", "m", divergence(p, q).alias("value")), "cells")
    # each value holds one term at least, so the first values are enough; the terms before a value decide whether it counts
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = values.withColumn("place", F.row_number().over(falling)).where(F.col("place") <= top)
    before = F.coalesce(F.sum("m").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = first.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value")
    wanted = cells.join(reached, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value")
    expanded = some.join(wanted, ["lang", "source", "n", "lang_n"]).select("lang", "source", F.col("term").alias("item"), "value")
    return ranked(expanded).where(F.col("rank") <= top)


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``docs``, which has text, lang and source."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(name("lang"), name("source"), "text")
    counts = stage(term_counts(rows), "counts")
    by_lang = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_documents)
    kept = stage(counts.join(by_lang.select("lang", "term", "lang_n"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    langs = by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    seen = rows.select("lang", "source").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = stage(
        seen.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("lang_total")),
        "groups",
    )
    per_lang = groups.select("lang", "lang_total").distinct()
    sizes = groups.select("lang", "source", "total", "terms")
    pairs = pair_part(sizes, kept).withColumn("part", F.lit("pair"))
    terms = term_part(sizes, kept, per_lang, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each lang lie apart, and the ten terms that mark each source."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), tokens AS (
  SELECT r, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT lang, count(*) AS v, CAST(sum(lang_n) AS BIGINT) AS lang_total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
  SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p,
    1 + 1000000000 * (k.lang_n + 2) // (l.lang_total + 2 * l.v) AS lang_p
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - lang_p) * (p - lang_p) // (p + lang_p) AS value
  FROM p WHERE n > 0 AND p > lang_p
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""
