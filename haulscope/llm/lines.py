"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A document is the sequence of hashes of its lines; blank lines do not count and white space at the ends of a line is
ignored. Of every ``RUN`` consecutive lines the one with the least hash (the last of equals) is a fingerprint, so
two documents that share a run of RUN or more lines share a fingerprint at the same place in the run. Fingerprints
that occur once in the corpus are dropped: most lines end here. At every other occurrence the match is extended both
ways: the windows of RUN lines around the fingerprint are looked up, and those that also start earlier (smaller
doc_id, or same document and earlier line) are repeated. The union of repeated windows is every later occurrence of
every repeated run in its full length, and its lines are deleted.

With ``enough`` a single line or two lines that follow one another also make a run if they hold so many words. There is
at most one such run from each line, so they are met by their hashes as they are. Without it, as in ``op2_line_dedup``,
whose SQL fixes runs of three lines, shorter repeats stay whatever their length.

Occurrences are never paired with each other. A window's first occurrence is an aggregate, and each other occurrence
meets that one row, so a line or a run in a third of all documents costs what its rows cost.

Defined results: a null text stays null and has no lines; without ``enough`` fewer than RUN lines never lose any; a document may become
empty; rows equal in doc_id and text are judged as one and lose the same lines; a null doc_id comes first; an empty
table gives an empty result; other columns travel untouched, and clashing ones are replaced. Lines are compared by
64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.llm.common import WORD, table
from haulscope.session import stage

RUN = 3  # lines in a window: runs at least so long are found and their later occurrences deleted
ENDS = " \t\r\x0b\x0c"


def _bare(line: Column) -> Column:
    """The line without ASCII white space at its ends."""
    return F.trim(line, F.lit(ENDS))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, hashes): one array of hashes of the lines that are not blank."""
    bare = F.transform(F.split("text", "\n"), _bare)
    return docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.xxhash64(x)).alias("hashes")
    )


def fingerprints(hashed: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, text_hash, lines, fingerprint, first, around): ``around`` are the lines of all windows that chose the
    fingerprint, which follow one another; ``first`` is the line where they begin."""
    last = F.size("hashes") - run
    place = lambda p: F.array_min(
        F.transform(F.sequence(F.lit(0), F.lit(run - 1)), lambda j: F.struct(F.get("hashes", p + j).alias("h"), (-p - j).alias("at")))
    )
    chosen = hashed.where(last >= 0).withColumn("chosen", F.transform(F.sequence(F.lit(0), last), place))
    changes = F.filter(
        F.sequence(F.lit(0), last), lambda p: (p == 0) | (F.get("chosen", p)["at"] != F.get("chosen", F.greatest(p - 1, F.lit(0)))["at"])
    )
    begins = chosen.withColumn("begins", changes)
    ranges = F.transform(
        "begins", lambda p, i: F.struct(p.alias("first"), (F.coalesce(F.get("begins", i + 1), last + 1) - p).alias("windows"))
    )
    spread = begins.select("doc_id", "text_hash", "hashes", "chosen", F.explode(ranges).alias("r"))
    return spread.select(
        "doc_id",
        "text_hash",
        F.size("hashes").alias("lines"),
        F.get("chosen", F.col("r.first"))["h"].alias("fingerprint"),
        "r.first",
        F.slice("hashes", F.col("r.first") + 1, F.col("r.windows") + run - 1).alias("around"),
    )


def repeated_windows(hashed: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, text_hash, first, lines): windows of ``run`` lines that also start earlier in the corpus."""
    marks = stage(fingerprints(hashed, run), "fingerprints")
    # rows equal in id and text are one document, so they do not repeat each other
    shared = marks.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    met = marks.join(shared, "fingerprint")
    windows = stage(
        met.select("doc_id", "text_hash", "lines", "first", "around", F.explode(F.sequence(F.lit(0), F.size("around") - run)).alias("o")).select(
            F.struct("doc_id", "text_hash", (F.col("first") + F.col("o")).alias("first"), "lines").alias("at"),
            F.slice("around", F.col("o") + 1, run).alias("window"),
        ),
        "windows",
    )
    earliest = windows.groupBy("window").agg(F.min("at").alias("earliest"), F.count("*").alias("n")).where("n > 1")
    return windows.join(earliest.select("window", "earliest"), "window").where("at > earliest").select("at.*").distinct()


def repeated_long(docs: DataFrame, enough: int) -> DataFrame:
    """(doc_id, text_hash, first, lines, width) of one or two lines with ``enough`` words that also occur earlier."""
    bare = F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: x != "")
    lines = F.transform(bare, lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("all"))

    def window(x: Column, i: Column) -> Column:
        after = F.get("all", i + 1)
        pair = F.when(x["words"] + after["words"] >= enough, F.array(x["h"], after["h"]))
        body = F.when(x["words"] >= enough, F.array(x["h"])).otherwise(pair)
        return F.struct(i.alias("first"), body.alias("window"))

    long = F.filter(F.transform("all", window), lambda w: w["window"].isNotNull())
    windows = stage(
        given.select("doc_id", "text_hash", F.size("all").alias("lines"), F.explode(long).alias("w")).select(
            F.struct("doc_id", "text_hash", "w.first", "lines").alias("at"), "w.window"
        ),
        "long",
    )
    earliest = windows.groupBy("window").agg(F.min("at").alias("earliest"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(earliest.select("window", "earliest"), "window").where("at > earliest")
    return later.select("at.*", F.size("window").alias("width")).distinct()


def drop_repeats(docs: DataFrame, run: int = RUN, enough: int | None = None) -> DataFrame:
    """``docs`` with the text that is left, n_lines (not blank, before), n_removed and emptied (all of them were).

    What is removed is known from the windows alone; filters on n_removed and emptied never take a text apart.
    """
    docs = docs.drop("n_lines", "n_removed", "emptied")
    found = repeated_windows(line_hashes(docs.select("doc_id", "text")).distinct(), run)
    found = found.withColumn("width", F.lit(run))
    if enough is not None:
        found = found.unionByName(repeated_long(docs, enough))
    starts = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "width")).alias("_starts"), F.max("lines").alias("_all"))
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda p: F.sequence(p["first"], p["first"] + p["width"] - 1))))
    starts = starts.withColumn("_lost", F.array_sort(covered))
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    s = starts.withColumnRenamed("doc_id", "_doc")
    joined = keyed.join(s, keyed.doc_id.eqNullSafe(s._doc) & (keyed._hash == s.text_hash), "left").drop("_doc", "text_hash", "_hash")
    lines = F.split("text", "\n")
    places = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: _bare(F.get("_lines", i)) != "")
    with_lines = joined.withColumn("_lines", lines).withColumn("_places", F.coalesce(places, F.array().cast("array<int>")))
    gone = F.transform("_lost", lambda p: F.get("_places", p))
    marked = with_lines.withColumn("_gone", F.coalesce(gone, F.array().cast("array<int>")))
    # array_except hashes, so a long document takes time in proportion to its lines
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda i: F.get("_lines", i))
    return (
        marked.withColumn("n_lines", F.size("_places").cast("long"))
        .withColumn("n_removed", F.when(F.col("_lost").isNull(), 0).otherwise(F.size("_lost")).cast("long"))
        .withColumn("emptied", F.coalesce(F.size("_lost") == F.col("_all"), F.lit(False)))
        .withColumn("text", F.when(F.col("_lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .drop("_starts", "_all", "_lost", "_lines", "_places", "_gone")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when later occurrences of runs of lines are deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
), bare AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS b FROM raw
), solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM bare WHERE b <> ''
), windows AS (
  SELECT doc_id, p, b || chr(10) || lead(b, 1) OVER w || chr(10) || lead(b, 2) OVER w AS body
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), later AS (
  SELECT doc_id, p FROM (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, p) AS n FROM windows WHERE body IS NOT NULL
  ) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, p + o AS p FROM later, (SELECT unnest([0, 1, 2]) AS o)
), judged AS (
  SELECT r.doc_id, r.i, r.line, s.p, g.p IS NOT NULL AS removed
  FROM raw r LEFT JOIN solid s ON r.doc_id = s.doc_id AND r.i = s.i LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.p = g.p
)
SELECT d.doc_id, count(j.p) AS n_lines, count(*) FILTER (WHERE j.removed) AS n_removed,
       sha256(coalesce(string_agg(j.line, chr(10) ORDER BY j.i) FILTER (WHERE NOT j.removed), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id
GROUP BY d.doc_id
"""
