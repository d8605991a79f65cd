"""From raw documents to packed training sequences, in five stages; each calls one operator of haulscope.llm.

A stage works on every row its predecessor kept and returns the columns of documents, the last one packed pieces.
Empty tables pass through; null and empty texts are handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.llm.common import free_name, ready, word_count
from haulscope.llm.language import judgement, learn
from haulscope.llm.lines import drop_repeats
from haulscope.llm.mixing import mix
from haulscope.llm.packing import pack
from haulscope.llm.shingles import near_duplicates
from haulscope.session import stage

# bits per letter from which a text is like none of the languages; texts in one of them have 2 to 5
FOREIGN = 6.0
# a text is foreign only if it needs so many bits beyond FOREIGN for each letter (three pieces or so), and has so many letters
BEYOND = 48.0
LEAST_LETTERS = 20
# words that make a run of one or two lines
ENOUGH = 50


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that can be in one of the labelled languages; those without a letter or unlike all of them go.

    A piece costs about 15 bits however short it is, so a short text says nothing by its bits per letter: what counts
    are the bits beyond FOREIGN in the whole text. Texts too short to tell stay, and all texts where nothing is labelled.
    """
    ready(spark)
    model = learn(docs.select("doc_id", "text", "lang"))
    name = free_name(docs, "judged")
    judged = docs.withColumn(name, judgement(spark, model, F.col("text")))
    letters, bits = F.col(name)["n_letters"], F.col(name)["bits"]
    foreign = (letters >= LEAST_LETTERS) & ((bits - FOREIGN) * letters > BEYOND)
    return judged.where((letters > 0) & ~F.coalesce(foreign, F.lit(False))).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of runs of lines or of long lines; those of which no line is left go."""
    ready(spark)
    # the text is carried once, beside the other columns
    rest = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])
    left = drop_repeats(docs.select("doc_id", "text", rest.alias("rest")), enough=ENOUGH)
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("rest")["n_chars"])
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": n_chars}
    return left.where("NOT emptied").select(*(own.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Documents without words are not near copies of anything and stay; of rows equal in doc_id and text one stays.
    """
    ready(spark)
    found = near_duplicates(docs.select("doc_id", "text"), words=5, least=(80, 100))
    name = free_name(docs, "kept")
    kept = found.where("n_shingles = 0 OR doc_id <=> component_id").select(F.col("doc_id").alias(name)).distinct()
    rows = docs.join(kept, docs.doc_id.eqNullSafe(kept[name]), "left_semi")
    return rows.withColumn(name, F.xxhash64("text")).dropDuplicates(["doc_id", name]).drop(name)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ready(spark)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.struct("*").alias("row"))
    mixed = mix(rows, F.col("words")).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens."""
    ready(spark)
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# language models and packing have no SQL form; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written and read again."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
