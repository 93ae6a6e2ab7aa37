"""A corpus pipeline over `documents`: each stage works on all that the one before it kept.

`STAGES` lists the stages in order; each takes (spark, docs, sf_dir) and returns documents, the last one token ids.
SQL can't say compression, near-duplicate signatures or subword encoding, so tests hold `run` against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.llm.common import stored, table
from seqweft.llm.decontam import without_leaks
from seqweft.llm.language import learn_and_identify
from seqweft.llm.language_queries import LEAST_MARGIN
from seqweft.llm.line_dedup import drop_boilerplate
from seqweft.llm.line_queries import SITES
from seqweft.llm.near_dedup import one_of_each
from seqweft.llm.pieces import encode_checked
from seqweft.llm.token_queries import model_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those between two languages; names the language of unlabelled ones."""
    named = learn_and_identify(docs, least_margin=LEAST_MARGIN)
    return named.where(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate out of texts; every document stays."""
    cleaned = drop_boilerplate(docs, sites=SITES)
    size = F.when(F.col("n_lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", size).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, four fifths alike."""
    return one_of_each(docs, words=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, packed as little-endian unsigned 32-bit integers, and whether they decode to it."""
    coded = encode_checked(docs, model_path())
    return coded.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("exact").alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
