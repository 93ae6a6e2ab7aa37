"""Query of the passage operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.llm.common import table
from seqweft.llm.registry import query
from seqweft.llm.unit_dedup import repeated_runs


@query("op9_substring_dedup")
def substring_dedup(spark, sf):
    runs = repeated_runs(table(spark, sf, "documents").select("doc_id", "text"), into_neighbours=True)
    return runs.select(F.col("key").alias("doc_id"), "start", "end", "n_units", "n_words", F.col("first_key").alias("first_doc_id"))
