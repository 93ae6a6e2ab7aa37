"""Query of the decontamination operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.llm.common import table
from seqweft.llm.decontam import contaminated
from seqweft.llm.registry import query


@query("op10_benchmark_decontamination")
def benchmark_decontamination(spark, sf):
    found = contaminated(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("covered", 4).alias("covered"), "first_word", "last_word")
