"""Query of the near-duplicate operator."""

from __future__ import annotations

from seqweft.llm.common import table
from seqweft.llm.near_dedup import near_duplicates
from seqweft.llm.registry import query


@query("op1_minhash_near_dedup")
def minhash_near_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "documents").select("doc_id", "text")).drop("mix")
