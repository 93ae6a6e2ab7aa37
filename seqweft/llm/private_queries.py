"""Query of the personal-data operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.llm.common import table
from seqweft.llm.private import find_private, learn
from seqweft.llm.registry import query


@query("op4_pii")
def pii(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = find_private(docs, learn(docs, "doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
