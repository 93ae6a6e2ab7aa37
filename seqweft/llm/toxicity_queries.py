"""Query of the toxicity operator."""

from __future__ import annotations

from seqweft.llm.common import table
from seqweft.llm.registry import query
from seqweft.llm.toxicity import learn_and_score


@query("op11_toxicity")
def toxicity(spark, sf):
    scored = learn_and_score(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
