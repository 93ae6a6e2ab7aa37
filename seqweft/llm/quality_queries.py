"""Query of the quality operator."""

from __future__ import annotations

from seqweft.llm.common import table
from seqweft.llm.quality import STATISTICS, with_verdicts
from seqweft.llm.registry import query


@query("op6_quality_rules")
def quality_rules(spark, sf):
    out = with_verdicts(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *STATISTICS, "base_failed", "kept", "distance")
