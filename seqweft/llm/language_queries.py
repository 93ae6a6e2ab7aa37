"""Query of the language operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.llm.common import table
from seqweft.llm.language import learn_and_identify
from seqweft.llm.registry import query

#: A text is rejected if the next language packs it less than this share larger.
LEAST_MARGIN = 0.005


@query("op2_language_id")
def language_id(spark, sf):
    out = learn_and_identify(table(spark, sf, "documents").select("doc_id", "text", "lang"), least_margin=LEAST_MARGIN)
    return out.select("doc_id", "held_out", "lang_pred", "score", "margin", (~F.col("rejected")).alias("kept"))
