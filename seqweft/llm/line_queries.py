"""Query of the boilerplate operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.llm.common import table
from seqweft.llm.line_dedup import DROP_SQL, drop_boilerplate
from seqweft.llm.registry import query

SITES = 10


@query(
    "op5_line_dedup",
    f"""WITH o AS ({DROP_SQL.format(docs="documents", sites=SITES)})
    SELECT doc_id, CAST(n_lines_dropped AS INTEGER) AS n_lines_dropped, length(text) AS n_chars_kept, sha256(text) AS text_sha256 FROM o""",
)
def line_dedup(spark, sf):
    out = drop_boilerplate(table(spark, sf, "documents").select("doc_id", "text", "source"), sites=SITES)
    return out.select("doc_id", "n_lines_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
