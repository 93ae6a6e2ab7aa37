"""Query of the ranked lexical search."""

from __future__ import annotations

from seqweft.llm.common import table
from seqweft.llm.lexical import ranked
from seqweft.llm.registry import query

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED_SQL = f"""
WITH said AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
), held AS (
  SELECT r, doc_id, len(terms) AS n, terms FROM said WHERE len(terms) > 0
), whole AS (
  SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM held
), counts AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM held) GROUP BY ALL
), asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)
), weights AS (
  SELECT c.term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_all) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts c JOIN (SELECT DISTINCT term FROM asked) USING (term), whole GROUP BY c.term
), scored AS (
  SELECT a.item_id, c.r, c.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM asked a JOIN counts c USING (term) JOIN weights USING (term), whole GROUP BY a.item_id, c.r, c.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
"""


@query("op13_lexical_search", RANKED_SQL)
def lexical_search(spark, sf):
    return ranked(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
