"""Query of the URL filter."""

from __future__ import annotations

from seqweft.llm.common import table
from seqweft.llm.registry import query
from seqweft.llm.url_rules import judge

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"

SQL = f"""WITH u AS (SELECT page_id, coalesce({_REST}, '') AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r(rule_host, rule_path, says) AS (VALUES {_VALUES}),
    m AS (SELECT page_id, rule_host || rule_path AS rule, says FROM p JOIN r
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) = 1)
    SELECT p.page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)"""


@query("op3_url_filters", SQL)
def url_filters(spark, sf):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = judge(table(spark, sf, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")
