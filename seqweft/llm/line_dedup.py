"""Cross-site boilerplate: lines that stand on many distinct sites are taken out of texts.

The distinct sites of a line are estimated by HyperLogLog sketches, which merge by aggregation. Lines whose
estimate is near the threshold get an exact distinct count. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import fresh, stored

SKETCH = 12
#: Half-width of the band around the threshold, as a share of it: twelve times the sketch's standard error.
BAND = 0.2


def normal(line: Column) -> Column:
    """A line without spaces, tabs and carriage returns around it."""
    return F.btrim(line, F.lit(" \t\r"))


def digest(line: Column) -> Column:
    return F.xxhash64(normal(line))


def spread_lines(df: DataFrame, text: str, site: str, sites: int) -> DataFrame:
    """`h`: digests of the lines that stand on at least `sites` distinct sites."""
    line = F.explode(F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: normal(x) != ""), digest)))
    units = df.where(F.col(site).isNotNull()).select(F.col(site).alias("site"), line.alias("h"))
    # A line on fewer rows than the threshold can't be on as many sites; most lines end here, before any sketch.
    often = units.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    often = often.where((F.col("n") >= sites) & (F.lit(sites <= 1) | (F.col("a") != F.col("b")))).select("h")
    spread = stored(units.join(often, "h").groupBy("h", "site").agg(F.count(F.lit(1)).alias("n")).drop("n"), "line-sites")
    sketched = spread.groupBy("h").agg(F.hll_sketch_agg("site", SKETCH).alias("sketch"))
    guess = sketched.select("h", F.hll_sketch_estimate("sketch").alias("guess"))
    sure = guess.where(F.col("guess") > sites * (1 + BAND)).select("h")
    near = guess.where(F.col("guess").between(sites * (1 - BAND), sites * (1 + BAND))).select("h")
    exact = spread.join(near, "h").groupBy("h").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= sites).select("h")
    return sure.unionByName(exact)


def drop_boilerplate(df: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", sites: int = 10) -> DataFrame:
    """Takes lines that stand on at least `sites` sites out of `text`; adds `n_lines_dropped`.

    A line counts with what is around it trimmed; blank lines are never boilerplate, and a null site is no
    site. A text of which boilerplate makes up more than half of the characters is a copy of a widely spread
    text rather than a carrier of boilerplate: it stays as it is, for near-duplicate removal to judge. Every
    row comes back once: null and empty texts stay as they are, rows that repeat a key are treated alike
    line by line, null keys are a key like any other. Other columns come along.
    """
    bad, own, lines, drop, n = fresh(df, "bad", "own", "lines", "drop", "n_lines_dropped")
    df = df.drop("n_lines_dropped")
    spread = stored(spread_lines(df, text, site, sites), "spread-lines")
    line = F.explode(F.array_distinct(F.transform(F.split(text, "\n"), digest)))
    hits = df.select(F.col(key).alias(own), line.alias("h")).join(spread, "h").groupBy(own).agg(F.collect_set("h").alias(bad))
    out = df.join(hits, df[key].eqNullSafe(hits[own]), "left").drop(own)
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    out = out.withColumn(lines, F.split(text, "\n"))
    out = out.withColumn(drop, F.filter(lines, lambda x: F.array_contains(bad, digest(x))))
    kept = F.col(bad).isNull() | (size(F.transform(drop, normal)) * 2 > size(F.transform(lines, normal)))
    new = F.when(kept, F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x: ~F.array_contains(bad, digest(x))), "\n"))
    count = F.when(kept, F.lit(0)).otherwise(F.size(drop))
    return out.withColumns({text: new, "n_lines_dropped": count}).drop(bad, lines, drop)


DROP_SQL = """WITH l AS (SELECT row_id, doc_id, source, i, line, trim(line, ' ' || chr(9) || chr(13)) AS t FROM
        (SELECT row_id, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
         FROM (SELECT *, row_number() OVER () AS row_id FROM {docs}))),
    bad AS (SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {sites}),
    m AS (SELECT l.*, bad.t IS NOT NULL AS is_bad FROM l LEFT JOIN bad ON l.t = bad.t),
    d AS (SELECT row_id, any_value(doc_id) AS doc_id, sum(CASE WHEN is_bad THEN length(t) ELSE 0 END) * 2 > sum(length(t)) AS spared,
        count(*) FILTER (is_bad) AS n_bad, string_agg(line, chr(10) ORDER BY i) AS whole,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_bad), '') AS cleaned FROM m GROUP BY row_id)
    SELECT doc_id, CASE WHEN spared OR n_bad = 0 THEN whole ELSE cleaned END AS text,
        CASE WHEN spared THEN 0 ELSE n_bad END AS n_lines_dropped FROM d"""
