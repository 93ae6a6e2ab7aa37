"""URL filters as a sort-merge range join of reversed hosts with nested rules.

A host turned round by its labels, each closed by a dot (`com.example.news.`), makes the rule for a host
and all its subdomains an interval of sorted keys. Rules and URLs are brought together by ranges of that
key; a sweep through each range keeps the open rules on a stack, closes those that the next key leaves
behind, and looks from the innermost outwards for rules whose path begins the URL's path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import borders, fresh, part_of

RULE, URL = 0, 1
#: Sorts after every character a key can go on with, so it closes an interval.
LAST = "\U0010ffff"


def host(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), capitals, small), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_key(name: Column) -> Column:
    return F.when(name == "", F.lit("")).otherwise(F.concat(F.concat_ws(".", F.reverse(F.split(name, r"\."))), F.lit(".")))


def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of part, key and kind; gives the row, rule and verdict of each URL."""
    part, open_rules = None, []  # (key, host, path, verdict), outermost first
    for frame in frames:
        out = []
        for p, key, kind, rule_host, rule_path, verdict, row in zip(
            frame["part"], frame["key"], frame["kind"], frame["host"], frame["path"], frame["verdict"], frame["row"], strict=True
        ):
            if p != part:
                part, open_rules = p, []
            while open_rules and not key.startswith(open_rules[-1][0]):
                open_rules.pop()
            if kind == RULE:
                open_rules.append((key, rule_host, rule_path, verdict))
                continue
            best = None
            for _, h, start, says in reversed(open_rules):
                if rule_path.startswith(start) and (best is None or (len(h) + len(start), len(h), says) > best[0]):
                    best = (len(h) + len(start), len(h), says), h + start, says
            out.append((row, best and best[1], best and best[2]))
        yield pd.DataFrame(out, columns=["row", "rule", "verdict"])


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", parts: int | None = None) -> DataFrame:
    """Adds `host`, `path`, `rule` (null if none fits) and `verdict` to every URL.

    `rules` has `host`, `path` and `verdict`. A rule fits its host and all subdomains where the URL's path
    starts with the rule's; the longest wins, of equally long ones that with the longer host, then the
    greater verdict. A null URL, or one without `://`, has an empty host, which no rule with a host fits.
    Rules with a null in any column or an empty host, and repeated rules, are left out. Repeated URLs repeat
    their result, other columns come along, and columns named like the new ones are replaced. An empty table
    of either kind works.

    A wide rule goes to each range it reaches over, at most one row for each; a host that fills several
    ranges is dealt among them.
    """
    spark = urls.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = urls.drop(*[c for c in urls.columns if c.lower() in ("host", "path", "rule", "verdict")])
    key, part, kind, row = fresh(urls, "key", "part", "kind", "row")
    named = urls.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    keyed = named.withColumn(key, host_key(F.col("host")))
    cuts = borders(keyed.select(key, "path"), F.col(key), parts)

    @F.pandas_udf("int")
    def own_part(keys: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series([part_of(cuts, k, s) for k, s in zip(keys, spread, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def reached(keys: pd.Series) -> pd.Series:
        return pd.Series([list(range(part_of(cuts, k), part_of(cuts, k + LAST) + 1)) if k else [] for k in keys])

    carried = F.struct(*[F.col(f"`{c}`") for c in named.columns])
    left = keyed.select(
        own_part(F.col(key), F.pmod(F.xxhash64("path", F.rand(7)), F.lit(1 << 20)).cast("int")).alias(part),
        F.col(key), F.lit(URL).alias(kind), "host", "path", F.lit(None).cast("string").alias("verdict"), carried.alias(row),
    )
    clean = rules.select("host", "path", "verdict").where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").distinct()
    spread = clean.withColumn(key, host_key(F.col("host")))
    right = spread.select(
        F.explode(reached(F.col(key))).alias(part), F.col(key), F.lit(RULE).alias(kind), "host", "path", "verdict",
        F.lit(None).cast(left.schema[row].dataType).alias(row),
    )
    both = left.unionByName(right).select(
        F.col(part).alias("part"), F.col(key).alias("key"), F.col(kind).alias("kind"), "host", "path", "verdict", F.col(row).alias("row")
    )
    ordered = both.repartition(parts, "part").sortWithinPartitions("part", "key", "kind")
    row_type = left.schema[row].dataType.simpleString()
    out = ordered.mapInPandas(sweep, f"row {row_type}, rule string, verdict string")
    return out.select("row.*", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
