"""Language of a text by compression: the language whose dictionary packs it smallest.

Each language has a raw-content zstandard dictionary made of texts that carry its label. A text is packed
once with each dictionary; the smallest result names the language, and a narrow margin to the next one
rejects the text.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.llm.common import fresh, text_column, with_struct

UNDETERMINED = "und"
SCHEMA = "lang_pred string, score double, margin double"
LEVEL = 5


def learn(df: DataFrame, text: str, lang: str, key: str, sample: int = 64, chars: int = 2000) -> dict[str, bytes]:
    """Dictionaries by language from a bounded sample of labelled rows.

    For each language the `sample` rows with the smallest hash of `key` are taken, with up to `chars`
    characters each, so a dictionary has at most `sample * chars` characters whatever the table's size,
    and the same rows are chosen on every run. Rows without a text, a letter or a language are left out.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("l"), F.xxhash64(key).alias("h"), F.substring(text, 1, chars).alias("t")
    )
    ranked = rows.select("l", "h").withColumn("i", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("i") <= sample)
    last = {r.l: r.h for r in ranked.groupBy("l").agg(F.max("h").alias("h")).collect()}
    if not last:
        return {}
    chosen = F.lit(False)
    for name, h in last.items():
        chosen = chosen | ((F.col("l") == name) & (F.col("h") <= h))
    texts: dict[str, list[str]] = {}
    for r in rows.where(chosen).groupBy("l", "h").agg(F.min("t").alias("t")).orderBy("l", F.col("h").desc()).collect():
        texts.setdefault(r.l, []).append(folded(r.t))
    return {name: "\n".join(parts).encode() for name, parts in sorted(texts.items())}


def folded(text: str) -> str:
    """Lower case, with what isn't a letter or a mark inside words left out, as it says little of a language."""
    return text.lower().translate(_PLAIN)


_PLAIN = {c: " " for c in range(128) if not chr(c).isalpha() and chr(c) not in "'- "}


@lru_cache(4)
def packers(dictionaries: tuple[tuple[str, bytes], ...]):
    out = []
    for name, content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)))
    return out


def judged(text: str | None, made) -> tuple[str, float, float]:
    if not text or not made or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0
    data = folded(text).encode("utf-8", "replace")
    sizes = sorted((len(packer.compress(data)), name) for name, packer in made)
    best = sizes[0]
    if len(sizes) == 1:
        return best[1], 1.0, 1.0
    margin = (sizes[1][0] - best[0]) / sizes[1][0]
    return best[1], 0.5 + margin / 2, margin


def language_struct(dictionaries: dict[str, bytes]):
    fixed = tuple(sorted(dictionaries.items()))

    def named(texts):
        made = packers(fixed)
        return pd.DataFrame([judged(t, made) for t in texts], columns=["lang_pred", "score", "margin"])

    return text_column(named, SCHEMA, packers.cache_clear)


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", least_margin: float = 0.0) -> DataFrame:
    """Adds `lang_pred`, `score` (0.5 at a tie with the next language, up to 1), `margin` and `rejected`.

    `und` with score 0 for a null or letterless text, and for any text if no language was learned; equal
    sizes go to the first name. `rejected` is true for `und` and where the margin is below `least_margin`;
    a text so short that a single byte is more than that margin isn't rejected for a tie.
    Rows are independent: repeated rows repeat their result, columns named like the new ones are replaced.
    """
    out = with_struct(df, language_struct(dictionaries)(F.col(text).cast("string")), ["lang_pred", "score", "margin"])
    narrow = (F.col("margin") < least_margin) & (F.octet_length(F.col(text).cast("string")) * least_margin >= 1)
    rejected = (F.col("lang_pred") == UNDETERMINED) | narrow
    return out.drop("rejected").withColumn("rejected", rejected)


def held_out(key: Column) -> Column:
    """Rows kept for measuring: the key's checksum leaves 2 when divided by 4; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_and_identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least_margin: float = 0.0, sample: int = 64):
    """Learns from rows that aren't held out (a null key teaches nothing) and predicts every row."""
    (hold,) = fresh(df, "held_out")
    marked = df.withColumn(hold, held_out(F.col(key)))
    made = learn(marked.where(F.col(key).isNotNull() & ~F.col(hold)), text, lang, key, sample)
    return identify(marked, made, text, least_margin)
