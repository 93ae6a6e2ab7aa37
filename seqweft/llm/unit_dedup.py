"""Repeated lines, paragraphs and passages: the first occurrence stays, others go by their offsets.

Texts are cut into units (paragraphs, lines, or pieces of lines that end with a sentence), which are
normalised and hashed. One aggregate over all digests finds the first document of each; joined back, every
later place is marked, and adjacent marked units make a run with its offsets in the original text. A passage
seldom begins and ends where units do, so runs can be carried on word by word into the units beside them.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.llm.common import fresh, release_memory, stored, text_column

SPACE = "\x20\x09-\x0d"
#: Words after which a unit of the kind "sentence" ends at the next sentence border.
SENTENCE_WORDS = 5


def _capitals() -> str:
    spans, first = [], None
    for c in range(0x41, 0x3000):
        if chr(c).isupper():
            first = c if first is None else first
        elif first is not None:
            spans.append(f"{chr(first)}-{chr(c - 1)}")
            first = None
    return "".join(spans)


LINE = re.compile(r"[^\n]+")
PARAGRAPH = re.compile(rf"[^\n]+(?:\n(?![{SPACE}]*\n)[^\n]+)*")
#: A border between sentences: a closing mark before the space, or a capital after it.
BORDER = re.compile(rf"(?<=[.!?])[{SPACE}]+|[{SPACE}]+(?=[{_capitals()}])|\n+")
#: What units are made of: runs of what isn't space, as bytes.split() takes it, with A-Z lower-cased.
WORD = re.compile(rf"[^{SPACE}]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_SMALL = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def spans_of(text: str, unit: str) -> list[tuple[int, int]]:
    if unit == "sentence":
        out, start = [], 0
        for m in BORDER.finditer(text):
            if "\n" in m.group() or len(text[start : m.start()].encode().split()) >= SENTENCE_WORDS:
                out.append((start, m.start()))
                start = m.end()
        out.append((start, len(text)))
        return out
    pattern = {"line": LINE, "paragraph": PARAGRAPH}[unit]
    return [m.span() for m in pattern.finditer(text)]


def units_of(text: str, unit: str) -> list[tuple]:
    """(number, start, end, words, digest in two halves, seen before in this text) of all units with a word.

    Offsets are code points, the end exclusive. Units are equal if they have the same words, A-Z lower-cased.
    """
    out, seen = [], set()
    for start, end in spans_of(text, unit):
        words = text[start:end].encode("utf-8", "replace").translate(_SMALL).split()
        if words:
            d = xxhash.xxh3_128_digest(b" ".join(words))
            high, low = (int.from_bytes(x, sys.byteorder, signed=True) for x in (d[:8], d[8:]))
            out.append((len(out), start, end, len(words), high, low, d in seen))
            seen.add(d)
    return out


UNIT = "u int, start int, end int, words int, h1 long, h2 long, again boolean"


def units_struct(unit: str):
    names = [c.split()[0] for c in UNIT.split(", ")]

    def cut(texts):
        return pd.DataFrame({
            "units": [[dict(zip(names, u, strict=True)) for u in units_of(t, unit)] if t else [] for t in texts],
            "row": [xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "replace")) - (1 << 63) for t in texts],
        })

    return text_column(cut, f"units array<struct<{UNIT.replace(' ', ':').replace(',:', ',')}>>, row long")


def repeated_runs(
    df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", least_words: int = 25, into_neighbours: bool = False,
) -> DataFrame:
    """(key, row, start, end, n_units, n_words, first_key): runs of adjacent units that stand earlier.

    The first place of a unit is in the row with the least key; there, only its later places in the same
    text count. Runs of at least `least_words` words are given, with offsets in the original text;
    `first_key` is the least of the keys that keep a unit of the run. With `into_neighbours`, a run is first
    carried on over the words that the units beside it share with those beside the first places of its first
    and last unit; these count for the limit, and `n_units` stays the number of whole units. Null keys rank last and remove nothing
    from one another; rows that repeat a key rank alike and are told apart by `row`, a hash of the text (equal rows
    give one result). Null and empty texts have no units; the input's other columns don't matter.
    """
    made = df.select(F.col(key).alias("key"), units_struct(unit)(F.col(text).cast("string")).alias("m"))
    places = stored(made.select("key", F.col("m.row").alias("row"), F.explode("m.units").alias("x")).select("key", "row", "x.*"), "units")
    place = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row", "u")) if into_neighbours else F.lit(None)
    first = places.groupBy("h1", "h2").agg(F.min("key").alias("first_key"), place.alias("place"), F.count(F.lit(1)).alias("n"))
    first = first.where(F.col("n") > 1).drop("n")
    later = F.col("again") | F.coalesce(F.col("key") > F.col("first_key"), F.col("key").isNull() & F.col("first_key").isNotNull())
    marked = places.join(first, ["h1", "h2"]).where(later).select("key", "row", "u", "start", "end", "words", "first_key", "place")
    order = Window.partitionBy("key", "row").orderBy("u")
    runs = marked.distinct().withColumn("run", F.col("u") - F.row_number().over(order)).groupBy("key", "row", "run")
    out = runs.agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"),
        F.sum("words").alias("n_words"), F.min("first_key").alias("first_key"),
        F.min("u").alias("u0"), F.max("u").alias("u1"), F.min_by("place", "u").alias("p0"), F.max_by("place", "u").alias("p1"),
    )
    if into_neighbours:
        out = carried_on(out.drop("run"), df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), unit)
        return out.where(F.col("whole") >= least_words).drop("whole")
    return out.where(F.col("n_words") >= least_words).drop("run", "u0", "u1", "p0", "p1")


def words_at(text: str) -> list[tuple[str, int, int]]:
    """(word as units compare it, start, end) of all words of a text."""
    return [(m.group().translate(_LOWER), *m.span()) for m in WORD.finditer(text)]


def shared(own: list, other: list) -> int:
    """How many words two lists share from their beginning on."""
    n = 0
    for (a, *_), (b, *_) in zip(own, other, strict=False):
        if a != b:
            break
        n += 1
    return n


def _row(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "replace")) - (1 << 63)


def carried_on(runs: DataFrame, docs: DataFrame, unit: str) -> DataFrame:
    """Runs with the words before and after them that stand beside the first places too; `whole` counts all of them.

    Only the units beside runs and first places are fetched, from texts that have any. The words between two runs go
    to the first of them where both want them, and a run isn't carried on into its own first place.
    """
    runs = stored(runs, "runs")
    same = lambda p: F.col(f"{p}.key").eqNullSafe(F.col("key")) & (F.col(f"{p}.row") == F.col("row"))
    # Null keys keep nothing for one another.
    known = lambda p: ~F.col(f"{p}.none") | same(p)
    ahead = known("p0") & ~(same("p0") & (F.col("u0") - 1 <= F.col("p0.u") + F.col("u1") - F.col("u0")))
    asked = F.array(
        F.when(ahead, F.struct(F.lit(0).alias("side"), "key", "row", (F.col("u0") - 1).alias("u"))),
        F.when(ahead, F.struct(F.lit(1).alias("side"), F.col("p0.key").alias("key"), F.col("p0.row").alias("row"), (F.col("p0.u") - 1).alias("u"))),
        F.when(known("p1"), F.struct(F.lit(2).alias("side"), "key", "row", (F.col("u1") + 1).alias("u"))),
        F.when(known("p1"), F.struct(F.lit(3).alias("side"), F.col("p1.key").alias("key"), F.col("p1.row").alias("row"), (F.col("p1.u") + 1).alias("u"))),
    )
    asks = runs.select(F.col("key").alias("rk"), F.col("row").alias("rr"), F.col("u0").alias("ru"), F.explode(asked).alias("a")).where("a.u >= 0")
    asks = asks.select("rk", "rr", "ru", "a.*")
    wanted = asks.select("key", "row", "u").distinct().groupBy(F.col("key").alias("wk"), F.col("row").alias("wr")).agg(F.collect_list("u").alias("us"))

    @F.pandas_udf("long")
    def row_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_row(t) for t in texts], dtype="int64")
        release_memory()

    @F.pandas_udf("array<struct<u:int,start:int,said:string>>")
    def pieces(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, numbers in batches:
            out = []
            for t, us in zip(texts, numbers, strict=True):
                spans = [(a, b) for a, b in spans_of(t, unit) if WORD.search(t, a, b)]
                out.append([{"u": int(u), "start": spans[u][0], "said": t[slice(*spans[u])]} for u in us if u < len(spans)])
            yield pd.Series(out, index=texts.index)
        release_memory()

    texts = docs.where(F.length("text") > 0).withColumn("row", row_of("text"))
    found = texts.join(wanted, F.col("key").eqNullSafe(F.col("wk")) & (F.col("row") == F.col("wr"))).select("key", "row", F.explode(pieces("text", "us")).alias("x"))
    found = found.select(F.col("key").alias("fk"), F.col("row").alias("fr"), F.col("x.u").alias("fu"), "x.start", "x.said")
    found = found.dropDuplicates(["fk", "fr", "fu"])
    got = asks.join(found, F.col("key").eqNullSafe(F.col("fk")) & (F.col("row") == F.col("fr")) & (F.col("u") == F.col("fu")))
    side = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    beside = got.groupBy("rk", "rr", "ru").agg(*[side(n, "said").alias(f"t{n}") for n in range(4)], side(0, "start").alias("s0"), side(2, "start").alias("s2"))

    @F.pandas_udf("before array<int>, n_before int, after array<int>, n_after int, n_left int")
    def compared(t0: pd.Series, t1: pd.Series, t2: pd.Series, t3: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c, d in zip(t0, t1, t2, t3, strict=True):
            left, right = words_at(a or ""), words_at(c or "")
            l, r = shared(left[::-1], words_at(b or "")[::-1]), shared(right, words_at(d or ""))  # noqa: E741
            # Where each shared word before the run begins, the nearest first; where each one after it ends.
            rows.append(([w[1] for w in left[::-1][:l]], l, [w[2] for w in right[:r]], r, len(left)))
        return pd.DataFrame(rows, columns=["before", "n_before", "after", "n_after", "n_left"])

    beside = beside.select("rk", "rr", "ru", "s0", "s2", compared("t0", "t1", "t2", "t3").alias("c")).select("rk", "rr", "ru", "s0", "s2", "c.*")
    out = runs.join(beside, F.col("key").eqNullSafe(F.col("rk")) & (F.col("row") == F.col("rr")) & (F.col("u0") == F.col("ru")), "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    out = out.withColumns({"n_before": none("n_before"), "n_after": none("n_after")}).withColumn("whole", F.col("n_words") + F.col("n_before") + F.col("n_after"))
    order = Window.partitionBy("key", "row").orderBy("u0")
    taken = F.when(F.lag("u1").over(order) + 2 == F.col("u0"), F.lag("n_after").over(order))
    free = F.least("n_before", F.coalesce("n_left", F.lit(0)) - none(taken))
    out = out.withColumn("free", F.greatest(free, F.lit(0)))
    return out.select(
        "key", "row",
        F.when(F.col("free") > 0, F.col("s0") + F.get("before", F.col("free") - 1)).otherwise(F.col("start")).alias("start"),
        F.when(F.col("n_after") > 0, F.col("s2") + F.get("after", F.col("n_after") - 1)).otherwise(F.col("end")).alias("end"),
        "n_units", (F.col("n_words") + F.col("free") + F.col("n_after")).alias("n_words"), "first_key", "whole",
    )


def without_repeats(df: DataFrame, runs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with their runs cut out of `text`; `removed` keeps the runs' offsets (empty if there are none)."""
    own, spans, row = fresh(df, "own", "removed", "row")
    df = df.drop("removed")

    @F.pandas_udf("long")
    def row_of(texts: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "replace")) - (1 << 63) for t in texts], dtype="int64")

    listed = runs.groupBy(F.col("key").alias(own), F.col("row").alias(row + "_")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    out = df.withColumn(row, row_of(F.col(text))).join(listed, F.col(own).eqNullSafe(F.col(key)) & (F.col(row) == F.col(row + "_")), "left")
    return out.withColumns({text: cut_out(F.col(text), F.col("removed")), "removed": F.coalesce("removed", F.array())}).drop(own, row, row + "_")


def cut_out(text: Column, spans: Column) -> Column:
    n = F.size(spans)
    starts = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]))
    kept = F.transform(starts, lambda s, i: F.substring(text, s + 1, F.coalesce(F.get(spans, i)["start"], F.length(text)) - s))
    return F.when(spans.isNull(), text).otherwise(F.array_join(kept, ""))
