"""Quality rules: text statistics, and robust outliers by minimum covariance determinant.

Statistic vectors of a language and source are held against a centre and covariance that describe the
densest part of that cell. The estimate starts from medians and quartile ranges and improves by
concentration steps: measure all rows, keep the nearest share, estimate again. A step is one grouped
aggregate: rows are summed by distance bin, and the bins up to the wanted share make the next estimate,
so a cell of any size is spread over all tasks and only its sums meet.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.llm.common import fresh, stored, text_column, with_struct

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VECTOR = ["log_words", "word_length", "symbol_share", "dup_lines", "repeat_share"]
#: Least standard deviations: a spread below these isn't held against a text.
FLOORS = [0.25, 0.02, 0.05, 0.35, 0.10]
SPAN = 8
_SPACE = b" \t\n\r\x0b\x0c"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), len(data.translate(None, _NOT_COUNTED)), symbols, dup, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more in the text."""
    windows = list(zip(*[words[i:] for i in range(SPAN)], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts: dict[tuple, int] = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = reach = 0
    for at, w in enumerate(windows):
        if counts[w] > 1:
            covered += at + SPAN - max(at, reach)
            reach = at + SPAN
    return covered


def statistics_struct():
    return text_column(lambda texts: pd.DataFrame([text_statistics(t) for t in texts], columns=STATISTICS), ", ".join(f"{n} long" for n in STATISTICS))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five counts; a null text counts as empty, columns of the same names are replaced."""
    return with_struct(df, statistics_struct()(F.col(text).cast("string")), STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log(words), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.log1p(F.col("n_dup_lines").cast("double")), F.sqrt(F.col("n_repeat_words") / words)]


def chi_square_cdf(x: float, k: int, steps: int = 20_000) -> float:
    t = (np.arange(steps) + 0.5) * (x / steps)
    return float(np.sum(t ** (k / 2 - 1) * np.exp(-t / 2)) * (x / steps) / (2 ** (k / 2) * math.gamma(k / 2)))


def chi_square_quantile(q: float, k: int) -> float:
    low, high = 0.0, 50.0 * k
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k, 4000) < q else (low, mid)
    return (low + high) / 2


def consistency(share: float, k: int) -> float:
    """By how much the covariance of the nearest share of normal rows is to be enlarged."""
    return share / chi_square_cdf(chi_square_quantile(share, k), k + 2)


def shape_udf(k: int, floors: list[float], factor: float):
    """Centre and whitening matrix, row by row, from a count, k sums and k(k+1)/2 sums of products."""

    @F.pandas_udf("array<double>")
    def shape(sums: pd.Series) -> pd.Series:
        out = []
        rows, cols = np.tril_indices(k)
        for s in sums:
            s = np.asarray(s, float)
            centre = s[1 : k + 1] / s[0]
            cov = np.zeros((k, k))
            cov[rows, cols] = s[k + 1 :] / s[0]
            cov = cov + np.tril(cov, -1).T - np.outer(centre, centre)
            cov = cov * factor + np.diag(np.square(floors))
            out.append(np.concatenate([centre, np.linalg.inv(np.linalg.cholesky(cov))[rows, cols]]))
        return pd.Series(out)

    return shape


def distance(names: list[str], shape: Column) -> Column:
    """Squared Mahalanobis distance of the named columns under (centre, lower whitening matrix)."""
    k, at, total = len(names), len(names), F.lit(0.0)
    gaps = [F.col(n) - shape[i] for i, n in enumerate(names)]
    for i in range(k):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + shape[at] * gaps[j]
            at += 1
        total = total + row * row
    return total


def concentrated(rows: DataFrame, names: list[str], floors: list[float], cell: str = "cell", share: float = 0.75, steps: int = 4) -> DataFrame:
    """(cell, shape) for each cell: the minimum-covariance-determinant estimate after `steps` steps.

    The share is rounded up to whole distance bins of a sixteenth of an octave. All rows count at every
    step. `rows` should be a stored table, as each step reads it once.
    """
    k = len(names)
    quartiles = [F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(n) for n in names]
    start = rows.groupBy(cell).agg(*quartiles)
    scales = [F.lit(1.0) / F.greatest((F.col(n)[2] - F.col(n)[0]) / 1.349, F.lit(f)) for n, f in zip(names, floors, strict=True)]
    tri = [scales[i] if i == j else F.lit(0.0) for i in range(k) for j in range(i + 1)]
    shapes = start.select(cell, F.array(*[F.col(n)[1] for n in names], *tri).alias("shape"))
    sums = [F.count(F.lit(1)).cast("double").alias("s0")] + [F.sum(n).alias(f"s{i + 1}") for i, n in enumerate(names)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{k + 1 + p}") for p, (i, j) in enumerate(pairs)]
    keys = [f"s{i}" for i in range(len(sums))]
    make = shape_udf(k, floors, consistency(share, k))
    inner = Window.partitionBy(cell).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(steps):
        binned = rows.join(shapes, cell).withColumn("bin", F.floor(F.log2(distance(names, F.col("shape")) + 2.0**-6) * 16)).groupBy(cell, "bin").agg(*sums)
        near = binned.withColumn("before", F.coalesce(F.sum("s0").over(inner), F.lit(0.0))).withColumn("all", F.sum("s0").over(Window.partitionBy(cell)))
        near = near.where(F.col("before") < F.col("all") * share).groupBy(cell).agg(*[F.sum(s).alias(s) for s in keys])
        shapes = stored(near.select(cell, make(F.array(*keys)).alias("shape")), "shapes")
    return shapes


def with_verdicts(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cut: float = 50.0, least: int = 100, share: float = 0.75
) -> DataFrame:
    """Adds the counts, `base_failed`, `distance` and `kept`.

    A text that passes the base rules is rejected if its vector lies further than `cut` (squared distance)
    from the estimate of its language and source. Cells of fewer than `least` such texts are pooled by
    language; what is still smaller is judged by the base rules alone (`distance` null). Null languages and
    sources are cells of their own. Null and empty texts fail the base rules. Every row is judged, repeated
    rows alike; columns named like the new ones are replaced and the text itself isn't returned. An empty
    table gives an empty table.
    """
    new = [*STATISTICS, "base_failed", "distance", "kept"]
    df = df.drop(*[c for c in df.columns if c.lower() in new])
    names, (cell, own, pooled, many, shape) = fresh(df, *VECTOR), fresh(df, "cell", "own_cell", "pooled_cell", "many", "shape")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    counted = with_statistics(df, text).withColumn("base_failed", base_failed())
    if text not in (lang, source):
        counted = counted.drop(text)
    counted = stored(counted.withColumns({pooled: key(lang), own: F.concat_ws("\t", key(lang), key(source))} | dict(zip(names, vector(), strict=True))), "statistics")
    passed = counted.where(~F.col("base_failed"))
    large = passed.groupBy(own).agg(F.count(F.lit(1)).alias(many)).where(F.col(many) >= least)
    cells = counted.join(large, own, "left").withColumn(cell, F.when(F.col(many).isNotNull(), F.col(own)).otherwise(F.col(pooled)))
    cells = stored(cells.drop(own, pooled, many), "cells")
    fit = cells.where(~F.col("base_failed")).select(cell, *names)
    shapes = concentrated(fit, names, FLOORS, cell, share).withColumnRenamed("shape", shape)
    enough = fit.groupBy(cell).agg(F.count(F.lit(1)).alias(many)).where(F.col(many) >= least).drop(many)
    out = cells.join(shapes.join(enough, cell, "left_semi"), cell, "left").withColumn("distance", F.when(~F.col("base_failed"), distance(names, F.col(shape))))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cut, F.lit(False))).drop(cell, shape, *names)
