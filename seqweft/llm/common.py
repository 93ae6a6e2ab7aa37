"""Helpers shared by the corpus operators: tables, cut lineage, Arrow columns and sampled range borders."""

from __future__ import annotations

import bisect
import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.session import scratch_path

SAMPLE_PER_PART = 32
#: Rows of text that a Python worker gets at once, so that long texts fit; the session's own number, if it sets one, holds.
TEXTS_AT_ONCE = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: computed once, safe when executors go."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have yet, one for each wanted name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_column(
    fn: Callable[[list[str | None]], pd.DataFrame], schema: str, after: Callable[[], None] | None = None
) -> Callable[[Column], Column]:
    """A struct column made from batches of texts; `fn` gets a list and returns a frame of as many rows.

    `after` is called when a task has seen all its batches.
    """
    small_batches()

    @F.pandas_udf(schema)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield fn(texts.tolist())
        if after is not None:
            after()
        release_memory()

    return made


def release_memory() -> None:
    """Gives back what a finished task has freed: the worker stays, and the next task may be of another operator."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches() -> None:
    spark = SparkSession.active()
    if spark.conf.get(_BATCH) == "10000":  # Spark's default
        spark.conf.set(_BATCH, TEXTS_AT_ONCE)


def with_struct(df: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    """Adds the struct's fields as columns; a column of the same name is replaced."""
    (tmp,) = fresh(df, "_made")
    drop = {n.lower() for n in names}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in drop]
    return df.withColumn(tmp, struct).select(*kept, *[F.col(f"`{tmp}`.{n}").alias(n) for n in names])


def borders(df: DataFrame, key: Column, parts: int) -> list:
    """Ordered keys that cut the rows into about equal parts.

    They come from the `32 * parts` keys with the smallest hash of key and row content, so the sample is
    bounded by the number of parts and the same on every run. A frequent key may appear several times.
    Hashes far above those wanted are left out in the tasks, which then send few keys each.
    """
    wanted = SAMPLE_PER_PART * parts
    share = min(1.0, 4 * wanted / max(1, df.count()))
    mix = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    low = -(1 << 63) + int(share * (1 << 64)) - 1
    picked = df.select(key.alias("k"), mix.alias("h")).where(F.col("k").isNotNull() & (F.col("h") <= low))
    picked = picked.orderBy("h", "k").limit(wanted)
    keys = sorted(r.k for r in picked.collect())
    step = len(keys) / parts
    return [keys[int(i * step)] for i in range(1, parts)] if keys else []


def part_of(cuts: list, key, spread: int = 0) -> int:
    """The part of a key; rows of a key that fills several parts are dealt among them by `spread`."""
    if key is None:
        return 0
    low, high = bisect.bisect_left(cuts, key), bisect.bisect_right(cuts, key)
    return high if high - low < 2 else low + 1 + spread % (high - low)
