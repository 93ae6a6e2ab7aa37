"""Sinks and the fingerprint-guarded table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.sources.readers import CSV_FORMATS


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_windows(windows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_parquet(windows, path, ["window_config"], mode)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**CSV_FORMATS).csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row that is the same for the same rows in any order: a count and a sum and xor of row hashes."""
    row = F.xxhash64(*(cols or df.columns))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(row).alias("hash_xor"),
        F.sum(row.cast("decimal(20,0)")).cast("string").alias("hash_sum"),
    )


def text_fingerprint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same idea on md5 of the columns' text, which other engines can repeat."""
    code = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols])), 1, 8), 16, 10)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(code.cast("long")).alias("hash_xor"),
        F.sum(code.cast("long")).alias("hash_sum"),
    )


def rebuilt_if_changed(
    spark: SparkSession, source: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str
) -> DataFrame:
    """The built table for this source: read back if its fingerprint is on file, else built and written.

    Every fingerprint of source and `build` has a folder of its own, so a table in use is never overwritten,
    and the marker is written after the table, so a broken build is not taken for a finished one.
    """
    mark = fingerprint(source).first()
    name = f"{mark['rows']}_{mark['hash_xor'] & 0xFFFFFFFFFFFFFFFF:016x}_{mark['hash_sum']}_{_function_mark(build)}"
    data, meta = f"{folder}/table_{name}", f"{folder}/meta_{name}"
    try:
        spark.read.schema("name string, rows long").json(meta)
    except AnalysisException:  # nothing there yet
        write_parquet(build(source), data, mode="overwrite")
        write_json(spark.createDataFrame([(name, mark["rows"])], "name string, rows long"), meta, mode="overwrite")
    return spark.read.parquet(data)


def _function_mark(build: Callable) -> str:
    """Differs for functions of other names, code or constants; values a function only refers to don't count."""
    code = getattr(build, "__code__", None)
    constants = [c for c in code.co_consts if not hasattr(c, "co_code")] if code else []
    said = (getattr(build, "__module__", ""), getattr(build, "__qualname__", repr(type(build))), code and code.co_code, constants)
    return hashlib.md5(repr(said).encode()).hexdigest()[:8]
