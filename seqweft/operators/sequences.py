"""Per-sequence operators that look along the order: peaks, crossings, differences, first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.operators.ordered import nearest_known, running, with_lag, with_positions, with_sequence_mean


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in order; a map-side aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)


def mark_peaks(
    df: DataFrame, keys: Sequence[str], channel: str, pos: str = "pos", order: Sequence[str] | None = None
) -> DataFrame:
    """Adds `is_peak`: the row starts a run of equal values that lies above both neighbouring runs.

    Runs at the ends of a sequence are never peaks. The channel must have no nulls.
    """
    columns = df.columns
    lagged = with_lag(df, keys, [channel], pos, order)
    before = F.col(f"_lag_{channel}")
    starts = before.isNull() | (F.col(channel) != before)
    lagged = lagged.withColumn("_run", F.when(starts, F.col(channel)))
    looked = nearest_known(lagged, keys, ["_run"], pos, strict=True, order=order)
    after = F.col("_next__run")["v"]
    peak = starts & (before < F.col(channel)) & (after < F.col(channel))
    return looked.select(*columns, F.coalesce(peak, F.lit(False)).alias("is_peak"))


def signal_summary(
    df: DataFrame, keys: Sequence[str], channel: str, pos: str = "pos", order: Sequence[str] | None = None
) -> DataFrame:
    """One row per sequence: level, spread, differences, peaks at or above the mean, mean crossings, energy."""
    v = F.col(channel)
    marked = mark_peaks(with_sequence_mean(df.where(v.isNotNull()), keys, [channel]), keys, channel, pos, order)
    lagged = with_lag(marked, keys, [channel], pos, order)
    mean, lag = F.col(f"_mean_{channel}"), F.col(f"_lag_{channel}")
    diff = v - lag
    crossing = (F.signum(v - mean) != F.signum(lag - mean)).cast("int")
    return lagged.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std_samp"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("range"),
        F.avg(diff).alias("diff_mean"),
        F.stddev_samp(diff).alias("diff_std"),
        F.count_if(F.col("is_peak")).alias("peaks"),
        F.count_if(F.col("is_peak") & (v >= mean)).alias("peaks_over_mean"),
        F.coalesce(F.sum(crossing), F.lit(0)).cast("long").alias("zero_crossings"),
        F.sum(v * v).alias("energy"),
    )


def empirical_cdf(df: DataFrame, value: str) -> DataFrame:
    """Share of rows up to and including each row in value order, as one row per distinct value.

    `first_share` to `last_share` are the shares at the first and last of the value's rows.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    placed = with_positions(counts, [], [value], pos="_before", length="_all", weight="n")
    return placed.select(
        value,
        "n",
        ((F.col("_before") + 1) / F.col("_all")).alias("first_share"),
        ((F.col("_before") + F.col("n")) / F.col("_all")).alias("last_share"),
    )


def running_best(df: DataFrame, order: Sequence[str], value: str, name: str = "best_so_far") -> DataFrame:
    return running(df, [], order, value, "max", name)
