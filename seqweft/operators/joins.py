"""Joins of readings with attributes, and set tests between key columns.

No side is broadcast by hint: attribute tables grow with the number of subjects, and Spark broadcasts the
small ones by itself after looking at their size. Sides that do not fit are joined with salted keys, as
one subject may hold a large part of the readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.operators.ordered import salted_join


def join_attributes(
    readings: DataFrame,
    attributes: DataFrame,
    on: Sequence[str],
    salt: Sequence[str],
    columns: Sequence[str] | None = None,
    drop_clashes: bool = False,
) -> DataFrame:
    """Left join of one attribute row per key, optionally of some columns, optionally without those the
    readings have already."""
    right = attributes if columns is None else attributes.select(*on, *columns)
    if drop_clashes:
        right = right.drop(*[c for c in right.columns if c in readings.columns and c not in on])
    return salted_join(readings, right, on, salt, "left")


def rows_of(readings: DataFrame, chosen: DataFrame, on: Sequence[str], salt: Sequence[str]) -> DataFrame:
    return salted_join(readings, chosen.select(*on).distinct(), on, salt, "left_semi")


def keys_without(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of the left that the right lacks; keys are made distinct first, so none is hot."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), list(on), "left_anti")


def positions_match(windows: DataFrame, labels: DataFrame, window_id: Sequence[str]) -> DataFrame:
    """Windows with their labels by window id, never by row position."""
    return windows.join(labels, list(window_id), "inner")


def folds_of(df: DataFrame, folds: DataFrame, on: Sequence[str], valid: int) -> DataFrame:
    """Rows with their part of one cross-validation round: `valid` fold against the others."""
    part = F.when(F.col("fold") == valid, "valid").otherwise("train")
    return df.join(folds.select(*on, "fold"), list(on)).withColumn("part", part)
