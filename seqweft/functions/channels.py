"""Choosing channels by name and reading their names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: channel families by name prefix
FAMILIES = {"acc": "acc_", "rot": "rot_", "thm": "thm_", "tof": "tof_"}
PIXEL_NAME = r"^tof_(\d+)_v(\d+)$"


def by_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def by_substring(df: DataFrame, *parts: str) -> list[str]:
    return [c for c in df.columns if any(p in c for p in parts)]


def all_but(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(excluded)]


def by_pattern(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def families(df: DataFrame) -> dict[str, list[str]]:
    return {name: by_prefix(df, prefix) for name, prefix in FAMILIES.items()}


def family_of(name: Column) -> Column:
    """Channel family named in a feature or channel name; anything else is `other`."""
    out = F.lit("other")
    for family, prefix in reversed(FAMILIES.items()):
        out = F.when(name.contains(prefix), F.lit(family)).otherwise(out)
    return out


def to_long(df: DataFrame, keep: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """One row per reading and channel: columns `channel` and `value`."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in channels])
    return wide.unpivot(list(keep), list(channels), "channel", "value")


def pixel_parts(channel: Column, width: int = 8) -> dict[str, Column]:
    """Sensor, pixel, row and column numbers of a pixel channel name."""
    sensor = F.regexp_extract(channel, PIXEL_NAME, 1).cast("int")
    pixel = F.regexp_extract(channel, PIXEL_NAME, 2).cast("int")
    return {
        "sensor": sensor,
        "pixel": pixel,
        "row": F.floor(pixel / width).cast("int"),
        "col": (pixel % width).cast("int"),
    }


def pixel_grid(df: DataFrame, name: str = "frame", fill: float = 0.0, sentinel: float = -1.0) -> DataFrame:
    """Adds one array per row: sensor x row x column. No response and absent pixels become `fill`; nulls stay."""
    found = {}
    for c in df.columns:
        if hit := re.match(PIXEL_NAME, c):
            found[int(hit[1]), int(hit[2])] = c
    if not found:
        raise ValueError("no pixel columns")
    side = int((max(p for _, p in found) + 1) ** 0.5)

    def cell(sensor: int, pixel: int) -> Column:
        if (sensor, pixel) not in found:
            return F.lit(float(fill))
        col = F.col(found[sensor, pixel]).cast("double")
        return F.when(col == sentinel, F.lit(float(fill))).otherwise(col)

    layers = [
        F.array(*[F.array(*[cell(s, r * side + c) for c in range(side)]) for r in range(side)])
        for s in sorted({s for s, _ in found})
    ]
    return df.withColumn(name, F.array(*layers))
