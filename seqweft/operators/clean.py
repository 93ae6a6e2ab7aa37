"""Cleaning of ordered channels: sentinels, ranges, gaps and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.operators.ordered import all_of, nearest_known

# fixed values: cleaning defaults per channel family
ACC_LIMIT = 40.0
SENTINEL = -1.0
GAP_LIMITS = {"acc": 3, "rot": 2, "tof": None, "thm": 5}


def sentinel_to_null(df: DataFrame, channels: Sequence[str], sentinel: float = SENTINEL) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != sentinel, F.col(c)) for c in channels})


def out_of_range_to_null(df: DataFrame, channels: Sequence[str], limit: float = ACC_LIMIT) -> DataFrame:
    """Keeps only absolute values up to and including the limit."""
    return df.withColumns({c: F.when(F.abs(F.col(c)) <= limit, F.col(c)) for c in channels})


def clean_families(df: DataFrame, families: dict[str, Sequence[str]], limit: float = ACC_LIMIT) -> DataFrame:
    """Acceleration outside the limit and time-of-flight sentinels become null; other families stay."""
    df = out_of_range_to_null(df, families.get("acc", []), limit)
    return sentinel_to_null(df, families.get("tof", []))


def replace_non_finite(
    df: DataFrame, channels: Sequence[str], nan: float = 0.0, posinf: float = 1.0, neginf: float = -1.0
) -> DataFrame:
    def fixed(c: str) -> Column:
        col = F.col(c)
        return (
            F.when(col.isNull() | F.isnan(col), F.lit(nan))
            .when(col == float("inf"), F.lit(posinf))
            .when(col == float("-inf"), F.lit(neginf))
            .otherwise(col)
        )

    return df.withColumns({c: fixed(c) for c in channels})


def missing_group_flags(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Adds `<group>_missing`, true where every channel of the group is null."""
    return df.withColumns({f"{g}_missing": all_of([F.col(c).isNull() for c in cs]) for g, cs in groups.items()})


def _filled(value: Column, pos: Column, prev: Column, nxt: Column, limit: int | None) -> Column:
    pv, pi, nv, ni = prev["v"], prev["at"], nxt["v"], nxt["at"]
    between = pv + (nv - pv) * (pos - pi) / (ni - pi)
    guess = F.when(pv.isNull(), nv).when(nv.isNull(), pv).otherwise(between)
    if limit is None:
        return F.coalesce(value, guess)
    near = F.coalesce(pos - pi <= limit, F.lit(False)) | F.coalesce(ni - pos <= limit, F.lit(False))
    return F.when(value.isNotNull(), value).when(near, guess)


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    limits: dict[str, int],
    then_carry: Sequence[str] = (),
    pos: str = "pos",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Linear interpolation per sequence, reaching `limits[c]` positions from a known value on either side.

    At the sequence's ends the nearest known value is copied, as far as the limit goes. Channels in
    `then_carry` have the remaining gaps filled from the last value before or, failing that, the first
    after; filled gaps count as values then. All channels share the sorts and the one shuffle.
    """
    channels = list(limits)
    looked = nearest_known(df, keys, channels, pos, order=order)
    out = {}
    for c in channels:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        k = limits[c]
        value = _filled(F.col(c), F.col(pos), prev, nxt, k)
        if c in then_carry:
            value = F.coalesce(value, _carried(prev, nxt, k))
        out[c] = value
    return looked.withColumns(out).select(*df.columns)


def _carried(prev: Column, nxt: Column, limit: int) -> Column:
    """What forward then backward fill finds in a gap already interpolated up to `limit` from each side.

    In an inner gap the last filled position before the hole is `limit` after the previous value, so its
    interpolated value is carried on; at the front of a sequence the first known value comes back.
    """
    pv, pi, nv, ni = prev["v"], prev["at"], nxt["v"], nxt["at"]
    edge = pv + (nv - pv) * F.lit(limit) / (ni - pi)
    return F.when(pv.isNull(), nv).when(nv.isNull(), pv).otherwise(edge)


def carry_fill(
    df: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    pos: str = "pos",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Forward fill, then backward fill for what precedes the first known value."""
    looked = nearest_known(df, keys, channels, pos, order=order)
    out = {c: F.coalesce(F.col(f"_prev_{c}")["v"], F.col(f"_next_{c}")["v"]) for c in channels}
    return looked.withColumns(out).select(*df.columns)


def clean_uniform(
    df: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    sentinel_channels: Sequence[str] | None = None,
    gap: int = 5,
    pos: str = "pos",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Sentinel to null, interpolation over short gaps, then carrying: the same for every channel."""
    marked = sentinel_to_null(df, channels if sentinel_channels is None else sentinel_channels)
    return fill_gaps(marked, keys, {c: gap for c in channels}, then_carry=channels, pos=pos, order=order)


def clean_by_family(
    df: DataFrame,
    keys: Sequence[str],
    families: dict[str, Sequence[str]],
    limits: dict[str, int | None] | None = None,
    pos: str = "pos",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Gap filling with a limit per family; time of flight loses its sentinel first and ends at zero,
    thermal channels are carried on after interpolation."""
    limits = {**GAP_LIMITS, **(limits or {})}
    tof = list(families.get("tof", []))
    df = sentinel_to_null(df, tof)
    per_channel = {c: limits[f] for f, cs in families.items() for c in cs if limits.get(f) is not None}
    if per_channel:
        carried = list(families.get("thm", []))
        df = fill_gaps(df, keys, per_channel, then_carry=carried, pos=pos, order=order)
    return df.fillna(0.0, tof) if tof else df
