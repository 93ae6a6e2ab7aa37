"""Fitted transforms, feature scores and selection, and data splits.

A fitted transform is a small table (one row per channel) or a Spark ML model; splits are ordered by a
hash, so they repeat on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.functions.channels import to_long
from seqweft.functions.expressions import finite, hash_order
from seqweft.operators.ordered import exact_quantiles, has_hot_key, salted_join, stored, with_positions
from seqweft.operators.user import apply_in_chunks


def fit_scaler(df: DataFrame, channels: Sequence[str], null_as_zero: bool = False) -> DataFrame:
    """Mean and population deviation per channel as one row; a constant channel gets the divisor 1."""

    def values(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) if null_as_zero else F.col(c)

    row = df.agg(
        *[F.avg(values(c)).alias(f"{c}_mean") for c in channels],
        *[F.stddev_pop(values(c)).alias(f"_s_{c}") for c in channels],
    )
    return row.select(
        *[f"{c}_mean" for c in channels],
        *[F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")).alias(f"{c}_std_pop") for c in channels],
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, channels: Sequence[str], null_as_zero: bool = False) -> DataFrame:
    """Scales with a fitted (or stored) one-row scaler, read as a scalar subquery."""
    stats = scaler.select(F.struct("*")).scalar()
    out = df.select("*", stats.alias("_s"))

    def scaled(c: str) -> Column:
        value = F.coalesce(F.col(c), F.lit(0.0)) if null_as_zero else F.col(c)
        return (value - F.col("_s")[f"{c}_mean"]) / F.col("_s")[f"{c}_std_pop"]

    return out.withColumns({c: scaled(c) for c in channels}).drop("_s")


def fit_window_scaler(windows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Scaler over all positions of all windows; a reading counts once per window it is in.

    Sums come from the arrays, so windows are never exploded. A first pass takes the means, a second the
    squared distances from them.
    """

    def over(c: str, term) -> Column:
        return F.aggregate(F.col(c), F.lit(0.0), lambda acc, x: acc + term(F.coalesce(x, F.lit(0.0))))

    means = windows.agg(
        F.struct(*[(F.sum(over(c, lambda x: x)) / F.sum(F.size(c))).alias(c) for c in channels])
    ).scalar()
    based = windows.select(*channels, means.alias("_m"))

    def spread(c: str) -> Column:
        m = F.col("_m")[c]
        return F.sqrt(F.sum(over(c, lambda x: (x - m) * (x - m))) / F.sum(F.size(c)))

    row = based.agg(*[F.max(F.col("_m")[c]).alias(f"{c}_mean") for c in channels], *[spread(c).alias(f"_s_{c}") for c in channels])
    return row.select(
        *[f"{c}_mean" for c in channels],
        *[F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")).alias(f"{c}_std_pop") for c in channels],
    )


def fit_reading_scaler(
    readings: DataFrame,
    channels: Sequence[str],
    width: int,
    stride: int,
    min_length: int = 0,
    centre_from: DataFrame | None = None,
    pos: str = "pos",
    length: str = "seq_len",
) -> DataFrame:
    """The scaler `fit_window_scaler` finds, without making the windows.

    How many windows a reading is in follows from its position and its sequence's length, so one weighted
    aggregate over the readings is enough. Sums are taken around the plain mean of `centre_from`.
    """
    p, n = F.col(pos), F.col(length)
    first = F.greatest(F.ceil((p - width + 1) / stride), F.lit(0))
    last = F.least(F.floor(p / stride), F.floor((n - width) / stride))
    short = n < width
    times = F.when(short, F.lit(1)).otherwise(F.greatest(last - first + 1, F.lit(0))).cast("double")
    padded = F.when(short & (p == 0), width - n).otherwise(F.lit(0)).cast("double")
    source = readings if centre_from is None else centre_from
    centre = source.agg(F.struct(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in channels])).scalar()
    based = readings.where(n >= min_length).select(*channels, times.alias("_t"), padded.alias("_z"), centre.alias("_m"))
    t, z = F.col("_t"), F.col("_z")
    sums = [F.sum(t + z).alias("_n")]
    for c in channels:
        m = F.col("_m")[c]
        off = F.coalesce(F.col(c), F.lit(0.0)) - m
        sums += [
            F.max(m).alias(f"_m_{c}"),
            F.sum(t * off - z * m).alias(f"_a_{c}"),
            F.sum(t * off * off + z * m * m).alias(f"_b_{c}"),
        ]
    row = based.agg(*sums)
    shift = {c: F.col(f"_a_{c}") / F.col("_n") for c in channels}
    spread = {c: F.sqrt(F.greatest(F.col(f"_b_{c}") / F.col("_n") - shift[c] * shift[c], F.lit(0.0))) for c in channels}
    return row.select(
        *[(F.col(f"_m_{c}") + shift[c]).alias(f"{c}_mean") for c in channels],
        *[F.when(spread[c] == 0, F.lit(1.0)).otherwise(spread[c]).alias(f"{c}_std_pop") for c in channels],
    )


def apply_window_scaler(windows: DataFrame, scaler: DataFrame, channels: Sequence[str]) -> DataFrame:
    stats = scaler.select(F.struct("*")).scalar()
    out = windows.select("*", stats.alias("_s"))
    scaled = {}
    for c in channels:
        mean, std = F.col("_s")[f"{c}_mean"], F.col("_s")[f"{c}_std_pop"]
        scaled[c] = F.transform(F.col(c), _scaling(mean, std))
    return out.withColumns(scaled).drop("_s")


def _scaling(mean: Column, std: Column):
    return lambda x: (F.coalesce(x, F.lit(0.0)) - mean) / std


def hash_sample(df: DataFrame, key: Sequence[str], share: float) -> DataFrame:
    """The rows whose key hash falls below the share: the same rows every time."""
    return df.where(hash_order(*[F.col(k).cast("string") for k in key]) < int(share * (1 << 32)))


def interactions(df: DataFrame, columns: Sequence[str], keep: Sequence[str], squares: bool = False) -> DataFrame:
    """The columns and all their pairwise products."""
    pairs = list(combinations(columns, 2)) + ([(c, c) for c in columns] if squares else [])
    return df.select(*keep, *columns, *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in pairs])


def anova_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """F score per feature: spread between label means against spread inside labels.

    Sums are taken around the overall mean, map-side, per (feature, label).
    """
    centre = df.agg(F.struct(*[F.avg(c).alias(c) for c in features])).scalar()
    based = df.where(F.col(label).isNotNull()).select(label, *features, centre.alias("_m"))
    moved = based.select(label, *[(F.col(c) - F.col("_m")[c]).alias(c) for c in features])
    v = F.col("value")
    groups = (
        to_long(moved, [label], features)
        .where(v.isNotNull())
        .groupBy("channel", label)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    )
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    total = groups.groupBy("channel").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("n"),
        F.sum(s * s / n).alias("between"),
        F.sum(s).alias("s"),
        F.sum(q - s * s / n).alias("within"),
    )
    between = F.col("between") - F.col("s") * F.col("s") / F.col("n")
    f = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return total.select(F.col("channel").alias("feature"), f.alias("f_score"))


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information between label and the feature's quantile bin, in nats."""
    probs = {f"p{i}": i / bins for i in range(1, bins)}
    long = to_long(df.where(F.col(label).isNotNull()), [label], features).where(F.col("value").isNotNull())
    # one row per feature
    edges = exact_quantiles(long, ["channel"], "value", probs, hot=has_hot_key(df, []))
    cut = edges.select("channel", F.array(*probs).alias("_edges"))
    placed = long.join(F.broadcast(cut), "channel")
    bin_of = F.size(F.filter("_edges", lambda e: F.col("value") > e))
    cells = placed.groupBy("channel", label, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # features x labels x bins rows are left, so sums over them are cheap windows
    joined = cells.withColumns(
        {
            "n_bin": F.sum("n").over(Window.partitionBy("channel", "bin")),
            "n_label": F.sum("n").over(Window.partitionBy("channel", label)),
            "n_all": F.sum("n").over(Window.partitionBy("channel")),
        }
    )
    p = F.col("n") / F.col("n_all")
    term = p * F.log(F.col("n") * F.col("n_all") / (F.col("n_bin") * F.col("n_label")))
    return joined.groupBy(F.col("channel").alias("feature")).agg(F.sum(term).alias("mi_score"))


def digamma(x: Column) -> Column:
    """The digamma function of a positive number, to about twelve digits."""
    x = x.cast("double")
    y = x + 8
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    return series - sum((1 / (x + i) for i in range(1, 8)), 1 / x)


def _reaches(k: int, by: list[str]):
    """For a chunk of one feature's and label's values in order: between which values a row's neighbours lie."""

    def reach(frame: pd.DataFrame) -> pd.DataFrame:
        v, own = frame["value"].to_numpy(), np.flatnonzero(frame["own"])
        near = np.minimum(k, frame["_n"].to_numpy()[own] - 1)
        distance = np.full(len(own), np.inf)
        low, high = np.empty(len(own)), np.empty(len(own))
        for a in range(k + 1):  # so many of the nearest stand before the row, the others behind it
            left, right = own - a, own + near - a
            fits = (a <= near) & (left >= 0) & (right < len(v))
            to_left, to_right = (v[own] - v[np.where(fits, left, 0)], v[np.where(fits, right, 0)] - v[own])
            d = np.where(fits, np.maximum(to_left, to_right), np.inf)
            better = d < distance
            distance = np.where(better, d, distance)
            # The end on which the farthest neighbour lies is that neighbour itself, untouched by rounding.
            low = np.where(better, np.where(to_left == d, v[np.where(fits, left, 0)], v[own] - d), low)
            high = np.where(better, np.where(to_right == d, v[np.where(fits, right, 0)], v[own] + d), high)
        out = frame.iloc[own][[*by, "_n", "value"]].copy()
        return out.assign(_k=near, _low=low, _high=high, _apart=distance > 0)

    return reach


def neighbour_information(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], k: int = 3) -> DataFrame:
    """Mutual information between a label and each feature, in nats, by the distances to nearest neighbours.

    A row's `k`-th nearest neighbour among its own label's values says how far to look, and the number of
    all values closer than that how crowded it is there (itself included; at distance 0 the equal ones).
    Both come from sorted values: neighbours from chunks with `k` rows beside them, counts from merging the
    values with the ends of all rows' ranges. So neither a label nor a feature has to fit one task.
    Labels with a single value of a feature are left out of it; `key` names a row. Never below 0.
    """
    key = list(key)
    known = df.where(F.col(label).isNotNull()).select(label, *key, F.array(*[F.col(c).cast("double") for c in features]).alias("_v"))
    # Written once, as it is read to be counted, ranked and looked up.
    long = stored(known.select(label, *key, F.posexplode("_v").alias("_f", "value")), "feature-values")
    long = long.where(finite(F.col("value")).isNotNull())
    own = with_positions(long, ["_f", label], ["value", *key], length="_n").where("_n > 1")
    names = ["_f", label, *key]
    fields = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = ", ".join([*[f"`{c}` {fields[c]}" for c in [*names, "_n", "value"]], "_k long, _low double, _high double, _apart boolean"])
    reached = stored(apply_in_chunks(own, ["_f", label], _reaches(k, names), schema, before=k, after=k), "reaches")
    # An end counts the values before it: those at a low end too, unless the equal ones themselves are meant.
    first, second = F.lit(0), F.lit(2)
    events = F.array(
        F.struct(F.col("value").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("weight"), F.lit(0).alias("sign")),
        F.struct(F.col("_low").alias("at"), F.when(F.col("_apart"), second).otherwise(first).alias("kind"), F.lit(0).alias("weight"), F.lit(-1).alias("sign")),
        F.struct(F.col("_high").alias("at"), F.when(F.col("_apart"), first).otherwise(second).alias("kind"), F.lit(0).alias("weight"), F.lit(1).alias("sign")),
    )
    merged = reached.select(*names, "_n", "_k", F.explode(events).alias("_e")).select(*names, "_n", "_k", "_e.*")
    counted = with_positions(merged, ["_f"], ["at", "kind"], pos="_before", weight="weight")
    rows = counted.groupBy(*names).agg(F.sum(F.col("sign") * F.col("_before")).alias("_m"), F.first("_n").alias("_n"), F.first("_k").alias("_k"))
    n = digamma(F.count(F.lit(1)))
    score = n + F.avg(digamma(F.col("_k"))) - F.avg(digamma(F.col("_n"))) - F.avg(digamma(F.col("_m")))
    name = F.element_at(F.array(*map(F.lit, features)), F.col("_f") + 1).alias("feature")
    return rows.groupBy("_f").agg(F.greatest(score, F.lit(0.0)).alias("mi_score")).select(name, "mi_score")


def top_features(scores: DataFrame, score: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc(score), "feature").limit(k)


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Labels with whole-number codes in alphabetical order, one row per label."""
    names = df.select(label).where(F.col(label).isNotNull()).distinct()
    ranked = with_positions(names, [], [label], pos="code")
    return ranked.select(label, F.col("code").cast("int").alias("code"))


# ---- splits ---------------------------------------------------------------------------------------


def _hashed(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.withColumn("_hash", hash_order(*[F.col(k).cast("string") for k in key]))


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int, hot: bool | None = None) -> DataFrame:
    """Adds `fold`: rows of each label dealt out in hash order. A large label is ranked in slices."""
    ranked = with_positions(_hashed(df, key), [label], ["_hash", *key], pos="_rank", hot=hot)
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_hash", "_rank")


def plain_folds(df: DataFrame, key: Sequence[str], k: int, hot: bool | None = None) -> DataFrame:
    """Adds `fold` without regard to labels."""
    ranked = with_positions(_hashed(df, key), [], ["_hash", *key], pos="_rank", hot=hot)
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_hash", "_rank")


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """One row per group with its fold, so that no group is in two folds."""
    return plain_folds(df.select(group).distinct(), [group], k)


def stratified_split(df: DataFrame, label: str, key: Sequence[str], test: float = 0.2, valid: float = 0.2) -> DataFrame:
    """Adds `part`: of each label the first share in hash order is test, the next of the rest is valid."""
    ranked = with_positions(_hashed(df, key), [label], ["_hash", *key], pos="_rank", length="_n")
    n_test = F.floor(F.col("_n") * F.lit(test) + 0.5)
    n_valid = F.floor((F.col("_n") - n_test) * F.lit(valid) + 0.5)
    part = (
        F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_valid, "valid").otherwise("train")
    )
    return ranked.withColumn("part", part).drop("_hash", "_rank", "_n")


def split_with_fallback(df: DataFrame, label: str, key: Sequence[str], test: float = 0.2) -> DataFrame:
    """Stratified only if every label has two rows and there are ten in all, otherwise over all rows."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    fits = sizes.agg(F.coalesce((F.min("n") >= 2) & (F.sum("n") >= 10), F.lit(False))).scalar()
    stratum = F.when(fits, F.col(label).cast("string")).otherwise(F.lit("all"))
    out = stratified_split(df.withColumn("_stratum", stratum), "_stratum", key, test, 0.0)
    return out.drop("_stratum")


def with_group_folds(df: DataFrame, group: str, key: Sequence[str], k: int) -> DataFrame:
    """Adds the fold of the row's group; a group may hold most of the rows, so the join is salted."""
    return salted_join(df, group_folds(df, group, k), [group], key, "inner")


def first_sequences(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of the first `n` sequences in key order."""
    chosen = df.select(*keys).distinct().orderBy(*keys).limit(n)
    return df.join(F.broadcast(chosen), list(keys), "left_semi")
