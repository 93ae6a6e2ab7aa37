"""Profiling: missingness, distributions, correlations, histograms and box-plot numbers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.functions.channels import to_long
from seqweft.functions.expressions import finite, pearson
from seqweft.operators.ordered import _attach, hot_row_limit, salted_join, stored
from seqweft.operators.quantiles import WIDE, channel_quantiles

WIDE_PAIRS = 300  # above this many channel pairs, correlations go through partial product sums


def column_report(df: DataFrame) -> DataFrame:
    """Type, rows and nulls of every column, and how many columns there are."""
    types = dict(df.dtypes)
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n_{c}") for c in df.columns])
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("type"),
            F.col("_rows").alias("rows"),
            (F.col("_rows") - F.col(f"_n_{c}")).alias("nulls"),
            F.lit(len(types)).alias("columns"),
        )
        for c in df.columns
    ]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and ratio per column; one scan, one row of partial counts per task."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in columns])
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"_n_{c}").alias("nulls"), (F.col(f"_n_{c}") / F.col("_rows")).alias("ratio"))
        for c in columns
    ]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def value_counts(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Counts per label with their share of all rows."""
    counts = value_counts(df, *by)
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") / total)


def missingness(df: DataFrame, families: dict[str, Sequence[str]], sentinel: float = -1.0) -> DataFrame:
    """Per family and channel: rows, nulls, sentinels, zeros, range, mean and spread."""
    family_of = {c: f for f, cs in families.items() for c in cs}
    long = to_long(df, [], list(family_of))
    v = F.col("value")
    got = long.groupBy("channel").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(v.isNull()).alias("nulls"),
        F.count_if(v == sentinel).alias("sentinels"),
        F.count_if(v == 0).alias("zeros"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
    )
    names = F.create_map(*[x for c, f in family_of.items() for x in (F.lit(c), F.lit(f))])
    return got.select(F.element_at(names, F.col("channel")).alias("family"), "*")


def outliers(df: DataFrame, channels: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Values outside the quartiles by more than `reach` quartile ranges, per channel."""
    fences = channel_quantiles(df, [], channels, {"q1": 0.25, "q3": 0.75})
    outside = _outside(F.col("value"), reach)
    if len(channels) > WIDE:
        # one row per channel
        held = to_long(df, [], channels).where(F.col("value").isNotNull()).join(F.broadcast(fences), "channel")
        return held.groupBy("channel").agg(F.count_if(outside).alias("outliers"), F.avg(outside.cast("double")).alias("share"))
    # As one row, which every task gets: the table is then read once more and nothing but counts is moved.
    row = stored(fences.groupBy().pivot("channel", list(channels)).agg(F.first(F.struct("q1", "q3"))), "fences")
    counts = []
    for c in channels:
        box = row.select(F.col(f"`{c}`")).scalar()
        v = F.col(c).cast("double")
        room = (box["q3"] - box["q1"]) * reach
        counts += [F.count_if((v < box["q1"] - room) | (v > box["q3"] + room)).alias(f"_o_{c}"), F.count(v).alias(f"_n_{c}")]
    cells = [F.struct(F.lit(c).alias("channel"), F.col(f"_o_{c}").alias("outliers"), F.col(f"_n_{c}").alias("n")) for c in channels]
    got = df.agg(*counts).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").where("n > 0")
    return got.select("channel", "outliers", (F.col("outliers") / F.col("n")).alias("share"))


def _outside(v: Column, reach: float) -> Column:
    room = (F.col("q3") - F.col("q1")) * reach
    return (v < F.col("q1") - room) | (v > F.col("q3") + room)


def missingness_report(df: DataFrame, families: dict[str, Sequence[str]], sentinel: float = -1.0, reach: float = 1.5) -> DataFrame:
    """`missingness` of every channel with its outliers and their share, and the most channels of its family missing at once."""
    channels = [c for cs in families.values() for c in cs]
    beside = outliers(df, channels, reach).withColumnRenamed("share", "outlier_share")
    family = simultaneous_missing(df, families).select("family", "most_at_once")
    # one row per channel and per family
    joined = missingness(df, families, sentinel).join(F.broadcast(beside), "channel", "left")
    return joined.join(F.broadcast(family), "family").withColumn("outliers", F.coalesce("outliers", F.lit(0).cast("long")))


def simultaneous_missing(df: DataFrame, families: dict[str, Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """Rows with any missing channel and the largest number missing at once, per family."""
    counts = {f: sum((F.col(c).isNull().cast("int") for c in cs), F.lit(0)) for f, cs in families.items()}
    cells = F.array(*[F.struct(F.lit(f).alias("family"), n.alias("missing")) for f, n in counts.items()])
    long = df.select(*by, F.explode(cells).alias("_m")).select(*by, "_m.*")
    return long.groupBy(*by, "family").agg(
        F.count_if(F.col("missing") > 0).alias("rows_with_missing"),
        F.max("missing").alias("most_at_once"),
        F.count(F.lit(1)).alias("rows"),
    )


def special_values(df: DataFrame, channels: Sequence[str], sentinel: float = -1.0) -> DataFrame:
    v = F.col("value")
    return to_long(df, [], channels).groupBy("channel").agg(
        F.count_if(v.isNull()).alias("nulls"),
        F.count_if(v == sentinel).alias("sentinels"),
        F.count_if(v == 0).alias("zeros"),
        F.count(F.lit(1)).alias("rows"),
    )


def cleaning_effect(before: DataFrame, after: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Nulls, sentinels and zeros before and after, joined per channel on two small tables."""
    names = ("nulls", "sentinels", "zeros")
    a = special_values(before, channels).select("channel", *[F.col(n).alias(f"{n}_before") for n in names], "rows")
    b = special_values(after, channels).select("channel", *[F.col(n).alias(f"{n}_after") for n in names])
    return a.join(b, "channel")


def reconciliation(effect: DataFrame, tolerance: int = 1000) -> DataFrame:
    """Whether the new nulls are what the removed sentinels and zeros lead one to expect."""
    total = {c: F.sum(c) for c in effect.columns if c.endswith(("_before", "_after"))}
    row = effect.agg(*[e.alias(c) for c, e in total.items()])
    expected = sum((F.col(f"{n}_before") - F.col(f"{n}_after") for n in ("sentinels", "zeros")), F.lit(0))
    actual = F.col("nulls_after") - F.col("nulls_before")
    return row.select(
        "*",
        expected.alias("expected_new_nulls"),
        actual.alias("actual_new_nulls"),
        *[
            F.coalesce(F.try_divide((F.col(f"{n}_after") - F.col(f"{n}_before")) * 100.0, F.col(f"{n}_before")), F.lit(0.0)).alias(f"{n}_change")
            for n in ("nulls", "sentinels", "zeros")
        ],
        (F.abs(actual - expected) <= tolerance).alias("as_expected"),
    )


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts between the smallest and largest value; the last bin includes its upper edge."""
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    v = F.col(value)
    put = df.where(v.isNotNull()).select(*by, v.cast("double").alias("_v"), ends.alias("_e"))
    lo, hi = F.col("_e.lo").cast("double"), F.col("_e.hi").cast("double")
    width = (hi - lo) / bins
    index = F.least(F.floor(F.coalesce(F.try_divide(F.col("_v") - lo, width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return put.select(*by, index.alias("bin")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def box_numbers(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, and whiskers at the outermost values within `reach` quartile ranges of the box."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    boxes = channel_quantiles(df, by, [value], {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("channel").where("q1 IS NOT NULL")
    if by:
        joined = salted_join(counts, boxes, by, [value], "inner")
    else:
        box = boxes.select(F.struct("q1", "median", "q3").alias("_b")).scalar()
        joined = counts.select("*", box.alias("_b")).select(*counts.columns, "_b.*")
    room = (F.col("q3") - F.col("q1")) * reach
    v = F.col(value)
    inside = (v >= F.col("q1") - room) & (v <= F.col("q3") + room)
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("low_whisker"),
        F.max(F.when(inside, v)).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outside"),
    )


# fixed values: the quantiles of a description
DESCRIBE = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per group."""
    v = F.col(value)
    moments = df.groupBy(*by).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    middle = channel_quantiles(df, by, [value], DESCRIBE).drop("channel")
    if by:
        return moments.join(middle, list(by), "left")
    row = middle.select(F.struct(*DESCRIBE).alias("_m")).scalar()
    return moments.select("*", row.alias("_m")).select(*moments.columns, "_m.*")


def correlations(df: DataFrame, channels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair of channels over rows where both are finite, both orientations.

    Few channels become one native aggregate. Many go through product sums, made a group at a time in each
    task and added up per group and pair. Groups of few rows are brought together first, as their rows are
    smaller than their sums; others stay where they are, and only their sums move.
    """
    pairs = list(combinations(channels, 2))
    if len(pairs) <= WIDE_PAIRS:
        row = df.groupBy(*by).agg(*[pearson(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
        cells = [
            F.struct(F.lit(x).alias("channel_a"), F.lit(y).alias("channel_b"), F.col(f"_{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
            for x, y in ((a, b), (b, a))
        ]
        return row.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")
    return _product_sum_correlations(df, list(channels), list(by))


SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
CONSTANT = 1e-13


def _product_sum_correlations(df: DataFrame, channels: list[str], by: list[str]) -> DataFrame:
    values = df.select(*by, *[finite(F.col(c)).alias(c) for c in channels])
    # Centring on the overall means, one number per channel, keeps the products small.
    means = values.agg(*[F.avg(c).alias(c) for c in channels]).first()
    centre = np.array([0.0 if m is None else m for m in means])
    packed = values.select(*by, F.array(*channels).alias("_v"))
    if by:
        sizes = stored(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")), "group-sizes")
        rows, groups = sizes.agg(F.sum("_rows"), F.count(F.lit(1))).first()
        if groups and rows / groups < len(SUMS) * len(channels):
            limit = hot_row_limit(df)
            hot = sizes.where(F.col("_rows") > limit).select(*by, F.ceil(F.col("_rows") / F.lit(float(limit))).alias("_parts"))
            hot = stored(hot, "hot-groups")
            spread = F.coalesce(F.pmod(F.xxhash64("_v"), F.col("_parts")), F.lit(0))
            packed = _attach(packed, hot, by, ["_parts"]).repartition(*by, spread).drop("_parts")
        packed = packed.sortWithinPartitions(*by)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields if f.name != "_v"]
    schema = ", ".join([*kinds, "i int", "j int", *[f"{n} double" for n in SUMS]])
    sums = packed.mapInArrow(_product_sums(by, centre), schema)
    added = sums.groupBy(*by, "i", "j").agg(*[F.sum(n).alias(n) for n in SUMS])
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in SUMS)
    # What rounding leaves of a constant channel's spread is none.
    x, y = n * sxx - sx * sx, n * syy - sy * sy
    varies = (x > CONSTANT * n * sxx) & (y > CONSTANT * n * syy)
    r = F.try_divide(n * sxy - sx * sy, F.sqrt(F.when(varies, x * y)))
    label = F.array(*[F.lit(c) for c in channels])
    a, b = F.get(label, F.col("i")), F.get(label, F.col("j"))
    both = [F.struct(x.alias("channel_a"), y.alias("channel_b"), F.col("_r").alias("r")) for x, y in ((a, b), (b, a))]
    return added.withColumn("_r", r).select(*by, F.explode(F.array(*both)).alias("_c")).select(*by, "_c.*")


def _product_sums(by: list[str], centre: np.ndarray):
    """Sums over all pairs of channels i < j, for each run of rows of one group; a task holds one group's sums."""
    i, j = np.triu_indices(len(centre), 1)

    def sums(batches):
        group, total, kinds = None, None, None

        def done():
            columns = [pa.array([k] * len(i), t) for k, t in zip(group, kinds, strict=True)]
            columns += [pa.array(i.astype("int32")), pa.array(j.astype("int32")), *[pa.array(t[i, j]) for t in total]]
            return pa.RecordBatch.from_arrays(columns, [*by, "i", "j", *SUMS])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(k).type for k in by]
            keys = list(zip(*[batch.column(k).to_pylist() for k in by], strict=True)) if by else [()] * batch.num_rows
            flat = batch.column("_v").flatten().to_numpy(zero_copy_only=False).astype("float64")
            x = flat.reshape(batch.num_rows, -1) - centre
            starts = [0, *[n for n in range(1, len(keys)) if keys[n] != keys[n - 1]], len(keys)]
            for a, b in zip(starts, starts[1:], strict=False):
                if group is not None and keys[a] != group:
                    yield done()
                    total = None
                group = keys[a]
                part = _gram(x[a:b])
                total = part if total is None else total + part
        if total is not None:
            yield done()

    return sums


def _gram(x: np.ndarray) -> np.ndarray:
    known = (~np.isnan(x)).astype("float64")
    x = np.nan_to_num(x)
    square = x * x
    return np.stack([known.T @ known, x.T @ known, known.T @ x, square.T @ known, known.T @ square, x.T @ x])


def strong_pairs(corr: DataFrame, least: float = 0.8) -> DataFrame:
    size = F.abs(F.col("r"))
    return corr.where((size >= least) & (size < 1))


def mode_of(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties; counts are made before groups meet."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias(name))


def cross_tab(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Counts of `row` by `col`, one column per listed value, 0 where a pair never occurs."""
    counts = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return counts.fillna(0)


def low_cardinality(df: DataFrame, columns: Sequence[str], at_most: int = 3) -> DataFrame:
    """String columns with few distinct values. Distinct (column, value) pairs are found before counting."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    pairs = df.select(F.explode(cells).alias("_p")).select("_p.*").where(F.col("value").isNotNull()).distinct()
    return pairs.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values")).where(F.col("distinct_values") <= at_most)
