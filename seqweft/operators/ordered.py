"""Order-dependent primitives that never put a whole sequence into one task.

A key that holds a large share of the rows is cut into consecutive slices of its order, each slice
is ranked on its own, and the slices' totals, a small table, give the offsets. All other keys form
one slice. The positions so found are exact; slices only decide where the work is done.

Later look-ups along the sequence (neighbours, fills, means, chunks) keep the same slices, so they run
on the shuffle that ranked the rows. Values cross slice borders through a table with one row per slice.
Ordinary keys have slice 0 and hot keys count from 1, so that `_slice1 > 0` reaches the scan through the
windows. Whether any key is hot is asked up front by one aggregate over the key columns; if none is, the
plan has no slices at all and is a plain window per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqweft.session import scratch_path

HOT_ROWS = 1 << 20  # a key with more rows than this is sliced; setting spark.seqweft.hotRows overrides it
HOT_CELLS = 1 << 24  # of wide tables fewer rows make a key hot, so that a slice stays of a size in memory
HOT_KEYS = 1 << 16  # up to so many hot keys their bounds are broadcast; more are joined without a hint
LARGEST = 8e307  # stands for infinity, so that the width of a range stays finite

SLICES = ["_slice1", "_slice2", "_slice3", "_slice4"]  # rounds of slicing; most data need one or two
IS_HOT = f"{SLICES[0]} > 0"


def ordinals(df: DataFrame, name: str) -> list[Column]:
    """Doubles that follow the order of the column: each decides only where all before it are equal.

    Null stays null, which a sort puts first. Infinities are the largest finite values and NaN comes after
    them, as in a sort. Empty for types that have no such doubles, such as arrays.
    """
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.LongType):
        # a double has 53 bits, so neighbouring large numbers need both halves
        return [F.shiftright(col, 32).cast("double"), col.bitwiseAND(F.lit((1 << 32) - 1)).cast("double")]
    if isinstance(kind, T.FractionalType):
        value = col.cast("double")
        inside = F.greatest(F.least(value, F.lit(LARGEST)), F.lit(-LARGEST))
        return [F.when(F.isnan(value), F.lit(1.1 * LARGEST)).when(value.isNotNull(), inside)]
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return [col.cast("double")]
    if isinstance(kind, T.DateType):
        return [F.unix_date(col).cast("double")]
    if isinstance(kind, T.TimestampNTZType):
        # read off the fields: a cast to a zoned timestamp would not be monotone at clock changes
        seconds = F.hour(col) * 3600 + F.minute(col) * 60 + F.date_part(F.lit("SECOND"), col).cast("double")
        return [(F.unix_date(col.cast("date")) * F.lit(86400.0) + seconds).cast("double")]
    if isinstance(kind, T.TimestampType):
        return [F.unix_micros(col).cast("double")]
    if isinstance(kind, T.StringType):
        # six bytes at a time, as names often share a long prefix
        raw = col.cast("binary")
        parts = [F.rpad(F.hex(F.substring(raw, at, 6)), 12, "0") for at in (1, 7, 13, 19)]
        return [F.conv(p, 16, 10).cast("double") for p in parts]
    return []


def hot_row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.seqweft.hotRows", str(min(HOT_ROWS, HOT_CELLS // max(1, len(df.columns))))))


def has_hot_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """Runs one count per key (map-side combined, key columns only) and fetches at most one row."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return not counts.where(F.col("_rows") > hot_row_limit(df)).isEmpty()


def slice_columns(df: DataFrame) -> list[str]:
    return [s for s in SLICES if s in df.columns]


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join of a stored table, broadcast if its count allows; without keys it has at most one row and
    becomes a scalar subquery. Keys match null to null, as grouping does."""
    if keys:
        hinted = F.broadcast(small) if small.count() <= HOT_KEYS else small
        named = hinted.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *cols)
        same = all_of([F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        return df.join(named, same, "left").drop(*[f"_k_{k}" for k in keys])
    row = small.select(F.struct(*cols)).scalar()
    return df.select("*", row.alias("_row")).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in cols])


def _by_slice(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join with a table of one row per slice; a null key is a key like any other."""
    named = small.withColumnsRenamed({k: f"_k_{k}" for k in by})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) if k not in SLICES and df.schema[k].nullable else F.col(k) == F.col(f"_k_{k}") for k in by]
    return df.join(named, all_of(same), "left").drop(*[f"_k_{k}" for k in by])


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: a cut in the lineage that outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def slice_hot_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds the slice columns: 0 where nothing is cut, else slice numbers from 1 that follow the order.

    A hot key is cut by equal width over its own range; slices still too full, as skewed orders leave
    them, are cut again in the next round. Each cut uses the first order column that varies inside the
    group, so long ties are cut by the next column; of strings, the first six bytes that vary. Nulls come
    first, as in a sort. Bounds come from exact minima and maxima, so a recomputed task finds the same slices.
    """
    hot_rows = hot_row_limit(df)
    scales = [s for o in order for s in ordinals(df, o)]
    ends = (("lo", F.min), ("hi", F.max), ("known", F.count))
    bounds = [f(s).alias(f"_{end}{i}") for i, s in enumerate(scales) for end, f in ends]
    names = [f"_{end}{i}" for i in range(len(scales)) for end, _ in ends]
    by, finished = list(keys), False
    for level in SLICES:
        if not finished:
            source = df if level == SLICES[0] else df.where(F.col(by[-1]) > 0)
            crowded = source.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *bounds).where(F.col("_rows") > hot_rows)
            parts = F.ceil(F.col("_rows") / F.lit(float(hot_rows))).cast("double").alias("_parts")
            hot = stored(crowded.select(*by, "_rows", parts, *names), "hot-keys")
            finished = hot.isEmpty()
        if finished:
            df = df.withColumn(level, F.lit(0).cast("long"))
            continue
        columns = df.columns
        joined = _attach(df, hot, by, ["_rows", "_parts", *names])
        number = F.lit(1)
        for i, s in reversed(list(enumerate(scales))):
            width = F.col(f"_hi{i}") - F.col(f"_lo{i}")
            part = F.floor((s - F.col(f"_lo{i}")) / F.nullif(width, F.lit(0.0)) * F.col("_parts")) + 1
            known = F.col(f"_known{i}")
            spread = F.when(s.isNull(), F.lit(1)).otherwise(F.least(part, F.col("_parts").cast("long")))
            # nulls and one value: the nulls come before it, and neither is cut further by this column
            split = F.when(s.isNull(), F.lit(1)).otherwise(F.lit(2))
            number = F.when(width > 0, spread).when((known > 0) & (known < F.col("_rows")), split).otherwise(number)
        cut = F.when(F.col("_parts").isNotNull(), number).otherwise(F.lit(0)).cast("long")
        df = joined.select(*columns, cut.alias(level))
        by = by + [level]
    return df


def _slice_frames(keys: Sequence[str]):
    """Windows over the slices of a key: all, those before and those after the current one."""
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(*SLICES).rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy(*[F.desc(s) for s in SLICES]).rowsBetween(Window.unboundedPreceding, -1)
    return whole, before, after


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    pos: str = "pos",
    length: str | None = None,
    weight: str | None = None,
    hot: bool | None = None,
    keep_slices: bool = False,
) -> DataFrame:
    """0-based position of each row in its key's order; `length` also adds the key's row count.

    With `weight` the position is the sum of the weights before the row and `length` their total. The
    order must be total (end it with a unique column); nulls come first. `keep_slices` leaves the slice
    columns in, as the look-ups below need them. `hot` says whether to slice; by default the input is asked.
    """
    keys, order = list(keys), list(order)
    unit = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    hot = has_hot_key(df, keys) if hot is None else hot
    sliced = slice_hot_keys(df, keys, order) if hot else df
    by = keys + slice_columns(sliced)
    inside = Window.partitionBy(*by)
    ordered = inside.orderBy(*order)
    if weight is None:
        rank = F.row_number().over(ordered).cast("long") - 1
    else:
        rank = F.sum(unit).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - unit
    total = F.sum(unit).over(inside) if weight else F.count(F.lit(1)).over(inside)
    if not hot:
        lengths = [total.alias(length)] if length else []
        return df.select("*", rank.alias(pos), *lengths)
    out = sliced.withColumn("_rank", rank)
    if length:
        out = out.withColumn("_size", total)
    whole, before, _ = _slice_frames(keys)
    totals = sliced.where(IS_HOT).groupBy(*by).agg(F.sum(unit).alias("_inside"))
    offsets = totals.select(
        *by,
        F.coalesce(F.sum("_inside").over(before), F.lit(0)).alias("_offset"),
        F.sum("_inside").over(whole).alias("_total"),
    )
    out = _by_slice(out, offsets, by)
    cols = [*df.columns, (F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_rank")).cast("long").alias(pos)]
    if length:
        cols.append(F.coalesce(F.col("_total"), F.col("_size")).cast("long").alias(length))
    if not keep_slices:
        return out.select(*cols)
    # look-ups read these rows once more per branch for hot keys, so they are written once instead
    return stored(out.select(*cols, *SLICES), "positions")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    hot: bool | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per key, one column per entry of `probs`.

    Rows are first reduced to (key, value, count), then ranked by cumulative count, so neither a hot key
    nor a hot value is held in one task's memory (the built-in `percentile` keeps all values of a group).
    """
    keys = list(keys)
    known = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    hot = has_hot_key(known, keys) if hot is None else hot  # rows bound the distinct values
    ranked = with_positions(counts, keys, ["_v"], pos="_from", length="_n", weight="_c", hot=hot)
    aggs, final = [], []
    for i, (name, p) in enumerate(probs.items()):
        target = F.lit(float(p)) * (F.col("_n") - 1)
        lower = F.floor(target).cast("long")
        at = {"a": lower, "b": lower + 1}
        for tag, rank in at.items():
            hit = (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_c"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}{i}"))
        aggs.append(F.max(target - lower).alias(f"_f{i}"))
        low, high = F.col(f"_a{i}"), F.coalesce(F.col(f"_b{i}"), F.col(f"_a{i}"))
        share = F.col(f"_f{i}")
        final.append(F.when(share == 0, low).otherwise(low + (high - low) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *final)


# ---- look-ups along a sequence -------------------------------------------------------------------
# They take readings made by `with_positions(..., keep_slices=True)`. `order` names the columns that ranked
# them, if they are still there unchanged: the ranking's sort then serves the look-up as well.


def _row_order(df: DataFrame, pos: str, order: Sequence[str] | None) -> list[str]:
    return list(order) if order and not slice_columns(df) else [pos]


def nearest_known(
    df: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    pos: str = "pos",
    strict: bool = False,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Adds `_prev_<c>` and `_next_<c>`: struct(v, at) of the nearest non-null reading on each side.

    The row itself counts unless `strict`. Both sides of all channels come from one pass over one sort.
    """
    by = [*keys, *slice_columns(df)]
    marked = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(pos).alias("at"))) for c in channels}
    rows = _row_order(df, pos, order)
    back = Window.partitionBy(*by).orderBy(*rows).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    # lead over known values is linear, while a frame that runs to the end of the partition is quadratic
    group, sort = (", ".join(f"`{c}`" for c in cols) for cols in (by, rows))
    ahead = {
        c: F.expr(f"lead(`_known_{c}`) IGNORE NULLS OVER (PARTITION BY {group} ORDER BY {sort})") for c in channels
    }
    columns = df.columns
    out = df.withColumns({f"_known_{c}": marked[c] for c in channels}).withColumns(
        {f"_prev_{c}": F.last(f"_known_{c}", ignorenulls=True).over(back) for c in channels}
        | {f"_next_{c}": ahead[c] if strict else F.coalesce(f"_known_{c}", ahead[c]) for c in channels}
    )
    out = out.drop(*[f"_known_{c}" for c in channels])
    if not slice_columns(df):
        return out
    place = {c: F.when(F.col(c).isNotNull(), F.col(pos)) for c in channels}
    edges = (
        df.where(IS_HOT)
        .groupBy(*by)
        .agg(
            *[F.max_by(marked[c], place[c]).alias(f"_last_{c}") for c in channels],
            *[F.min_by(marked[c], place[c]).alias(f"_first_{c}") for c in channels],
        )
    )
    _, before, after = _slice_frames(keys)
    carried = edges.select(
        *by,
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_before_{c}") for c in channels],
        *[F.last(f"_first_{c}", ignorenulls=True).over(after).alias(f"_after_{c}") for c in channels],
    )
    return _by_slice(out, carried, by).select(
        *columns,
        *[F.coalesce(f"_prev_{c}", f"_before_{c}").alias(f"_prev_{c}") for c in channels],
        *[F.coalesce(f"_next_{c}", f"_after_{c}").alias(f"_next_{c}") for c in channels],
    )


def with_lag(
    df: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    pos: str = "pos",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Adds `_lag_<c>`, the value one row earlier; a slice's first row reads the last row of the one before."""
    by = [*keys, *slice_columns(df)]
    rows = Window.partitionBy(*by).orderBy(*_row_order(df, pos, order))
    columns = df.columns
    out = df.withColumns({f"_lag_{c}": F.lag(c).over(rows) for c in channels})
    if not slice_columns(df):
        return out
    edges = (
        df.where(IS_HOT)
        .groupBy(*by)
        .agg(F.min(pos).alias("_start"), F.max_by(F.struct(*channels), pos).alias("_last"))
    )
    slices = Window.partitionBy(*keys).orderBy(*SLICES)
    carried = edges.select(*by, "_start", F.lag("_last").over(slices).alias("_edge"))
    first = F.coalesce(F.col(pos) == F.col("_start"), F.lit(False))
    return _by_slice(out, carried, by).select(
        *columns,
        *[F.when(first, F.col("_edge")[c]).otherwise(F.col(f"_lag_{c}")).alias(f"_lag_{c}") for c in channels],
    )


def with_sequence_mean(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Adds `_mean_<c>`; the mean of a hot key is put together from its slices' sums and counts."""
    by = [*keys, *slice_columns(df)]
    inside = Window.partitionBy(*by)
    columns = df.columns
    out = df.withColumns({f"_mean_{c}": F.avg(c).over(inside) for c in channels})
    if not slice_columns(df):
        return out
    parts = (
        df.where(IS_HOT)
        .groupBy(*by)
        .agg(*[F.sum(c).alias(f"_s_{c}") for c in channels], *[F.count(c).alias(f"_n_{c}") for c in channels])
    )
    whole, _, _ = _slice_frames(keys)
    means = parts.select(
        *by,
        *[F.try_divide(F.sum(f"_s_{c}").over(whole), F.sum(f"_n_{c}").over(whole)).alias(f"_all_{c}") for c in channels],
    )
    return out.join(means, by, "left").select(
        *columns, *[F.coalesce(f"_all_{c}", f"_mean_{c}").alias(f"_mean_{c}") for c in channels]
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    how: str,
    name: str,
    hot: bool | None = None,
) -> DataFrame:
    """Running max or min along an order, exact for hot keys and for a table without keys."""
    combine = {"max": F.max, "min": F.min}[how]
    pick = {"max": F.greatest, "min": F.least}[how]
    hot = has_hot_key(df, keys) if hot is None else hot
    sliced = slice_hot_keys(df, keys, order) if hot else df
    by = [*keys, *slice_columns(sliced)]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.withColumn(name, combine(value).over(inside))
    if not hot:
        return out
    tops = sliced.where(IS_HOT).groupBy(*by).agg(combine(value).alias("_top"))
    _, before, _ = _slice_frames(keys)
    carried = tops.select(*by, combine("_top").over(before).alias("_carried"))
    return _by_slice(out, carried, by).select(*df.columns, pick(name, "_carried").alias(name))


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], salt: Sequence[str], how: str = "left", hot: bool | None = None
) -> DataFrame:
    """Join where a key may be hot on the left and is unique on the right.

    Without a hot key it is a plain join. Otherwise only hot keys are salted: their rows on the left are
    spread by a hash of the `salt` columns over as many tasks as their count asks for, and their rows on
    the right are repeated that often. No hint: Spark still broadcasts the right side if it is small.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(how)
    on = list(on)
    hot = has_hot_key(left, on) if hot is None else hot
    if not hot:
        return left.join(right, on, how)
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_row_limit(left))
    crowded = stored(counts.select(*on, F.ceil(F.col("_rows") / F.lit(float(hot_row_limit(left)))).alias("_salts")), "hot-keys")
    many = F.coalesce(F.col("_salts"), F.lit(1).cast("long"))
    spread = _attach(left, crowded, on, ["_salts"]).withColumn("_salt", F.pmod(F.xxhash64(*salt), many)).drop("_salts")
    copies = _attach(right, crowded, on, ["_salts"])
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("_salts")
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
