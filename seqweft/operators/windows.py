"""Fixed-length windows over sequences.

Readings are gathered into chunks of a bounded number of positions, each with the few rows of the next
chunk that its last windows reach into. Windows are cut from chunks, so no task holds a whole sequence,
and an ordinary key's chunks are built where its rows were ranked, without a further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.operators.ordered import IS_HOT, SLICES, salted_join, slice_columns, with_positions

# fixed values: window configurations (width, stride) and minimum lengths
CONFIGS = {"w64_s16": (64, 16), "w128_s32": (128, 32)}
MIN_LENGTH = 10
PADDING = 0.0


def with_first(df: DataFrame, keys: Sequence[str], cols: Sequence[str], pos: str = "pos") -> DataFrame:
    """Replaces the columns by the values on the sequence's first row.

    The frame is the whole partition, so no order is needed and the ranking's sort is not repeated.
    """
    if not cols:
        return df
    whole = Window.partitionBy(*keys, *slice_columns(df))
    out = df.withColumn("_first", F.min_by(F.struct(*cols), pos).over(whole))
    if slice_columns(df):
        # at most HOT_KEYS rows
        firsts = df.where(IS_HOT).where(F.col(pos) == 0).select(*keys, F.struct(*cols).alias("_hot_first"))
        out = out.join(F.broadcast(firsts), list(keys), "left")
        out = out.withColumn("_first", F.coalesce("_hot_first", "_first"))
    return out.select(*[F.col("_first")[c].alias(c) if c in cols else F.col(c) for c in df.columns])


def chunks(
    df: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    span: int,
    reach: int,
    constants: Sequence[str] = (),
    pos: str = "pos",
) -> DataFrame:
    """One row per (key, chunk) with `rows`, the chunk's readings in order and `reach` rows beyond.

    `constants` are columns with one value per key.
    """
    chunk = F.floor(F.col(pos) / span).cast("long")
    reading = F.struct(F.col(pos), *channels)

    def gather(part: DataFrame, by: list[str]) -> DataFrame:
        ids = F.array(F.col("_chunk"))
        if reach > 0:
            earlier = (F.col("_chunk") > 0) & (F.col(pos) % span < reach)
            ids = F.when(earlier, F.array("_chunk", F.col("_chunk") - 1)).otherwise(ids)
        spread = part.withColumn("_chunk", chunk).withColumn("_chunk", F.explode(ids))
        rows = F.sort_array(F.collect_list(reading)).alias("rows")
        got = spread.groupBy(*by, "_chunk").agg(rows, *[F.first(c).alias(c) for c in constants])
        return got.select(*keys, "_chunk", "rows", *constants)

    if not slice_columns(df):
        return gather(df, list(keys))
    cold = gather(df.where(~F.expr(IS_HOT)), [*keys, *SLICES])
    return cold.unionByName(gather(df.where(IS_HOT), list(keys)))


def sliding_windows(
    df: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    configs: dict[str, tuple[int, int]] | tuple[int, int],
    min_length: int = MIN_LENGTH,
    padding: float = PADDING,
    first_of: Sequence[str] = (),
    pos: str = "pos",
    length: str = "seq_len",
) -> DataFrame:
    """Windows of each configuration (width, stride), one row each, one array column per channel.

    Sequences below `min_length` are left out; one shorter than a width gives a single window padded on
    the right; rows after the last full window are dropped. `first_of` columns take the value of the
    sequence's first row. All configurations are cut from the same chunks.
    """
    named = isinstance(configs, dict)
    plan = configs if named else {"": configs}
    stride_step = lcm(*[s for _, s in plan.values()])
    widest = max(w for w, _ in plan.values())
    span = stride_step * -(-16 * widest // stride_step)
    reach = max(0, max(w - s for w, s in plan.values()))
    usable = with_first(df.where(F.col(length) >= min_length), keys, first_of, pos)
    got = chunks(usable, keys, channels, span, reach, [*first_of, length], pos)
    size = F.size("rows")

    def starts(width: int, stride: int) -> Column:
        last = F.least(F.lit(span - stride), size - width)
        full = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
        alone = F.when(F.col("_chunk") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.when(size >= width, full).otherwise(alone)

    def offer(name: str, width: int, stride: int) -> Column:
        return F.transform(
            starts(width, stride),
            lambda at: F.struct(F.lit(name).alias("config"), F.lit(width).alias("width"), at.alias("at")),
        )

    offers = F.flatten(F.array(*[offer(name, w, s) for name, (w, s) in plan.items()]))
    cut = got.select("*", F.explode(offers).alias("_w"))
    width, at = F.col("_w.width"), F.col("_w.at")
    cut = cut.select(
        *keys,
        *([F.col("_w.config").alias("window_config")] if named else []),
        (F.col("_chunk") * span + at).cast("long").alias("start_idx"),
        (F.col("_chunk") * span + at + width).cast("long").alias("end_idx"),
        (F.col(length) < width).alias("padded"),
        F.col(length).alias("original_length"),
        *first_of,
        width.alias("_width"),
        F.slice("rows", at + 1, width).alias("_part"),
    )
    fill = F.array_repeat(F.lit(float(padding)), F.col("_width") - F.size("_part"))
    kept = [c for c in cut.columns if c not in ("_width", "_part")]
    return cut.select(*kept, *[F.concat(F.col("_part")[c], fill).alias(c) for c in channels])


def edge_window(
    df: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    width: int,
    end: str,
    padding: float = PADDING,
    pos: str = "pos",
    length: str = "seq_len",
) -> DataFrame:
    """The first or last `width` readings of each sequence, padded on the right if it is shorter."""
    inside = {"first": F.col(pos) < width, "last": F.col(pos) >= F.col(length) - width}[end]
    got = df.where(inside).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, *channels))).alias("rows"))
    fill = F.array_repeat(F.lit(float(padding)), width - F.size("rows"))
    return got.select(*keys, *[F.concat(F.col("rows")[c], fill).alias(c) for c in channels])


def with_batches(
    windows: DataFrame, sequences: DataFrame, keys: Sequence[str], batch_size: int, start: str = "start_idx"
) -> DataFrame:
    """Adds `batch_id`: the sequences, one row each, numbered in key order, `batch_size` to a batch."""
    ranked = with_positions(sequences.select(*keys), [], keys, pos="_rank")
    numbered = ranked.select(*keys, F.floor(F.col("_rank") / batch_size).cast("long").alias("batch_id"))
    return salted_join(windows, numbered, keys, [start], "inner")


def window_count(length: Column, width: Column | int, stride: Column | int) -> Column:
    """How many unpadded windows a length gives."""
    width = width if isinstance(width, Column) else F.lit(width)
    stride = stride if isinstance(stride, Column) else F.lit(stride)
    return F.when(length >= width, F.floor((length - width) / stride) + 1).otherwise(0).cast("long")


def coverage_grid(lengths: DataFrame, grid: Sequence[tuple[int, int]], length: str = "seq_len") -> DataFrame:
    """For each (width, stride): windows, sequences long enough, their share, windows per such sequence."""
    cells = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(s).alias("stride")) for w, s in grid])
    # lengths are counted first, so the grid multiplies distinct lengths, not sequences
    counted = lengths.groupBy(length).agg(F.count(F.lit(1)).alias("_n"))
    crossed = counted.select("*", F.explode(cells).alias("_c")).select(length, "_n", "_c.*")
    n = F.col("_n")
    windows = window_count(F.col(length), F.col("width"), F.col("stride"))
    valid = F.sum(F.when(F.col(length) >= F.col("width"), n).otherwise(0))
    return crossed.groupBy("width", "stride").agg(
        F.sum(windows * n).alias("windows"),
        valid.alias("valid_sequences"),
        (valid * 100.0 / F.sum(n)).alias("coverage"),
        F.coalesce(F.try_divide(F.sum(windows * n), valid), F.lit(0.0)).alias("mean_windows"),
    )


def recommended(grid: DataFrame, min_coverage: float = 90.0) -> DataFrame:
    """The configuration with the most windows among those covering enough sequences."""
    good = grid.where(F.col("coverage") >= min_coverage)
    return good.orderBy(F.desc("windows"), "width", "stride").limit(1)
