"""Exact quantiles of several channels at once, by key.

The values of a key with few rows are gathered in one sorted array for each channel. A key with many rows
is read twice: the first scan makes a mergeable sketch of each channel, which brackets every wanted quantile;
the second counts what lies below each bracket and keeps only the values inside. The counts are exact, so
the values found are the quantiles themselves, and a bracket that should miss its quantile is noticed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.operators.ordered import _attach, exact_quantiles, hot_row_limit, stored, with_positions

#: Values of all channels of a key that are gathered; a key with more is bracketed.
GATHERED = 1 << 20
#: Size of a sketch, and by what share of the rows a bracket reaches beyond the sketch's own guess: three times
#: the error that the sketch has with 99 % probability.
SKETCH = 2000
MARGIN = 0.0043
#: More channels than this are numbered and go one below the other.
WIDE = 16

Extra = dict[str, Callable[[Column], Column]]


def channel_quantiles(
    df: DataFrame, keys: Sequence[str], channels: Sequence[str], probs: dict[str, float], extra: Extra | None = None
) -> DataFrame:
    """(keys, channel, extra aggregates, quantiles): one row for each key and channel.

    Quantiles are interpolated linearly; nulls don't count, NaN is the largest value, and a channel without
    a value has nulls. `extra` names further aggregates of a channel's values, made in the same scan.
    """
    keys, channels, extra = list(keys), list(channels), extra or {}
    limit = min(hot_row_limit(df), GATHERED // max(1, len(channels)))
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in channels])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    crowded = stored(counts, "crowded-keys")
    if crowded.isEmpty():
        return gathered(rows, keys, channels, probs, extra)
    if not keys:
        return bracketed(rows, keys, channels, probs, extra)
    marked = _attach(rows, crowded, keys, ["_rows"])
    few, many = (marked.where(c).drop("_rows") for c in ("_rows IS NULL", "_rows IS NOT NULL"))
    return gathered(few, keys, channels, probs, extra).unionByName(bracketed(many, keys, channels, probs, extra))


def _numbered(rows: DataFrame, keys: list[str], channels: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """The rows, their keys and value columns; with many channels one row for each channel's number and value."""
    if len(channels) <= WIDE:
        return rows, keys, channels
    return rows.select(*keys, F.posexplode(F.array(*channels)).alias("_channel", "_value")), [*keys, "_channel"], ["_value"]


def _by_channel(df: DataFrame, keys: list[str], channels: list[str], cells: list[Column], names: list[str]) -> DataFrame:
    """One row for each key and channel from a row per key, or per key and channel number, with structs of `names`."""
    if len(channels) > WIDE:
        name = F.element_at(F.array(*map(F.lit, channels)), F.col("_channel") + 1)
        return df.select(*keys, name.alias("channel"), cells[0].alias("_c")).select(*keys, "channel", *[F.col(f"_c.{n}") for n in names])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), cell.alias("c")) for c, cell in zip(channels, cells, strict=True)]))
    return df.select(*keys, each.alias("_c")).select(*keys, "_c.channel", *[F.col(f"_c.c.{n}") for n in names])


def gathered(rows: DataFrame, keys: list[str], channels: list[str], probs: dict[str, float], extra: Extra) -> DataFrame:
    rows, by, values = _numbered(rows, keys, channels)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(values):
        aggs.append(F.sort_array(F.collect_list(c)).alias(f"_v{i}"))
    got = rows.groupBy(*by).agg(*aggs).where("_rows > 0")
    if extra:
        # By themselves, as plain sums run in generated code, and gathering does not.
        beside = {f"_e{i}_{n}": e(F.col(c)) for i, c in enumerate(values) for n, e in extra.items()}
        sums = rows.groupBy(*by).agg(*[e.alias(n) for n, e in beside.items()])
        got = _with(got, sums, by, list(beside)) if by else _attach(got, sums, [], list(beside))
    cells = []
    for i in range(len(values)):
        v = F.col(f"_v{i}")
        found = []
        for name, p in probs.items():
            target = F.lit(float(p)) * (F.size(v) - 1)
            lower = F.floor(target).cast("int")
            low = F.get(v, lower)
            high = F.coalesce(F.get(v, lower + 1), low)
            found.append(_along(low, high, target - lower).alias(name))
        cells.append(F.struct(*[F.col(f"_e{i}_{n}").alias(n) for n in extra], *found))
    return _by_channel(got, keys, channels, cells, [*extra, *probs])


def bracketed(rows: DataFrame, keys: list[str], channels: list[str], probs: dict[str, float], extra: Extra) -> DataFrame:
    names = list(probs)
    long, by, values = _numbered(rows, keys, channels)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(values):
        v = F.col(c)
        known = F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v)
        aggs += [F.kll_sketch_agg_double(known, F.lit(SKETCH)).alias(f"_s{i}"), F.count(v).alias(f"_n{i}")]
        aggs += [e(v).alias(f"_e{i}_{n}") for n, e in extra.items()]
    first = stored(long.groupBy(*by).agg(*aggs).where("_rows > 0"), "sketches")
    ends = [
        F.when(F.col(f"_n{i}") > 0, _ends(F.col(f"_s{i}"), p, F.col(f"_n{i}"))).alias(f"_b{i}_{j}") for i in range(len(values)) for j, p in enumerate(probs.values())
    ]
    brackets = [f"_b{i}_{j}" for i in range(len(values)) for j in range(len(probs))]
    held = _attach(long, first.select(*by, *ends), by, brackets)
    counted = []
    for i, c in enumerate(values):
        v, inside = F.col(c), F.lit(False)
        for j in range(len(probs)):
            low, high = F.col(f"_b{i}_{j}")["low"], F.col(f"_b{i}_{j}")["high"]
            counted += [
                F.count_if(v < low).alias(f"_below{i}_{j}"), F.count_if(v == low).alias(f"_low{i}_{j}"),
                F.count_if((v == high) & (high > low)).alias(f"_high{i}_{j}"), F.first(f"_b{i}_{j}").alias(f"_b{i}_{j}"),
            ]
            inside = inside | ((v > low) & (v < high))
        counted.append(F.collect_list(F.when(inside, v)).alias(f"_in{i}"))
    # A group stays inside one partition, so no list is longer than a task's own rows and nothing but the inside leaves it.
    second = held.groupBy(*by, F.spark_partition_id().alias("_part")).agg(*counted)
    pieces = []
    for i in range(len(values)):
        for j in range(len(probs)):
            end = F.col(f"_b{i}_{j}")
            within = F.filter(F.col(f"_in{i}"), _between(end["low"], end["high"]))
            pieces.append(
                F.struct(
                    F.lit(i).alias("i"), F.lit(j).alias("j"), end["n"].alias("n"), end["low"].alias("low"), end["high"].alias("high"),
                    F.col(f"_below{i}_{j}").alias("below"), F.col(f"_low{i}_{j}").alias("at_low"), F.col(f"_high{i}_{j}").alias("at_high"),
                    within.alias("within"),
                )
            )
    parts = stored(second.select(*by, F.explode(F.array(*pieces)).alias("_p")).select(*by, "_p.*"), "brackets")
    group = [*by, "i", "j"]
    share = F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("j") + 1)
    most = parts.groupBy(*group).agg(F.sum(F.size("within")).alias("s")).agg(F.max("s")).first()[0]
    ends_of = (_sorted_ends if (most or 0) <= GATHERED else _ranked_ends)(parts, group, share * (F.col("n") - 1))
    value = _along(F.col("_a"), F.coalesce("_b", "_a"), F.col("_target") - F.floor("_target"))
    last = (F.floor("_target") + 1 >= F.col("n")) | (F.col("_target") == F.floor("_target"))
    sound = F.col("n").isNull() | (F.col("_a").isNotNull() & (F.col("_b").isNotNull() | last))
    found = ends_of.select(*group, value.alias("_q"), sound.alias("_sound"))
    short = found.groupBy(*by, "i").agg(
        F.bool_and("_sound").alias("_sound"), *[F.max(F.when(F.col("j") == j, F.col("_q"))).alias(n) for j, n in enumerate(names)]
    )
    named = F.element_at(F.array(*map(F.lit, channels)), (F.col("_channel") if len(channels) > WIDE else F.col("i")) + 1)
    short = stored(short.select(*keys, named.alias("channel"), "_sound", *names), "quantiles")
    missed = short.where("NOT _sound").select(*keys, "channel")
    if not missed.isEmpty():
        again = rows.unpivot(keys, channels, "channel", "value")
        again = exact_quantiles(_matching(again, missed, [*keys, "channel"]), [*keys, "channel"], "value", probs)
        short = short.where("_sound").drop("_sound").unionByName(again)
    structs = [F.struct(F.col(f"_n{i}").alias("_n"), *[F.col(f"_e{i}_{n}").alias(n) for n in extra]) for i in range(len(values))]
    every = _by_channel(first, keys, channels, structs, list(extra))
    return _with(every, short.drop("_sound") if "_sound" in short.columns else short, [*keys, "channel"], names)


def _sorted_ends(parts: DataFrame, group: list[str], target: Column) -> DataFrame:
    """The two values around each target rank, from a bracket's values in one array."""
    once = [F.first(c).alias(c) for c in ("n", "low", "high")]
    counts = [F.sum(c).alias(c) for c in ("below", "at_low", "at_high")]
    got = parts.groupBy(*group).agg(*once, *counts, F.sort_array(F.flatten(F.collect_list("within"))).alias("_w"))
    got = got.withColumn("_target", target)

    def at(rank: Column) -> Column:
        place, inside = rank - F.col("below") - F.col("at_low"), F.size("_w")
        high = F.when((place >= inside) & (place < inside + F.col("at_high")), F.col("high"))
        within = F.when((place >= 0) & (place < inside), F.get("_w", F.least(place, F.lit((1 << 31) - 1)).cast("int")))
        return F.coalesce(F.when((rank >= F.col("below")) & (place < 0), F.col("low")), within, high)

    lower = F.floor("_target").cast("long")
    return got.select(*group, "n", "_target", at(lower).alias("_a"), at(lower + 1).alias("_b"))


def _ranked_ends(parts: DataFrame, group: list[str], target: Column) -> DataFrame:
    """The same where a bracket holds more values than one row should: they are counted and ranked."""
    cells = F.array(F.struct(F.col("low").alias("v"), F.col("at_low").alias("c")), F.struct(F.col("high").alias("v"), F.col("at_high").alias("c")))
    edges = parts.select(*group, F.explode(cells).alias("_x")).select(*group, "_x.v", "_x.c").where("c > 0")
    inner = parts.select(*group, F.explode("within").alias("v"), F.lit(1).cast("long").alias("c"))
    tallied = edges.unionByName(inner).groupBy(*group, "v").agg(F.sum("c").alias("_c"))
    ranked = with_positions(tallied, group, ["v"], pos="_from", weight="_c")
    sizes = stored(parts.groupBy(*group).agg(F.first("n").alias("n"), F.sum("below").alias("below")).withColumn("_target", target), "targets")
    hits = _attach(ranked, sizes, group, ["n", "below", "_target"])
    place, lower = F.col("below") + F.col("_from"), F.floor("_target").cast("long")
    at = lambda r: F.max(F.when((place <= r) & (r < place + F.col("_c")), F.col("v")))
    return hits.groupBy(*group).agg(at(lower).alias("_a"), at(lower + 1).alias("_b"), F.first("n").alias("n"), F.first("_target").alias("_target"))


def _ends(sketch: Column, p: float, n: Column) -> Column:
    """Values between which the quantile lies, by the sketch's guess and its error; all of them where there are few."""
    low, high = p - MARGIN, p + MARGIN
    least, most = F.lit(float("-inf")), F.lit(float("inf"))
    at = lambda q: F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))
    many = n > 4 * SKETCH
    return F.struct(
        (F.when(many, at(low)).otherwise(least) if low > 0 else least).alias("low"),
        (F.when(many, at(high)).otherwise(most) if high < 1 else most).alias("high"),
        n.alias("n"),
    )


def _along(low: Column, high: Column, share: Column) -> Column:
    """The point that lies a share of the way from one value to the next, which may be infinite."""
    return F.when(share == 0, low).otherwise(low + (high - low) * share)


def _between(low: Column, high: Column) -> Callable[[Column], Column]:
    return lambda x: (x > low) & (x < high)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _matching(df: DataFrame, some: DataFrame, on: list[str]) -> DataFrame:
    named = some.select(*[F.col(c).alias(f"_k_{c}") for c in on])
    return df.join(named, _all([F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on]), "left_semi")


def _with(df: DataFrame, more: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    renamed = more.select(*[F.col(c).alias(f"_k_{c}") for c in on], *names)
    joined = df.join(renamed, _all([F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on]), "left")
    return joined.select(*df.columns, *names)
