"""User functions over sequences and windows.

A function never gets a whole unbounded group: it sees a chunk with the rows its edge needs, one window,
or partial results that Spark then merges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqweft.operators.ordered import salted_join

MERGES = {"sum": F.sum, "min": F.min, "max": F.max}
BLOCK = 2048  # positions that move together, rounded up to whole chunks; more where chunks see more of their neighbours
SEEN = 1 << 16  # rows that chunks see, copied for some of them at a time; one chunk may see more


def apply_in_chunks(
    df: DataFrame,
    keys: Sequence[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame] | Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]],
    schema: str,
    span: int = 4096,
    before: int = 0,
    after: int = 0,
    pos: str = "pos",
    arrays: bool = False,
) -> DataFrame:
    """Runs `fn` per sequence chunk of `span` positions, in order.

    The frame also holds the `before` rows ahead of the chunk and the `after` rows behind it, from as many
    chunks as these reach over; the boolean column `own` tells the chunk's own rows, and `fn` returns rows
    for these only. With `arrays` it takes and returns columns as a dict of arrays, not as a frame: for
    short chunks, where making frames costs more than the function does.

    Rows move in blocks of many chunks and are copied only near a block's edge; each task reads its sorted blocks
    as a stream and cuts the chunks from them. So a row doesn't move once per chunk that sees it, and a chunk
    isn't a group of its own to Spark.
    """
    size = span * -(-max(BLOCK, before + after) // span)
    first = F.greatest(F.floor((F.col(pos) - after) / size), F.lit(0).cast("long"))
    last = F.floor((F.col(pos) + before) / size)
    spread = df.select("*", F.explode(F.sequence(first, last)).alias("_block"))
    # an explicit number keeps small inputs spread: the function's cost, not the bytes, sets the time
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = Window.partitionBy(*keys, "_block").orderBy(pos)
    ranked = spread.repartition(tasks, *keys, "_block").withColumn("_at", F.row_number().over(inside))
    # pandas has other types for whole numbers and booleans with nulls: a chunk takes them for its own nulls only
    nullable = {f.name: f.dataType for f in df.schema.fields if f.nullable and f.name != pos}
    whole = {c: "float64" for c, t in nullable.items() if isinstance(t, T.IntegralType)}
    loose = whole | {c: "object" for c, t in nullable.items() if isinstance(t, T.BooleanType)}
    filled = [F.coalesce(c, F.lit(0).cast(nullable[c])).alias(c) if c in loose else F.col(c) for c in df.columns]
    marks = [F.col(c).isNull().alias(f"_null_{c}") for c in loose]
    columns = list(df.columns)

    def cut(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, dict[str, np.ndarray]]]:
        """What the chunks of whole blocks see, one after another, with the edges between them and the nulls."""
        block = np.cumsum(rows["_at"].to_numpy() == 1) - 1
        offset = rows[pos].to_numpy() - rows["_block"].to_numpy() * size
        line = block * (before + size + after) + offset  # ascending through all blocks
        own = np.flatnonzero((offset >= 0) & (offset < size))
        chunk = block[own] * (size // span) + offset[own] // span
        begin = own[np.diff(chunk, prepend=-1) != 0]
        start = line[begin] - offset[begin] % span
        end, low, high = (np.searchsorted(line, start + by) for by in (span, -before, span + after))
        total = np.cumsum(high - low)
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(total, SEEN + (total[i - 1] if i else 0), "right")))
            sizes = (high - low)[i:j]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            take = np.arange(edges[-1]) + np.repeat(low[i:j] - edges[:-1], sizes)
            seen = rows[columns].take(take)
            seen["own"] = (take >= np.repeat(begin[i:j], sizes)) & (take < np.repeat(end[i:j], sizes))
            nulls = {c: rows[f"_null_{c}"].to_numpy()[take] for c in loose}
            yield seen, edges, {c: gone for c, gone in nulls.items() if gone.any()}
            i = j

    def results(blocks: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for seen, edges, nulls in cut(pd.concat(blocks, ignore_index=True)):
            values = {c: seen[c].to_numpy() for c in seen} if arrays else {}
            alike = {}  # put together only where types are equal, as else one chunk's would change another's values
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if arrays:
                    part = {c: v[a:b] for c, v in values.items()}
                else:
                    part = seen.iloc[a:b].copy(deep=False)
                    part.index = pd.RangeIndex(b - a)
                for c, gone in nulls.items():
                    if gone[a:b].any():
                        known = np.array(part[c], dtype=loose[c])
                        known[gone[a:b]] = None
                        part[c] = known
                out = fn(part)
                if len(out):
                    alike.setdefault(tuple((c, v.dtype) for c, v in out.items()), []).append(out)
            for outs in alike.values():
                if arrays:
                    yield pd.DataFrame({c: np.concatenate([out[c] for out in outs]) for c in outs[0]})
                else:
                    yield pd.concat(outs, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            begun = np.flatnonzero(batch["_at"].to_numpy() == 1)
            if len(begun):
                yield from results([*held, batch.iloc[: begun[-1]]])
                batch, held = batch.iloc[begun[-1] :], []
            held.append(batch)
        if held:
            yield from results(held)

    return ranked.select(*filled, "_block", "_at", *marks).mapInPandas(run, schema)


def aggregate_in_parts(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merges: dict[str, str],
    schema: str,
) -> DataFrame:
    """User aggregate: `partial` reduces each Arrow batch to one row per key with the `merges` columns,
    which are then added up or compared by Spark. `schema` covers keys and those columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield partial(batch)

    parts = df.mapInPandas(run, schema)
    return parts.groupBy(*keys).agg(*[MERGES[how](c).alias(c) for c, how in merges.items()])


def window_vector(windows: DataFrame, channel: str, fn: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """Adds the vector `fn` makes of each window's values."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def udf(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: np.asarray(fn(np.asarray(a, dtype="float64")), dtype="float64"))

    return windows.withColumn(name, udf(F.col(channel)))


def predict_sequences(
    windows: DataFrame,
    attributes: DataFrame,
    on: Sequence[str],
    key: Sequence[str],
    make_predict: Callable[[], Callable[[pd.DataFrame], pd.Series]],
    salt: Sequence[str] = ("start_idx",),
    name: str = "label",
) -> DataFrame:
    """A label per sequence by a user's predictor: windows with their attributes go through it batch by
    batch, and each sequence takes its most frequent label, the smallest on ties.

    `make_predict` runs once per task, so that a model is loaded once and not per batch.
    """
    joined = salted_join(windows, attributes, on, salt)
    schema = T.StructType([windows.schema[k] for k in key] + [T.StructField(name, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for batch in batches:
            if len(batch):
                yield batch[list(key)].assign(**{name: predict(batch).astype(str)})

    votes = joined.mapInPandas(run, schema).groupBy(*key, name).agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(*key).agg(F.min_by(name, F.struct(-F.col("_n"), name)).alias(name))
