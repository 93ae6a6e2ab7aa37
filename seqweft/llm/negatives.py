"""Hard negatives for contrastive training: rows of another label that score nearly as high as a positive.

Anchors and candidates meet in a grid of cells. A cell holds one block of anchors, which its task keeps as a
matrix, and one share of the candidates, which passes by in tiles; a tile's scores are a product by
Strassen's recursion. Each anchor keeps a heap of its best rows of the same label, and after these are
known, one heap for each positive of the best rows of other labels whose scores lie in the positive's
window. Heaps of different cells are merged by rank. No cell, heap or tile grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweft.llm.common import release_memory, stored
from seqweft.llm.heaps import HIGHEST, LOWEST, Heaps
from seqweft.llm.strassen import multiply

#: Anchors of a cell, and candidates of a tile.
BLOCK = 1024
TILE = 512
#: Candidates that are worth a cell of their own.
SHARE = 4096
ROW = ["label", "id", "mix"]


class Positives:
    """The first `k` other rows of each anchor's own label."""

    SCHEMA = "label long, id long, mix long, other long, score long"

    def __init__(self, anchors: dict, k: int) -> None:
        self.anchors, self.heaps = anchors, Heaps(len(anchors["id"]), k)

    def meet(self, tile: dict) -> None:
        own = self.anchors
        for label in np.intersect1d(own["label"], tile["label"]):
            rows, some = np.flatnonzero(own["label"] == label), np.flatnonzero(tile["label"] == label)
            scores = product(own["v"][rows], tile["v"][some])
            itself = (own["id"][rows][:, None] == tile["id"][some]) & (own["mix"][rows][:, None] == tile["mix"][some])
            self.heaps.offer(rows, scores, tile["id"][some], ~itself)

    def found(self) -> list[np.ndarray]:
        h = self.heaps
        return [*[self.anchors[c][h.row] for c in ROW], h.id, h.score]


class Windows:
    """For each anchor and positive the first `k` rows of other labels with a score in the positive's window."""

    SCHEMA = "label long, id long, mix long, place long, other long, score long"

    def __init__(self, anchors: dict, k: int, least: int, most: int) -> None:
        self.anchors = anchors
        self.places = max(map(len, anchors["scores"]))
        n = len(anchors["id"])
        # least * positive <= 100 * negative <= most * positive, as bounds of the negative's score.
        self.low, self.high = np.zeros((n, self.places), np.int64), np.full((n, self.places), -1)
        for i, scores in enumerate(anchors["scores"]):
            for j, s in enumerate(map(int, scores)):
                self.low[i, j], self.high[i, j] = bounded(-(-least * s // 100)), bounded(most * s // 100)
        self.heaps = Heaps(n * self.places, k)

    def meet(self, tile: dict) -> None:
        own, h = self.anchors, self.heaps
        scores = product(own["v"], tile["v"])
        other = own["label"][:, None] != tile["label"]
        # First what lies in any window and can enter any heap, then each positive's own.
        bottom = np.maximum(self.low, h.least.reshape(self.low.shape))
        open_ = bottom <= self.high
        lowest, highest = np.where(open_, bottom, HIGHEST).min(axis=1), np.where(open_, self.high, LOWEST).max(axis=1)
        other &= (scores >= lowest[:, None]) & (scores <= highest[:, None])
        rows = np.flatnonzero(other.any(axis=1))
        if not len(rows):
            return
        scores, other = scores[rows], other[rows]
        for p in range(self.places):
            inside = other & (scores >= bottom[rows, p][:, None]) & (scores <= self.high[rows, p][:, None])
            some = np.flatnonzero(inside.any(axis=1))
            if len(some):
                h.offer(rows[some] * self.places + p, scores[some], tile["id"], inside[some])

    def found(self) -> list[np.ndarray]:
        h = self.heaps
        at, place = np.divmod(h.row, self.places)
        return [*[self.anchors[c][at] for c in ROW], place, h.id, h.score]


def bounded(x: int) -> int:
    return min(max(x, LOWEST), HIGHEST)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of anchors (rows of a) and candidates (rows of b); the shorter vectors are filled up with zeros."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (a, b))
    return multiply(a, b.T)


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def rows_of(batch: pa.RecordBatch) -> dict:
    names = batch.schema.names
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*ROW, "side", "cell"]}
    out["v"] = matrix(batch.column("v"))
    out["scores"] = None
    if "scores" in names:
        out["scores"] = np.empty(batch.num_rows, object)
        out["scores"][:] = batch.column("scores").to_pylist()
    return out


def some_rows(rows: dict, which) -> dict:
    return {c: None if x is None else x[which] for c, x in rows.items()}


def together(parts: list[dict]) -> dict:
    """Parts of one block as one."""
    width = max(p["v"].shape[1] for p in parts)
    out = {c: None if parts[0][c] is None else np.concatenate([p[c] for p in parts]) for c in parts[0] if c != "v"}
    return out | {"v": np.concatenate([np.pad(p["v"], ((0, 0), (0, width - p["v"].shape[1]))) for p in parts])}


def unlike_before(rows: dict, last: tuple | None) -> np.ndarray:
    """Which rows differ from the one before; rows are sorted, so repeats stand together."""
    keys = [rows[c] for c in ["cell", "side", *ROW]]
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        new[0] = last is None or tuple(int(k[0]) for k in keys) != last
    return new


def in_cells(batches: Iterator[pa.RecordBatch], made: Callable[[dict], Positives | Windows], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Meets each cell's anchors, which come first, with its candidates, tile by tile."""
    cell, block, solver, last = None, [], None, None

    def done():
        if solver is not None:
            columns = solver.found()
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    for batch in batches:
        rows = rows_of(batch)
        if not len(rows["id"]):
            continue
        new = unlike_before(rows, last)
        last = tuple(int(rows[c][-1]) for c in ["cell", "side", *ROW])
        rows = some_rows(rows, new)
        runs = rows["cell"] * 2 + rows["side"]
        starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]]) if len(runs) else []
        for a, b in zip(starts, [*starts[1:], len(runs)], strict=True):
            run = some_rows(rows, slice(a, b))
            if run["cell"][0] != cell:
                yield from done()
                cell, block, solver = run["cell"][0], [], None
            if run["side"][0] == 0:
                block.append(run)
                continue
            if not block:
                continue
            solver = solver or made(together(block))
            for at in range(0, b - a, TILE):
                solver.meet(some_rows(run, slice(at, at + TILE)))
    yield from done()
    release_memory()


def gridded(anchors: DataFrame, rows: DataFrame, blocks: int, shares: int) -> DataFrame:
    """Every anchor in all cells of its block, every row in all cells of its share; anchors come first in a cell."""
    block, share = F.pmod(F.xxhash64(*ROW), F.lit(blocks)), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(shares))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    extra = [c for c in anchors.columns if c not in rows.columns]
    left = anchors.select("*", F.lit(0).alias("side"), block.alias("block"), every(shares).alias("share"))
    right = rows.select("*", *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra], F.lit(1).alias("side"), every(blocks).alias("block"), share.alias("share"))
    cells = left.unionByName(right).withColumn("cell", F.col("block") * shares + F.col("share")).drop("block", "share")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell", "side", *ROW)


def met(anchors: DataFrame, rows: DataFrame, blocks: int, shares: int, made, schema: str) -> DataFrame:
    arrow = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])
    return gridded(anchors, rows, blocks, shares).mapInArrow(lambda batches: in_cells(batches, made, arrow), schema)


def whole_vectors(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v, mix) of the rows that take part; components are floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    there = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(x, sound)
    v = F.transform(x, lambda c: F.floor(c * scale))
    rows = df.where(there).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    return rows.withColumn("mix", F.xxhash64("v"))


def hard_negatives(
    df: DataFrame, every: int = 50, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(scale * x), higher first, ties by smaller key. Anchors are the rows
    whose key is divisible by `every`; an anchor's positives are its first `positives` other rows of its
    label, and each positive gets the first `negatives` rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score.

    Rows with a null key, label, vector or component, or one that isn't finite, take no part; neither do
    other columns. Exact repeats of a row count once; rows that share a key only are rows of their own, and
    each such anchor has its own answers. Vectors of different lengths are filled up with zeros. An anchor
    without positives, or a positive without rows in its window, has no rows; so has an empty table.
    Scores are 64-bit whole numbers and wrap around where vectors are too large for these.
    """
    rows = stored(whole_vectors(df, key, vector, label, scale), "vectors")
    anchors = rows.where(F.col("id") % every == 0)
    spark = rows.sparkSession
    blocks = max(1, -(-anchors.count() // block))
    # Cells enough for all tasks, but none so small that its heaps outweigh its candidates.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, min(-(-2 * parts // blocks), -(-rows.count() // SHARE)))
    best = met(anchors, rows, blocks, shares, lambda a: Positives(a, positives), Positives.SCHEMA)
    first = F.row_number().over(Window.partitionBy(*ROW).orderBy(F.col("score").desc(), "other"))
    best = best.withColumn("place", first).where(F.col("place") <= positives)
    listed = F.array_sort(F.collect_list(F.struct("place", "score", "other")))
    chosen = best.groupBy(*ROW).agg(listed.alias("chosen")).select(*ROW, F.col("chosen.score").alias("scores"), F.col("chosen.other").alias("others"))
    chosen = stored(chosen, "positives")
    with_scores = anchors.dropDuplicates(ROW).join(chosen.drop("others"), ROW)
    windows = met(with_scores, rows, blocks, shares, lambda a: Windows(a, negatives, least, most), Windows.SCHEMA)
    rank = F.row_number().over(Window.partitionBy(*ROW, "place").orderBy(F.col("score").desc(), "other"))
    windows = windows.withColumn("rank", rank).where(F.col("rank") <= negatives)
    at = lambda c: F.get(F.col(c), F.col("place").cast("int"))
    return windows.join(chosen, ROW).select(
        F.col("id").alias("anchor_id"), at("others").alias("positive_id"), "rank",
        F.col("other").alias("negative_id"), at("scores").alias("positive_score"), F.col("score").alias("negative_score"),
    )
