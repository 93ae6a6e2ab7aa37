"""Near-duplicate texts by an inverted join of signature coordinates.

A text's word shingles make a set, its minima under several hashes a signature. Equal sets are one class
from the start, which has a number of its own, so that it doesn't matter whether keys repeat. A class is posted under coordinate and value; two classes whose signatures agree in `t` of
`K` coordinates share a posting among any `K - t + 1` of them, so only that many are posted, the rarest
first, which skips long lists. Where classes meet, the collisions of their whole signatures are counted,
and those with `t` or more belong to one candidate family. Within a family the full sets are compared
exactly; lists and families of any size are cut into blocks which meet pairwise. A block hands on a star of
links for each set of classes it connects, never all pairs.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import release_memory, stored, text_column
from seqweft.llm.components import components

COORDINATES = 32
#: Standard deviations by which the match threshold lies below the expected matches of a pair at the limit.
SAFETY = 5.0
#: Posting lists longer than this are used last.
LONG = 64
BLOCK = 512
#: Shingles in a block of a family.
BLOCK_SHINGLES = 1 << 18
_MIX = np.random.default_rng(2654435761).integers(1, 2**63, (2, COORDINATES), dtype=np.uint64)
_XOR, _ODD = _MIX[0][:, None], (_MIX[1] * np.uint64(2) + np.uint64(1))[:, None]


def least_matches(percent: int, k: int = COORDINATES) -> int:
    p = percent / 100
    return max(1, math.floor(k * p - SAFETY * math.sqrt(k * p * (1 - p))))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; the whole sequence is one if it has fewer words."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    some = {b" ".join(found)} if len(found) < words else set(map(b" ".join, zip(*[found[i:] for i in range(words)], strict=False)))
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(some)))


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[None, at : at + 4096] ^ _XOR) * _ODD).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def features_struct(words: int):
    def made(texts):
        rows = []
        for t in texts:
            s = shingles(t, words)
            d = xxhash.xxh3_128_digest(s.tobytes())
            d1, d2 = (int.from_bytes(x, sys.byteorder, signed=True) for x in (d[:8], d[8:]))
            rows.append((len(s), d1, d2, signature(s) if len(s) else None))
        return pd.DataFrame(rows, columns=["n", "d1", "d2", "sig"])

    return text_column(made, "n long, d1 long, d2 long, sig array<int>")


class Forest:
    """Union of small sets, each named by its least member."""

    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def stars(ids: np.ndarray, linked: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each set of rows that the links connect, an edge from every id to the least (ids ascend)."""
    forest = Forest(len(ids))
    for a, b in linked:
        forest.join(a, b)
    return [(int(ids[i]), int(ids[top])) for i in range(len(ids)) if (top := forest.find(i)) != i]


def by_group(frames: Iterator[pd.DataFrame], keys: list[str], solve) -> Iterator[pd.DataFrame]:
    """Calls `solve` for each run of rows with equal keys; rows come sorted by them, in batches."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        values = frame[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)]) if len(frame) else np.empty(0, int)
        out = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            out += solve(frame.iloc[a:b]) if b - a > 1 else []
        rest = frame.iloc[starts[-1] :] if len(frame) else None
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])
    if rest is not None and len(rest) > 1 and (out := solve(rest)):
        yield pd.DataFrame(out, columns=["a", "b"])
    release_memory()


def collided(least: int):
    """Links of rows whose signatures agree in `least` coordinates."""

    def solve(rows: pd.DataFrame) -> list[tuple[int, int]]:
        rows = rows.drop_duplicates("rep").sort_values("rep")
        sig = np.stack(rows["sig"].to_numpy())
        if len(sig) < 2:
            return []

        def pairs():
            for i in range(len(sig) - 1):
                for j in np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= least):
                    yield i, i + 1 + int(j)

        return stars(rows["rep"].to_numpy(), pairs())

    return solve


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the elements that occur in more than one set."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[at] > 1
    owner, at = owner[shared], (np.cumsum(counts > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, (1 << 20) // len(sets))
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        a, b = np.searchsorted(at, (low, low + step))
        holds = np.zeros((len(sets), step), np.float32)
        holds[owner[a:b], at[a:b] - low] = 1
        total += holds @ holds.T
    return np.rint(total).astype(np.int64)


def similar(percent: int):
    """Links of rows whose full sets are similar enough."""

    def solve(rows: pd.DataFrame) -> list[tuple[int, int]]:
        rows = rows.sort_values("rep")
        sets = [np.frombuffer(s, np.uint64) for s in rows["hashes"]]
        sizes = np.array([len(s) for s in sets])
        both = overlaps(sets)
        near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        a, b = np.nonzero(np.triu(near, 1))
        return stars(rows["rep"].to_numpy(), zip(a.tolist(), b.tolist(), strict=True))

    return solve


def in_blocks(rows: DataFrame, keys: list[str], blocks: str, solve, batch: list[str]) -> DataFrame:
    """Edges (a, b) from rows of equal keys; a group of several blocks is solved block by block."""
    mine = F.pmod(F.xxhash64("rep"), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    dealt = rows.withColumn("mine", mine).withColumn("other", other)
    # Of a group with several blocks the meeting (i, i) is part of every (i, j), so it needs no task of its own.
    dealt = dealt.where((F.col(blocks) == 1) | (F.col("mine") != F.col("other")))
    dealt = dealt.withColumns({"bi": F.least("mine", "other"), "bj": F.greatest("mine", "other")}).select(*keys, "bi", "bj", *batch)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = [*keys, "bi", "bj"]
    ordered = dealt.repartition(parts, *grouped).sortWithinPartitions(*grouped)
    return ordered.mapInPandas(lambda frames: by_group(frames, grouped, solve), "a long, b long")


def candidate_families(reps: DataFrame, least: int) -> DataFrame:
    """(node, component): families connected by pairs with `least` or more colliding coordinates."""
    prefix = COORDINATES - least + 1
    listed = reps.select("rep", F.posexplode("sig").alias("k", "v"))
    long_lists = stored(listed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LONG), "long-lists")
    known = listed.join(long_lists, ["k", "v"]).groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("k", "size"))).alias("sizes"))
    size = lambda k: F.coalesce(F.element_at("sizes", k), F.lit(0).cast("long"))
    ranked = F.array_sort(F.transform("sig", lambda v, k: F.struct(size(k).alias("s"), k.alias("k"), v.alias("v"))))
    posted = reps.join(known, "rep", "left").select("rep", F.explode(F.slice(ranked, 1, prefix)).alias("p")).select("rep", "p.k", "p.v")
    posted = stored(posted, "postings")
    lists = posted.groupBy("k", "v").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    lists = lists.select("k", "v", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    meeting = posted.join(lists, ["k", "v"]).join(reps.select("rep", "sig"), "rep")
    edges = in_blocks(meeting, ["k", "v"], "blocks", collided(least), ["rep", "sig"])
    return components(edges, "families")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept, mix) for every row; `mix` is a hash of its text.

    Texts are linked where 100 times the intersection of their shingle sets is at least `percent` times the
    union; the component is named by its least key and that row is kept. Null, empty and blank texts have
    no shingles and no links: their component is their own key. Rows with a null key link nothing, get a
    null component and are kept. Keys are whole numbers. Rows that repeat a key are judged each by its own
    text. Very long texts are hashed whole. The match threshold
    lies five standard deviations below a linked pair's expected collisions, so a pair at the limit is
    missed with a probability of about one in a million; `kept` follows from the links alone.
    """
    struct = features_struct(words)(F.col(text).cast("string"))
    mix = F.xxhash64(F.col(text).cast("string"))
    features = stored(df.select(F.col(key).cast("long").alias("key"), mix.alias("mix"), struct.alias("x")).select("key", "mix", "x.*"), "features")
    known = features.where("n > 0 AND key IS NOT NULL")
    named = known.groupBy("d1", "d2").agg(F.min("key").alias("least"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = stored(named.withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = classes.select("rep", "sig")
    family = stored(candidate_families(reps, least_matches(percent)), "family-members")
    members = family.join(classes, family["node"] == classes["rep"]).select("component", "rep", "least", "n", "d1", "d2")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES))
    sizes = sizes.select("component", blocks.alias("blocks"))
    wanted = members.select(F.col("least").alias("key"), "rep", "component", "d1", "d2")
    full = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key IS NOT NULL")
    hashed = text_column(lambda texts: _hashed(texts, words), "hashes binary, d1 long, d2 long")
    texts = full.join(wanted.select("key").distinct(), "key", "left_semi")
    sets = texts.select("key", hashed(F.col("text")).alias("x")).select("key", "x.*").dropDuplicates(["key", "d1", "d2"])
    compared = wanted.join(sets, ["key", "d1", "d2"]).join(sizes, "component").select("component", "blocks", "rep", "hashes")
    links = in_blocks(compared, ["component"], "blocks", similar(percent), ["rep", "hashes"])
    linked = components(links, "links").join(classes.select(F.col("rep").alias("node"), "least", "d1", "d2"), "node")
    least = linked.groupBy("component").agg(F.min("least").alias("least"))
    linked = linked.select("d1", "d2", "component").join(least, "component").select("d1", "d2", F.col("least").alias("linked"))
    named = classes.select("d1", "d2", "least").join(linked, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("linked", "least").alias("component"))
    out = features.join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))
    component = F.when(F.col("key").isNotNull(), component)
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"), "mix",
    )


def _hashed(texts: list, words: int) -> pd.DataFrame:
    rows = []
    for t in texts:
        s = shingles(t, words)
        d = xxhash.xxh3_128_digest(s.tobytes())
        rows.append((s.tobytes(), *(int.from_bytes(x, sys.byteorder, signed=True) for x in (d[:8], d[8:]))))
    return pd.DataFrame(rows, columns=["hashes", "d1", "d2"])


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows that are kept: one document of each group of near duplicates, and all rows without a key.

    A row goes for its own text, so another text under the same key stays if it is no duplicate.
    """
    judged = near_duplicates(df, key, text, words, percent).where("NOT kept").select(F.col(key).alias("_gone"), F.col("mix").alias("_mix")).distinct()
    mix = F.xxhash64(df[text].cast("string"))
    return df.join(judged, (df[key].cast("long") == judged["_gone"]) & mix.eqNullSafe(judged["_mix"]), "left_anti")
