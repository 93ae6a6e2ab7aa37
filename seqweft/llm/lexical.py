"""Ranked lexical search over bit-sliced Bloom signatures.

Every document has a Bloom signature of its terms, with a further entry for a term that occurs 2, 4 or 8
times. Signatures of documents of like size stand side by side in a block, bit by bit, so a slice is a
bitmap over the block's documents, and the slices of a term's bits, and-ed, name the documents that may
hold it. Sums of the terms' weights over these bitmaps, times the most that so many occurrences can give in
each document, bound its score for an item from above. Documents whose bound reaches the least score in
an item's heap are scored exactly; all others are proven not to be among the best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweft.llm.common import release_memory, small_batches, stored
from seqweft.llm.heaps import Heaps

#: Bits that a signature entry sets, and bits of the signature for each entry at least.
HASHES = 4
BITS = 12
LEAST_BITS, MOST_BITS = 1 << 8, 1 << 20
#: Entries for terms that occur at least so often.
LEVELS = (1, 2, 4, 8)
#: Documents of a block, and bits of all its signatures together.
DOCUMENTS = 1024
BLOCK_BITS = 1 << 22
#: Characters of the items that are searched at once, and terms of those that are bounded together.
ITEM_CHARS = 2_000_000
GROUP_TERMS = 1 << 14
ROWS_AT_ONCE = 1 << 13
LOOKUPS = 1 << 20
_LEVEL = np.random.default_rng(40503).integers(1, 2**63, len(LEVELS), dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Terms are runs of digits, ASCII letters and everything beyond ASCII; only A-Z is folded.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
BLOCKS = "ids binary, lengths binary, most binary, slices binary, starts binary, terms binary, counts binary, documents long, words long, df_term array<int>, df array<long>"
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def hashes_of(terms) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def places(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The signature bits (HASHES, entries) of terms at a level."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ _LEVEL[level]) * _ODD
        mixed ^= mixed >> np.uint64(29)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        return ((mixed + np.arange(HASHES, dtype=np.uint64)[:, None] * step) & np.uint64(bits - 1)).astype(np.int64)


class Shelf:
    """Documents of like size on the way to a block."""

    def __init__(self, bits: int) -> None:
        self.bits, self.room = bits, max(1, min(DOCUMENTS, BLOCK_BITS // bits))
        self.ids, self.lengths, self.most, self.hashes, self.tfs, self.known = [], [], [], [], [], []

    def add(self, key: int, length: int, hashes: np.ndarray, tfs: np.ndarray, known: np.ndarray) -> None:
        self.ids.append(key)
        self.lengths.append(length)
        self.most.append(int(tfs.max()))
        self.hashes.append(hashes)
        self.tfs.append(tfs)
        self.known.append(known)

    def full(self) -> bool:
        return len(self.ids) >= self.room

    def block(self) -> tuple:
        n, sizes = len(self.ids), [len(h) for h in self.hashes]
        owner, hashes, tfs, known = np.repeat(np.arange(n), sizes), np.concatenate(self.hashes), np.concatenate(self.tfs), np.concatenate(self.known)
        there = np.zeros((self.bits, n), bool)
        for level, least in enumerate(LEVELS):
            some = tfs >= least
            there[places(hashes[some], level, self.bits), owner[some]] = True
        some = np.flatnonzero(known)
        some = some[np.lexsort((known[some], owner[some]))]
        starts = np.searchsorted(owner[some], np.arange(n + 1))
        packed = (np.array(self.ids, np.int64), np.array(self.lengths, np.int64), np.array(self.most, np.int64), np.packbits(there, axis=1), starts.astype(np.int64), known[some].astype(np.int32), tfs[some])
        return (*[x.tobytes() for x in packed], None, None, None, None)


def indexed(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """Blocks of signatures and, once for each task, the counts that weights are made of.

    A block also lists each document's counts of the vocabulary's terms (numbered from 1), for exact scores.
    """

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shelves: dict[int, Shelf] = {}
        documents = words = 0
        df = np.zeros(len(vocabulary) + 1, np.int64)
        get = vocabulary.get
        for frame in frames:
            for name, said in zip(frame["key"], frame["text"], strict=True):
                terms = terms_of(said)
                if not terms:
                    continue
                counts = Counter(terms)
                tfs = np.fromiter(counts.values(), np.int64, len(counts))
                known = np.fromiter((get(t, 0) for t in counts), np.int64, len(counts))
                df[known] += 1
                documents, words = documents + 1, words + len(terms)
                if pd.isna(name):
                    continue
                entries = sum(int((tfs >= least).sum()) for least in LEVELS)
                bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * entries - 1).bit_length()))
                shelf = shelves.setdefault(bits, Shelf(bits))
                shelf.add(int(name), len(terms), hashes_of(counts), tfs, known)
                if shelf.full():
                    yield pd.DataFrame([shelves.pop(bits).block()], columns=NAMES)
        for shelf in shelves.values():
            yield pd.DataFrame([shelf.block()], columns=NAMES)
        some = np.flatnonzero(df[1:]) + 1
        yield pd.DataFrame([(*[None] * 7, documents, words, some.astype(np.int32), df[some])], columns=NAMES)
        release_memory()

    small_batches()
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(made, BLOCKS)


def factor(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What `tf` occurrences give in a document of relative length m, per weight; it never falls with tf."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Search:
    """Items by their terms' numbers and weights, in groups whose terms are looked up together."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, hashes: np.ndarray, n: int, length: int, best: int) -> None:
        self.items, self.weights, self.hashes, self.n, self.length, self.best = items, weights, hashes, n, length, best
        self.groups, held, size = [], [], 0
        for k, terms in enumerate(items):
            if held and size + len(terms) > GROUP_TERMS:
                self.groups.append(held)
                held, size = [], 0
            held.append(k)
            size += len(terms)
        self.groups += [held] if held else []
        self.tables = [self.table(g) for g in self.groups]

    def table(self, group: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a group's items, and the items' weights of them."""
        terms = np.unique(np.concatenate([self.items[k] for k in group]))
        heaviest = max(int(self.weights[self.items[k]].sum()) for k in group)
        table = np.zeros((len(group), len(terms)), np.float32 if heaviest < 1 << 24 else np.float64)
        for row, k in enumerate(group):
            at = np.searchsorted(terms, self.items[k])
            table[row, at] = self.weights[self.items[k]]
        return terms, table

    def bounds(self, block: Block, terms: np.ndarray, table: np.ndarray) -> np.ndarray:
        """For each item of a group and each document a score that it can't exceed."""
        out = np.zeros((len(table), block.n), np.int64)
        for level in range(len(LEVELS)):
            sums = np.zeros(out.shape, table.dtype)
            for at in range(0, len(terms), ROWS_AT_ONCE):
                some = terms[at : at + ROWS_AT_ONCE]
                bitmaps = block.holding(self.hashes[some], level)
                rows = np.flatnonzero(bitmaps.any(axis=1))
                there = np.unpackbits(bitmaps[rows], axis=1, count=block.n)
                sums += table[:, at + rows] @ there.astype(table.dtype)
            out += sums.astype(np.int64) * block.gains[level]
        return out

    def exact(self, block: Block, items: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """Scores of (item, document) pairs, from the documents' own counts."""
        out = np.zeros(len(items), np.int64)
        sizes = np.array([len(self.items[k]) for k in items.tolist()], np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(items):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKUPS, "right")))
            terms = np.concatenate([self.items[k] for k in items[at:stop].tolist()])
            owner = np.repeat(documents[at:stop], sizes[at:stop])
            tf = block.occurrences(owner, terms)
            gained = self.weights[terms] * factor(tf, block.m[owner])
            out[at:stop] = np.add.reduceat(gained, np.r_[0, np.cumsum(sizes[at:stop])[:-1]])
            at = stop
        return out

    def meet(self, block: Block, heaps: Heaps) -> None:
        for group, (terms, table) in zip(self.groups, self.tables, strict=True):
            most = self.bounds(block, terms, table)
            rows = np.array(group)
            done = np.zeros(most.shape, bool)
            fresh = np.flatnonzero(heaps.least[rows] <= 0)
            if len(fresh) and block.n > self.best:
                # The highest bounds first: their scores raise the bar for the rest.
                high = np.argpartition(most[fresh], block.n - self.best, axis=1)[:, block.n - self.best :]
                done[fresh[:, None], high] = True
                self.score(block, heaps, rows, done & (most > 0))
            self.score(block, heaps, rows, ~done & (most >= np.maximum(1, heaps.least[rows])[:, None]))

    def score(self, block: Block, heaps: Heaps, rows: np.ndarray, wanted: np.ndarray) -> None:
        at, which = np.nonzero(wanted)
        if not len(at):
            return
        scores = self.exact(block, rows[at], which)
        some = (scores > 0) & (scores >= heaps.least[rows[at]])
        heaps.add(rows[at][some], scores[some], block.ids[which][some])


class Block:
    """A block of signatures as read back, with each document's gains by level."""

    def __init__(self, row, search: Search) -> None:
        self.ids, lengths, most = (np.frombuffer(x, np.int64) for x in (row.ids, row.lengths, row.most))
        self.n = len(self.ids)
        self.slices = np.frombuffer(row.slices, np.uint8).reshape(-1, -(-self.n // 8))
        starts, self.terms, self.tfs = np.frombuffer(row.starts, np.int64), np.frombuffer(row.terms, np.int32), np.frombuffer(row.counts, np.int64)
        self.span = len(search.weights)
        self.keys = np.repeat(np.arange(self.n), np.diff(starts)) * self.span + self.terms
        self.m = np.array([50 + 50 * int(x) * search.n // search.length for x in lengths], np.int64)
        # A term that is seen at a level and not at the next occurs at most so often.
        caps = [*[np.minimum(b - 1, most) for b in LEVELS[1:]], most]
        reached = [np.zeros(self.n, np.int64), *[factor(c, self.m) for c in caps]]
        self.gains = [np.maximum(0, b - a) for a, b in zip(reached, reached[1:], strict=False)]

    def holding(self, hashes: np.ndarray, level: int) -> np.ndarray:
        """For each term the bitmap of the documents that may hold it at a level."""
        rows = places(hashes, level, len(self.slices))
        out = self.slices[rows[0]]
        for r in rows[1:]:
            out = out & self.slices[r]
        return out

    def occurrences(self, documents: np.ndarray, terms: np.ndarray) -> np.ndarray:
        wanted = documents * self.span + terms
        at = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == wanted, self.tfs[at], 0) if len(self.keys) else np.zeros(len(wanted), np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, terms): the distinct terms of each item that has any."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            terms = [sorted(set(terms_of(t))) for t in frame["text"]]
            out = pd.DataFrame({"item": frame["item"], "terms": terms})
            yield out[[bool(t) for t in terms]]

    return items.mapInPandas(split, "item long, terms array<binary>")


def ranked(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", best: int = 50
) -> DataFrame:
    """(item, rank, key, score): each item's `best` documents with a score above 0, ties by ascending key.

    All documents count for the weights and lengths. Keys and items are whole numbers. A null or empty text
    has no terms and is never returned; neither is a document with a null key, though it counts. Documents
    that repeat a key are ranked each by its own text. Items with a null id or without terms have no rows;
    exact repeats of an item count once, and other texts under one id are ranked by themselves. Other
    columns don't matter; empty tables give no rows. Texts of any length are indexed whole. Items are
    searched in blocks of about ITEM_CHARS characters, dealt by hash; each block reads the documents once.
    """
    schema = "item long, row int, key long, score long"
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // ITEM_CHARS))
    found = None
    for b in range(blocks):
        listed = [(r.item, r.terms) for r in item_terms(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)).orderBy("item", "terms").collect()]
        if not listed:
            continue
        own = searched(docs, [(i, list(map(bytes, t))) for i, t in listed], key, text, best, schema)
        own = own if blocks == 1 else stored(own, "ranked")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item long, rank int, key long, score long")
    return found.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def searched(docs: DataFrame, listed: list[tuple[int, list[bytes]]], key: str, text: str, best: int, schema: str) -> DataFrame:
    vocabulary = {t: n + 1 for n, t in enumerate(sorted({t for _, ts in listed for t in ts}))}
    index = stored(indexed(docs, vocabulary, key, text), "signatures")
    counts = index.where("documents IS NOT NULL")
    n, length = counts.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for r in counts.select(F.explode(F.arrays_zip("df_term", "df")).alias("x")).groupBy("x.df_term").agg(F.sum("x.df").alias("n")).collect():
        df[r.df_term] = r.n
    weights = np.array([0, *[math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df[1:].tolist()]], np.int64)
    hashes = np.concatenate([np.zeros(1, np.uint64), hashes_of(sorted(vocabulary))])
    items = [np.array([vocabulary[t] for t in ts if df[vocabulary[t]]], np.int64) for _, ts in listed]
    some = [k for k, terms in enumerate(items) if len(terms)]
    names = np.array([listed[k][0] for k in some], np.int64)
    search = Search([items[k] for k in some], weights, hashes, n, length, best)

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps = Heaps(len(names), best)
        for frame in frames:
            for row in frame.itertuples():
                search.meet(Block(row, search), heaps)
        if len(heaps.row):
            yield pd.DataFrame({"item": names[heaps.row], "row": heaps.row.astype(np.int32), "key": heaps.id, "score": heaps.score})
        release_memory()

    hits = index.where("slices IS NOT NULL").select(*NAMES[:7]).mapInPandas(found, schema)
    return best_of(hits, best)


def best_of(hits: DataFrame, best: int) -> DataFrame:
    """Merges the heaps of all tasks: (item, rank, key, score)."""
    rank = F.row_number().over(Window.partitionBy("item", "row").orderBy(F.col("score").desc(), "key"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= best).select("item", "rank", "key", "score")
