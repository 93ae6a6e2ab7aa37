"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's vocabulary; a randomised singular value decomposition,
whose products with the passage matrix are sums over tasks, gives their latent space. A window of a document
is a candidate for an item if it holds enough of the item's words and its cosine to the item in that space
is high enough; one with words enough for a copy is a candidate whatever its cosine. Candidates are held
against the item word by word: the longest common subsequence must cover enough of it, and the item's
rarest words, which carry its answer, must be there too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import release_memory, stored, text_column

PASSAGE = 64
STEP = 8
RANK = 96
WIDE = 16
#: Words that a task works on at once.
CHUNK = 16_384
#: From this share of an item on, a window is a copy rather than a paraphrase, and needs no answer check.
VERBATIM = 0.8
#: Words of an item that are searched as one; of a longer one each piece of so many is an item of its own.
LONGEST = 1024
#: Characters of the items that are searched at once; the words, vectors and counts of so many fit every task.
BLOCK = 400_000
#: Cosine to an item, times what a window has beside it, from which a window is a candidate.
COSINE = 0.2
_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z), without ASCII punctuation."""
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def coded_struct(vocabulary: dict[bytes, int]):
    def coded(texts):
        get = vocabulary.get
        return pd.DataFrame({"ids": [np.array([get(w, 0) for w in words_of(t)], "<i4").tobytes() for t in texts]})

    return text_column(coded, "ids binary")


def laid_out(docs: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' words in blocks of a length, each document's last one filled up with 0, and its blocks."""
    lengths = np.array([len(d) for d in docs])
    blocks = -(-lengths // length)
    starts = (np.cumsum(blocks) - blocks) * length
    out = np.zeros(int(blocks.sum()) * length, np.int64)
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(starts, lengths) + inside] = np.concatenate(docs)
    return out, blocks


def in_chunks(frames: Iterator[pd.DataFrame], words: int) -> Iterator[list[np.ndarray]]:
    """Lists of documents of about so many words, small enough for what is made of them to stay in the cache."""
    held, size = [], 0
    for frame in frames:
        for b in frame["ids"]:
            held.append(np.frombuffer(b, "<i4"))
            size += len(held[-1])
            if size >= words:
                yield held
                held, size = [], 0
    if held:
        yield held


def frequencies(coded: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many passages each term stands, and the number of passages."""
    words = max(PASSAGE, (1 << 20) * PASSAGE // terms)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, passages = np.zeros(terms, np.int64), 0
        for docs in in_chunks(frames, words):
            padded, blocks = laid_out(docs, PASSAGE)
            n = int(blocks.sum())
            pairs = np.repeat(np.arange(n) * terms, PASSAGE) + padded
            if n * terms <= 1 << 24:
                there = np.zeros(n * terms, bool)
                there[pairs] = True
                df += there.reshape(n, terms).sum(axis=0)
            else:  # a long document: only the pairs that occur
                df += np.bincount(np.unique(pairs) % terms, minlength=terms)
            passages += n
        df[0] = passages
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": some.astype("int32"), "n": df[some]})
        release_memory()

    got = coded.mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(terms, np.int64)
    df[got["term"]] = got["n"]
    return df, int(df[0])


def product(docs: list[np.ndarray], scaled: np.ndarray, total: np.ndarray) -> None:
    """Adds to `total` the documents' passage matrix, transposed, times itself times `scaled`."""
    padded, _ = laid_out(docs, PASSAGE)
    if len(padded):
        rows = block_sums(scaled, padded, PASSAGE)
        order = np.argsort(padded, kind="stable")
        ids = padded[order]
        order, ids = order[ids > 0], ids[ids > 0]
        if len(ids):
            firsts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            total[ids[firsts]] += np.add.reduceat(rows[order // PASSAGE], firsts, axis=0)


def multiplied(coded: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The passage matrix's transpose times the matrix times `basis`, summed over all tasks."""
    terms, rank = basis.shape
    scaled = (weights[:, None] * basis).astype(np.float32)
    chunks = -(-rank // WIDE)
    names = [f"y{i}" for i in range(WIDE)]

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((terms, chunks * WIDE), np.float64)
        for docs in in_chunks(frames, CHUNK):
            product(docs, scaled, total[:, :rank])
        some = np.flatnonzero(total.any(axis=1))
        flat = total[some].reshape(-1, WIDE)
        out = pd.DataFrame(flat, columns=names)
        out.insert(0, "chunk", np.tile(np.arange(chunks, dtype="int32"), len(some)))
        out.insert(0, "term", np.repeat(some.astype("int32"), chunks))
        yield out
        release_memory()

    schema = "term int, chunk int, " + ", ".join(f"{n} double" for n in names)
    got = coded.mapInPandas(multiply, schema).groupBy("term", "chunk").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((terms, chunks, WIDE))
    out[got["term"], got["chunk"]] = got[names].to_numpy()
    return out.reshape(terms, -1)[:, :rank] * weights[:, None]


def latent_terms(coded: DataFrame, terms: int, rank: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Term vectors in the space of the leading right singular vectors of all passages, and the terms' weights."""
    df, n = frequencies(coded, terms)
    weights = np.log((n + 1) / (df + 1.0))
    weights[0] = 0
    rank = min(rank, terms)
    basis = np.linalg.qr(np.random.default_rng(97).standard_normal((terms, rank)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(multiplied(coded, weights, basis))[0]
    return (weights[:, None] * basis).astype(np.float32), weights


def places(item: np.ndarray) -> dict[int, int]:
    """For each word of an item the bits of its places."""
    masks: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def common_length(masks: dict[int, int], length: int, window: np.ndarray) -> int:
    """Length of the longest common subsequence of an item, given by its places, and a window; bit-parallel."""
    full = (1 << length) - 1
    v = full
    for x in window.tolist():
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def answers(item: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rarest quarter of an item's distinct words, three at least."""
    distinct = np.unique(item)
    return distinct[np.argsort(-weights[distinct], kind="stable")][: max(3, len(distinct) // 4)]


class Search:
    """Items in the latent space, grouped by the length of the windows they are compared with."""

    def __init__(self, ids: list[int], items: list[np.ndarray], vectors: np.ndarray, weights: np.ndarray, cosine: float | None, covered: float, answered: float):
        self.vectors, self.cosine, self.covered, self.answered = vectors, cosine, covered, answered
        # Items of one class stand together, so that a class is a slice of columns.
        order = sorted(range(len(items)), key=lambda k: -(-len(items[k]) // STEP))
        ids, items = [ids[k] for k in order], [items[k] for k in order]
        self.ids, self.items = ids, items
        self.places = [places(i) for i in items]
        found = [[i.tolist().index(x) for x in answers(i, weights).tolist()] for i in items]
        directions = np.stack([vectors[i].sum(axis=0) for i in items])
        directions /= np.linalg.norm(directions, axis=1, keepdims=True) + 1e-9
        sizes = [(-(-len(i) // STEP) + 1) * STEP for i in items]
        self.classes = [(s, sizes.index(s), sizes.index(s) + sizes.count(s)) for s in sorted(set(sizes))]
        # For each class its first item, the items' words side by side, and the first places of their answers.
        self.tables = {}
        for size, a, b in self.classes:
            table = np.full((b - a, max(map(len, items[a:b]))), -1, np.int32)
            carries = np.zeros(table.shape, bool)
            for k in range(a, b):
                table[k - a, : len(items[k])] = items[k]
                carries[k - a, found[k]] = True
            self.tables[size] = a, table, carries
        self.directions = {s: np.ascontiguousarray(directions[a:b].T, dtype=np.float32) for s, a, b in self.classes}
        self.member = np.zeros((len(vectors), len(items)), np.uint8)
        for k, i in enumerate(items):
            self.member[i, k] = 1
        self.least = np.ceil(np.array([covered * len(i) for i in items]) - 1e-9).astype(np.int16)
        self.copied = np.ceil(np.array([VERBATIM * len(i) for i in items]) - 1e-9).astype(np.int16)

    def bounds(self, padded: np.ndarray, begins: np.ndarray, ends: np.ndarray, ks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each window can cover enough of its item, by the item's words that stand in it, and has its answers."""
        possible, answered = np.zeros(len(ks), bool), np.zeros(len(ks), bool)
        base, table, carries = self.tables[size]
        longest = table.shape[1]
        step = max(1, (1 << 22) // (longest * size))
        for low in range(0, len(ks), step):
            some = slice(low, low + step)
            places = begins[some, None] + np.arange(size)
            words = np.where(places < ends[some, None], padded[np.minimum(places, len(padded) - 1)], 0).astype(np.int32)
            own = ks[some]
            items, firsts = table[own - base], carries[own - base]
            if longest * size <= 1 << 22:
                there = (items[:, :, None] == words[:, None, :]).any(axis=2)
            else:
                there = np.stack([np.isin(i, w) for i, w in zip(items, words, strict=True)])
            n = there.sum(axis=1)
            answered[some] = (there & firsts).sum(axis=1) / firsts.sum(axis=1) >= self.answered
            possible[some] = (n >= self.copied[own]) | ((n >= self.least[own]) & answered[some])
        return possible, answered

    def hits(self, docs: list[np.ndarray]) -> list[list[tuple]]:
        """For each document (item, cosine, share covered, first word, last word) of the best window for each item found."""
        best: list[dict[int, tuple]] = [{} for _ in docs]
        padded, blocks = laid_out(docs, STEP)
        ends = np.cumsum(blocks)
        total, starts = int(ends[-1]), ends - blocks
        if not total:
            return [[] for _ in docs]
        # Differences of these are at most a window's words, so it doesn't matter that the sums wrap around.
        counts = np.zeros((total + 1, len(self.items)), np.int16)
        np.cumsum(block_sums(self.member, padded, STEP), axis=0, dtype=np.int16, out=counts[1:])
        possible, needed = [], np.zeros(total + 1, np.int32)
        for size, low, high in self.classes:
            span = size // STEP
            # All windows inside a document, or all of a shorter one.
            many = np.where(blocks > 0, np.maximum(1, blocks - span + 1), 0)
            owner = np.repeat(np.arange(len(docs)), many)
            first = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            last = np.minimum(first + span, ends[owner])
            # A window can't cover more of an item than the number of its words that the item has.
            own = counts[:, low:high]
            shared = own[last] - own[first]
            enough = shared >= self.least[low:high]
            some = np.flatnonzero(enough.any(axis=1))
            np.add.at(needed, first[some], 1)
            np.add.at(needed, last[some], -1)
            possible.append((owner[some], first[some], last[some], shared[some], enough[some]))
        sums = self.vector_sums(padded, np.cumsum(needed)[:-1] > 0)
        for (size, low, high), (owner, first, last, shared, candidates) in zip(self.classes, possible, strict=True):
            windows = sums[last] - sums[first]
            norms = np.sqrt(np.einsum("ij,ij->i", windows, windows)) + 1e-9
            near = windows @ self.directions[size]
            if self.cosine is not None:
                # Words beside the item turn a short window further away than a long one; a copy is looked at in any case.
                candidates &= (near >= (self.cosine * (1 - STEP / size) * norms).astype(np.float32)[:, None]) | (shared >= self.copied[low:high])
            at, which = np.nonzero(candidates)
            begins, ends_at = first[at] * STEP, last[at] * STEP
            fit, answered = self.bounds(padded, begins, ends_at, low + which, size)
            for x in np.flatnonzero(fit).tolist():
                a, w = int(at[x]), int(which[x])
                k, d = low + w, int(owner[a])
                start = (int(first[a]) - int(starts[d])) * STEP
                window = docs[d][start : start + size]
                share = common_length(self.places[k], len(self.items[k]), window[window > 0]) / len(self.items[k])
                if share >= VERBATIM or (share >= self.covered and answered[x]):
                    found = (share, float(near[a, w] / norms[a]), -start, start + len(window))
                    best[d][k] = max(best[d].get(k, found), found)
        return [self.by_item(b) for b in best]

    def by_item(self, best: dict[int, tuple]) -> list[tuple]:
        """The best window of each item id, which may have several pieces or rows."""
        out: dict[int, tuple] = {}
        for k, found in best.items():
            out[self.ids[k]] = max(out.get(self.ids[k], found), found)
        return [(i, c, s, -start, end) for i, (s, c, start, end) in out.items()]

    def vector_sums(self, padded: np.ndarray, needed: np.ndarray) -> np.ndarray:
        """Running sums of the blocks' vectors; blocks that no window needs count as nothing."""
        sums = np.zeros((len(needed) + 1, self.vectors.shape[1]), np.float32)
        if needed.any():
            sums[1:][needed] = block_sums(self.vectors, padded.reshape(-1, STEP)[needed].reshape(-1), STEP)
            np.cumsum(sums, axis=0, out=sums)
        return sums


def block_sums(rows: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Sums of the words' rows over blocks of a length, one place in all blocks after the other."""
    places = words.reshape(-1, length).T
    out = rows[places[0]]
    for place in places[1:]:
        out += rows[place]
    return out


FOUND = "item_id long, cosine double, covered double, first_word int, last_word int"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    cosine: float | None = COSINE, covered: float = 0.6, answered: float = 0.5, rank: int = RANK,
) -> DataFrame:
    """(key, item_id, cosine, covered, first_word, last_word): the items found in each document.

    Windows step by eight words over the whole text and are a little longer than the item they are held
    against. Candidates are at least as near as `cosine` in the latent space, lowered by the share that may
    be beside the item, or have words enough for a copy; without a `cosine` every window with enough of an
    item's words is one. The best window for each item is given, its last word exclusive. An item of more
    than LONGEST words is searched in pieces, and its best piece is given. Null, empty and blank texts hold
    nothing; items without a word, or with a null id, are left out. Items' ids are whole numbers. Repeated
    rows repeat their results, a null key is kept as it is, and other columns don't matter. An empty
    benchmark or an empty corpus finds nothing. Pieces of a large benchmark are dealt by hash to blocks of
    about BLOCK characters, which are searched one after another, each in a latent space of its own; the
    driver holds one block. In that case rows that share a key give one result for each item.
    """
    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    pieces = stored(rows.mapInPandas(in_pieces(LONGEST), PIECES), "items")
    blocks = -(-pieces.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] // BLOCK)
    schema = f"key {docs.schema[key].dataType.simpleString()}, {FOUND}"
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    hits = None
    for b in range(blocks):
        part = pieces if blocks == 1 else pieces.where(F.pmod(F.xxhash64("i", "n", "t"), F.lit(blocks)) == b)
        listed = [(r.i, bytes(r.t).split()) for r in part.orderBy("i", "n", "t").collect()]
        if not listed:
            continue
        own = hits_of(texts, listed, rank, cosine, covered, answered)
        # With several parts each is searched before the next, so that the driver holds one part's vectors only.
        own = own if blocks == 1 else stored(own, "hits")
        hits = own if hits is None else hits.unionByName(own)
    if hits is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    if blocks > 1:  # pieces of one item may lie in several blocks
        best = F.max(F.struct("covered", "cosine", F.negative("first_word").alias("f"), "last_word"))
        best = hits.groupBy("key", "item_id").agg(best.alias("b"))
        hits = best.select("key", "item_id", "b.cosine", "b.covered", F.negative("b.f").alias("first_word"), "b.last_word")
    return hits.withColumnRenamed("key", key)


PIECES = "i long, n long, t binary"


def in_pieces(longest: int):
    """Items' words, in pieces of at most `longest` words of about equal length."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text in zip(frame["i"], frame["t"], strict=True):
                words = words_of(text)
                many = -(-len(words) // longest)
                for n in range(many):
                    out.append((i, n, b" ".join(words[len(words) * n // many : len(words) * (n + 1) // many])))
            yield pd.DataFrame(out, columns=["i", "n", "t"])

    return cut


def hits_of(texts: DataFrame, listed: list[tuple[int, list[bytes]]], rank: int, cosine: float | None, covered: float, answered: float) -> DataFrame:
    """(key, item_id, cosine, ...) of the items of one block, in a space of their own."""
    vocabulary = {w: n + 1 for n, w in enumerate(sorted({w for _, ws in listed for w in ws}))}
    terms = len(vocabulary) + 1
    coded = stored(texts.select("key", coded_struct(vocabulary)(F.col("text"))["ids"].alias("ids")), "coded")
    vectors, weights = latent_terms(coded, terms, rank)
    items = [np.array([vocabulary[w] for w in ws]) for _, ws in listed]
    search = Search([i for i, _ in listed], items, vectors, weights, cosine, covered, answered)

    @F.pandas_udf(f"array<struct<{FOUND.replace(' ', ':').replace(',:', ',')}>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        for ids in batches:
            out = []
            for docs in in_chunks([pd.DataFrame({"ids": ids})], CHUNK):
                out += [[dict(zip(names, h, strict=True)) for h in hits] for hits in search.hits(docs)]
            yield pd.Series(out, index=ids.index)
        release_memory()

    return coded.select("key", F.explode(found("ids")).alias("h")).select("key", "h.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents in which no benchmark item was found; those with a null key stay."""
    bad = contaminated(docs, benchmark, key, text, **settings).select(F.col(key).alias("_bad")).where("_bad IS NOT NULL").distinct()
    return docs.join(bad, docs[key] == bad["_bad"], "left_anti")
