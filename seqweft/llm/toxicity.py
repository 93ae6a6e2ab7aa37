"""Toxicity of texts by a gated recurrent network over words and characters.

The network scores overlapping windows of words; a text's score is that of its worst window, so a long
text is not excused by its length. It is trained on a bounded sample of labelled texts, whose label says
only that some window of the text is toxic: a text's windows share its label in proportion to their scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.llm import gated
from seqweft.llm.common import fresh, release_memory, small_batches, with_struct

#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 64, 48
WORDS, GRAMS, STEMS, WIDE, HIDDEN = 8192, 4096, 1 << 14, 16, 16
#: Bytes of a word's beginning that may speak by themselves.
STEM_BYTES = (4, 12)
#: Windows that go through the network together, and bytes of text that are cut together.
AT_ONCE = 256
BYTES = 1 << 20
#: Standard errors that a word's odds must lie from nothing to be where learning starts from.
SURE = 2.5
#: Share of the pace by which weights shrink at every step.
SHRINK = 0.1
#: Log odds of a text without a word.
SILENT = -4.0
#: Windows of a training step.
BATCH = 192
SLOTS = 16
SCHEMA = "score double, predicted int"
_LETTER = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_BASE, _ODD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(256, _BASE, np.uint64))


class Cut:
    """Words of some texts: a number among the distinct ones, whose hashes and characters are kept once."""

    def __init__(self, texts: list[str | None]) -> None:
        said = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        flat = np.frombuffer(b" ".join([*said, b" "]), np.uint8)
        letter = _LETTER[flat]
        edges = np.flatnonzero(np.diff(np.r_[False, letter].astype(np.int8)))
        begins, ends = edges[::2], edges[1::2]
        self.firsts = np.searchsorted(begins, np.cumsum([0, *[len(s) + 1 for s in said]]))  # words before each text's beginning
        first, self.words = self.distinct(flat, begins, ends)
        self.characters(flat, begins[first], ends[first])

    def distinct(self, flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place of every distinct word, and each word's number among these."""
        at, starts, place = spread(begins, ends)
        hashes = self.mixed(flat[at], place)
        whole = np.add.reduceat(hashes, starts) * _ODD if len(starts) else np.empty(0, np.uint64)
        self.hashes, first, words = np.unique(whole, return_index=True, return_inverse=True)
        return first, words

    @staticmethod
    def mixed(characters: np.ndarray, place: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (characters.astype(np.uint64) + np.uint64(7)) * _POWERS[place & 255] * (np.uint64(1) + (place >> 8).astype(np.uint64))

    def characters(self, flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """For every character of the distinct words its trigram, 0 standing beside the word, and the beginning up to it."""
        at, self.starts, place = spread(begins, ends)
        inside = flat[at].astype(np.uint32)
        size = np.repeat(ends - begins, ends - begins)
        before, after = np.where(place > 0, np.roll(inside, 1), 0).astype(np.uint32), np.where(place < size - 1, np.roll(inside, -1), 0).astype(np.uint32)
        mixed = ((before * np.uint32(0x01000193) + inside) * np.uint32(0x85EBCA6B) + after) * np.uint32(0xC2B2AE35)
        self.grams = (mixed >> np.uint32(32 - GRAMS.bit_length() + 1)).astype(np.int64)
        hashes = np.cumsum(self.mixed(inside, place))
        until = hashes - np.repeat(np.r_[np.uint64(0), hashes][self.starts], ends - begins)
        stems = (until * _ODD >> np.uint64(64 - STEMS.bit_length() + 1)).astype(np.int64)
        self.stems = np.where((place + 1 >= STEM_BYTES[0]) & (place < STEM_BYTES[1]), np.maximum(stems, 1), 0)


def spread(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all characters of some words, where each word begins among these, and the characters' places in their words."""
    sizes = ends - begins
    starts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    return np.repeat(begins, sizes) + place, starts, place


class Vocabulary:
    """Numbers of known words by their hash, from 1; 0 is any other word."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.r_[np.uint64(0), hashes.astype(np.uint64)]
        self.slots = np.zeros(1 << SLOTS, np.int64)
        where = (self.hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.slots[where[:0:-1]] = np.arange(len(hashes), 0, -1)  # of two in one slot the first stays

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = self.slots[(hashes >> np.uint64(64 - SLOTS)).astype(np.int64)]
        return np.where(self.hashes[at] == hashes, at, 0)


def windows_of(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts whose words begin at `firsts`: each window's text, first word and number of words.

    A text without words has one empty window.
    """
    lengths = np.diff(firsts)
    many = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(lengths)), many)
    begin = firsts[owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
    return owner, begin, np.minimum(WINDOW, firsts[owner + 1] - begin)


class Model:
    """A trained network with its vocabulary."""

    def __init__(self, params: gated.Params, vocabulary: Vocabulary, shift: float = 0.0) -> None:
        self.params, self.vocabulary, self.shift = params, vocabulary, shift

    def features(self, cut: Cut) -> np.ndarray:
        """Gate inputs of every distinct word; one more row, for places without a word, keeps the state."""
        words = self.params["word"][self.vocabulary.numbers(cut.hashes)]
        both = np.concatenate([words, gated.spelled(self.params, cut.grams, cut.stems, cut.starts)], axis=1)
        return np.concatenate([gated.inputs(self.params, both), nothing(self.params)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The worst window's score of each text, as log odds."""
        cut = Cut(texts)
        rows = self.features(cut)
        owner, begin, size = windows_of(cut.firsts)
        out = np.full(len(texts), -np.inf)
        order = np.argsort(size, kind="stable")  # windows of like length run together
        for a in range(0, len(order), AT_ONCE):
            some = order[a : a + AT_ONCE]
            x, there, _ = laid_out(rows, cut.words, begin[some], size[some])
            np.maximum.at(out, owner[some], gated.run(self.params, x, there)[0].astype(float))
        return np.where(np.diff(cut.firsts[: len(texts) + 1]) > 0, out - self.shift, SILENT)


def nothing(p: gated.Params) -> np.ndarray:
    hidden = p["state"].shape[2]
    row = np.zeros((2, 3 * hidden), np.float32)
    row[:, :hidden] = gated.SHUT
    return row.reshape(1, -1)


def laid_out(rows: np.ndarray, words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gate inputs (length, 2, 3 * hidden, windows) of windows over words, which words are there, and their rows."""
    length = max(1, int(size.max()))
    there = np.arange(length)[:, None] < size
    at = np.full(there.shape, len(rows) - 1)
    at[there] = words[(begin + np.arange(length)[:, None])[there]]
    x = np.ascontiguousarray(rows[at].transpose(0, 2, 1))
    return x.reshape(length, 2, -1, len(begin)), there, at


def in_pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in lists of about BYTES characters; a longer text is a list of its own."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


# --- training


def log_odds(present: list[np.ndarray], labels: np.ndarray, least: int = 3) -> dict[int, tuple[int, float]]:
    """For each thing that stands in `least` or more texts their number, and how much its presence speaks for label 1."""
    things, counts = np.unique(np.concatenate([p for p, y in zip(present, labels, strict=True) if y] or [np.empty(0, np.int64)]), return_counts=True)
    ones = dict(zip(things.tolist(), counts.tolist(), strict=True))
    things, counts = np.unique(np.concatenate(present), return_counts=True)
    n1, n0 = int(labels.sum()), int((labels == 0).sum())
    out = {}
    for x, n in zip(things.tolist(), counts.tolist(), strict=True):
        if n >= least:
            one = ones.get(x, 0)
            odds = float(np.log((one + 0.5) / (n1 + 1)) - np.log((n - one + 0.5) / (n0 + 1)))
            sure = abs(odds) > SURE * np.sqrt(1 / (one + 0.5) + 1 / (n - one + 0.5))
            out[x] = n, odds if sure else 0.0
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 17) -> Model:
    """A model fitted to texts and their labels; the same rows give the same model.

    A fifth of the texts isn't trained on: on these the point between the classes is set.
    """
    rng = np.random.default_rng(seed)
    cuts = [Cut([t]) for t in texts]
    words = log_odds([c.hashes for c in cuts], labels)
    hashes = sorted(words, key=lambda h: (-words[h][0], h))[: WORDS - 1]
    vocabulary = Vocabulary(np.array(hashes, np.uint64))
    p = gated.start(len(hashes) + 1, GRAMS, STEMS, WIDE, HIDDEN, rng)
    # Learning starts from what the presence of a word or a beginning alone says.
    p["word"][1:, 0] = [words[h][1] for h in hashes]
    p["stem"][:, 0] = 0
    for stem, (_, odds) in log_odds([np.unique(c.stems) for c in cuts], labels).items():
        p["stem"][stem, 0] = odds if stem else 0
    model = Model(p, vocabulary)
    order = rng.permutation(len(texts))
    checked, learned = order[: len(order) // 5], order[len(order) // 5 :]
    bags = [(cuts[i], int(labels[i])) for i in learned]
    sizes = np.array([len(windows_of(c.firsts)[0]) for c, _ in bags])
    steps = epochs * -(-int(sizes.sum()) // BATCH)
    adam = gated.Adam(p, steps, rate, SHRINK)
    for _ in range(epochs):
        held, size = [], 0
        for i in rng.permutation(len(bags)):
            held.append(bags[i])
            size += sizes[i]
            if size >= BATCH:
                adam.move(gradients(model, held, rng))
                held, size = [], 0
        if held:
            adam.move(gradients(model, held, rng))
    model.shift = between(model, [texts[i] for i in order], labels[order], len(checked))
    return model


def gradients(model: Model, bags: list[tuple[Cut, int]], rng: np.random.Generator) -> gated.Params:
    """Gradients of the mean cross entropy of some texts' scores."""
    p = model.params
    numbers = np.concatenate([model.vocabulary.numbers(c.hashes) for c, _ in bags])
    numbers[rng.random(len(numbers)) < 0.1] = 0  # so that spelling has to speak too
    grams, stems = np.concatenate([c.grams for c, _ in bags]), np.concatenate([c.stems for c, _ in bags])
    before = lambda sizes: np.cumsum([0, *sizes])
    starts = np.concatenate([c.starts + s for (c, _), s in zip(bags, before([len(c.grams) for c, _ in bags]), strict=False)])
    words = np.concatenate([c.words + s for (c, _), s in zip(bags, before([len(c.hashes) for c, _ in bags]), strict=False)])
    firsts = before([len(c.words) for c, _ in bags])
    features = np.concatenate([p["word"][numbers], gated.spelled(p, grams, stems, starts)], axis=1)
    rows = np.concatenate([gated.inputs(p, features), nothing(p)])
    owner, begin, size = windows_of(firsts)
    x, there, at = laid_out(rows, words, begin, size)
    scores, memory = gated.run(p, x, there, keep=True)
    worst = np.full(len(bags), -np.inf, np.float32)
    np.maximum.at(worst, owner, scores)
    part = np.exp(scores - worst[owner])
    part /= np.bincount(owner, part, len(bags))[owner]
    said = np.bincount(owner, part * scores, len(bags))
    wrong = 1 / (1 + np.exp(-said)) - np.array([label for _, label in bags])
    slope = (part * wrong[owner] / len(bags)).astype(np.float32)
    g, given = gated.back(p, slope, memory)
    given = given.reshape(len(there), -1, len(owner)).transpose(0, 2, 1)[there]
    by_word = gated.summed(given, at[there], len(features))
    g["in"] = (by_word.T @ features).reshape(p["in"].shape)
    g["gate"] = by_word.sum(axis=0).reshape(p["gate"].shape)
    inner = by_word @ p["in"].reshape(given.shape[1], -1)
    g["word"] = gated.summed(inner[:, :WIDE], numbers, len(p["word"]))
    lengths = np.diff(np.r_[starts, len(grams)])
    by_character = np.repeat(inner[:, WIDE:] / np.maximum(1, lengths)[:, None], lengths, axis=0)
    g["gram"], g["stem"] = gated.summed(by_character, grams, len(p["gram"])), gated.summed(by_character, stems, len(p["stem"]))
    g["word"][0] = g["stem"][0] = 0
    return g


def between(model: Model, texts: list[str], labels: np.ndarray, checked: int) -> float:
    """The score that best parts the classes on the texts that weren't trained on, or on all if these lack a class."""
    if len(set(labels[:checked].tolist())) == 2:
        texts, labels = texts[:checked], labels[:checked]
    scores = np.concatenate([model.scores(piece) for piece in in_pieces(texts)])
    order = np.argsort(scores)
    ordered, truth = scores[order], labels[order]
    ups, downs = max(1, int(truth.sum())), max(1, int((truth == 0).sum()))
    # Cutting before place k: the clean ones below and the toxic ones from there on are right.
    right = np.r_[0, np.cumsum(truth == 0)] / downs + (truth.sum() - np.r_[0, np.cumsum(truth)]) / ups
    best = np.flatnonzero(right >= right.max() - 1e-12)
    k = int(best[len(best) // 2])
    low, high = ordered[max(0, k - 1)], ordered[min(k, len(ordered) - 1)]
    return float((low + high) / 2)


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = 800, chars: int = 20_000) -> Model | None:
    """Trains on at most `sample` labelled texts of each class, with up to `chars` characters each.

    They are those with the smallest hash of the key, so the bound holds for tables of any size and every run
    takes the same rows. A key with several labels has the highest. None if a class has no text.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    rows = rows.select("key", "label", F.xxhash64("key").alias("h"))
    chosen = [r for one in (0, 1) for r in rows.where(F.col("label") == one).orderBy("h", "key").limit(sample).collect()]
    if len({r.label for r in chosen}) < 2:
        return None
    truth = {r.key: r.label for r in chosen}
    said = docs.where(F.col(key).isin(list(truth)) & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.substring(text, 1, chars).alias("text"))
    found = sorted((r.key, r.text) for r in said.groupBy("key").agg(F.min("text").alias("text")).collect())
    truths = np.array([truth[k] for k, _ in found])
    if len(set(truths.tolist())) < 2:
        return None
    return train([t for _, t in found], truths)


# --- whole texts


def toxicity_struct(model: Model | None):
    small_batches()

    @F.pandas_udf(SCHEMA)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if model is None:
                scores = np.zeros(len(batch))
            else:
                odds = [model.scores(piece) for piece in in_pieces(batch.tolist())]
                scores = 1 / (1 + np.exp(-np.clip(np.concatenate(odds), -60, 60))) if odds else np.zeros(0)
            yield pd.DataFrame({"score": scores, "predicted": (scores >= 0.5).astype(np.int32)})
        release_memory()

    return scored


def score_toxicity(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds `score` (0 to 1, of the worst window) and `predicted` (1 from 0.5 on).

    A null or empty text, or one without a word, has the score of SILENT, 0.018. Without a model, because a
    class had no labelled text, every score is 0. Rows are independent: repeated rows repeat their score,
    columns named like the new ones are replaced, an empty table stays empty. Every window of a text is
    read, however long it is.
    """
    return with_struct(df, toxicity_struct(model)(F.col(text).cast("string")), ["score", "predicted"])


def held_out(key: Column) -> Column:
    """Rows kept for measuring: the key's checksum is divisible by 5; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_and_score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 800) -> DataFrame:
    """Learns from labelled rows that aren't held out and scores every row; adds `held_out`."""
    (hold,) = fresh(docs, "held_out")
    model = learn(docs, labels.where(~held_out(F.col(key))), key, text, label, sample)
    return score_toxicity(docs.withColumn(hold, held_out(F.col(key))), model, text)
