"""Subword encoding by a table of last tokens, and decoding back to text.

A merge encoding has one last token for every prefix of a text. Going through the text, the automaton
gives all pieces that end at a position; the last token is the one piece whose pair with the last token
of what stands before it is stable, that is, encodes to itself. The ids are then read off backwards.
Texts are cut where no piece can cross (before a space mark, around characters outside the vocabulary),
and the ids of such segments are remembered in a cache of bounded size (two generations of `CACHED` segments of at
most 64 characters), which is emptied after every task.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import text_column, with_struct

SPACE = "▁"
CACHED = 150_000
PAIRS = 200_000
#: Characters of a text that are cut into segments at once.
SLICE = 1 << 16
NEVER = float("-inf")
SCHEMA = "ids binary, decoded string"
# Kinds of pieces in the model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as form

        model = form.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or any(p.type == USER for p in model.pieces):
            raise ValueError("only merge models with plain normalisation and without user-defined pieces are supported")
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        if model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models that remove extra white space are not supported")
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, UNUSED)}
        ids = {p.piece: i for i, p in enumerate(model.pieces)}
        self.ids = {p: ids[p] for p in self.scores}
        self.byte_ids = [ids.get(f"<0x{b:02X}>", model.trainer_spec.unk_id) for b in range(256)]
        self.unknown = model.trainer_spec.unk_id
        self.bytes_known = model.trainer_spec.byte_fallback
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.surface = [self._surface(p) for p in model.pieces]
        self.is_byte = [p.type == BYTE for p in model.pieces]
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.automaton = ahocorasick.Automaton()
        joined = {c for p in self.scores if len(p) > 1 for c in p} | {SPACE}
        for piece in self.scores.keys() | joined:
            self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.scores)
        letters = "".join(re.escape(c) for c in sorted(joined if crossing else joined - {SPACE}))
        self.cut = re.compile(f"[{letters}]+|." if crossing else f"{SPACE}*[{letters}]+|{SPACE}+|.", re.S)
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.packed_ids = {p: self.packed(self.spelled(p)) for p in self.scores.keys() | joined}
        self.history = lru_cache(len(self.packed_ids))(self._history)
        self.stable_pair = lru_cache(PAIRS)(self._stable_pair)

    @staticmethod
    def _surface(p) -> bytes:
        if p.type == BYTE:
            return bytes([int(p.piece[3:5], 16)])
        if p.type == CONTROL:
            return b""
        return " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode()

    def _history(self, token: str) -> tuple[tuple, tuple, tuple] | None:
        """A token's own merges, the best pair first, the leftmost of equals; None if they don't end in the token.

        Gives each merge's score and, from the start on, the first and the last part between merges.
        """
        scores, parts = self.scores, list(token)
        firsts, lasts, merges = [parts[0]], [parts[-1]], []
        pairs = [scores.get(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == NEVER:
                return None
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = scores.get(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = scores.get(parts[at] + parts[at + 1], NEVER)
            merges.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return tuple(merges), tuple(firsts), tuple(lasts)

    def _stable_pair(self, a: str, b: str) -> bool:
        """Whether two tokens side by side (or `b` alone) stay as they are when their text is merged.

        Up to the first merge across the border each side merges as it does alone, so it is enough to go
        through both sides' merges in order, holding the pair at the border against the next of each.
        """
        right = self.history(b)
        if not a or right is None:
            return right is not None
        left = self.history(a)
        if left is None:
            return False
        get = self.scores.get
        (own, _, lasts), (other, firsts, _) = left, right
        i = j = 0
        while True:
            across = get(lasts[i] + firsts[j], NEVER)
            x = own[i] if i < len(own) else NEVER
            y = other[j] if j < len(other) else NEVER
            if across > x and across >= y:
                return False
            if x == y == NEVER:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def segment(self, s: str) -> bytes:
        """The packed ids of a text without cut points: a last token for each prefix, then back from the end."""
        packed = self.packed_ids
        if len(s) == 1:
            return packed.get(s) or self.packed(self.spelled(s))
        pair, last, done = self.stable_pair, [""], -1
        for at, (token, length) in self.automaton.iter(s):
            if at != done and pair(last[at + 1 - length], token):
                last.append(token)
                done = at
        out: list[bytes] = []
        stop = len(s)
        while stop:
            token = last[stop]
            out.append(packed[token])
            stop -= len(token)
        out.reverse()
        return b"".join(out)

    def spelled(self, token: str) -> list[int]:
        known = self.ids.get(token)
        if known is not None:
            return [known]
        return [self.byte_ids[b] for b in token.encode()] if self.bytes_known else [self.unknown]

    def segments(self, text: str) -> Iterator[list[str]]:
        """The segments of a text, those of about SLICE characters at a time."""
        at, size = 0, SLICE
        while at < len(text):
            found = self.cut.findall(text, at, at + size)
            if at + size >= len(text):
                at = len(text)
            elif len(found) > 1:  # the last one may go on
                at, size = at + size - len(found.pop()), SLICE
            else:
                size *= 2
                continue
            yield found

    def encode(self, text: str) -> bytes:
        """All ids, begin and end included, as little-endian unsigned 32-bit integers."""
        out = [self.packed([self.begin])]
        if text:
            for found in self.segments(self.prefix + text.replace(" ", SPACE)):
                recent, older, long = self.recent, self.older, []
                for s in set(found).difference(recent):
                    recent[s] = older.get(s) or self.segment(s)
                    if len(s) > 64:
                        long.append(s)
                out += map(recent.__getitem__, found)
                for s in long:
                    del recent[s]
                if len(recent) > CACHED:
                    self.recent, self.older = {}, recent
        out.append(self.packed([self.end]))
        return b"".join(out)

    def forget(self) -> None:
        """Empties the caches."""
        self.recent, self.older = {}, {}
        self.stable_pair.cache_clear()
        self.history.cache_clear()

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        said = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        first = next((i for i in ids if i not in self.silent), None)
        marked = self.prefix and first is not None and not self.is_byte[first] and first != self.unknown
        return said[1:] if marked and said.startswith(" ") else said


@lru_cache(2)
def model(path: str) -> Pieces:
    return Pieces(path)


def token_struct(path: str):
    def coded(texts):
        pieces = model(path)
        ids = [pieces.encode(t or "") for t in texts]
        return pd.DataFrame({"ids": ids, "decoded": [pieces.decode(i) for i in ids]})

    return text_column(coded, SCHEMA, lambda: model(path).forget())


def checked_struct(path: str):
    """Ids, and whether they decode to the text; the decoded text stays in the worker."""

    def coded(texts):
        pieces = model(path)
        ids = [pieces.encode(t or "") for t in texts]
        return pd.DataFrame({"ids": ids, "exact": [pieces.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]})

    return text_column(coded, "ids binary, exact boolean", lambda: model(path).forget())


def encode_checked(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds `ids` as `encode_decode` does, and `exact`: whether they decode to the text (a null one counts as empty)."""
    return with_struct(df, checked_struct(path)(F.col(text).cast("string")), ["ids", "exact"])


def encode_decode(df: DataFrame, path: str, text: Column | str = "text") -> DataFrame:
    """Adds `ids` (little-endian unsigned 32-bit integers, begin and end included) and `decoded`.

    A null or empty text has the ids begin and end, and decodes to an empty text. Rows are independent:
    repeated rows repeat their result, an empty table stays empty, columns named like the new ones are
    replaced. `ids_array` turns packed ids into an array. A very long text without any cut point is one
    segment, handled in time linear in its length.
    """
    column = F.col(text) if isinstance(text, str) else text
    return with_struct(df, token_struct(path)(column.cast("string")), ["ids", "decoded"])


def ids_array(packed: Column) -> Column:
    """Packed ids as array<int>, without Python."""
    numbers = F.sequence(F.lit(0), F.floor(F.length(packed) / 4).cast("int") - 1)
    swapped = lambda b: F.concat(*[F.substring(F.hex(b), k, 2) for k in (7, 5, 3, 1)])
    ids = F.transform(numbers, lambda i: F.conv(swapped(F.substring(packed, i * 4 + 1, F.lit(4))), 16, 10).cast("int"))
    return F.when(F.length(packed) >= 4, ids).otherwise(F.array().cast("array<int>"))
