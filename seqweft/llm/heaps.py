"""Heaps of the best (score, id) of many rows at once; heaps of different tasks merge by rank."""

from __future__ import annotations

import numpy as np

LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Heaps:
    """The best `k` (score, id) of every row: higher scores first, equal ones by id."""

    def __init__(self, rows: int, k: int) -> None:
        self.k = k
        self.row, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(rows, LOWEST)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        row, score, ids = np.r_[self.row, row], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, ~score, row))  # ~s falls as s rises, and can't overflow
        row, score, ids = row[order], score[order], ids[order]
        firsts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(firsts, np.diff(np.r_[firsts, len(row)]))
        kept = place < self.k
        self.row, self.score, self.id = row[kept], score[kept], ids[kept]
        full = place == self.k - 1
        self.least[row[full]] = score[full]

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Adds those of a table of scores (rows by candidates) that may be among the best."""
        allowed = allowed & (scores >= self.least[rows][:, None])
        if np.count_nonzero(allowed) > 4 * self.k * len(rows) and scores.shape[1] > self.k:
            own = np.partition(np.where(allowed, scores, LOWEST), -self.k, axis=1)[:, -self.k]
            allowed &= scores >= own[:, None]
        at, which = np.nonzero(allowed)
        self.add(rows[at], scores[at, which], ids[which])
