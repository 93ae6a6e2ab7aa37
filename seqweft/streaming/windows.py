"""Sliding windows over sequences whose rows arrive in pieces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from seqweft.streaming.arrivals import InOrder, arriving


class WindowCutter(InOrder):
    """Keeps the rows that later windows still need, fewer than a width per sequence, and emits each full
    window once; with a stride beyond the width it also keeps how many coming rows lie between windows. A
    sequence shorter than the width gives its padded window when it ends."""

    def __init__(self, width: int, stride: int, channel: str, min_length: int, padding: float, keys: Sequence[str], patience: int | None = None):
        super().__init__([channel], keys, patience)
        self.width, self.stride, self.min_length, self.padding = width, stride, min_length, padding

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "base long, skip long, held array<double>")

    def rest(self) -> tuple[int, int, np.ndarray]:
        base, skip, held = self.kept.get() if self.kept.exists() else (0, 0, [])
        return int(base), int(skip), np.asarray(held, "float64")

    def take(self, key: Any, first: int, values: np.ndarray) -> Iterator[pd.DataFrame]:
        base, skip, held = self.rest()
        new = values[:, 0]
        values, skip = np.concatenate([held, new[skip:]]), max(0, skip - len(new))
        out = []
        while len(values) >= self.width:
            out.append((base, False, values[: self.width]))
            skip = max(0, self.stride - len(values))
            values, base = values[self.stride :], base + self.stride
        self.kept.update((base, skip, values.tolist()))
        return self.named(key, out, ["start_idx", "padded", *self.channels])

    def finish(self, key: Any) -> Iterator[pd.DataFrame]:
        base, _, values = self.rest()
        out = []
        if base == 0 and self.min_length <= len(values):
            out.append((0, True, np.pad(values, (0, self.width - len(values)), constant_values=self.padding)))
        return self.named(key, out, ["start_idx", "padded", *self.channels])

    def forget(self) -> None:
        self.kept.clear()


def stream_windows(
    stream: DataFrame,
    keys: Sequence[str],
    channel: str,
    width: int,
    stride: int,
    min_length: int = 10,
    padding: float = 0.0,
    time: str | None = None,
    patience: int | None = None,
    delay: str = "0 seconds",
) -> DataFrame:
    """Windows of a stream with columns keys, pos, the channel and `is_last` (true on a sequence's last row).

    Rows may come in any order and more than once; a window is emitted when all its rows are there. With
    an event `time`, a sequence of which nothing has come for `patience` milliseconds has ended: a short one
    then gives its padded window, and rows behind a gap follow on directly. Rows of an ended sequence are
    ignored until its mark goes with the timer; without a `time` there is no mark.
    """
    processor = WindowCutter(width, stride, channel, min_length, padding, keys, patience if time else None)
    return arriving(stream, processor, keys, [channel], f"start_idx long, padded boolean, {channel} array<double>", time, delay)
