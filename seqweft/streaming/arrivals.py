"""Sequences that arrive in pieces, in any order, put back into order in state.

A sequence's rows carry their position. Rows that come before their turn wait in a map of the state, in
slices of `SLICE` positions, so that no state row and no frame grows with the sequence; rows that repeat
a position already taken, or come after the end, change nothing. A sequence ends with the row marked as
its last, or when nothing of it has come for a while of event time: then what came is all there is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Positions of a state row, and output rows of a frame.
SLICE = 1024
FRAME = 256
PLACE = "next long, ended boolean, last long, timer long"


class InOrder(StatefulProcessor):
    """Hands on each sequence's rows in order, a bounded run at a time.

    A subclass says what to do with a run (`take`), at a sequence's end (`finish`), and what to forget (`forget`).
    """

    def __init__(self, channels: Sequence[str], keys: Sequence[str], patience: int | None) -> None:
        self.channels, self.keys, self.patience = list(channels), list(keys), patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE)
        self.waiting = handle.getMapState("waiting", "slice long", "at array<long>, held array<double>")

    def take(self, key: Any, first: int, values: np.ndarray) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def finish(self, key: Any) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def forget(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, ended, last, timer = self.place.get() if self.place.exists() else (0, False, None, None)
        latest = None
        for came in rows:
            if self.patience is not None:
                latest = max(filter(None, [latest, int(came["time"].max())]))
            if ended:
                continue
            if came["is_last"].any():
                last = int(came["pos"][came["is_last"]].min()) if last is None else last
            came = came[came["pos"] >= at].drop_duplicates("pos").sort_values("pos")
            places, values = came["pos"].to_numpy("int64"), came[self.channels].to_numpy("float64")
            # What joins on directly needs no state.
            run = int((places == at + np.arange(len(places))).sum()) if len(places) and places[0] == at else 0
            run = 0 if run and self.waiting.containsKey((at // SLICE,)) else run
            if run:
                yield from self.take(key, at, values[:run])
                at += run
            self.keep(places[run:], values[run:])
            for first, more in self.ready(at):
                yield from self.take(key, first, more)
                at = first + len(more)
        if not ended and last is not None and at > last:
            yield from self.finish(key)
            ended = True
            self.drop()
        if self.patience is None:
            # Nothing would ever remove the mark of an ended sequence.
            self.place.clear() if ended else self.place.update((at, ended, last, None))
            return
        due = max(filter(None, [timer, (latest or 0) + self.patience]))
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.place.update((at, ended, last, due))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.place.exists():
            at, ended, _, _ = self.place.get()
            seen = at
            if not ended:
                # Rows behind a gap that was never filled follow on directly.
                for slice_ in sorted(k[0] for k in self.waiting.keys()):
                    places, held = self.waiting.getValue((slice_,))
                    values = np.asarray(held, "float64").reshape(-1, len(self.channels))[np.asarray(places, "int64") >= seen]
                    yield from self.take(key, at, values)
                    at += len(values)
                yield from self.finish(key)
                self.drop()
            self.place.clear()

    def keep(self, places: np.ndarray, values: np.ndarray) -> None:
        """Puts rows aside by slice, in order; of rows that share a position the first stays."""
        for slice_ in np.unique(places // SLICE).tolist():
            own = places // SLICE == slice_
            at, held = places[own], values[own]
            if self.waiting.containsKey((slice_,)):
                old_at, old = self.waiting.getValue((slice_,))
                at = np.concatenate([np.asarray(old_at, "int64"), at])
                held = np.concatenate([np.asarray(old, "float64").reshape(-1, len(self.channels)), held])
                at, first = np.unique(at, return_index=True)
                held = held[first]
            self.waiting.updateValue((slice_,), (at.tolist(), held.reshape(-1).tolist()))

    def ready(self, at: int) -> Iterator[tuple[int, np.ndarray]]:
        """Runs of waiting rows that join on at the next position, one slice after another."""
        while self.waiting.containsKey((at // SLICE,)):
            slice_ = at // SLICE
            places, held = self.waiting.getValue((slice_,))
            places, values = np.asarray(places, "int64"), np.asarray(held, "float64").reshape(-1, len(self.channels))
            places, values = places[places >= at], values[places >= at]  # a repeat may have been taken already
            if not len(places):
                self.waiting.removeKey((slice_,))
                return
            run = int(np.searchsorted(places - np.arange(len(places)) > at, True)) if places[0] == at else 0
            if not run:
                return
            if run < len(places):
                self.waiting.updateValue((slice_,), (places[run:].tolist(), values[run:].reshape(-1).tolist()))
            else:
                self.waiting.removeKey((slice_,))
            yield at, values[:run]
            at += run

    def drop(self) -> None:
        for slice_ in [k[0] for k in self.waiting.keys()]:
            self.waiting.removeKey((slice_,))
        self.forget()

    def named(self, key: Any, rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
        """Frames of at most FRAME rows with the key's columns before the others."""
        for a in range(0, len(rows), FRAME):
            frame = pd.DataFrame(rows[a : a + FRAME], columns=columns)
            for name, value in zip(self.keys, key, strict=True):
                frame[name] = value
            yield frame[[*self.keys, *columns]]

    def close(self) -> None:
        pass


class Gatherer(InOrder):
    """Holds a sequence's rows back until it has ended, then gives all of them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.whole = handle.getMapState("whole", "slice long", "held array<double>")

    def take(self, key: Any, first: int, values: np.ndarray) -> Iterator[pd.DataFrame]:
        while len(values):
            slice_, room = first // SLICE, SLICE - first % SLICE
            before = list(self.whole.getValue((slice_,))[0]) if self.whole.containsKey((slice_,)) else []
            self.whole.updateValue((slice_,), ([*before, *values[:room].reshape(-1).tolist()],))
            first, values = first + min(room, len(values)), values[room:]
        return iter(())

    def finish(self, key: Any) -> Iterator[pd.DataFrame]:
        slices = sorted(k[0] for k in self.whole.keys())
        for slice_ in slices:
            values = np.asarray(self.whole.getValue((slice_,))[0], "float64").reshape(-1, len(self.channels))
            rows = [(slice_ * SLICE + i, *v) for i, v in enumerate(values.tolist())]
            yield from self.named(key, rows, ["pos", *self.channels])

    def forget(self) -> None:
        for slice_ in [k[0] for k in self.whole.keys()]:
            self.whole.removeKey((slice_,))


def arriving(
    stream: DataFrame, processor: InOrder, keys: Sequence[str], channels: Sequence[str], output: str, time: str | None, delay: str
) -> DataFrame:
    """The processor's output for a stream with columns keys, pos, channels, `is_last` and perhaps an event time.

    A row may come up to `delay` of event time after later ones; rows beyond that are dropped by the watermark.
    """
    key_types = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    rows = stream if time is None else stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    clock = [] if time is None else [F.unix_millis(time).alias("time"), time]
    rows = rows.select(*keys, "pos", *[F.col(c).cast("double").alias(c) for c in channels], "is_last", *clock)
    return rows.groupBy(*keys).transformWithStateInPandas(
        processor, outputStructType=f"{key_types}, {output}", outputMode="Append", timeMode="None" if time is None else "EventTime"
    )


def whole_sequences(
    stream: DataFrame, keys: Sequence[str], channels: Sequence[str], time: str | None = None, patience: int | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """(keys, pos, channels) of every sequence once it has ended, in order; a null reading is NaN here.

    `patience` milliseconds of event time after its latest row, a sequence without an end counts as ended.
    """
    processor = Gatherer(channels, keys, patience if time else None)
    return arriving(stream, processor, keys, channels, "pos long, " + ", ".join(f"{c} double" for c in channels), time, delay)
