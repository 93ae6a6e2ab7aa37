"""Numeric kernels for equally long arrays, run inside tasks on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: sampling rate and frequency bands
SAMPLING_HZ = 50.0
BANDS = ((0.5, 2.0), (2.0, 5.0), (5.0, 10.0), (10.0, 20.0))

# fixed values: published Daubechies-4 decomposition low-pass taps
DB4_LOW = (
    -0.010597401784997278,
    0.032883011666982945,
    0.030841381835986965,
    -0.18703481171888114,
    -0.02798376941698385,
    0.6308807679295904,
    0.7148465705525415,
    0.23037781330885523,
)
# the high-pass taps mirror the low-pass ones with alternating signs
DB4_HIGH = tuple((-1.0) ** (k + 1) * DB4_LOW[7 - k] for k in range(8))


def _by_length(arrays: pd.Series, kernel) -> pd.Series:
    """Applies a kernel on (rows, length) blocks, one block per array length in the batch."""
    out = pd.Series([None] * len(arrays), index=arrays.index, dtype="object")
    lengths = arrays.map(lambda a: -1 if a is None else len(a))
    for length, part in arrays.groupby(lengths):
        if length > 0:
            block = np.array([np.asarray(a, dtype="float64") for a in part])
            out.loc[part.index] = pd.Series(list(kernel(block)), index=part.index)
    return out


def band_energy(fs: float = SAMPLING_HZ, bands=BANDS):
    """Array column to one energy per band: squared spectrum magnitudes summed over lo <= f < hi."""
    bounds = [tuple(b) for b in bands]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def udf(arrays: pd.Series) -> pd.Series:
        def kernel(x):
            power = np.abs(np.fft.rfft(x, axis=1)) ** 2
            freq = np.fft.rfftfreq(x.shape[1], d=1.0 / fs)
            return np.stack([power[:, (freq >= lo) & (freq < hi)].sum(axis=1) for lo, hi in bounds], axis=1)

        return _by_length(arrays, kernel)

    return udf


def amplitude():
    """Array column to the magnitudes of its positive-frequency half."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def udf(arrays: pd.Series) -> pd.Series:
        return _by_length(arrays, lambda x: np.abs(np.fft.fft(x, axis=1))[:, : x.shape[1] // 2])

    return udf


def _dwt_step(x: np.ndarray, taps) -> np.ndarray:
    """One decomposition step with mirrored edges, keeping every second output."""
    edge = len(taps) - 1
    padded = np.pad(x, ((0, 0), (edge, edge)), mode="symmetric")
    length = (x.shape[1] + edge) // 2
    starts = 2 * np.arange(length) + 1
    picks = starts[:, None] + edge - np.arange(len(taps))[None, :]
    return padded[:, picks] @ np.asarray(taps)


def wavelet_energy(level: int = 3):
    """Array column to energies of the coarse part, then of the details from coarse to fine."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def udf(arrays: pd.Series) -> pd.Series:
        def kernel(x):
            details = []
            for _ in range(level):
                details.append((_dwt_step(x, DB4_HIGH) ** 2).sum(axis=1))
                x = _dwt_step(x, DB4_LOW)
            return np.stack([(x**2).sum(axis=1), *reversed(details)], axis=1)

        return _by_length(arrays, kernel)

    return udf
