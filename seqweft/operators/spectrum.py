"""Fourier transforms of sequences of any length, as two rounds of short transforms.

A transform of length a * b splits into b transforms of length a over every b-th value, a rotation, and a
transforms of length b: two shuffles whose groups hold about the root of the length. Lengths that don't split
are carried by a chirp: the transform is a convolution, done at a padded power of two.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transformed(df: DataFrame, keys: Sequence[str], back: bool = False) -> DataFrame:
    """(keys, m, n, re, im) to its discrete Fourier transform; `m`, a power of two, is the key's length.

    Places `n` that have no row count as 0. `back` gives the inverse.
    """
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, m long, n long, re double, im double"
    sign = 1.0 if back else -1.0

    def sides(m: int) -> tuple[int, int]:
        a = 1 << (int(m).bit_length() // 2)
        return a, m // a

    def filled(frame: pd.DataFrame, at: np.ndarray, size: int) -> np.ndarray:
        x = np.zeros(size, complex)
        x[at] = frame["re"].to_numpy() + 1j * frame["im"].to_numpy()
        return np.fft.ifft(x) * size if back else np.fft.fft(x)

    def rows(frame: pd.DataFrame, n: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        out = {k: frame[k].iloc[0] for k in keys} | {"m": frame["m"].iloc[0], "n": n, "re": x.real, "im": x.imag}
        return pd.DataFrame(out)

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        m = int(frame["m"].iloc[0])
        a, b = sides(m)
        place = int(frame["n"].iloc[0]) % b
        k = np.arange(a)
        x = filled(frame, frame["n"].to_numpy() // b, a) * np.exp(sign * 2j * np.pi * (place * k % m) / m)
        return rows(frame, k * b + place, x)

    def second(frame: pd.DataFrame) -> pd.DataFrame:
        m = int(frame["m"].iloc[0])
        a, b = sides(m)
        k = int(frame["n"].iloc[0]) // b
        x = filled(frame, frame["n"].to_numpy() % b, b)
        return rows(frame, k + a * np.arange(b), x / m if back else x)

    # the same rule as `sides`: bits of m, halved
    a = F.expr("shiftleft(1L, CAST(floor(length(bin(m)) / 2) AS INT))")
    short = F.floor(F.col("m") / a)
    once = df.withColumn("_g", F.col("n") % short).groupBy(*keys, "m", "_g").applyInPandas(lambda f: first(f.drop(columns="_g")), schema)
    return once.withColumn("_g", F.floor(F.col("n") / short)).groupBy(*keys, "m", "_g").applyInPandas(lambda f: second(f.drop(columns="_g")), schema)


def _turn(n: Column, length: Column, sign: float) -> tuple[Column, Column]:
    """exp(sign * i * pi * n^2 / length), with the square reduced before it loses digits."""
    angle = F.lit(sign * np.pi) * ((n * n) % (2 * length)) / length
    return F.cos(angle), F.sin(angle)


def _times(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def long_amplitudes(df: DataFrame, keys: Sequence[str], value: str, pos: str = "pos") -> DataFrame:
    """(keys, length, bin, amplitude) over the lower half of the spectrum of whole sequences of any length.

    Positions run from 0 without gaps; missing values count as 0. No group is larger than about twice the
    root of the length.
    """
    lengths = df.groupBy(*keys).agg((F.max(pos) + 1).cast("long").alias("length"))
    lengths = lengths.withColumn("m", F.expr("shiftleft(1L, CAST(length(bin(2 * length - 1)) AS INT))"))
    n, size = F.col("n"), F.col("length")
    named = [F.col(k) for k in keys]
    known = df.select(*named, F.col(pos).cast("long").alias("n"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    down, up = _turn(n, size, -1.0), _turn(n, size, 1.0)
    signal = known.join(lengths, list(keys)).select(*named, "m", "n", (F.col("v") * down[0]).alias("re"), (F.col("v") * down[1]).alias("im"))
    chirp = known.join(lengths, list(keys)).select(*named, "m", "length", "n")
    chirp = chirp.select(*named, "m", up[0].alias("re"), up[1].alias("im"), F.explode(F.when(n == 0, F.array(n)).otherwise(F.array(n, F.col("m") - n))).alias("n"))
    chirp = chirp.select(*named, "m", "n", "re", "im")
    by = [*keys, "m", "n"]
    a = transformed(signal, keys).withColumnsRenamed({"re": "re1", "im": "im1"})
    both = a.join(transformed(chirp, keys), by)
    product = _times((F.col("re1"), F.col("im1")), (F.col("re"), F.col("im")))
    folded = transformed(both.select(*by, product[0].alias("re"), product[1].alias("im")), keys, back=True)
    out = folded.drop("m").join(lengths, list(keys)).where(n < F.floor(size / 2))
    # the last turn has size one and leaves the amplitude as it is
    return out.select(*named, "length", n.cast("int").alias("bin"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("amplitude"))
