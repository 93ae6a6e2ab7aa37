"""Features of windows (array columns) and of whole sequences (rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.functions.expressions import sample_kurtosis, sample_skew
from seqweft.functions.kernels import BANDS, SAMPLING_HZ, amplitude, band_energy, wavelet_energy
from seqweft.operators.ordered import IS_HOT, slice_columns
from seqweft.operators.quantiles import channel_quantiles
from seqweft.operators.spectrum import long_amplitudes

ZERO = 0.0


def _total(values: Column, term=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(ZERO), lambda acc, x: acc + term(x))


def _mean(values: Column) -> Column:
    return _total(values) / F.size(values)


def _spread(values: Column, mean: Column) -> Column:
    return F.sqrt(_total(values, lambda x: (x - mean) * (x - mean)) / F.size(values))


def window_statistics(windows: DataFrame, channels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Mean, population deviation, range, root mean square and energy per channel; with three or more
    channels also mean and deviation of the length of the first three as a vector."""
    vector = list(channels[:3]) if len(channels) >= 3 else []
    first = {f"_mean_{c}": _mean(F.col(c)) for c in channels}
    if vector:
        x, y, z = (F.col(c) for c in vector)
        first["_mag"] = F.zip_with(
            F.zip_with(x, y, lambda a, b: a * a + b * b), z, lambda ab, c: F.sqrt(ab + c * c)
        )
    base = windows.withColumns(first).withColumns(
        {f"_sq_{c}": _total(F.col(c), lambda x: x * x) for c in channels}
    )
    out: list[Column] = []
    for c in channels:
        values, energy = F.col(c), F.col(f"_sq_{c}")
        out += [
            F.col(f"_mean_{c}").alias(f"{c}_mean"),
            _spread(values, F.col(f"_mean_{c}")).alias(f"{c}_std_pop"),
            (F.array_max(values) - F.array_min(values)).alias(f"{c}_range"),
            F.sqrt(energy / F.size(values)).alias(f"{c}_rms"),
            energy.alias(f"{c}_energy"),
        ]
    if vector:
        base = base.withColumn("_mag_mean", _mean(F.col("_mag")))
        out += [F.col("_mag_mean").alias("mag_mean"), _spread(F.col("_mag"), F.col("_mag_mean")).alias("mag_std_pop")]
    return base.select(*keep, *out)


def window_peaks(windows: DataFrame, channels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Peaks per channel: runs of equal values above both neighbouring runs, edges excluded."""

    def without_repeats(values: Column) -> Column:
        return F.filter(values, lambda x, i: (i == 0) | (x != F.get(values, i - 1)))

    runs = windows.withColumns({f"_runs_{c}": without_repeats(F.col(c)) for c in channels})

    def count(c: str) -> Column:
        r = F.col(f"_runs_{c}")
        tops = F.filter(r, lambda x, i: (F.get(r, i - 1) < x) & (F.get(r, i + 1) < x))
        return F.size(tops).cast("long").alias(f"{c}_peaks")

    return runs.select(*keep, *[count(c) for c in channels])


def window_band_energy(
    windows: DataFrame,
    channels: Sequence[str],
    keep: Sequence[str],
    fs: float = SAMPLING_HZ,
    bands: Sequence[tuple[float, float]] = BANDS,
) -> DataFrame:
    kernel = band_energy(fs, bands)
    got = windows.select(*keep, *[kernel(F.col(c)).alias(f"_b_{c}") for c in channels])
    return got.select(
        *keep, *[F.get(f"_b_{c}", F.lit(i)).alias(f"{c}_band{i}") for i in range(len(bands)) for c in channels]
    )


def window_spectrum(
    windows: DataFrame, channel: str, keep: Sequence[str], fs: float = SAMPLING_HZ
) -> DataFrame:
    """Amplitudes over the positive half of the spectrum, one row per frequency."""
    width = F.size(channel)
    got = windows.select(*keep, width.alias("_w"), F.posexplode(amplitude()(F.col(channel))).alias("bin", "amplitude"))
    return got.select(*keep, "bin", (F.col("bin") * F.lit(float(fs)) / F.col("_w")).alias("frequency"), "amplitude")


def sequence_spectrum(
    df: DataFrame, keys: Sequence[str], channel: str, fs: float = SAMPLING_HZ, pos: str = "pos"
) -> DataFrame:
    """Amplitudes of whole sequences, missing values taken as 0.

    Sequences long enough to be sliced are transformed in short pieces (`long_amplitudes`), others in one.
    """
    if slice_columns(df):
        hot = long_amplitudes(df.where(IS_HOT), keys, channel, pos)
        frequency = F.col("bin") * F.lit(float(fs)) / F.col("length")
        cool = sequence_spectrum(df.where(f"NOT ({IS_HOT})").drop(*slice_columns(df)), keys, channel, fs, pos)
        return cool.unionByName(hot.select(*keys, "bin", frequency.alias("frequency"), "amplitude"))
    rows = F.sort_array(F.collect_list(F.struct(pos, F.coalesce(F.col(channel), F.lit(ZERO)).alias("v"))))
    whole = df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.col("_rows.v").alias(channel))
    return window_spectrum(whole, channel, keys, fs)


def window_wavelet_energy(
    windows: DataFrame, channels: Sequence[str], keep: Sequence[str], level: int = 3
) -> DataFrame:
    kernel = wavelet_energy(level)
    names = [f"a{level}", *[f"d{i}" for i in range(level, 0, -1)]]
    got = windows.select(*keep, *[kernel(F.col(c)).alias(f"_w_{c}") for c in channels])
    return got.select(*keep, *[F.get(f"_w_{c}", F.lit(i)).alias(f"{c}_{n}") for c in channels for i, n in enumerate(names)])


def window_features(windows: DataFrame, channels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """All window features side by side, in one projection over the arrays and without joins."""
    names = list(channels)
    out = window_statistics(windows, names, [*keep, *names])
    out = window_peaks(out, names, [c for c in out.columns])
    out = window_band_energy(out, names, [c for c in out.columns])
    out = window_wavelet_energy(out, names, [c for c in out.columns])
    return out.drop(*names)


def reconstruction_error(original: Column, rebuilt: Column) -> Column:
    """Mean squared difference of two arrays."""
    squares = F.zip_with(original, rebuilt, lambda a, b: (a - b) * (a - b))
    return _total(squares) / F.size(original)


# fixed values: the ten statistics per channel
STATISTICS = ("mean", "std", "min", "max", "median", "q25", "q75", "range", "skew", "kurtosis")


def channel_statistics(
    df: DataFrame, keys: Sequence[str], channels: Sequence[str], statistics: Sequence[str] = STATISTICS
) -> DataFrame:
    """Statistics per key and channel in long form; moments and quantiles come from the same scan."""
    moments = {
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "range": lambda v: F.max(v) - F.min(v),
        "skew": sample_skew,
        "kurtosis": sample_kurtosis,
    }
    probs = {n: p for n, p in {"median": 0.5, "q25": 0.25, "q75": 0.75}.items() if n in statistics}
    got = channel_quantiles(df, keys, channels, probs, {n: m for n, m in moments.items() if n in statistics})
    return got.select(*keys, "channel", *statistics)


def spread_statistics(
    stats: DataFrame, keys: Sequence[str], channels: Sequence[str], statistics: Sequence[str] = STATISTICS
) -> DataFrame:
    """Long statistics to one row per key with columns `<channel>_<statistic>`."""
    wide = stats.groupBy(*keys).pivot("channel", list(channels)).agg(*[F.first(s).alias(s) for s in statistics])
    return wide.select(*keys, *[f"{c}_{s}" for c in channels for s in statistics])
