"""Window, spectrum, wavelet, grid and sequence features (G, A1, A2, A23)."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from seqweft.functions.channels import pixel_grid, pixel_parts, to_long
from seqweft.functions.kernels import BANDS, DB4_HIGH, DB4_LOW
from seqweft.operators import features as feat
from seqweft.operators.sequences import signal_summary
from seqweft.plans.adapters import (
    EVENT_KEYS,
    EVENTS_SQL,
    GAPPY_SQL,
    GRID_SQL,
    LINE_CHANNELS,
    LINE_KEYS,
    LINE_ORDER,
    LINES_SQL,
    events,
    gappy_events,
    grid,
    line_channels,
    lines,
    table,
)
from seqweft.plans.registry import query
from seqweft.plans.window_queries import WINDOW_ID, WINDOWS_SQL, event_windows, windows_sql
from seqweft.operators.windows import sliding_windows


def rounded(df, keep, digits=6):
    """Rounds every other double column, as sums differ in their last digits with the order of addition."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


# one row per window and position, as a base for SQL statistics
POINTS_SQL = f"""{WINDOWS_SQL},
pt AS (SELECT user_id, start_idx, t, value[t + 1] AS value, k[t + 1] AS k FROM w, range(0, 64) AS g(t))"""


def _stats_sql(c: str) -> str:
    return f"""round(avg({c}), 8) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std_pop,
    max({c}) - min({c}) AS {c}_range, round(sqrt(avg({c} * {c})), 6) AS {c}_rms, round(sum({c} * {c}), 4) AS {c}_energy"""


def _stats_rounded(df):
    # means of 64 or 128 values with two decimals are exact at eight digits, so no value lies on a tie
    digits = {"_mean": 8, "_std_pop": 6, "_rms": 6, "_energy": 4}
    return df.withColumns({c: F.round(c, d) for c in df.columns for e, d in digits.items() if c.endswith(e)} | (
        {"mag_mean": F.round("mag_mean", 6)} if "mag_mean" in df.columns else {}))


@query(
    "g1_window_statistics",
    f"""WITH {LINES_SQL}, {windows_sql('ln', 'l_suppkey', LINE_CHANNELS, 128, 64, 10, 'w')},
    pt AS (SELECT l_suppkey, start_idx, {", ".join(f"{c}[t + 1] AS {c}" for c in LINE_CHANNELS)},
           sqrt({" + ".join(f"{c}[t + 1] * {c}[t + 1]" for c in LINE_CHANNELS[:3])}) AS mag FROM w, range(0, 128) AS g(t))
    SELECT l_suppkey, start_idx, {", ".join(_stats_sql(c) for c in LINE_CHANNELS)},
           round(avg(mag), 6) AS mag_mean, round(stddev_pop(mag), 6) AS mag_std_pop
    FROM pt GROUP BY l_suppkey, start_idx""",
)
def window_statistics(spark, sf):
    got = sliding_windows(lines(spark, sf), LINE_KEYS, LINE_CHANNELS, (128, 64))
    out = feat.window_statistics(got, LINE_CHANNELS, ["l_suppkey", "start_idx"])
    return _stats_rounded(out)


_BAND_CASES = ", ".join(
    f"round(sum(CASE WHEN f >= {lo} AND f < {hi} THEN p_{{c}} ELSE 0 END), 2) AS {{c}}_band{i}"
    for i, (lo, hi) in enumerate(BANDS)
)
SPECTRUM_SQL = f"""{POINTS_SQL},
tw AS (SELECT b, t, cos(2 * pi() * b * t / 64) AS c, sin(2 * pi() * b * t / 64) AS s
       FROM range(0, 33) AS x(b), range(0, 64) AS y(t)),
sp AS (SELECT user_id, start_idx, b, b * 50.0::DOUBLE / 64 AS f,
              pow(sum(value * c), 2) + pow(sum(value * s), 2) AS p_value,
              pow(sum(k * c), 2) + pow(sum(k * s), 2) AS p_k
       FROM pt JOIN tw USING (t) GROUP BY user_id, start_idx, b)"""


@query(
    "g2_band_energy",
    f"WITH {SPECTRUM_SQL} SELECT user_id, start_idx, {_BAND_CASES.replace('{c}', 'value')}, "
    f"{_BAND_CASES.replace('{c}', 'k')} FROM sp GROUP BY user_id, start_idx",
)
def band_energy(spark, sf):
    out = feat.window_band_energy(event_windows(spark, sf), ["value", "k"], WINDOW_ID)
    return rounded(out, WINDOW_ID, 2)


@query(
    "g3_amplitude_spectrum",
    f"""WITH {SPECTRUM_SQL} SELECT user_id, start_idx, CAST(b AS INTEGER) AS bin, f AS frequency,
        round(sqrt(p_value), 5) AS amplitude FROM sp WHERE b < 32""",
)
def amplitude_spectrum(spark, sf):
    out = feat.window_spectrum(event_windows(spark, sf), "value", WINDOW_ID)
    return out.withColumn("amplitude", F.round("amplitude", 5))


@query(
    "g3_sequence_spectrum",
    f"""WITH {EVENTS_SQL}, b AS (SELECT DISTINCT user_id, seq_len, unnest(range(0, seq_len // 2)) AS bin FROM ev)
    SELECT user_id, CAST(bin AS INTEGER) AS bin, bin * 50.0::DOUBLE / any_value(ev.seq_len) AS frequency,
           round(sqrt(pow(sum(value * cos(2 * pi() * bin * pos / ev.seq_len)), 2)
                    + pow(sum(value * sin(2 * pi() * bin * pos / ev.seq_len)), 2)), 5) AS amplitude
    FROM ev JOIN b USING (user_id) GROUP BY user_id, bin""",
)
def sequence_spectrum(spark, sf):
    out = feat.sequence_spectrum(events(spark, sf), EVENT_KEYS, "value")
    return out.withColumn("amplitude", F.round("amplitude", 5))


def _taps(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def wavelet_sql(source: str, column: str) -> str:
    """SQL for three decomposition steps: mirrored edges, eight taps, every second output."""
    out, previous, size = [], f"SELECT user_id, start_idx, {column} AS x FROM {source}", 64
    for level in (1, 2, 3):
        length = (size + 7) // 2
        out.append(
            f"""dw{level}i AS ({previous}),
dw{level} AS (
  SELECT user_id, start_idx,
    list_transform(range(0, {length}), lambda i: list_sum(list_transform(range(0, 8), lambda j:
      {_taps(DB4_LOW)}[j + 1] * x[CASE WHEN 2 * i + 1 - j < 0 THEN j - 2 * i - 2
        WHEN 2 * i + 1 - j >= {size} THEN {2 * size - 1} - (2 * i + 1 - j) ELSE 2 * i + 1 - j END + 1]))) AS x,
    list_sum(list_transform(range(0, {length}), lambda i: pow(list_sum(list_transform(range(0, 8), lambda j:
      {_taps(DB4_HIGH)}[j + 1] * x[CASE WHEN 2 * i + 1 - j < 0 THEN j - 2 * i - 2
        WHEN 2 * i + 1 - j >= {size} THEN {2 * size - 1} - (2 * i + 1 - j) ELSE 2 * i + 1 - j END + 1])), 2))) AS d
  FROM dw{level}i)"""
        )
        previous, size = f"SELECT user_id, start_idx, x FROM dw{level}", length
    return ",\n".join(out)


WAVELET_SQL = f"""{WINDOWS_SQL}, {wavelet_sql('w', 'value')},
wv AS (SELECT user_id, start_idx, list_sum(list_transform(dw3.x, lambda v: v * v)) AS a3, dw3.d AS d3, dw2.d AS d2, dw1.d AS d1
       FROM dw1 JOIN dw2 USING (user_id, start_idx) JOIN dw3 USING (user_id, start_idx))"""


@query(
    "g4_wavelet_energy",
    f"""WITH {WAVELET_SQL} SELECT user_id, start_idx, round(a3, 3) AS value_a3, round(d3, 3) AS value_d3,
        round(d2, 3) AS value_d2, round(d1, 3) AS value_d1 FROM wv""",
)
def wavelet_energy(spark, sf):
    out = feat.window_wavelet_energy(event_windows(spark, sf), ["value"], WINDOW_ID)
    return rounded(out, WINDOW_ID, 3)


@query(
    "g5_pixel_grid",
    f"""WITH {GRID_SQL} SELECT vec_id, CAST(1 AS INTEGER) AS sensor, CAST(pixel AS INTEGER) AS pixel,
        CAST(pixel // 8 AS INTEGER) AS "row", CAST(pixel % 8 AS INTEGER) AS col,
        CASE WHEN value = -1.0 THEN 0.0 ELSE value END AS value FROM gr""",
)
def pixel_grid_long(spark, sf):
    df = grid(spark, sf)
    long = to_long(df, ["vec_id"], [c for c in df.columns if c.startswith("tof_")])
    parts = pixel_parts(F.col("channel"))
    value = F.when(F.col("value") == -1.0, F.lit(0.0)).otherwise(F.col("value"))
    return long.select("vec_id", *[e.alias(n) for n, e in parts.items()], value.alias("value"))


@query(
    "g5_pixel_frame",
    f"""WITH {GRID_SQL}, r AS (
      SELECT vec_id, pixel // 8 AS r, list(CASE WHEN value = -1.0 THEN 0.0 ELSE value END ORDER BY pixel) AS line
      FROM gr GROUP BY ALL)
    SELECT vec_id, list(line ORDER BY r) AS frame FROM r GROUP BY vec_id""",
)
def pixel_frame(spark, sf):
    return pixel_grid(grid(spark, sf)).select("vec_id", F.get("frame", F.lit(0)).alias("frame"))


@query(
    "g6_signal_summary",
    f"""WITH {LINES_SQL}, m AS (SELECT l_suppkey, sum(l_quantity) / count(*) AS m FROM ln GROUP BY 1),
    d AS (SELECT l_suppkey, pos, l_quantity AS v, m, lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY pos) AS p
          FROM ln JOIN m USING (l_suppkey)),
    kept AS (SELECT l_suppkey, v, m, p, lead(v) OVER (PARTITION BY l_suppkey ORDER BY pos) AS n
             FROM d WHERE p IS NULL OR p <> v),
    pk AS (SELECT l_suppkey, count(*) FILTER (WHERE p < v AND n < v) AS peaks,
                  count(*) FILTER (WHERE p < v AND n < v AND v >= m) AS peaks_over_mean FROM kept GROUP BY l_suppkey)
    SELECT l_suppkey, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std_samp, min(v) AS min, max(v) AS max,
           max(v) - min(v) AS range, round(avg(v - p), 6) AS diff_mean, round(stddev_samp(v - p), 6) AS diff_std,
           any_value(peaks) AS peaks, any_value(peaks_over_mean) AS peaks_over_mean,
           count(*) FILTER (WHERE sign(v - m) <> sign(p - m)) AS zero_crossings, sum(v * v) AS energy
    FROM d JOIN pk USING (l_suppkey) GROUP BY l_suppkey""",
)
def signal_features(spark, sf):
    out = signal_summary(lines(spark, sf), LINE_KEYS, "l_quantity", order=LINE_ORDER)
    return rounded(out, ["min", "max", "range", "energy"])


def _rebuilt():
    return F.transform("embedding", lambda x: F.round(x.cast("double"), 1))


_ERRORS_SQL = """er AS (
  SELECT vec_id, label, list_sum(list_transform(embedding, lambda x:
    pow(CAST(x AS DOUBLE) - round(CAST(x AS DOUBLE), 1), 2))) / len(embedding) AS error FROM embeddings)"""


def _errors(spark, sf):
    """Error of a coarse reconstruction: every entry rounded to one decimal."""
    original = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", feat.reconstruction_error(original, _rebuilt()).alias("error")
    )


@query("g7_reconstruction_error", f"WITH {_ERRORS_SQL} SELECT vec_id, round(error, 9) AS error FROM er")
def reconstruction_error(spark, sf):
    return _errors(spark, sf).select("vec_id", F.round("error", 9).alias("error"))


@query("g7_linear_reconstruction")
def linear_reconstruction(spark, sf):
    """Reconstruction from the eight leading principal components, a linear stand-in for an autoencoder.

    Components are those of the centred entries, so the mean itself is never an error.
    """
    names = [f"e{i}" for i in range(64)]
    entries = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]
    return linear_errors(table(spark, sf, "embeddings").select("vec_id", *entries), names, 8, ["vec_id"])


def _scaled_by(i: int):
    """Multiplies by the row's score on component i."""
    return lambda a: a * F.get("s", F.lit(i))


def linear_errors(df, names, k, keep):
    """Mean squared difference between centred features and their projection on k components."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in names])).scalar()
    centred = df.select(*keep, F.array(*names).alias("v"), means.alias("m"))
    centred = centred.select(*keep, F.array(*[F.col("v")[i] - F.col("m")[c] for i, c in enumerate(names)]).alias("x"))
    model = PCA(k=k, inputCol="_x", outputCol="_s").fit(centred.select(array_to_vector("x").alias("_x")))
    axes = model.pc.toArray().T.tolist()
    projected = model.transform(centred.withColumn("_x", array_to_vector("x"))).select(*keep, "x", vector_to_array("_s").alias("s"))
    parts = [F.transform(F.array(*[F.lit(v) for v in axis]), _scaled_by(i)) for i, axis in enumerate(axes)]
    rebuilt = parts[0]
    for part in parts[1:]:
        rebuilt = F.zip_with(rebuilt, part, lambda a, b: a + b)
    return projected.select(*keep, feat.reconstruction_error(F.col("x"), rebuilt).alias("error"))


_PAIR_SQL = """pr AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
    st AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM pr),
    ax AS (SELECT ma, mb, c, (va + vb) / 2 - sqrt(pow((va - vb) / 2, 2) + c * c) - va AS d FROM st)"""


@query(
    "g7_pair_reconstruction",
    f"""WITH {_PAIR_SQL} SELECT vec_id, round(pow((c * (a - ma) + d * (b - mb)) / sqrt(c * c + d * d), 2) / 2, 9) AS error FROM pr, ax""",
)
def pair_reconstruction(spark, sf):
    """Two entries rebuilt from one component: the error is the square along the other, in closed form."""
    e = F.col("embedding")
    df = table(spark, sf, "embeddings").select("vec_id", e[0].cast("double").alias("a"), e[1].cast("double").alias("b"))
    return linear_errors(df, ["a", "b"], 1, ["vec_id"]).withColumn("error", F.round("error", 9))


@query(
    "g8_error_by_class",
    f"""WITH {_ERRORS_SQL} SELECT label, round(avg(error), 9) AS error_mean, round(stddev_pop(error), 9) AS error_std_pop
    FROM er GROUP BY label""",
)
def error_by_class(spark, sf):
    return _errors(spark, sf).groupBy("label").agg(
        F.round(F.avg("error"), 9).alias("error_mean"), F.round(F.stddev_pop("error"), 9).alias("error_std_pop")
    )


WINDOW_PEAKS_SQL = """wr AS (
  SELECT user_id, start_idx, t, value AS v, lag(value) OVER (PARTITION BY user_id, start_idx ORDER BY t) AS p FROM pt),
wk AS (
  SELECT user_id, start_idx, v, p, lead(v) OVER (PARTITION BY user_id, start_idx ORDER BY t) AS n
  FROM wr WHERE p IS NULL OR p <> v),
wp AS (SELECT user_id, start_idx, count(*) FILTER (WHERE p < v AND n < v) AS value_peaks FROM wk GROUP BY ALL)"""


@query(
    "w8_window_peaks",
    f"WITH {POINTS_SQL}, {WINDOW_PEAKS_SQL} SELECT user_id, start_idx, value_peaks FROM wp",
)
def window_peaks(spark, sf):
    return feat.window_peaks(event_windows(spark, sf), ["value"], WINDOW_ID)


@query(
    "g9_window_feature_table",
    f"""WITH {SPECTRUM_SQL}, {WINDOW_PEAKS_SQL}, {wavelet_sql('w', 'value')},
    wv AS (SELECT user_id, start_idx, list_sum(list_transform(dw3.x, lambda v: v * v)) AS a3, dw3.d AS d3, dw2.d AS d2,
           dw1.d AS d1 FROM dw1 JOIN dw2 USING (user_id, start_idx) JOIN dw3 USING (user_id, start_idx)),
    st AS (SELECT user_id, start_idx, {_stats_sql('value')} FROM pt GROUP BY user_id, start_idx),
    bd AS (SELECT user_id, start_idx, {_BAND_CASES.replace('{c}', 'value')} FROM sp GROUP BY user_id, start_idx)
    SELECT st.*, value_peaks, value_band0, value_band1, value_band2, value_band3,
           round(a3, 2) AS value_a3, round(d3, 2) AS value_d3, round(d2, 2) AS value_d2, round(d1, 2) AS value_d1
    FROM st JOIN wp USING (user_id, start_idx) JOIN bd USING (user_id, start_idx) JOIN wv USING (user_id, start_idx)
    """.replace("max(value) - min(value)", "round(max(value) - min(value), 6)"),
)
def window_feature_table(spark, sf):
    got = feat.window_features(event_windows(spark, sf), ["value"], WINDOW_ID)
    two = [c for c in got.columns if c.startswith("value_band") or c[-3:] in ("_a3", "_d3", "_d2", "_d1")]
    return _stats_rounded(got).withColumns({c: F.round(c, 2) for c in two} | {"value_range": F.round("value_range", 6)})


@query(
    "g10_band_totals_by_label",
    f"""WITH {SPECTRUM_SQL}, bd AS (SELECT user_id, start_idx, {_BAND_CASES.replace('{c}', 'value').replace('round(', '(').replace(', 2)', ')')}
      FROM sp GROUP BY user_id, start_idx)
    SELECT event_type, count(*) AS windows, round(avg(value_band0) / 1e6, 6) AS band0, round(avg(value_band1) / 1e6, 6) AS band1,
           round(avg(value_band2) / 1e6, 6) AS band2, round(avg(value_band3) / 1e6, 6) AS band3,
           round(avg(value_band0 + value_band1 + value_band2 + value_band3) / 1e6, 6) AS total
    FROM bd JOIN ev USING (user_id) WHERE pos = 0 GROUP BY event_type""",
)
def band_totals_by_label(spark, sf):
    bands = [f"value_band{i}" for i in range(len(BANDS))]
    got = feat.window_band_energy(event_windows(spark, sf), ["value"], [*WINDOW_ID, "event_type"])
    total = sum((F.col(b) for b in bands[1:]), F.col(bands[0]))
    return got.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("windows"),
        *[F.round(F.avg(b) / 1e6, 6).alias(f"band{i}") for i, b in enumerate(bands)],
        F.round(F.avg(total) / 1e6, 6).alias("total"),
    )


@query(
    "a23_label_mean_of_window_features",
    f"""WITH {POINTS_SQL}, st AS (SELECT user_id, start_idx, avg(value) AS m, stddev_pop(value) AS s, max(value) - min(value) AS r,
          sqrt(avg(value * value)) AS q, sum(value * value) AS e FROM pt GROUP BY user_id, start_idx)
    SELECT event_type, count(*) AS windows, round(avg(m), 8) AS value_mean, round(avg(s), 6) AS value_std_pop,
           round(avg(r), 6) AS value_range, round(avg(q), 6) AS value_rms, round(avg(e), 4) AS value_energy
    FROM st JOIN ev USING (user_id) WHERE pos = 0 GROUP BY event_type""",
)
def label_mean_of_window_features(spark, sf):
    got = feat.window_statistics(event_windows(spark, sf), ["value"], ["event_type"])
    names = [c for c in got.columns if c != "event_type"]
    return got.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("windows"),
        *[F.round(F.avg(c), {"value_energy": 4, "value_mean": 8}.get(c, 6)).alias(c) for c in names],
    )


_CHANNELS_SQL = f"""{GAPPY_SQL},
lg AS (SELECT user_id, 'value' AS channel, value FROM gap UNION ALL SELECT user_id, 'k', k FROM gap)"""


@query(
    "a1_channel_statistics",
    f"""WITH {_CHANNELS_SQL} SELECT user_id, channel, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
        min(value) AS min, max(value) AS max, round(median(value), 6) AS median,
        round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75,
        round(max(value) - min(value), 6) AS range, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurtosis
    FROM lg GROUP BY user_id, channel""",
)
def channel_statistics(spark, sf):
    got = feat.channel_statistics(gappy_events(spark, sf), EVENT_KEYS, ["value", "k"])
    return rounded(got, ["min", "max"])


@query(
    "a1_channel_statistics_wide",
    f"""WITH {LINES_SQL} SELECT l_suppkey, """
    + ", ".join(
        f"""round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max,
        round(median({c}), 6) AS {c}_median, round(quantile_cont({c}, 0.25), 6) AS {c}_q25,
        round(quantile_cont({c}, 0.75), 6) AS {c}_q75, round(max({c}) - min({c}), 6) AS {c}_range,
        round(skewness({c}), 6) AS {c}_skew, round(kurtosis({c}), 6) AS {c}_kurtosis"""
        for c in LINE_CHANNELS
    )
    + " FROM ln GROUP BY l_suppkey",
)
def channel_statistics_wide(spark, sf):
    raw = line_channels(table(spark, sf, "lineitem")).select("l_suppkey", *LINE_CHANNELS)
    stats = feat.channel_statistics(raw, LINE_KEYS, LINE_CHANNELS)
    wide = feat.spread_statistics(stats, LINE_KEYS, LINE_CHANNELS)
    return rounded(wide, [c for c in wide.columns if c.endswith(("_min", "_max"))])


@query(
    "a2_baseline_statistics",
    f"""WITH {EVENTS_SQL} SELECT user_id, 'value' AS channel, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
        min(value) AS min, max(value) AS max, round(median(value), 6) AS median, round(skewness(value), 6) AS skew,
        round(kurtosis(value), 6) AS kurtosis FROM ev GROUP BY user_id""",
)
def baseline_statistics(spark, sf):
    names = ("mean", "std", "min", "max", "median", "skew", "kurtosis")
    got = feat.channel_statistics(table(spark, sf, "events"), EVENT_KEYS, ["value"], names)
    return rounded(got, ["min", "max"])


