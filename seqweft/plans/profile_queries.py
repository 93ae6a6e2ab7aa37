"""Profiling of readings, sequences and labels (A3-A21, A24-A26, A33-A42)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.operators import clean, profile
from seqweft.operators.windows import sliding_windows
from seqweft.plans.adapters import (
    EVENT_KEYS,
    EVENT_ORDER,
    EVENTS_SQL,
    GAPPY_SQL,
    GRID_SQL,
    LINE_KEYS,
    MOTION_SQL,
    PREDICTIONS_SQL,
    SENTINEL_SQL,
    SUBJECTS_SQL,
    events,
    gappy_events,
    grid,
    motion,
    predictions,
    sentinel_events,
    subjects,
    table,
)
from seqweft.plans.registry import query
from seqweft.plans.sequence_queries import filled_sql
from seqweft.plans.window_queries import windows_sql

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _n():
    return F.count(F.lit(1))



@query("a3_label_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def label_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "events"), "event_type").orderBy(F.desc("n"), "event_type")


@query(
    "a4_sequence_lengths",
    f"WITH {EVENTS_SQL} SELECT user_id, count(*) AS by_count, max(pos) + 1 AS by_counter FROM ev GROUP BY user_id",
)
def sequence_lengths(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(_n().alias("by_count"), (F.max("pos") + 1).alias("by_counter"))


@query(
    "a5_length_and_first_label",
    f"""WITH {EVENTS_SQL} SELECT user_id, count(*) AS steps, max(CASE WHEN pos = 0 THEN event_type END) AS label
    FROM ev GROUP BY user_id""",
)
def length_and_first_label(spark, sf):
    order = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(_n().alias("steps"), F.min_by("event_type", order).alias("label"))


@query(
    "a6_distinct_counts",
    """SELECT count(DISTINCT user_id) AS sequences, count(DISTINCT event_type) AS labels,
        count(DISTINCT value) AS distinct_values FROM events""",
)
def distinct_counts(spark, sf):
    return table(spark, sf, "events").agg(
        F.count_distinct("user_id").alias("sequences"),
        F.count_distinct("event_type").alias("labels"),
        F.count_distinct("value").alias("distinct_values"),
    )


def _describe_sql(c):
    return f"""count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min,
    max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS median,
    round(quantile_cont({c}, 0.75), 6) AS q75"""


def _described(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "median", "q75")})


@query("a7_describe", f"SELECT {_describe_sql('value')} FROM events")
def describe(spark, sf):
    return _described(profile.describe(table(spark, sf, "events"), [], "value"))


@query("a8_describe_by_label", f"SELECT l_returnflag, {_describe_sql('l_quantity')} FROM lineitem GROUP BY l_returnflag")
def describe_by_label(spark, sf):
    return _described(profile.describe(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity"))


_COUNT_BY_TYPE = ", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS {e}" for e in EVENT_TYPES)


@query("a9_cross_table", f"SELECT user_id % 2 AS handedness, {_COUNT_BY_TYPE} FROM events GROUP BY 1")
def cross_table(spark, sf):
    df = table(spark, sf, "events").withColumn("handedness", F.col("user_id") % 2)
    return profile.cross_tab(df, "handedness", "event_type", EVENT_TYPES)


@query("a10_unstacked_sizes", f"SELECT user_id, {_COUNT_BY_TYPE} FROM events GROUP BY user_id")
def unstacked_sizes(spark, sf):
    return profile.cross_tab(table(spark, sf, "events"), "user_id", "event_type", EVENT_TYPES)


@query(
    "a11_null_report",
    f"""WITH {GRID_SQL} SELECT 'tof_1_v' || pixel AS "column", count(*) FILTER (WHERE value = -1) AS nulls,
        round(count(*) FILTER (WHERE value = -1) / count(*), 9) AS ratio FROM gr GROUP BY pixel""",
)
def null_report(spark, sf):
    df = grid(spark, sf)
    pixels = [c for c in df.columns if c.startswith("tof_")]
    out = profile.null_report(clean.sentinel_to_null(df, pixels), pixels)
    return out.select("column", "nulls", F.round("ratio", 9).alias("ratio")).orderBy(F.desc("nulls"), "column")


@query(
    "a12_special_values",
    f"""WITH {GRID_SQL} SELECT 'tof_1_v' || pixel AS channel, CAST(0 AS BIGINT) AS nulls,
        count(*) FILTER (WHERE value = -1) AS sentinels, count(*) FILTER (WHERE value = 0) AS zeros, count(*) AS rows,
        round(count(*) FILTER (WHERE value = -1) / count(*), 9) AS sentinel_ratio FROM gr GROUP BY pixel""",
)
def special_values(spark, sf):
    df = grid(spark, sf)
    out = profile.special_values(df, [c for c in df.columns if c.startswith("tof_")])
    return out.withColumn("sentinel_ratio", F.round(F.col("sentinels") / F.col("rows"), 9))


@query(
    "a13_missingness_by_family",
    f"""WITH {SENTINEL_SQL}, u AS (
      SELECT 'acc' AS family, 'k' AS channel, k AS v FROM sen
      UNION ALL SELECT 'tof', 'value', value FROM sen
      UNION ALL SELECT 'thm', 'gappy', CASE WHEN value = -1 THEN NULL ELSE value END FROM sen)
    SELECT family, channel, count(*) AS rows, count(*) FILTER (WHERE v IS NULL) AS nulls,
           count(*) FILTER (WHERE v = -1) AS sentinels, count(*) FILTER (WHERE v = 0) AS zeros, min(v) AS min, max(v) AS max,
           round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM u GROUP BY family, channel""",
)
def missingness_by_family(spark, sf):
    df = sentinel_events(spark, sf).withColumn("gappy", F.when(F.col("value") != -1, F.col("value")))
    out = profile.missingness(df, {"acc": ["k"], "tof": ["value"], "thm": ["gappy"]})
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "a13_missingness_report",
    f"""WITH {SENTINEL_SQL}, g AS (SELECT k, value, CASE WHEN value = -1 THEN NULL ELSE value END AS gappy FROM sen),
    u AS (SELECT 'tof' AS family, 'k' AS channel, k AS v FROM g UNION ALL SELECT 'tof', 'value', value FROM g UNION ALL SELECT 'thm', 'gappy', gappy FROM g),
    q AS (SELECT channel AS c, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM u GROUP BY channel),
    f AS (SELECT 'tof' AS fam, max(CASE WHEN k IS NULL THEN 1 ELSE 0 END + CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS most FROM g
      UNION ALL SELECT 'thm', max(CASE WHEN gappy IS NULL THEN 1 ELSE 0 END) FROM g),
    o AS (SELECT *, v < q1 - 0.5 * (q3 - q1) OR v > q3 + 0.5 * (q3 - q1) AS beyond FROM u JOIN q ON c = channel)
    SELECT family, channel, count(*) AS rows, count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) FILTER (WHERE v = -1) AS sentinels,
           count(*) FILTER (WHERE v = 0) AS zeros, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
           count(*) FILTER (WHERE beyond) AS outliers, round(count(*) FILTER (WHERE beyond) / count(v), 9) AS outlier_share,
           CAST(any_value(most) AS INTEGER) AS most_at_once
    FROM o JOIN f ON fam = family GROUP BY family, channel""",
)
def missingness_report(spark, sf):
    df = sentinel_events(spark, sf).withColumn("gappy", F.when(F.col("value") != -1, F.col("value")))
    out = profile.missingness_report(df, {"tof": ["k", "value"], "thm": ["gappy"]}, reach=0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")}).withColumn("outlier_share", F.round("outlier_share", 9))


@query(
    "a13_most_missing_at_once",
    f"""WITH {GRID_SQL}, r AS (SELECT vec_id, CAST(sum(CASE WHEN value = -1 THEN 1 ELSE 0 END) AS INTEGER) AS m FROM gr GROUP BY vec_id)
    SELECT 'tof' AS family, count(*) FILTER (WHERE m > 0) AS rows_with_missing, max(m) AS most_at_once, count(*) AS rows FROM r""",
)
def most_missing_at_once(spark, sf):
    df = grid(spark, sf)
    pixels = [c for c in df.columns if c.startswith("tof_")]
    return profile.simultaneous_missing(clean.sentinel_to_null(df, pixels), {"tof": pixels})


@query(
    "a14_outliers",
    """WITH u AS (SELECT 'l_quantity' AS channel, l_quantity AS v FROM lineitem
      UNION ALL SELECT 'l_extendedprice', round(l_extendedprice) FROM lineitem UNION ALL SELECT 'squared', l_quantity * l_quantity * l_quantity FROM lineitem),
    q AS (SELECT channel, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM u GROUP BY channel)
    SELECT channel, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers,
           round(count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(*), 9) AS share
    FROM u JOIN q USING (channel) GROUP BY channel""",
)
def outliers(spark, sf):
    q = F.col("l_quantity")
    df = table(spark, sf, "lineitem").select(q, F.round("l_extendedprice").alias("l_extendedprice"), (q * q * q).alias("squared"))
    out = profile.outliers(df, ["l_quantity", "l_extendedprice", "squared"])
    return out.withColumn("share", F.round("share", 9))


@query(
    "a15_cleaning_reconciliation",
    f"""WITH {SENTINEL_SQL} SELECT CAST(0 AS BIGINT) AS nulls_before, count(*) FILTER (WHERE value = -1) AS sentinels_before,
        count(*) FILTER (WHERE value = 0) AS zeros_before, count(*) FILTER (WHERE value = -1) AS nulls_after,
        CAST(0 AS BIGINT) AS sentinels_after, count(*) FILTER (WHERE value = 0) AS zeros_after,
        count(*) FILTER (WHERE value = -1) AS expected_new_nulls, count(*) FILTER (WHERE value = -1) AS actual_new_nulls,
        0.0::DOUBLE AS nulls_change, -100.0::DOUBLE AS sentinels_change, 0.0::DOUBLE AS zeros_change, true AS as_expected FROM sen""",
)
def cleaning_reconciliation(spark, sf):
    before = sentinel_events(spark, sf).select("value", "k")
    effect = profile.cleaning_effect(before, clean.sentinel_to_null(before, ["value"]), ["value"])
    return profile.reconciliation(effect)


_FILLED = f"{GAPPY_SQL}, {filled_sql('gap', 1)}"


def _filled(spark, sf):
    before = gappy_events(spark, sf)
    return before, clean.fill_gaps(before, EVENT_KEYS, {"value": 1}, order=EVENT_ORDER)


@query(
    "a16_missing_rate_change",
    f"""WITH {_FILLED}, r AS (SELECT avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS before,
          avg(CASE WHEN fixed IS NULL THEN 1.0 ELSE 0.0 END) AS after, count(*) FILTER (WHERE value IS NULL) AS nb,
          count(*) FILTER (WHERE fixed IS NULL) AS na FROM filled)
    SELECT round(before, 9) AS rate_before, round(after, 9) AS rate_after, round((nb - na) / nb, 9) AS removed FROM r""",
)
def missing_rate_change(spark, sf):
    before, after = _filled(spark, sf)
    effect = profile.cleaning_effect(before, after, ["value"])
    b, a, n = F.sum("nulls_before"), F.sum("nulls_after"), F.sum("rows")
    return effect.agg(
        F.round(b / n, 9).alias("rate_before"), F.round(a / n, 9).alias("rate_after"), F.round(F.try_divide(b - a, b), 9).alias("removed")
    )


@query(
    "a17_largest_reductions",
    f"""WITH {_FILLED}, u AS (SELECT 'value' AS channel, count(*) FILTER (WHERE value IS NULL) AS nulls_before,
          count(*) FILTER (WHERE fixed IS NULL) AS nulls_after FROM filled UNION ALL SELECT 'k', 0, 0)
    SELECT channel, nulls_before - nulls_after AS reduction FROM u ORDER BY reduction DESC, channel LIMIT 3""",
)
def largest_reductions(spark, sf):
    before, after = _filled(spark, sf)
    effect = profile.cleaning_effect(before, after, ["value", "k"])
    drop = (F.col("nulls_before") - F.col("nulls_after")).alias("reduction")
    return effect.select("channel", drop).orderBy(F.desc("reduction"), "channel").limit(3)


@query(
    "a18_sequence_with_most_missing",
    """SELECT user_id, count(*) AS missing FROM events WHERE event_type = 'error' GROUP BY user_id
    ORDER BY missing DESC, user_id LIMIT 1""",
)
def sequence_with_most_missing(spark, sf):
    gone = F.count_if(F.col("event_type") == "error").alias("missing")
    return table(spark, sf, "events").groupBy("user_id").agg(gone).orderBy(F.desc("missing"), "user_id").limit(1)


@query(
    "a19_missing_rate_by_group",
    f"""WITH {GAPPY_SQL} SELECT user_id % 5 AS gesture, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 9) AS value_missing,
        round(avg(CASE WHEN value IS NULL AND k < 50 THEN 1.0 ELSE 0.0 END), 9) AS both_missing FROM gap GROUP BY 1""",
)
def missing_rate_by_group(spark, sf):
    df = gappy_events(spark, sf).withColumn("k", F.when(F.col("k") >= 50, F.col("k")))
    flagged = clean.missing_group_flags(df, {"value": ["value"], "both": ["value", "k"]})
    rates = [F.round(F.avg(F.col(c).cast("double")), 9).alias(c) for c in ("value_missing", "both_missing")]
    return flagged.groupBy((F.col("user_id") % 5).alias("gesture")).agg(*rates)


_CORR_CHANNELS = ["acc_x", "acc_y", "acc_z", "rot_w", "rot_x"]
_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS channel_a, '{b}' AS channel_b, corr({a}, {b}) AS r FROM mo"
    for a in _CORR_CHANNELS
    for b in _CORR_CHANNELS
    if a != b
)


@query("a20_channel_correlations", f"WITH {MOTION_SQL}, c AS ({_CORR_SQL}) SELECT channel_a, channel_b, round(r, 9) AS r FROM c")
def channel_correlations(spark, sf):
    return profile.correlations(motion(spark, sf), _CORR_CHANNELS).withColumn("r", F.round("r", 9))


@query(
    "a20_sequence_correlations",
    """SELECT l_suppkey, 'l_quantity' AS channel_a, 'l_extendedprice' AS channel_b, round(corr(l_quantity, l_extendedprice), 9) AS r
    FROM lineitem GROUP BY l_suppkey UNION ALL
    SELECT l_suppkey, 'l_extendedprice', 'l_quantity', round(corr(l_quantity, l_extendedprice), 9) FROM lineitem GROUP BY l_suppkey""",
)
def sequence_correlations(spark, sf):
    df = table(spark, sf, "lineitem")
    return profile.correlations(df, ["l_quantity", "l_extendedprice"], LINE_KEYS).withColumn("r", F.round("r", 9))


@query(
    "a20_many_channel_correlations",
    f"""WITH {GRID_SQL} SELECT 'tof_1_v' || a.pixel AS channel_a, 'tof_1_v' || b.pixel AS channel_b, round(corr(a.value, b.value), 9) AS r
    FROM gr a JOIN gr b USING (vec_id) WHERE a.pixel <> b.pixel AND a.value <> -1 AND b.value <> -1 GROUP BY a.pixel, b.pixel""",
)
def many_channel_correlations(spark, sf):
    """All pairs of 64 pixels, sentinels left out pair by pair."""
    df = grid(spark, sf)
    pixels = [c for c in df.columns if c.startswith("tof_")]
    return profile.correlations(clean.sentinel_to_null(df, pixels), pixels).withColumn("r", F.round("r", 9))


@query(
    "a21_strong_pairs",
    """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_tax) AS b, corr(l_quantity, l_quantity * l_quantity) AS c FROM lineitem),
    u AS (SELECT unnest(['l_quantity', 'squared']) AS channel_a, unnest(['squared', 'l_quantity']) AS channel_b, c AS r FROM c
          UNION ALL SELECT unnest(['l_quantity', 'l_extendedprice']), unnest(['l_extendedprice', 'l_quantity']), a FROM c)
    SELECT channel_a, channel_b, round(r, 9) AS r FROM u WHERE abs(r) >= 0.8 AND abs(r) < 1""",
)
def strong_pairs(spark, sf):
    q = F.col("l_quantity")
    df = table(spark, sf, "lineitem").withColumn("squared", q * q)
    corr = profile.correlations(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "squared"])
    return profile.strong_pairs(corr).withColumn("r", F.round("r", 9)).orderBy(F.desc("r"), "channel_a")


@query(
    "a24_label_modes",
    f"""WITH m AS (SELECT event_type, user_id % 7 AS h, count(*) AS n FROM events GROUP BY ALL),
    r AS (SELECT event_type, h, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, h) AS i FROM m)
    SELECT event_type, h AS handedness, subjects, rows FROM r
    JOIN (SELECT event_type, count(DISTINCT user_id) AS subjects, count(*) AS rows FROM events GROUP BY event_type) USING (event_type)
    WHERE i = 1""",
)
def label_modes(spark, sf):
    df = table(spark, sf, "events").withColumn("h", F.col("user_id") % 7)
    modes = profile.mode_of(df, ["event_type"], "h", "handedness")
    sizes = df.groupBy("event_type").agg(F.count_distinct("user_id").alias("subjects"), _n().alias("rows"))
    return modes.join(sizes, "event_type")


@query(
    "a25_spread_by_label",
    f"""WITH {MOTION_SQL} SELECT label, {", ".join(f"round(stddev_pop({c}), 9) AS {c}_std_pop, round(stddev_samp({c}), 9) AS {c}_std_samp" for c in ("acc_x", "acc_y", "acc_z"))},
        round(avg(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z)), 9) AS magnitude, count(*) AS length FROM mo GROUP BY label""",
)
def spread_by_label(spark, sf):
    axes = ["acc_x", "acc_y", "acc_z"]
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in axes), F.lit(0.0)))
    spreads = [F.round(f(c), 9).alias(f"{c}_{n}") for c in axes for n, f in (("std_pop", F.stddev_pop), ("std_samp", F.stddev_samp))]
    return motion(spark, sf).groupBy("label").agg(*spreads, F.round(F.avg(size), 9).alias("magnitude"), _n().alias("length"))


@query(
    "a26_mean_length_per_subject",
    f"""WITH l AS (SELECT o_custkey, o_orderkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
    m AS (SELECT o_custkey, sum(n) / count(*) AS v FROM l GROUP BY o_custkey) SELECT {_describe_sql('v')} FROM m""".replace("min(v) AS min", "round(min(v), 6) AS min").replace("max(v) AS max", "round(max(v), 6) AS max"),
)
def mean_length_per_subject(spark, sf):
    """An order is a sequence of line items, a customer the subject."""
    lengths = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(_n().alias("n"))
    owners = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    means = lengths.join(owners, "o_orderkey").groupBy("o_custkey").agg(F.avg("n").alias("v"))
    return _described(profile.describe(means, [], "v")).withColumns({c: F.round(c, 6) for c in ("min", "max")})


@query(
    "a33_predicted_vs_true_distribution",
    f"""WITH {PREDICTIONS_SQL}, t AS (SELECT truth AS label, count(*) AS n_true FROM pr GROUP BY 1),
    g AS (SELECT guess AS label, count(*) AS n_predicted FROM pr GROUP BY 1)
    SELECT label, n_true, n_predicted, round(n_true / (SELECT count(*) FROM pr), 9) AS share_true,
           round(n_predicted / (SELECT count(*) FROM pr), 9) AS share_predicted FROM t JOIN g USING (label)""",
)
def predicted_vs_true_distribution(spark, sf):
    df = predictions(spark, sf)
    true = profile.shares(df.select(F.col("truth").alias("label")), "label")
    guess = profile.shares(df.select(F.col("guess").alias("label")), "label")
    true = true.select("label", F.col("n").alias("n_true"), F.round("share", 9).alias("share_true"))
    guess = guess.select("label", F.col("n").alias("n_predicted"), F.round("share", 9).alias("share_predicted"))
    return true.join(guess, "label")


@query(
    "a34_prediction_summary",
    f"""WITH {PREDICTIONS_SQL} SELECT count(*) AS count, round(avg(guess), 9) AS mean, round(stddev_pop(guess), 9) AS std_pop,
        min(guess) AS min, max(guess) AS max FROM pr""",
)
def prediction_summary(spark, sf):
    return predictions(spark, sf).agg(
        F.count("guess").alias("count"),
        F.round(F.avg("guess"), 9).alias("mean"),
        F.round(F.stddev_pop("guess"), 9).alias("std_pop"),
        F.min("guess").alias("min"),
        F.max("guess").alias("max"),
    )


_EVENT_WINDOWS = windows_sql("ev", "user_id", ["value"], 64, 16, 10, "w")


@query(
    "a35_window_totals_by_label",
    f"""WITH {EVENTS_SQL}, {_EVENT_WINDOWS} SELECT event_type, count(*) AS windows, count(*) FILTER (WHERE padded) AS padded,
        round(count(*) FILTER (WHERE padded) / count(*), 9) AS padded_share FROM w JOIN ev USING (user_id) WHERE pos = 0 GROUP BY event_type""",
)
def window_totals_by_label(spark, sf):
    got = sliding_windows(events(spark, sf), EVENT_KEYS, ["value"], (64, 16), first_of=["event_type"])
    padded = F.count_if("padded")
    return got.groupBy("event_type").agg(
        _n().alias("windows"), padded.alias("padded"), F.round(padded / _n(), 9).alias("padded_share")
    )


@query(
    "a36_window_build_counters",
    """WITH l AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT count(*) AS total, count(*) FILTER (WHERE n >= 10) AS processed, count(*) FILTER (WHERE n < 10) AS skipped,
           count(*) FILTER (WHERE n >= 10 AND n < 16) AS padded FROM l""",
)
def window_build_counters(spark, sf):
    n = F.col("n")
    lengths = table(spark, sf, "orders").groupBy("o_custkey").agg(_n().alias("n"))
    return lengths.agg(
        _n().alias("total"),
        F.count_if(n >= 10).alias("processed"),
        F.count_if(n < 10).alias("skipped"),
        F.count_if((n >= 10) & (n < 16)).alias("padded"),
    )


@query(
    "a38_low_cardinality_columns",
    """WITH u AS (SELECT unnest(['l_returnflag', 'l_linestatus', 'l_linenumber']) AS "column",
      unnest([count(DISTINCT l_returnflag), count(DISTINCT l_linestatus), count(DISTINCT l_linenumber)]) AS distinct_values FROM lineitem)
    SELECT * FROM u WHERE distinct_values <= 3""",
)
def low_cardinality_columns(spark, sf):
    return profile.low_cardinality(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "a39_label_shares",
    """SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 9) AS percent
    FROM events GROUP BY event_type""",
)
def label_shares(spark, sf):
    out = profile.shares(table(spark, sf, "events"), "event_type")
    return out.select("event_type", "n", F.round(F.col("share") * 100, 9).alias("percent"))


def _histogram_sql(source, value, bins):
    return f"""e AS (SELECT CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM {source})
    SELECT CAST(least(floor(({value} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
    FROM {source}, e GROUP BY 1"""


@query("a40_value_histogram", f"WITH {_histogram_sql('events', 'value', 50)}")
def value_histogram(spark, sf):
    return profile.histogram(table(spark, sf, "events"), "value", 50)


@query(
    "a40_length_histogram",
    f"WITH l AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), {_histogram_sql('l', 'n', 10)}",
)
def length_histogram(spark, sf):
    lengths = table(spark, sf, "orders").groupBy("o_custkey").agg(_n().alias("length"))
    return profile.histogram(lengths, "length", 10)


_BOX_SQL = """b AS (SELECT {by} quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3 FROM l {group})
    SELECT {by} round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
      min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS low_whisker,
      max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS high_whisker,
      count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outside
    FROM l {join} {group}"""


def _boxed(df):
    return df.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    "a41_box_numbers",
    "WITH l AS (SELECT o_custkey, count(*) AS v FROM orders GROUP BY o_custkey), " + _BOX_SQL.format(by="", group="", join=", b"),
)
def box_numbers(spark, sf):
    lengths = table(spark, sf, "orders").groupBy("o_custkey").agg(_n().alias("v"))
    return _boxed(profile.box_numbers(lengths, [], "v"))


@query(
    "a41_box_numbers_by_label",
    "WITH l AS (SELECT event_type, user_id, count(*) AS v FROM events GROUP BY ALL), "
    + _BOX_SQL.format(by="event_type,", group="GROUP BY event_type", join="JOIN b USING (event_type)"),
)
def box_numbers_by_label(spark, sf):
    lengths = table(spark, sf, "events").groupBy("event_type", "user_id").agg(_n().alias("v"))
    return _boxed(profile.box_numbers(lengths, ["event_type"], "v"))


@query(
    "a42_mean_length_by_label",
    """WITH l AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, round(sum(n) / count(*), 9) AS mean_length FROM l GROUP BY event_type ORDER BY 2 DESC, 1 LIMIT 10""",
)
def mean_length_by_label(spark, sf):
    lengths = table(spark, sf, "events").groupBy("event_type", "user_id").agg(_n().alias("n"))
    means = lengths.groupBy("event_type").agg(F.round(F.avg("n"), 9).alias("mean_length"))
    return means.orderBy(F.desc("mean_length"), "event_type").limit(10)


@query(
    "a20_grouped_many_channels",
    f"""WITH {GRID_SQL} SELECT a.label, 'tof_1_v' || a.pixel AS channel_a, 'tof_1_v' || b.pixel AS channel_b, round(corr(a.value, b.value), 8) AS r
    FROM gr a JOIN gr b USING (vec_id) WHERE a.pixel <> b.pixel AND a.value <> -1 AND b.value <> -1 GROUP BY a.label, a.pixel, b.pixel""",
)
def grouped_many_channels(spark, sf):
    """All pairs of 64 pixels within each label."""
    df = grid(spark, sf)
    pixels = [c for c in df.columns if c.startswith("tof_")]
    return profile.correlations(clean.sentinel_to_null(df, pixels), pixels, ["label"]).withColumn("r", F.round("r", 8))


@query(
    "a20_attribute_correlations",
    f"""WITH {SUBJECTS_SQL} SELECT 'age' AS channel_a, 'height_cm' AS channel_b, round(corr(age, height_cm), 9) AS r FROM sub
    UNION ALL SELECT 'height_cm', 'age', round(corr(age, height_cm), 9) FROM sub""",
)
def attribute_correlations(spark, sf):
    return profile.correlations(subjects(spark, sf), ["age", "height_cm"]).withColumn("r", F.round("r", 9))


