"""Queries over ordered readings: gaps, fills, differences, crossings, peaks, ranks (W)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqweft.operators import clean, sequences
from seqweft.operators.ordered import exact_quantiles, salted_join, slice_columns, with_lag, with_sequence_mean
from seqweft.plans.adapters import (
    EVENT_KEYS,
    EVENT_ORDER,
    EVENTS_SQL,
    GAPPY_SQL,
    LINE_KEYS,
    LINE_ORDER,
    LINES_SQL,
    SENTINEL_SQL,
    TRIALS_SQL,
    events,
    gappy_events,
    lines,
    sentinel_events,
    table,
    trial_values,
    trials,
)
from seqweft.plans.registry import query


@query(
    "w1_sequence_order",
    f"WITH {LINES_SQL} SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, pos, seq_len FROM ln",
)
def sequence_order(spark, sf):
    return lines(spark, sf).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "pos", "seq_len")


def filled_sql(source: str, limit: int, carry: bool = False) -> str:
    """SQL for gap filling: look up the known neighbours, then interpolate where one is near enough."""
    edge = f"""WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
               ELSE pv + (nv - pv) * {limit} / (ni - pi)""" if carry else "ELSE NULL"
    return f"""
known AS (
  SELECT *, last_value(value IGNORE NULLS) OVER back AS pv, first_value(value IGNORE NULLS) OVER ahead AS nv,
         last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS pi,
         first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS ni
  FROM {source}
  WINDOW back AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT *, CASE WHEN value IS NOT NULL THEN value
                 WHEN pos - pi <= {limit} OR ni - pos <= {limit} THEN
                   CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
                        ELSE pv + (nv - pv) * (pos - pi) / (ni - pi) END
                 {edge} END AS fixed
  FROM known)"""


@query(
    "w2_limited_interpolation",
    f"WITH {GAPPY_SQL}, {filled_sql('gap', 2)} SELECT user_id, pos, round(fixed, 6) AS value FROM filled",
)
def limited_interpolation(spark, sf):
    out = clean.fill_gaps(gappy_events(spark, sf), EVENT_KEYS, {"value": 2}, order=EVENT_ORDER)
    return out.select("user_id", "pos", F.round("value", 6).alias("value"))


@query(
    "w3_forward_backward_fill",
    f"""WITH {GAPPY_SQL} SELECT user_id, pos, coalesce(
        last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM gap""",
)
def forward_backward_fill(spark, sf):
    return clean.carry_fill(gappy_events(spark, sf), EVENT_KEYS, ["value"], order=EVENT_ORDER).select("user_id", "pos", "value")


_STEPWISE = """
clean AS (SELECT user_id, pos, nullif(value, -1.0) AS value FROM sen),
{filled},
carried AS (
  SELECT user_id, pos, coalesce(
    last_value(fixed IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(fixed IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS done
  FROM filled)"""


@query(
    "w4_uniform_cleaning",
    f"WITH {SENTINEL_SQL}, {_STEPWISE.format(filled=filled_sql('clean', 1))} "
    "SELECT user_id, pos, round(done, 6) AS value FROM carried",
)
def uniform_cleaning(spark, sf):
    """With a gap limit of 1, so that some gaps are left for the carrying step."""
    out = clean.clean_uniform(sentinel_events(spark, sf), EVENT_KEYS, ["value"], gap=1, order=EVENT_ORDER)
    return out.select("user_id", "pos", F.round("value", 6).alias("value"))


def _family_sql() -> str:
    parts = []
    for name, limit in (("acc", 3), ("rot", 2), ("thm", 5)):
        text = filled_sql("gap", limit).replace("known AS", f"known_{name} AS").replace("FROM known)", f"FROM known_{name})")
        parts.append(text.replace("filled AS", f"filled_{name} AS"))
    return ",".join(parts)


@query(
    "w5_family_cleaning",
    f"""WITH {GAPPY_SQL}, {_family_sql()}
    SELECT a.user_id, a.pos, round(a.fixed, 6) AS acc_x, round(r.fixed, 6) AS rot_w,
           round(coalesce(t.fixed,
             last_value(t.fixed IGNORE NULLS) OVER (PARTITION BY t.user_id ORDER BY t.pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(t.fixed IGNORE NULLS) OVER (PARTITION BY t.user_id ORDER BY t.pos
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS thm_1,
           coalesce(a.value, 0.0) AS tof_1_v0
    FROM filled_acc a JOIN filled_rot r USING (user_id, pos) JOIN filled_thm t USING (user_id, pos)""",
)
def family_cleaning(spark, sf):
    gappy = gappy_events(spark, sf)
    src = gappy.select(
        "user_id",
        "pos",
        *EVENT_ORDER,
        *slice_columns(gappy),
        *[F.col("value").alias(c) for c in ("acc_x", "rot_w", "thm_1")],
        F.coalesce("value", F.lit(-1.0)).alias("tof_1_v0"),
    )
    families = {"acc": ["acc_x"], "rot": ["rot_w"], "thm": ["thm_1"], "tof": ["tof_1_v0"]}
    out = clean.clean_by_family(src, EVENT_KEYS, families, order=EVENT_ORDER)
    return out.select(
        "user_id", "pos", *[F.round(c, 6).alias(c) for c in ("acc_x", "rot_w", "thm_1")], "tof_1_v0"
    )


@query(
    "w6_first_difference",
    f"""WITH {EVENTS_SQL}, d AS (
      SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS diff FROM ev)
    SELECT user_id, round(avg(diff), 6) AS diff_mean, round(stddev_samp(diff), 6) AS diff_std
    FROM d GROUP BY user_id""",
)
def first_difference(spark, sf):
    lagged = with_lag(events(spark, sf), EVENT_KEYS, ["value"], order=EVENT_ORDER)
    diff = F.col("value") - F.col("_lag_value")
    return lagged.groupBy("user_id").agg(
        F.round(F.avg(diff), 6).alias("diff_mean"), F.round(F.stddev_samp(diff), 6).alias("diff_std")
    )


@query(
    "w7_zero_crossings",
    f"""WITH {LINES_SQL}, m AS (
      SELECT l_suppkey, pos, sign(l_quantity - CAST(avg(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey)
             AS DOUBLE)) AS s FROM ln),
    d AS (SELECT l_suppkey, s, lag(s) OVER (PARTITION BY l_suppkey ORDER BY pos) AS p FROM m)
    SELECT l_suppkey, count(*) FILTER (WHERE s <> p) AS zero_crossings FROM d GROUP BY l_suppkey""",
)
def zero_crossings(spark, sf):
    marked = with_lag(with_sequence_mean(lines(spark, sf), LINE_KEYS, ["l_quantity"]), LINE_KEYS, ["l_quantity"], order=LINE_ORDER)
    mean = F.col("_mean_l_quantity")
    change = F.signum(F.col("l_quantity") - mean) != F.signum(F.col("_lag_l_quantity") - mean)
    return marked.groupBy("l_suppkey").agg(F.count_if(change).alias("zero_crossings"))


_PEAKS = """
runs AS (
  SELECT *, lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY pos) AS before FROM ln),
kept AS (
  SELECT *, lead(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY pos) AS after
  FROM runs WHERE before IS NULL OR l_quantity <> before),
means AS (SELECT l_suppkey, sum(l_quantity) / count(*) AS m FROM ln GROUP BY l_suppkey)"""


@query(
    "w8_peak_count",
    f"""WITH {LINES_SQL}, {_PEAKS}
    SELECT l_suppkey, count(*) FILTER (WHERE before < l_quantity AND after < l_quantity) AS peaks
    FROM kept GROUP BY l_suppkey""",
)
def peak_count(spark, sf):
    marked = sequences.mark_peaks(lines(spark, sf), LINE_KEYS, "l_quantity", order=LINE_ORDER)
    return marked.groupBy("l_suppkey").agg(F.count_if("is_peak").alias("peaks"))


@query(
    "w9_peaks_over_mean",
    f"""WITH {LINES_SQL}, {_PEAKS}
    SELECT l_suppkey, count(*) FILTER (WHERE before < l_quantity AND after < l_quantity AND l_quantity >= m)
             AS peaks_over_mean
    FROM kept JOIN means USING (l_suppkey) GROUP BY l_suppkey""",
)
def peaks_over_mean(spark, sf):
    meaned = with_sequence_mean(lines(spark, sf), LINE_KEYS, ["l_quantity"])
    marked = sequences.mark_peaks(meaned, LINE_KEYS, "l_quantity", order=LINE_ORDER)
    over = F.col("is_peak") & (F.col("l_quantity") >= F.col("_mean_l_quantity"))
    return marked.groupBy("l_suppkey").agg(F.count_if(over).alias("peaks_over_mean"))


@query(
    "w10_running_best",
    f"""WITH {TRIALS_SQL} SELECT trial_id, datetime_complete, value,
        max(value) OVER (ORDER BY datetime_complete, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          AS best_so_far
    FROM trials JOIN trial_values USING (trial_id) WHERE state = 'COMPLETE'""",
)
def running_best(spark, sf):
    done = trials(spark, sf).where(F.col("state") == "COMPLETE").join(trial_values(spark, sf), "trial_id")
    return sequences.running_best(
        done.select("trial_id", "datetime_complete", "value"), ["datetime_complete", "trial_id"], "value"
    )


@query(
    "w11_length_cdf",
    """WITH l AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
    r AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS total FROM l)
    SELECT n AS seq_len, count(*) AS n, min(i) / max(total) AS first_share, max(i) / max(total) AS last_share
    FROM r GROUP BY n""",
)
def length_cdf(spark, sf):
    lengths = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("seq_len"))
    return sequences.empirical_cdf(lengths, "seq_len")


@query(
    "w12_first_row",
    f"WITH {LINES_SQL} SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity FROM ln WHERE pos = 0",
)
def first_row(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    return sequences.first_rows(df, ["l_suppkey"], order).drop("l_shipdate")


@query(
    "w13_representative_sequence",
    """WITH l AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL),
    m AS (SELECT event_type, median(n) AS med FROM l GROUP BY event_type),
    r AS (SELECT event_type, user_id, n, row_number() OVER (
            PARTITION BY event_type ORDER BY abs(n - med), user_id) AS i FROM l JOIN m USING (event_type))
    SELECT event_type, user_id, n AS seq_len FROM r WHERE i = 1""",
)
def representative_sequence(spark, sf):
    lengths = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("seq_len"))
    middle = exact_quantiles(lengths, ["event_type"], "seq_len", {"med": 0.5})
    off = F.struct(F.abs(F.col("seq_len") - F.col("med")), "user_id")
    best = F.min_by(F.struct("user_id", "seq_len"), off).alias("_best")
    met = salted_join(lengths, middle, ["event_type"], ["user_id"], "inner")
    return met.groupBy("event_type").agg(best).select("event_type", "_best.*")


@query(
    "w14_first_sequences_per_label",
    f"""WITH {EVENTS_SQL}, f AS (SELECT user_id, event_type AS label FROM ev WHERE pos = 0),
    r AS (SELECT user_id, label, row_number() OVER (PARTITION BY label ORDER BY user_id) AS i FROM f)
    SELECT label, user_id, pos, value FROM r JOIN ev USING (user_id) WHERE i <= 3 AND pos < 16""",
)
def first_sequences_per_label(spark, sf):
    ev = events(spark, sf)
    firsts = ev.where(F.col("pos") == 0).select("user_id", F.col("event_type").alias("label"))
    # the rank filter is applied per input partition before the shuffle, so a large label stays small
    order = Window.partitionBy("label").orderBy("user_id")
    chosen = firsts.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= 3).drop("_i")
    return ev.where(F.col("pos") < 16).join(chosen, "user_id").select("label", "user_id", "pos", "value")


@query("w15_first_rows_of_sequence", f"WITH {EVENTS_SQL} SELECT user_id, pos, value FROM ev WHERE pos < 32")
def first_rows_of_sequence(spark, sf):
    return events(spark, sf).where(F.col("pos") < 32).select("user_id", "pos", "value")


@query(
    "w16_cumulative_length_shares",
    """WITH l AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
    SELECT g AS at_least, count(*) FILTER (WHERE n >= g) AS sequences,
           round(100.0 * count(*) FILTER (WHERE n >= g) / count(*), 6) AS share
    FROM l, (VALUES (32), (64), (96), (128)) AS t(g) GROUP BY g""",
)
def cumulative_length_shares(spark, sf):
    lengths = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    graded = lengths.withColumn("at_least", F.explode(F.array(*[F.lit(g) for g in (32, 64, 96, 128)])))
    reached = F.count_if(F.col("n") >= F.col("at_least"))
    return graded.groupBy("at_least").agg(
        reached.alias("sequences"), F.round(reached * 100.0 / F.count(F.lit(1)), 6).alias("share")
    )


@query(
    "w17_best_epoch",
    """WITH e AS (
      SELECT o_orderpriority AS run, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS epoch,
             CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / count(*) AS val_loss,
             count(*) AS loss FROM orders GROUP BY ALL),
    b AS (SELECT run, epoch, val_loss, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS i,
                 row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS j, loss FROM e)
    SELECT run, max(CASE WHEN i = 1 THEN epoch END) AS best_epoch,
           round(max(CASE WHEN i = 1 THEN val_loss END), 4) AS best_val_loss,
           round(max(CASE WHEN j = 1 THEN val_loss END), 4) AS last_val_loss,
           max(CASE WHEN j = 1 THEN loss END) AS last_loss FROM b GROUP BY run""",
)
def best_epoch(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    epochs = (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("run"),
            (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("epoch"),
        )
        .agg((F.sum(cents) / F.count(F.lit(1))).alias("val_loss"), F.count(F.lit(1)).alias("loss"))
    )
    order = F.struct("val_loss", "epoch")
    return epochs.groupBy("run").agg(
        F.min_by("epoch", order).alias("best_epoch"),
        F.round(F.min("val_loss"), 4).alias("best_val_loss"),
        F.round(F.max_by("val_loss", "epoch"), 4).alias("last_val_loss"),
        F.max_by("loss", "epoch").alias("last_loss"),
    )
