"""Sliding windows over readings (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.operators import windows as win
from seqweft.plans.adapters import (
    EVENT_KEYS,
    EVENTS_SQL,
    GAPPY_SQL,
    LINE_KEYS,
    LINES_SQL,
    events,
    gappy_events,
    lines,
    table,
)
from seqweft.plans.registry import query


def windows_sql(source: str, key: str, channels: list[str], width: int, stride: int, minimum: int, name: str) -> str:
    """SQL for padded windows: expand every window to its positions, join the readings, gather lists."""
    lists = ", ".join(
        f"list(coalesce({c}, 0.0) ORDER BY t) AS {c}" if minimum < 0 else
        f"list(CASE WHEN pos IS NULL THEN 0.0 ELSE {c} END ORDER BY t) AS {c}"
        for c in channels
    )
    return f"""
{name}_s AS (
  SELECT {key}, max(seq_len) AS original_length, unnest(range(0, greatest(max(seq_len), {width}) - {width} + 1, {stride})) AS start_idx
  FROM {source} WHERE seq_len >= {max(minimum, 0)} GROUP BY {key}),
{name} AS (
  SELECT s.{key}, start_idx, start_idx + {width} AS end_idx, original_length < {width} AS padded, original_length, {lists}
  FROM {name}_s s CROSS JOIN range(0, {width}) AS g(t)
  LEFT JOIN {source} r ON r.{key} = s.{key} AND r.pos = s.start_idx + t
  GROUP BY ALL)"""


WINDOWS_SQL = f"{EVENTS_SQL}, {windows_sql('ev', 'user_id', ['value', 'k'], 64, 16, 10, 'w')}"
WINDOW_ID = ["user_id", "start_idx"]


def event_windows(spark, sf):
    return win.sliding_windows(events(spark, sf), EVENT_KEYS, ["value", "k"], (64, 16), first_of=["event_type"])


@query(
    "x1_windows_with_attributes",
    f"""WITH {WINDOWS_SQL} SELECT w.user_id, start_idx, end_idx, padded, w.original_length, ev.event_type,
        c_mktsegment, w.value, w.k
    FROM w JOIN ev ON ev.user_id = w.user_id AND ev.pos = 0 LEFT JOIN customer ON c_custkey = w.user_id""",
)
def windows_with_attributes(spark, sf):
    attributes = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return win.salted_join(event_windows(spark, sf), attributes, EVENT_KEYS, ["start_idx"])


@query(
    "x2_windows_with_index",
    f"""WITH {LINES_SQL}, {windows_sql('ln', 'l_suppkey', ['l_quantity'], 128, 64, 10, 'w')}
    SELECT l_suppkey, start_idx // 64 AS window_index, start_idx, end_idx - 1 AS end_idx, padded, l_quantity FROM w""",
)
def windows_with_index(spark, sf):
    got = win.sliding_windows(lines(spark, sf), LINE_KEYS, ["l_quantity"], (128, 64))
    return got.select(
        "l_suppkey",
        F.floor(F.col("start_idx") / 64).cast("long").alias("window_index"),
        "start_idx",
        (F.col("end_idx") - 1).alias("end_idx"),
        "padded",
        "l_quantity",
    )


@query(
    "x3_windows_nulls_to_zero",
    f"WITH {GAPPY_SQL}, {windows_sql('gap', 'user_id', ['value'], 64, 16, -1, 'w')} "
    "SELECT user_id, start_idx, padded, value FROM w WHERE original_length >= 10",
)
def windows_nulls_to_zero(spark, sf):
    filled = gappy_events(spark, sf).fillna(0.0, ["value"])
    return win.sliding_windows(filled, EVENT_KEYS, ["value"], (64, 16)).select("user_id", "start_idx", "padded", "value")


@query(
    "x4_window_batches",
    f"""WITH {WINDOWS_SQL}, b AS (SELECT user_id, (dense_rank() OVER (ORDER BY user_id) - 1) // 50 AS batch_id FROM w)
    SELECT batch_id, count(*) AS windows, count(DISTINCT user_id) AS sequences FROM b GROUP BY batch_id""",
)
def window_batches(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    usable = counts.where(F.col("n") >= win.MIN_LENGTH)
    got = win.with_batches(event_windows(spark, sf).select(*WINDOW_ID), usable, EVENT_KEYS, 50)
    return got.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("user_id").alias("sequences")
    )


@query(
    "x5_first_window_of_first_sequences",
    f"""WITH {EVENTS_SQL}, s AS (SELECT DISTINCT user_id FROM ev WHERE seq_len >= 64 ORDER BY user_id LIMIT 100)
    SELECT user_id, list(value ORDER BY pos) AS value FROM ev SEMI JOIN s USING (user_id)
    WHERE pos < 64 GROUP BY user_id""",
)
def first_window_of_first_sequences(spark, sf):
    long_enough = events(spark, sf).where(F.col("seq_len") >= 64)
    chosen = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 64)
    chosen = chosen.orderBy("user_id").limit(100).select("user_id")
    return win.edge_window(long_enough.join(F.broadcast(chosen), "user_id", "left_semi"), EVENT_KEYS, ["value"], 64, "first")


@query(
    "x6_last_window",
    f"""WITH {EVENTS_SQL}, t AS (SELECT user_id, list(value ORDER BY pos) AS v FROM ev WHERE pos >= seq_len - 64 GROUP BY 1)
    SELECT user_id, list_concat(v, list_transform(range(0, 64 - len(v)), lambda i: 0.0::DOUBLE)) AS value FROM t""",
)
def last_window(spark, sf):
    return win.edge_window(events(spark, sf), EVENT_KEYS, ["value"], 64, "last")


@query(
    "x7_serving_windows",
    f"""WITH o AS (SELECT o_custkey, o_totalprice,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
          count(*) OVER (PARTITION BY o_custkey) AS seq_len FROM orders),
    {windows_sql('o', 'o_custkey', ['o_totalprice'], 64, 16, -1, 'w')}
    SELECT o_custkey, start_idx, padded, original_length, o_totalprice FROM w""",
)
def serving_windows(spark, sf):
    """No minimum length: even one reading gives a window."""
    raw = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    readings = win.with_positions(raw, ["o_custkey"], ["o_orderdate", "o_orderkey"], length="seq_len", keep_slices=True)
    got = win.sliding_windows(readings.fillna(0.0, ["o_totalprice"]), ["o_custkey"], ["o_totalprice"], (64, 16), min_length=0)
    return got.select("o_custkey", "start_idx", "padded", "original_length", "o_totalprice")


GRID = [(w, s) for w in (32, 64, 128) for s in (w // 4, w // 2, w)]
_GRID_VALUES = ", ".join(f"({w}, {s})" for w, s in GRID)
_GRID_SQL = f"""l AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
grid AS (
  SELECT width, stride, CAST(sum(CASE WHEN n >= width THEN (n - width) // stride + 1 ELSE 0 END) AS BIGINT) AS windows,
         count(*) FILTER (WHERE n >= width) AS valid_sequences,
         100.0 * count(*) FILTER (WHERE n >= width) / count(*) AS coverage,
         coalesce(sum(CASE WHEN n >= width THEN (n - width) // stride + 1 ELSE 0 END)
           / nullif(count(*) FILTER (WHERE n >= width), 0), 0) AS mean_windows
  FROM l, (VALUES {_GRID_VALUES}) AS g(width, stride) GROUP BY width, stride)"""


def _grid(spark, sf):
    lengths = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("seq_len"))
    return win.coverage_grid(lengths, GRID)


@query(
    "x8_coverage_grid",
    f"""WITH {_GRID_SQL} SELECT width, stride, windows, valid_sequences, round(coverage, 6) AS coverage,
        round(mean_windows, 6) AS mean_windows FROM grid""",
)
def coverage_grid(spark, sf):
    return _grid(spark, sf).withColumns({c: F.round(c, 6) for c in ("coverage", "mean_windows")})


@query(
    "x9_grid_by_width",
    f"""WITH {_GRID_SQL}, r AS (SELECT width, windows, width // stride AS overlap FROM grid)
    SELECT width, max(windows) FILTER (WHERE overlap = 1) AS overlap_1,
           max(windows) FILTER (WHERE overlap = 2) AS overlap_2, max(windows) FILTER (WHERE overlap = 4) AS overlap_4
    FROM r GROUP BY width""",
)
def grid_by_width(spark, sf):
    overlap = F.concat(F.lit("overlap_"), (F.col("width") / F.col("stride")).cast("int"))
    names = ["overlap_1", "overlap_2", "overlap_4"]
    return _grid(spark, sf).withColumn("o", overlap).groupBy("width").pivot("o", names).agg(F.first("windows"))


@query(
    "x10_recommended_configuration",
    f"""WITH {_GRID_SQL} SELECT width, stride, windows, round(coverage, 6) AS coverage FROM grid WHERE coverage >= 60
    ORDER BY windows DESC, width, stride LIMIT 1""",
)
def recommended_configuration(spark, sf):
    best = win.recommended(_grid(spark, sf), 60.0)
    return best.select("width", "stride", "windows", F.round("coverage", 6).alias("coverage"))


@query(
    "x11_long_enough_share",
    """WITH l AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)
    SELECT g AS width, round(100.0 * count(*) FILTER (WHERE n >= g) / count(*), 6) AS share
    FROM l, (VALUES (32), (64), (128), (256), (512), (600)) AS t(g) GROUP BY g""",
)
def long_enough_share(spark, sf):
    lengths = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("seq_len"))
    grid = win.coverage_grid(lengths, [(w, w) for w in (32, 64, 128, 256, 512, 600)])
    return grid.select("width", F.round("coverage", 6).alias("share"))


@query(
    "x12_several_configurations",
    f"""WITH {LINES_SQL}, {windows_sql('ln', 'l_suppkey', ['l_quantity', 'l_discount'], 64, 16, 10, 'a')},
    {windows_sql('ln', 'l_suppkey', ['l_quantity', 'l_discount'], 128, 32, 10, 'b')}
    SELECT 'w64_s16' AS window_config, l_suppkey, start_idx, end_idx, padded, l_quantity, l_discount FROM a
    UNION ALL SELECT 'w128_s32', l_suppkey, start_idx, end_idx, padded, l_quantity, l_discount FROM b""",
)
def several_configurations(spark, sf):
    got = win.sliding_windows(lines(spark, sf), LINE_KEYS, ["l_quantity", "l_discount"], win.CONFIGS)
    return got.drop("original_length")


@query(
    "p28_window_count_rule",
    """WITH l AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN n >= 64 THEN (n - 64) // 16 + 1 ELSE 0 END AS windows FROM l""",
)
def window_count_rule(spark, sf):
    lengths = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return lengths.select("user_id", win.window_count(F.col("n"), 64, 16).alias("windows"))


