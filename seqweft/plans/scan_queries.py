"""Scans, sinks, schema reports and guarded tables (S)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from seqweft.functions import channels as ch
from seqweft.operators.profile import column_report, null_report
from seqweft.operators.windows import CONFIGS, sliding_windows
from seqweft.plans.adapters import (
    GRID_SQL,
    LINE_CHANNELS,
    LINE_KEYS,
    LINES_SQL,
    PREDICTIONS_SQL,
    TRIALS_SQL,
    grid,
    lines,
    predictions,
    table,
    trial_values,
    trials,
)
from seqweft.plans.registry import query
from seqweft.plans.window_queries import windows_sql
from seqweft.session import scratch_path
from seqweft.sources import readers, writers
from seqweft.sources.predictions import read_predictions, write_predictions

_EVENT_COLUMNS = "event_id, ts, user_id, event_type, value"


@query("s1_csv_scan", f"SELECT {_EVENT_COLUMNS} FROM events")
def csv_scan(spark, sf):
    path = scratch_path(spark, "events-csv")
    writers.write_csv(table(spark, sf, "events").select(*_EVENT_COLUMNS.split(", ")), path)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    return readers.read_csv(spark, path, schema)


@query("s2_parquet_scan", "SELECT * FROM orders")
def parquet_scan(spark, sf):
    return readers.read_parquet(spark, f"{sf}/orders.parquet")


@query(
    "s2_filtered_scan",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderstatus = 'F'",
)
def filtered_scan(spark, sf):
    df = readers.read_parquet(spark, f"{sf}/orders.parquet")
    kept = (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "F")
    return df.where(kept).select("o_orderkey", "o_totalprice")


@query(
    "s3_many_file_scan",
    """SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
    FROM lineitem GROUP BY l_returnflag""",
)
def many_file_scan(spark, sf):
    path = scratch_path(spark, "lineitem-parts")
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    writers.write_parquet(df.withColumn("part", F.col("l_suppkey") % 8), path, ["part"])
    got = readers.read_parquet(spark, path)
    return got.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")
    )


@query("s4_zstd_parquet_sink", f"SELECT {_EVENT_COLUMNS} FROM events")
def zstd_parquet_sink(spark, sf):
    path = scratch_path(spark, "events-zstd")
    writers.write_parquet(table(spark, sf, "events").select(*_EVENT_COLUMNS.split(", ")), path)
    return readers.read_parquet(spark, path)


@query("s5_csv_sink", f"WITH {PREDICTIONS_SQL} SELECT sequence_id, guess AS gesture FROM pr")
def csv_sink(spark, sf):
    path = scratch_path(spark, "submission-csv")
    writers.write_csv(predictions(spark, sf).select("sequence_id", F.col("guess").alias("gesture")), path)
    return readers.read_csv(spark, path, "sequence_id long, gesture int")


@query(
    "s6_json_metadata_sink",
    """SELECT count(*) AS readings, count(DISTINCT user_id) AS sequences, count(DISTINCT event_type) AS labels,
        CAST(64 AS INTEGER) AS width, CAST(16 AS INTEGER) AS stride FROM events""",
)
def json_metadata_sink(spark, sf):
    path = scratch_path(spark, "metadata-json")
    row = table(spark, sf, "events").agg(
        F.count(F.lit(1)).alias("readings"),
        F.count_distinct("user_id").alias("sequences"),
        F.count_distinct("event_type").alias("labels"),
        F.lit(64).alias("width"),
        F.lit(16).alias("stride"),
    )
    writers.write_json(row, path)
    return spark.read.schema("readings long, sequences long, labels long, width int, stride int").json(path)


def _stored_windows(spark, sf) -> str:
    path = scratch_path(spark, "windows")
    got = sliding_windows(lines(spark, sf), LINE_KEYS, LINE_CHANNELS[:2], CONFIGS, first_of=["l_returnflag"])
    writers.write_windows(got, path)
    return path


_W64 = windows_sql("ln", "l_suppkey", LINE_CHANNELS[:2], 64, 16, 10, "a")
_W128 = windows_sql("ln", "l_suppkey", LINE_CHANNELS[:2], 128, 32, 10, "b")


@query(
    "s7_window_set_sink",
    f"""WITH {LINES_SQL}, {_W64}, {_W128}
    SELECT 'w64_s16' AS window_config, l_suppkey, start_idx, l_quantity, l_extendedprice FROM a
    UNION ALL SELECT 'w128_s32', l_suppkey, start_idx, l_quantity, l_extendedprice FROM b""",
)
def window_set_sink(spark, sf):
    path = _stored_windows(spark, sf)
    columns = ["l_suppkey", "start_idx", "l_quantity", "l_extendedprice"]
    sets = [readers.read_windows(spark, path, name).select(F.lit(name).alias("window_config"), *columns) for name in CONFIGS]
    return sets[0].unionByName(sets[1])


def _integrity_sql(flaw: str) -> str:
    """Counts and checks over the windows of both configurations, `flaw` telling which lost an array."""
    return f"""WITH {LINES_SQL}, {_W64}, {_W128}, u AS (
      SELECT 'w64_s16' AS window_config, 64 AS w, l_suppkey, start_idx, l_quantity, l_extendedprice FROM a
      UNION ALL SELECT 'w128_s32', 128, l_suppkey, start_idx, l_quantity, l_extendedprice FROM b),
    c AS (SELECT window_config, w, l_suppkey, start_idx, l_quantity, CASE WHEN NOT ({flaw}) THEN l_extendedprice END AS l_extendedprice FROM u)
    SELECT window_config, count(*) AS windows,
        CAST(min(least(coalesce(len(l_quantity), -1), coalesce(len(l_extendedprice), -1))) AS INTEGER) AS shortest,
        CAST(max(greatest(coalesce(len(l_quantity), -1), coalesce(len(l_extendedprice), -1))) AS INTEGER) AS longest,
        count(*) AS with_l_returnflag,
        CAST(max((l_quantity IS NOT NULL)::INT) + max((l_extendedprice IS NOT NULL)::INT) AS INTEGER) AS channels,
        count(*) = count(l_quantity) AND count(*) = count(l_extendedprice) AND min(len(l_quantity)) = max(w) AND max(len(l_quantity)) = max(w)
          AND min(len(l_extendedprice)) = max(w) AND max(len(l_extendedprice)) = max(w)
          AND count(*) = count(DISTINCT (l_suppkey, start_idx)) AS consistent
    FROM c GROUP BY window_config"""


@query("s8_window_set_integrity", _integrity_sql("false"))
def window_set_integrity(spark, sf):
    stored = readers.read_windows(spark, _stored_windows(spark, sf))
    return readers.window_integrity(stored, ["l_suppkey", "start_idx"], LINE_CHANNELS[:2], ["l_returnflag"])


@query(
    "s8_wrong_width_and_attributes",
    f"""WITH {LINES_SQL}, {_W64}, {_W128}, u AS (
      SELECT 'w64_s16' AS window_config, 64 AS w, 64 AS cut, l_suppkey, start_idx, l_quantity FROM a
      UNION ALL SELECT 'w128_s32', 128, 100, l_suppkey, start_idx, l_quantity[:100] FROM b
      UNION ALL SELECT 'w64_more', 64, 64, l_suppkey, start_idx, l_quantity FROM a)
    SELECT window_config, count(*) AS windows, CAST(min(len(l_quantity)) AS INTEGER) AS shortest, CAST(max(len(l_quantity)) AS INTEGER) AS longest,
        1 AS channels, max(w) = max(cut) AND count(*) FILTER (WHERE window_config = 'w64_more' AND s_acctbal < 0) = 0 AS consistent
    FROM u LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY window_config""",
)
def wrong_width_and_attributes(spark, sf):
    """Sets held against their widths and attributes: one right, one short in every window, one without some attributes."""
    sets = readers.read_windows(spark, _stored_windows(spark, sf)).drop("l_extendedprice")
    more = sets.where("window_config = 'w64_s16'").withColumn("window_config", F.lit("w64_more"))
    short = F.when(F.col("window_config") == "w128_s32", F.slice("l_quantity", 1, 100)).otherwise(F.col("l_quantity"))
    attributes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    joined = sets.withColumn("l_quantity", short).unionByName(more).join(attributes, "l_suppkey", "left")
    lost = (F.col("window_config") == "w64_more") & (F.col("s_acctbal") < 0)
    joined = joined.withColumn("s_acctbal", F.when(~lost, F.col("s_acctbal")))
    widths = {"w64_s16": 64, "w128_s32": 128, "w64_more": 64}
    return readers.window_integrity(joined, ["l_suppkey", "start_idx"], ["l_quantity"], (), ["s_acctbal"], widths)


@query("s8_broken_window_set", _integrity_sql("w = 128 AND l_suppkey % 5 = 0"))
def broken_window_set(spark, sf):
    """A set in which every fifth supplier's wide windows lost a channel."""
    stored = readers.read_windows(spark, _stored_windows(spark, sf))
    lost = (F.col("window_config") == "w128_s32") & (F.col("l_suppkey") % 5 == 0)
    broken = stored.withColumn("l_extendedprice", F.when(~lost, F.col("l_extendedprice")))
    return readers.window_integrity(broken, ["l_suppkey", "start_idx"], LINE_CHANNELS[:2], ["l_returnflag"])


_FINGERPRINT_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "s9_dataset_fingerprint",
    """WITH h AS (SELECT ('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)), 1, 8))::BIGINT AS h
      FROM orders)
    SELECT count(*) AS rows, bit_xor(h) AS hash_xor, CAST(sum(h) AS BIGINT) AS hash_sum FROM h""",
)
def dataset_fingerprint(spark, sf):
    return writers.text_fingerprint(table(spark, sf, "orders"), _FINGERPRINT_COLUMNS)


@query(
    "s9_guarded_table",
    "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
)
def guarded_table(spark, sf):
    """Asked for twice: the second call finds the fingerprint and reads the stored table."""
    folder = scratch_path(spark, "guarded")
    source = table(spark, sf, "orders").select(*_FINGERPRINT_COLUMNS)

    def build(df):
        return df.groupBy("o_orderpriority").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers")
        )

    writers.rebuilt_if_changed(spark, source, build, folder)
    return writers.rebuilt_if_changed(spark, source, build, folder)


_TRIAL_QUERY = """SELECT t.fusion, count(*) AS n, max(v.value) AS best, min(v.value) AS worst
    FROM {trials} t JOIN {values} v ON t.trial_id = v.trial_id WHERE t.state = 'COMPLETE' GROUP BY t.fusion"""


@query("s10_sql_over_trials", f"WITH {TRIALS_SQL} " + _TRIAL_QUERY.format(trials="trials", values="trial_values"))
def sql_over_trials(spark, sf):
    return spark.sql(_TRIAL_QUERY, trials=trials(spark, sf), values=trial_values(spark, sf))


@query("s11_prediction_sink", f"WITH {PREDICTIONS_SQL} SELECT sequence_id, CAST(guess AS VARCHAR) AS gesture FROM pr")
def prediction_sink(spark, sf):
    path = scratch_path(spark, "predictions")
    out = predictions(spark, sf).select("sequence_id", F.col("guess").cast("string").alias("gesture"))
    writers.write_parquet(out, path)
    return readers.read_parquet(spark, path)


@query("s11_checked_predictions", f"WITH {PREDICTIONS_SQL} SELECT sequence_id, CAST(guess AS VARCHAR) AS gesture FROM pr")
def checked_predictions(spark, sf):
    """Written in two phases: a wrong count, label or key would leave nothing to read."""
    path = scratch_path(spark, "checked-predictions")
    out = predictions(spark, sf).select("sequence_id", F.col("guess").cast("string").alias("gesture"))
    write_predictions(out, path, "sequence_id", "gesture", [str(i) for i in range(10)], out.count())
    return read_predictions(spark, path).drop("run")


@query("s12_saved_transform")
def saved_transform(spark, sf):
    """Scaler and projection fitted, saved, loaded again and applied."""
    path = scratch_path(spark, "transform")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_CHANNELS)
    stages = [
        VectorAssembler(inputCols=LINE_CHANNELS, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        PCA(k=2, inputCol="scaled", outputCol="components"),
    ]
    Pipeline(stages=stages).fit(df).write().overwrite().save(path)
    out = PipelineModel.load(path).transform(df)
    parts = vector_to_array("components")
    return out.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.abs(parts[i]).alias(f"component_{i}") for i in (0, 1)]
    )


@query(
    "s12_saved_scaler",
    """WITH s AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_quantity - m) / s, 6) AS scaled FROM lineitem, s""",
)
def saved_scaler(spark, sf):
    """Spark's own scaler, which divides by the sample deviation, fitted, saved, loaded and applied."""
    path = scratch_path(spark, "scaler-model")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    stages = [
        VectorAssembler(inputCols=["l_quantity"], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
    ]
    Pipeline(stages=stages).fit(df).write().overwrite().save(path)
    out = PipelineModel.load(path).transform(df)
    value = F.round(vector_to_array("scaled")[0], 6).alias("scaled")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", value)


@query(
    "s13_channels_by_name",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate
    FROM lineitem""",
)
def channels_by_name(spark, sf):
    """Prefix, substring, exclusion and pattern, each choosing a part of the columns."""
    df = table(spark, sf, "lineitem")
    keys = ch.by_substring(df, "key")
    numbers = ch.by_prefix(df, "l_quan", "l_ext", "l_disc", "l_tax", "l_line")
    dates = ch.by_pattern(df, r"^l_.*date$")
    rest = ch.all_but(df, ["l_returnflag", "l_linestatus"])
    chosen = [c for c in df.columns if c in set(keys + numbers + dates) & set(rest) and c != "l_linestatus"]
    return df.select(*chosen)


@query(
    "s14_schema_report",
    """WITH c AS (
      SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS "column",
             unnest(['bigint', 'timestamp_ntz', 'bigint', 'string', 'double', 'string']) AS type,
             unnest([count(event_id), count(ts), count(user_id), count(event_type),
                     count(CASE WHEN event_type <> 'error' THEN value END), count(props)]) AS present,
             count(*) AS rows FROM events)
    SELECT "column", type, rows, rows - present AS nulls, CAST(6 AS INTEGER) AS columns FROM c""",
)
def schema_report(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return column_report(df)


@query(
    "s14_top_null_columns",
    """SELECT 'value' AS "column", count(*) FILTER (WHERE event_type = 'error') AS nulls,
        round(count(*) FILTER (WHERE event_type = 'error') / count(*), 8) AS ratio FROM events""",
)
def top_null_columns(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    found = null_report(df, df.columns).where(F.col("nulls") > 0)
    top = found.orderBy(F.desc("nulls"), "column").limit(10)
    return top.select("column", "nulls", F.round("ratio", 8).alias("ratio"))


@query("s15_wide_to_long", f"WITH {GRID_SQL} SELECT vec_id, 'tof_1_v' || pixel AS channel, value FROM gr")
def wide_to_long(spark, sf):
    df = grid(spark, sf)
    return ch.to_long(df, ["vec_id"], ch.by_prefix(df, "tof_"))


_HISTORY_SQL = """h AS (
  SELECT o_orderpriority AS run, CAST(row_number() OVER (PARTITION BY o_orderpriority
           ORDER BY year(o_orderdate) * 12 + month(o_orderdate)) AS INTEGER) AS epoch,
         CAST(count(*) AS DOUBLE) AS loss, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS val_loss
  FROM orders GROUP BY o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate))"""


@query("s16_training_histories", f"WITH {_HISTORY_SQL} SELECT run, epoch, loss, val_loss FROM h")
def training_histories(spark, sf):
    """Runs are written in both layouts, half nested and half flat, then read as one table."""
    path = scratch_path(spark, "histories")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month")
    monthly = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("run"), month)
        .agg(
            F.count(F.lit(1)).cast("double").alias("loss"), F.count_distinct("o_custkey").cast("double").alias("val_loss")
        )
    )
    # months of the calendar bound each run's list
    series = F.sort_array(F.collect_list(F.struct("month", "loss", "val_loss")))
    runs = monthly.groupBy("run").agg(series.alias("s")).select("run", "s.loss", "s.val_loss")
    nested = F.col("run").substr(1, 1).cast("int") % 2 == 0
    both = F.struct("loss", "val_loss")
    laid_out = runs.select(
        "run",
        F.when(nested, both).alias("training_metrics"),
        F.when(~nested, F.col("loss")).alias("loss"),
        F.when(~nested, F.col("val_loss")).alias("val_loss"),
    )
    writers.write_json(laid_out, path)
    return readers.read_histories(spark, path, multi_line=False)
