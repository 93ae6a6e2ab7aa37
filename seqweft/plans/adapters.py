"""The given tables seen as readings, subject attributes, predictions and trials.

Each adapter has its SQL twin as a WITH clause, so that queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.operators.ordered import with_positions


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


EVENT_KEYS = ["user_id"]
EVENT_ORDER = ["ts", "event_id"]


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with two channels: a sequence is one user's events in time order."""
    df = table(spark, sf, "events").select(
        "user_id",
        "ts",
        "event_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    return with_positions(df, EVENT_KEYS, EVENT_ORDER, length="seq_len", keep_slices=True)


EVENTS_SQL = """ev AS (
  SELECT user_id, ts, event_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS seq_len
  FROM events)"""


def gappy_events(spark: SparkSession, sf: str) -> DataFrame:
    """The same readings with `value` missing on error events."""
    return events(spark, sf).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


GAPPY_SQL = (
    EVENTS_SQL
    + """,
gap AS (
  SELECT user_id, ts, event_id, event_type, pos, seq_len, k,
         CASE WHEN event_type <> 'error' THEN value END AS value
  FROM ev)"""
)


def sentinel_events(spark: SparkSession, sf: str) -> DataFrame:
    """The same readings with -1 in place of `value` on error events."""
    return events(spark, sf).withColumn(
        "value", F.when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(F.col("value"))
    )


SENTINEL_SQL = (
    EVENTS_SQL
    + """,
sen AS (
  SELECT user_id, ts, event_id, event_type, pos, seq_len, k,
         CASE WHEN event_type = 'error' THEN -1.0 ELSE value END AS value
  FROM ev)"""
)

LINE_KEYS = ["l_suppkey"]
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
LINE_CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_channels(lineitem: DataFrame) -> DataFrame:
    return lineitem.withColumns(
        {
            "l_extendedprice": F.round("l_extendedprice"),
            "l_discount": F.round(F.col("l_discount") * 100),
            "l_tax": F.round(F.col("l_tax") * 100),
        }
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with four channels: a sequence is one supplier's line items by ship date.

    Prices are in whole units and rates in percent: sums of whole numbers are exact in any order.
    """
    df = line_channels(table(spark, sf, "lineitem")).select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", *LINE_CHANNELS
    )
    return with_positions(df, LINE_KEYS, LINE_ORDER, length="seq_len", keep_slices=True)


LINES_SQL = """ln AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_returnflag,
         l_quantity, round(l_extendedprice) AS l_extendedprice, round(l_discount * 100) AS l_discount,
         round(l_tax * 100) AS l_tax,
         row_number() OVER (PARTITION BY l_suppkey
                            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos,
         count(*) OVER (PARTITION BY l_suppkey) AS seq_len
  FROM lineitem)"""


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Subject attributes read off the customer table; handedness 0 means left."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("subject"),
        (key % 2).cast("int").alias("adult_child"),
        (key % 104).cast("int").alias("age"),
        (F.floor(key / 2) % 2).cast("int").alias("sex"),
        (key % 3 != 0).cast("int").alias("handedness"),
        (F.col("c_acctbal") / 100 + 120).alias("height_cm"),
        (key % 17 + 40).cast("double").alias("shoulder_to_wrist_cm"),
        (key % 11 + 20).cast("double").alias("elbow_to_wrist_cm"),
    )


SUBJECTS_SQL = """sub AS (
  SELECT c_custkey AS subject, CAST(c_custkey % 2 AS INTEGER) AS adult_child,
         CAST(c_custkey % 104 AS INTEGER) AS age, CAST((c_custkey // 2) % 2 AS INTEGER) AS sex,
         CAST(CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS handedness,
         c_acctbal / 100 + 120 AS height_cm,
         CAST(c_custkey % 17 + 40 AS DOUBLE) AS shoulder_to_wrist_cm,
         CAST(c_custkey % 11 + 20 AS DOUBLE) AS elbow_to_wrist_cm
  FROM customer)"""


def motion(spark: SparkSession, sf: str) -> DataFrame:
    """Acceleration and orientation channels read off the first seven vector entries."""
    e = F.col("embedding")
    names = ["rot_w", "rot_x", "rot_y", "rot_z", "acc_x", "acc_y", "acc_z"]
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", *[e[i].cast("double").alias(n) for i, n in enumerate(names)]
    )


MOTION_SQL = """mo AS (
  SELECT vec_id, label,
         CAST(embedding[1] AS DOUBLE) AS rot_w, CAST(embedding[2] AS DOUBLE) AS rot_x,
         CAST(embedding[3] AS DOUBLE) AS rot_y, CAST(embedding[4] AS DOUBLE) AS rot_z,
         CAST(embedding[5] AS DOUBLE) AS acc_x, CAST(embedding[6] AS DOUBLE) AS acc_y,
         CAST(embedding[7] AS DOUBLE) AS acc_z
  FROM embeddings)"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """8x8 frames: the 64 vector entries as tof_1_v0 ... tof_1_v63; entries below -0.3 are no response."""
    e = F.col("embedding")
    pixels = [
        F.when(e[i] < -0.3, F.lit(-1.0)).otherwise(e[i].cast("double")).alias(f"tof_1_v{i}") for i in range(64)
    ]
    return table(spark, sf, "embeddings").select("vec_id", "label", *pixels)


GRID_SQL = """gr AS (
  SELECT vec_id, label, i AS pixel,
         CASE WHEN embedding[i + 1] < -0.3 THEN -1.0 ELSE CAST(embedding[i + 1] AS DOUBLE) END AS value
  FROM embeddings, range(0, 64) AS t(i))"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """True and predicted class per vector; one third of the predictions are off by one class."""
    wrong = (F.col("vec_id") % 3 == 0).cast("int")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sequence_id"),
        F.col("label").cast("int").alias("truth"),
        ((F.col("label") + wrong) % 10).cast("int").alias("guess"),
    )


PREDICTIONS_SQL = """pr AS (
  SELECT vec_id AS sequence_id, CAST(label AS INTEGER) AS truth,
         CAST((label + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) % 10 AS INTEGER) AS guess
  FROM embeddings)"""

TARGET_CODES = [0, 1, 2, 3]


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Long class probabilities: three models per sequence of five windows, ten classes.

    Weights are whole numbers out of 1000, so that averages do not depend on the order of addition.
    """
    e = F.col("embedding")
    weight = F.floor(F.abs(e[F.col("class")].cast("double")) * 1000).cast("long")
    base = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 5).cast("long").alias("sequence_id"),
        (F.col("vec_id") % 5).cast("int").alias("window_id"),
        (F.col("vec_id") % 3).cast("int").alias("model_id"),
        "embedding",
    )
    return base.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        "sequence_id", "window_id", "model_id", "class", (weight / F.lit(1000.0)).alias("probability")
    )


PROBABILITIES_SQL = """pb AS (
  SELECT vec_id // 5 AS sequence_id, CAST(vec_id % 5 AS INTEGER) AS window_id,
         CAST(vec_id % 3 AS INTEGER) AS model_id, CAST(c AS INTEGER) AS class,
         floor(abs(CAST(embedding[c + 1] AS DOUBLE)) * 1000) / 1000.0 AS probability
  FROM embeddings, range(0, 10) AS t(c))"""


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """Trial log: an order is a trial, its status the trial's state."""
    state = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trial_id"),
        F.when(state == "F", "COMPLETE").when(state == "O", "PRUNED").otherwise("FAIL").alias("state"),
        F.col("o_orderdate").alias("datetime_start"),
        F.col("o_orderpriority").alias("fusion"),
        (F.col("o_custkey") % 7).cast("int").alias("param"),
    )


def trial_values(spark: SparkSession, sf: str) -> DataFrame:
    """One score per trial, with the date the trial ended."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("trial_id"))
        .agg(
            (F.sum(F.col("l_quantity").cast("long")) / F.lit(1000.0)).alias("value"),
            F.max("l_shipdate").alias("datetime_complete"),
        )
    )


TRIALS_SQL = """trials AS (
  SELECT o_orderkey AS trial_id,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'PRUNED' ELSE 'FAIL' END AS state,
         o_orderdate AS datetime_start, o_orderpriority AS fusion,
         CAST(o_custkey % 7 AS INTEGER) AS param
  FROM orders),
trial_values AS (
  SELECT l_orderkey AS trial_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) / 1000.0 AS value,
         max(l_shipdate) AS datetime_complete
  FROM lineitem GROUP BY l_orderkey)"""
