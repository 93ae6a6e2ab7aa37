"""Whole preparations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.functions.attributes import FEATURES
from seqweft.plans import flows
from seqweft.plans.adapters import (
    EVENTS_SQL,
    PROBABILITIES_SQL,
    SUBJECTS_SQL,
    probabilities,
    subjects,
    table,
)
from seqweft.plans.column_queries import _one_hot_sql
from seqweft.plans.registry import query
from seqweft.plans.window_queries import windows_sql

_RATIOS = """elbow_to_wrist_cm / nullif(shoulder_to_wrist_cm, 0) AS arm_ratio,
    shoulder_to_wrist_cm / nullif(height_cm, 0) AS arm_length_relative,
    sex * age AS sex_age_interaction, handedness * 2 + sex AS handedness_sex"""


@query(
    "training_windows",
    f"""WITH {EVENTS_SQL}, {windows_sql('ev', 'user_id', ['value'], 64, 16, 10, 'w')}, {SUBJECTS_SQL},
    pt AS (SELECT user_id, start_idx, t, value[t + 1] AS v FROM w, range(0, 64) AS g(t)),
    s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM pt),
    sc AS (SELECT user_id, start_idx, list(round((v - m) / s, 6) ORDER BY t) AS value FROM pt, s GROUP BY user_id, start_idx),
    fe AS (SELECT subject, adult_child, age, sex, handedness, height_cm, shoulder_to_wrist_cm, elbow_to_wrist_cm, {_RATIOS}, {_one_hot_sql(False)} FROM sub),
    fs AS (SELECT {", ".join(f"avg({c}) AS m_{i}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{i}" for i, c in enumerate(FEATURES))} FROM fe),
    att AS (SELECT subject, {", ".join(f"round(({c} - m_{i}) / s_{i}, 6) AS {c}" for i, c in enumerate(FEATURES))} FROM fe, fs),
    cd AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT event_type FROM events))
    SELECT 'w64_s16' AS window_config, w.user_id, start_idx, padded, sc.value, code, {", ".join(FEATURES)}
    FROM w JOIN sc USING (user_id, start_idx) JOIN ev ON ev.user_id = w.user_id AND ev.pos = 0 JOIN cd USING (event_type)
    LEFT JOIN att ON subject = w.user_id""",
)
def training_windows(spark, sf):
    readings = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    attributes = subjects(spark, sf).withColumnRenamed("subject", "user_id")
    made = flows.training_set(
        readings, attributes, ["user_id"], ["ts", "event_id"], "user_id", "event_type", ["value"], (64, 16), "w64_s16"
    )
    return made.windows.select(
        "window_config",
        "user_id",
        "start_idx",
        "padded",
        F.transform("value", lambda x: F.round(x, 6)).alias("value"),
        "code",
        *[F.round(c, 6).alias(c) for c in FEATURES],
    )


_MOTION = f"""mo AS (
  SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey % 2 AS handedness,
    CASE WHEN abs(l_quantity) <= 40 THEN l_quantity END AS ax, l_discount * 100 AS ay, l_tax * 100 AS az,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos FROM lineitem),
kn AS (
  SELECT *, last_value(ax IGNORE NULLS) OVER b AS pv, first_value(ax IGNORE NULLS) OVER a AS nv,
    last_value(CASE WHEN ax IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pi,
    first_value(CASE WHEN ax IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS ni FROM mo
  WINDOW b AS (PARTITION BY l_suppkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY l_suppkey ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fi AS (
  SELECT l_suppkey, pos, CASE WHEN ax IS NOT NULL THEN ax WHEN pos - pi <= 3 OR ni - pos <= 3 THEN
      CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (pos - pi) / (ni - pi) END END AS x,
    CASE WHEN handedness = 0 THEN -ay ELSE ay END AS y, CASE WHEN handedness = 0 THEN -az ELSE az END AS z FROM kn)"""


@query(
    "cleaned_motion_readings",
    f"""WITH {_MOTION} SELECT l_suppkey, pos, round(x, 6) AS acc_w_x, round(-z + 0 * x, 6) AS acc_w_y,
        round(y + 0 * x, 6) AS acc_w_z, round(y + 0 * x - 9.81::DOUBLE, 6) AS lin_acc_z FROM fi""",
)
def cleaned_motion_readings(spark, sf):
    """Quantity, discount and tax as acceleration, turned a quarter about x; even suppliers are left-handed."""
    turn = 0.5**0.5
    readings = table(spark, sf, "lineitem").select(
        "l_suppkey",
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("acc_x"),
        (F.col("l_discount") * 100).alias("acc_y"),
        (F.col("l_tax") * 100).alias("acc_z"),
        F.lit(turn).alias("rot_w"),
        F.lit(turn).alias("rot_x"),
        F.lit(0.0).alias("rot_y"),
        F.lit(0.0).alias("rot_z"),
    )
    hands = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 2).alias("handedness")
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    made = flows.cleaned_motion(readings, hands, ["l_suppkey"], order, "l_suppkey")
    return made.select(
        "l_suppkey", "pos", *[F.round(c, 6).alias(c) for c in ("acc_w_x", "acc_w_y", "acc_w_z", "lin_acc_z")]
    )


_WHOLE_MEANS = f"{PROBABILITIES_SQL}, m AS (SELECT sequence_id, class, avg(round(probability * 1000)) AS p FROM pb GROUP BY ALL)"


@query(
    "ensemble_answers",
    f"""WITH {_WHOLE_MEANS}, r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY p DESC, class) AS i FROM m)
    SELECT sequence_id, class FROM r WHERE i = 1 UNION ALL
    SELECT DISTINCT vec_id + 1000000, CAST(0 AS INTEGER) FROM embeddings WHERE label = 0""",
)
def ensemble_answers(spark, sf):
    """Votes for every sequence; sequences that were asked for but never scored get class 0."""
    probs = probabilities(spark, sf).withColumn("probability", F.round(F.col("probability") * 1000))
    unseen = table(spark, sf, "embeddings").where(F.col("label") == 0).select((F.col("vec_id") + 1000000).alias("sequence_id"))
    expected = probs.select("sequence_id").distinct().unionByName(unseen)
    answers, _ = flows.ensemble_answers(probs, expected, "sequence_id", "class", 0)
    return answers
