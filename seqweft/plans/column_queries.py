"""Projections, filters and scalar functions (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.functions import attributes as att
from seqweft.functions import channels as ch
from seqweft.functions import geometry as geo
from seqweft.functions.handedness import mirror_left, mirror_left_v2
from seqweft.functions.labels import collapsed, is_target
from seqweft.operators import clean, trials as tr
from seqweft.plans.adapters import (
    EVENTS_SQL,
    GAPPY_SQL,
    GRID_SQL,
    MOTION_SQL,
    PREDICTIONS_SQL,
    SUBJECTS_SQL,
    TARGET_CODES,
    TRIALS_SQL,
    events,
    gappy_events,
    grid,
    motion,
    predictions,
    subjects,
    table,
    trial_values,
    trials,
)
from seqweft.plans.registry import query


@query("p1_filter_label", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def filter_label(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type") == "purchase").select("event_id", "user_id", "value")


@query("p2_minimum_length", f"WITH {EVENTS_SQL} SELECT user_id, pos, value FROM ev WHERE seq_len >= 64")
def minimum_length(spark, sf):
    return events(spark, sf).where(F.col("seq_len") >= 64).select("user_id", "pos", "value")


@query(
    "p3_sentinel_to_null",
    f"WITH {GRID_SQL} SELECT vec_id, pixel, nullif(value, -1.0) AS value FROM gr",
)
def sentinel_to_null(spark, sf):
    df = grid(spark, sf)
    pixels = ch.by_prefix(df, "tof_")
    cleaned = clean.sentinel_to_null(df, pixels)
    long = ch.to_long(cleaned, ["vec_id"], pixels)
    return long.select("vec_id", ch.pixel_parts(F.col("channel"))["pixel"].cast("long").alias("pixel"), "value")


@query(
    "p4_out_of_range_to_null",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN abs(l_quantity) <= 40 THEN l_quantity END AS l_quantity FROM lineitem",
)
def out_of_range_to_null(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return clean.out_of_range_to_null(df, ["l_quantity"])


@query(
    "p5_non_finite_replaced",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 0.0 WHEN 'click' THEN 1.0 WHEN 'view' THEN -1.0
        ELSE value END AS value FROM events""",
)
def non_finite_replaced(spark, sf):
    kind = F.col("event_type")
    odd = (
        F.when(kind == "error", F.lit(float("nan")))
        .when(kind == "click", F.lit(float("inf")))
        .when(kind == "view", F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    df = table(spark, sf, "events").select("event_id", odd.alias("value"))
    return clean.replace_non_finite(df, ["value"])


def _handed(spark, sf):
    return motion(spark, sf).withColumn("handedness", (F.col("vec_id") % 3 != 0).cast("int"))


_AXES = ["acc_x", "acc_y", "acc_z", "rot_w", "rot_x", "rot_y", "rot_z"]
_MIRROR_SQL = ", ".join(
    f"CASE WHEN vec_id % 3 = 0 THEN -{c} ELSE {c} END AS {c}" if c[-1] in "yz" else c for c in _AXES
)


@query("p6_mirror_left_handed", f"WITH {MOTION_SQL} SELECT vec_id, {_MIRROR_SQL} FROM mo")
def mirror_left_handed(spark, sf):
    return mirror_left(_handed(spark, sf)).select("vec_id", *_AXES)


_PIXELS = [f"tof_1_v{i}" for i in range(64)]
_PIXELS_SQL = ", ".join(
    f"max(CASE WHEN pixel = {i} THEN CASE WHEN vec_id % 3 = 0 THEN -value ELSE value END END) AS {c}" for i, c in enumerate(_PIXELS)
)


@query(
    "p7_mirror_left_handed_v2",
    f"""WITH {MOTION_SQL}, {GRID_SQL}, px AS (SELECT vec_id, {_PIXELS_SQL} FROM gr GROUP BY vec_id),
    mi AS (SELECT vec_id, {_MIRROR_SQL} FROM mo) SELECT * FROM mi JOIN px USING (vec_id)""",
)
def mirror_left_handed_v2(spark, sf):
    pixels = grid(spark, sf).select("vec_id", *_PIXELS)
    return mirror_left_v2(_handed(spark, sf).join(pixels, "vec_id")).select("vec_id", *_AXES, *_PIXELS)


@query(
    "p8_correction_difference",
    f"""WITH {MOTION_SQL} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -2 * acc_y ELSE 0.0 END AS acc_y,
        CASE WHEN vec_id % 3 = 0 THEN -2 * acc_z ELSE 0.0 END AS acc_z FROM mo""",
)
def correction_difference(spark, sf):
    before = _handed(spark, sf).withColumns({"y0": F.col("acc_y"), "z0": F.col("acc_z")})
    after = mirror_left(before)
    return after.select(
        "vec_id", (F.col("acc_y") - F.col("y0")).alias("acc_y"), (F.col("acc_z") - F.col("z0")).alias("acc_z")
    )


@query(
    "p9_missing_group_flags",
    f"""WITH {GAPPY_SQL} SELECT user_id, pos, value IS NULL AS motion_missing,
        (value IS NULL AND k < 10) AS both_missing FROM gap""",
)
def missing_group_flags(spark, sf):
    df = gappy_events(spark, sf).withColumn("k", F.when(F.col("k") >= 10, F.col("k")))
    out = clean.missing_group_flags(df, {"motion": ["value"], "both": ["value", "k"]})
    return out.select("user_id", "pos", "motion_missing", "both_missing")


_UNIT_SQL = f"""{MOTION_SQL},
nq AS (SELECT *, sqrt(rot_w * rot_w + rot_x * rot_x + rot_y * rot_y + rot_z * rot_z) AS n FROM mo),
un AS (SELECT vec_id, label, acc_x, acc_y, acc_z, rot_w / n AS w, rot_x / n AS x, rot_y / n AS y, rot_z / n AS z FROM nq),
rm AS (SELECT *, 1 - 2 * (y*y + z*z) AS r11, 2 * (x*y - z*w) AS r12, 2 * (x*z + y*w) AS r13,
  2 * (x*y + z*w) AS r21, 1 - 2 * (x*x + z*z) AS r22, 2 * (y*z - x*w) AS r23,
  2 * (x*z - y*w) AS r31, 2 * (y*z + x*w) AS r32, 1 - 2 * (x*x + y*y) AS r33 FROM un),
wo AS (SELECT *, r11*acc_x + r12*acc_y + r13*acc_z AS wx, r21*acc_x + r22*acc_y + r23*acc_z AS wy,
  r31*acc_x + r32*acc_y + r33*acc_z AS wz FROM rm)"""


def _unit(spark, sf):
    df = motion(spark, sf)
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in geo.QUATERNION), F.lit(0.0)))
    return df.withColumn("_n", norm).withColumns({c: F.col(c) / F.col("_n") for c in geo.QUATERNION})


@query(
    "p10_rotation_matrix",
    f"WITH {_UNIT_SQL} SELECT vec_id, "
    + ", ".join(f"round(r{i}{j}, 9) AS r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    + " FROM rm",
)
def rotation_matrix(spark, sf):
    df = geo.rotation_matrix(_unit(spark, sf))
    cells = [F.round(F.col("rotation")[i][j], 9).alias(f"r{i + 1}{j + 1}") for i in range(3) for j in range(3)]
    return df.select("vec_id", *cells)


@query(
    "p11_world_frame",
    f"WITH {_UNIT_SQL} SELECT vec_id, round(wx, 9) AS acc_w_x, round(wy, 9) AS acc_w_y, round(wz, 9) AS acc_w_z FROM wo",
)
def world_frame(spark, sf):
    out = geo.world_frame(_unit(spark, sf))
    return out.select("vec_id", *[F.round(f"acc_w_{a}", 9).alias(f"acc_w_{a}") for a in "xyz"])


@query(
    "p12_linear_acceleration",
    f"""WITH {_UNIT_SQL} SELECT vec_id, round(wx, 9) AS lin_acc_x, round(wy, 9) AS lin_acc_y,
        round(wz - 9.81::DOUBLE, 9) AS lin_acc_z FROM wo""",
)
def linear_acceleration(spark, sf):
    out = geo.world_frame(_unit(spark, sf))
    return out.select("vec_id", *[F.round(f"lin_acc_{a}", 9).alias(f"lin_acc_{a}") for a in "xyz"])


@query(
    "p13_magnitudes",
    f"""WITH {_UNIT_SQL} SELECT vec_id, round(sqrt(acc_x*acc_x + acc_y*acc_y + acc_z*acc_z), 9) AS raw,
        round(sqrt(wx*wx + wy*wy + wz*wz), 9) AS world,
        round(sqrt(wx*wx + wy*wy + (wz - 9.81::DOUBLE)*(wz - 9.81::DOUBLE)), 9) AS linear FROM wo""",
)
def magnitudes(spark, sf):
    out = geo.world_frame(_unit(spark, sf))
    names = {"raw": "acc_", "world": "acc_w_", "linear": "lin_acc_"}
    return out.select(
        "vec_id", *[F.round(geo.magnitude(*[F.col(p + a) for a in "xyz"]), 9).alias(n) for n, p in names.items()]
    )


def _bins_sql(column, edges, names, open_ended):
    cases = " ".join(f"WHEN {column} <= {hi} THEN '{n}'" for n, hi in zip(names, edges[1:]))
    low = "" if open_ended else f"WHEN {column} <= {edges[0]} THEN NULL"
    high = f"WHEN {column} > {edges[-1]} THEN " + (f"'{names[-1]}'" if open_ended else "NULL")
    return f"CASE {high} {low} {cases} END"


def _bins_query(name, open_ended):
    age, height = (_bins_sql(c, *b, open_ended) for c, b in (("age", att.AGE_BINS), ("height_cm", att.HEIGHT_BINS)))

    @query(name, f"WITH {SUBJECTS_SQL} SELECT subject, {age} AS age_group, {height} AS height_cat FROM sub")
    def bins(spark, sf):
        return subjects(spark, sf).select(
            "subject",
            att.binned(F.col("age"), *att.AGE_BINS, open_ended=open_ended).alias("age_group"),
            att.binned(F.col("height_cm"), *att.HEIGHT_BINS, open_ended=open_ended).alias("height_cat"),
        )

    return bins


attribute_bins = _bins_query("p14_attribute_bins", False)
serving_bins = _bins_query("p15_serving_bins", True)


@query(
    "p16_attribute_ratios",
    f"""WITH {SUBJECTS_SQL} SELECT subject, round(elbow_to_wrist_cm / shoulder_to_wrist_cm, 9) AS arm_ratio,
        round(shoulder_to_wrist_cm / nullif(height_cm, 0), 9) AS arm_length_relative FROM sub""",
)
def attribute_ratios(spark, sf):
    out = att.attribute_features(subjects(spark, sf))
    return out.select("subject", *[F.round(c, 9).alias(c) for c in ("arm_ratio", "arm_length_relative")])


@query(
    "p17_attribute_interactions",
    f"WITH {SUBJECTS_SQL} SELECT subject, sex * age AS sex_age_interaction, handedness * 2 + sex AS handedness_sex FROM sub",
)
def attribute_interactions(spark, sf):
    return att.attribute_features(subjects(spark, sf)).select("subject", "sex_age_interaction", "handedness_sex")


def _one_hot_sql(open_ended):
    parts = []
    for column, bins, prefix in (("age", att.AGE_BINS, "age_group"), ("height_cm", att.HEIGHT_BINS, "height_cat")):
        case = _bins_sql(column, *bins, open_ended)
        parts += [f"CAST(coalesce(({case}) = '{n}', false) AS INTEGER) AS {prefix}_{n}" for n in bins[1]]
    return ", ".join(parts)


@query("p18_one_hot_bins", f"WITH {SUBJECTS_SQL} SELECT subject, {_one_hot_sql(False)} FROM sub")
def one_hot_bins(spark, sf):
    return att.attribute_features(subjects(spark, sf)).select("subject", *att.ONE_HOT)


_FEATURES_SQL = f"""adult_child, age, sex, handedness, height_cm, shoulder_to_wrist_cm, elbow_to_wrist_cm,
    round(elbow_to_wrist_cm / nullif(shoulder_to_wrist_cm, 0), 9) AS arm_ratio,
    round(shoulder_to_wrist_cm / nullif(height_cm, 0), 9) AS arm_length_relative,
    sex * age AS sex_age_interaction, handedness * 2 + sex AS handedness_sex"""


@query("p19_attribute_features", f"WITH {SUBJECTS_SQL} SELECT subject, {_FEATURES_SQL}, {_one_hot_sql(False)} FROM sub")
def attribute_features(spark, sf):
    out = att.attribute_features(subjects(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("arm_ratio", "arm_length_relative")})


@query(
    "p20_default_attributes",
    f"""WITH {SUBJECTS_SQL}, d AS (
      SELECT DISTINCT o_custkey AS subject FROM orders UNION SELECT c_custkey + 1000000 FROM customer),
    j AS (SELECT d.subject, coalesce(adult_child, 1) AS adult_child, coalesce(age, 30) AS age, coalesce(sex, 1) AS sex,
        coalesce(handedness, 1) AS handedness, coalesce(height_cm, 170.0) AS height_cm,
        coalesce(shoulder_to_wrist_cm, 55.0) AS shoulder_to_wrist_cm, coalesce(elbow_to_wrist_cm, 25.0) AS elbow_to_wrist_cm
      FROM d LEFT JOIN sub USING (subject))
    SELECT subject, {_FEATURES_SQL}, {_one_hot_sql(True)} FROM j""",
)
def default_attributes(spark, sf):
    """Attributes of all who ordered, and of subjects nobody knows."""
    known = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"))
    unknown = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).alias("subject"))
    asked = known.union(unknown).distinct()
    joined = att.with_defaults(asked.join(subjects(spark, sf), "subject", "left"))
    out = att.attribute_features(joined, open_ended=True)
    return out.withColumns({c: F.round(c, 9) for c in ("arm_ratio", "arm_length_relative")})


_TARGETS = ", ".join(map(str, TARGET_CODES))


@query(
    "p21_target_mapping",
    f"""WITH {PREDICTIONS_SQL} SELECT sequence_id, CAST(CASE WHEN truth IN ({_TARGETS}) THEN 1 ELSE 0 END AS INTEGER) AS is_target,
        CASE WHEN truth IN ({_TARGETS}) THEN CAST(truth AS VARCHAR) ELSE 'non_target' END AS collapsed FROM pr""",
)
def target_mapping(spark, sf):
    label = F.col("truth")
    return predictions(spark, sf).select(
        "sequence_id", is_target(label, TARGET_CODES).alias("is_target"), collapsed(label, TARGET_CODES).alias("collapsed")
    )


@query(
    "p22_channel_family",
    f"""WITH {GRID_SQL}, n AS (SELECT DISTINCT 'tof_1_v' || pixel || '_mean' AS feature FROM gr
      UNION SELECT 'acc_' || l_returnflag || '_std' FROM lineitem UNION SELECT 'rot_' || l_linestatus FROM lineitem
      UNION SELECT 'thm_' || l_linenumber FROM lineitem UNION SELECT p_name FROM part)
    SELECT feature, CASE WHEN contains(feature, 'acc_') THEN 'acc' WHEN contains(feature, 'rot_') THEN 'rot'
      WHEN contains(feature, 'thm_') THEN 'thm' WHEN contains(feature, 'tof_') THEN 'tof' ELSE 'other' END AS family FROM n""",
)
def channel_family(spark, sf):
    items = table(spark, sf, "lineitem")
    names = [
        ch.to_long(g := grid(spark, sf), [], ch.by_prefix(g, "tof_")).select(F.concat("channel", F.lit("_mean")).alias("feature")),
        items.select(F.concat(F.lit("acc_"), "l_returnflag", F.lit("_std"))),
        items.select(F.concat(F.lit("rot_"), "l_linestatus")),
        items.select(F.concat(F.lit("thm_"), F.col("l_linenumber").cast("string"))),
        table(spark, sf, "part").select("p_name"),
    ]
    every = names[0]
    for more in names[1:]:
        every = every.union(more)
    return every.distinct().select("feature", ch.family_of(F.col("feature")).alias("family"))


@query(
    "p23_eligible_columns",
    """SELECT unnest(['event_id', 'user_id', 'value', 'gappy']) AS "column",
        unnest([count(event_id), count(user_id), count(value), count(CASE WHEN event_type <> 'error' THEN value END)]) = count(*)
          AS eligible FROM events""",
)
def eligible_columns(spark, sf):
    df = table(spark, sf, "events").withColumn("gappy", F.when(F.col("event_type") != "error", F.col("value")))
    return tr.eligible_columns(df)


@query(
    "p24_trial_durations",
    f"""WITH {TRIALS_SQL} SELECT trial_id, date_diff('second', datetime_start, datetime_complete) / 60 AS minutes
    FROM trials JOIN trial_values USING (trial_id)""",
)
def trial_durations(spark, sf):
    done = trials(spark, sf).join(trial_values(spark, sf), "trial_id")
    return done.select("trial_id", tr.minutes_between("datetime_start", "datetime_complete").alias("minutes"))


@query(
    "p25_normal_interval",
    """WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type)
    SELECT event_type, round(m - 1.96 * s, 6) AS low, round(m + 1.96 * s, 6) AS high FROM s""",
)
def normal_interval(spark, sf):
    stats = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return tr.normal_interval(stats, "m", "s").select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "p26_combined_scores",
    """WITH s AS (SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS f, CAST(count(*) AS DOUBLE) AS m,
          CAST(max(l_linenumber) AS DOUBLE) + count(DISTINCT l_partkey) AS r FROM lineitem GROUP BY l_suppkey),
    n AS (SELECT l_suppkey, (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) AS f_norm,
          (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) AS m_norm, r / max(r) OVER () AS r_norm FROM s)
    SELECT l_suppkey, round(f_norm, 9) AS f_norm, round(m_norm, 9) AS m_norm, round(r_norm, 9) AS r_norm,
           round((f_norm + m_norm + r_norm) / 3, 9) AS combined_score FROM n""",
)
def combined_scores(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.col("l_quantity").cast("long")).cast("double").alias("f"),
        F.count(F.lit(1)).cast("double").alias("m"),
        (F.max("l_linenumber").cast("double") + F.count_distinct("l_partkey")).alias("r"),
    )
    out = tr.combined_scores(scores, spread=["f", "m"], peak=["r"])
    return out.select("l_suppkey", *[F.round(c, 9).alias(c) for c in ("f_norm", "m_norm", "r_norm", "combined_score")])


@query(
    "p27_pixel_names",
    """SELECT DISTINCT 'tof_' || l_linenumber || '_v' || (l_suppkey % 64) AS channel, l_linenumber AS sensor,
        CAST(l_suppkey % 64 AS INTEGER) AS pixel, CAST(l_suppkey % 64 // 8 AS INTEGER) AS "row",
        CAST(l_suppkey % 64 % 8 AS INTEGER) AS col FROM lineitem""",
)
def pixel_names(spark, sf):
    pixel = (F.col("l_suppkey") % 64).cast("string")
    name = F.concat(F.lit("tof_"), F.col("l_linenumber").cast("string"), F.lit("_v"), pixel).alias("channel")
    names = table(spark, sf, "lineitem").select(name).distinct()
    return names.select("channel", *[e.alias(n) for n, e in ch.pixel_parts(F.col("channel")).items()])
