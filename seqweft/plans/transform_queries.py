"""Fitted transforms, feature scores, selection and splits (M)."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from seqweft.functions import attributes as att
from seqweft.operators import models
from seqweft.operators import transform as tf
from seqweft.operators.trials import combined_scores
from seqweft.plans.adapters import (
    GAPPY_SQL,
    PREDICTIONS_SQL,
    SUBJECTS_SQL,
    events,
    gappy_events,
    predictions,
    subjects,
    table,
)
from seqweft.plans.evaluation_queries import FEATURES, feature_table
from seqweft.plans.registry import query
from seqweft.plans.window_queries import WINDOW_ID, WINDOWS_SQL, event_windows
from seqweft.session import scratch_path
from seqweft.sources.writers import write_parquet

_HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


_STANDARDISED = (
    f"""WITH {WINDOWS_SQL}, pt AS (SELECT user_id, start_idx, t, value[t + 1] AS v FROM w, range(0, 64) AS g(t)),
    s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM pt)
    SELECT user_id, start_idx, list(round((v - m) / s, 6) ORDER BY t) AS value FROM pt, s GROUP BY user_id, start_idx"""
)


@query("m1_window_standardisation", _STANDARDISED)
def window_standardisation(spark, sf):
    windows = event_windows(spark, sf).select(*WINDOW_ID, "value")
    scaled = tf.apply_window_scaler(windows, tf.fit_window_scaler(windows, ["value"]), ["value"])
    return scaled.withColumn("value", F.transform("value", lambda x: F.round(x, 6)))


@query("m1_standardisation_from_readings", _STANDARDISED)
def standardisation_from_readings(spark, sf):
    """The same scaler by weighting each reading with the number of windows it is in."""
    readings = events(spark, sf)
    scaler = tf.fit_reading_scaler(readings, ["value"], 64, 16, 10, centre_from=table(spark, sf, "events"))
    scaled = tf.apply_window_scaler(event_windows(spark, sf).select(*WINDOW_ID, "value"), scaler, ["value"])
    return scaled.withColumn("value", F.transform("value", lambda x: F.round(x, 6)))


@query(
    "m2_tabular_standardisation",
    f"""WITH {GAPPY_SQL}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS s, avg(k) AS km, stddev_pop(k) AS ks FROM gap)
    SELECT user_id, pos, round((value - m) / s, 6) AS value, round((k - km) / ks, 6) AS k FROM gap, s""",
)
def tabular_standardisation(spark, sf):
    """Nulls are left out of the fit and stay null."""
    raw = table(spark, sf, "events")
    value = F.when(F.col("event_type") != "error", F.col("value"))
    fit_on = raw.select(value.alias("value"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    scaled = tf.apply_scaler(gappy_events(spark, sf), tf.fit_scaler(fit_on, ["value", "k"]), ["value", "k"])
    return scaled.select("user_id", "pos", *[F.round(c, 6).alias(c) for c in ("value", "k")])


@query(
    "m3_scaler_from_sample",
    f"""WITH smp AS (SELECT l_quantity AS q FROM lineitem WHERE {_HASH.format("concat_ws('|', l_orderkey, l_linenumber)")} < {int(0.3 * (1 << 32))}),
    s AS (SELECT avg(q) AS m, stddev_pop(q) AS s FROM smp)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - m) / s, 6) AS l_quantity FROM lineitem, s""",
)
def scaler_from_sample(spark, sf):
    """Fitted on the rows whose key hash falls in the first 30 %, applied to all."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    scaler = tf.fit_scaler(tf.hash_sample(df, ["l_orderkey", "l_linenumber"], 0.3), ["l_quantity"])
    return tf.apply_scaler(df, scaler, ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query(
    "m4_stored_scaler",
    """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)
    SELECT p_partkey, round((p_size - m) / s, 6) AS l_quantity FROM part, s""",
)
def stored_scaler(spark, sf):
    path = scratch_path(spark, "scaler")
    write_parquet(tf.fit_scaler(table(spark, sf, "lineitem"), ["l_quantity"]), path)
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("l_quantity"))
    return tf.apply_scaler(rows, spark.read.parquet(path), ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query(
    "a37_scaling_check",
    """SELECT round(avg(l_quantity), 6) AS mean_before, round(stddev_pop(l_quantity), 6) AS std_before,
        0.0::DOUBLE AS mean_after, 1.0::DOUBLE AS std_after FROM lineitem""",
)
def scaling_check(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity")
    scaled = tf.apply_scaler(df, tf.fit_scaler(df, ["l_quantity"]), ["l_quantity"])
    both = df.select(F.col("l_quantity").alias("before"), F.lit(None).cast("double").alias("after")).unionByName(
        scaled.select(F.lit(None).cast("double").alias("before"), F.col("l_quantity").alias("after"))
    )
    return both.agg(
        *[
            (F.round(f(c), 6) + 0.0).alias(f"{n}_{c}")
            for c in ("before", "after")
            for n, f in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    )


@query(
    "m5_label_codes",
    """WITH l AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code, event_id FROM events)
    SELECT event_id, event_type, code, event_type AS decoded FROM l""",
)
def encode_labels(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    codes = tf.label_codes(df, "event_type")
    back = codes.select("code", F.col("event_type").alias("decoded"))
    encoded = tf.salted_join(df, codes, ["event_type"], ["event_id"], "inner")
    decoded = tf.salted_join(encoded, back, ["code"], ["event_id"], "inner")
    return decoded.select("event_id", "event_type", "code", "decoded")


@query("m6_principal_components")
def principal_components(spark, sf):
    """Absolute values, as the components' signs are arbitrary."""
    features = att.attribute_features(subjects(spark, sf))
    scores, _ = models.principal_components(features, att.FEATURES, 18, ["subject"])
    return scores.select("subject", *[F.round(F.abs(f"pc{i + 1}"), 6).alias(f"pc{i + 1}") for i in range(18)])


@query(
    "m6_component_variances",
    f"""WITH {SUBJECTS_SQL}, c AS (SELECT var_samp(age) AS a, var_samp(height_cm) AS d, covar_samp(age, height_cm) AS b FROM sub)
    SELECT round((a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b), 6) AS first,
           round((a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b), 6) AS second FROM c""",
)
def component_variances(spark, sf):
    """Two components of two attributes: their variances are the eigenvalues SQL can write down."""
    scores, _ = models.principal_components(subjects(spark, sf), ["age", "height_cm"], 2, ["subject"])
    return scores.agg(
        F.round(F.var_samp("pc1"), 6).alias("first"), F.round(F.var_samp("pc2"), 6).alias("second")
    )


# fixed values: positions of the eight chosen attribute features
CHOSEN = [8, 6, 17, 2, 5, 7, 3, 16]


@query(
    "m7_chosen_features",
    f"""WITH {SUBJECTS_SQL} SELECT subject, round(shoulder_to_wrist_cm / nullif(height_cm, 0), 9) AS arm_length_relative,
        elbow_to_wrist_cm, CAST(coalesce(height_cm > 160 AND height_cm <= 170, false) AS INTEGER) AS height_cat_average, sex,
        shoulder_to_wrist_cm, round(elbow_to_wrist_cm / shoulder_to_wrist_cm, 9) AS arm_ratio, handedness,
        CAST(coalesce(height_cm > 0 AND height_cm <= 160, false) AS INTEGER) AS height_cat_short FROM sub""",
)
def chosen_features(spark, sf):
    features = att.attribute_features(subjects(spark, sf))
    out = features.select("subject", *[att.FEATURES[i] for i in CHOSEN])
    return out.withColumns({c: F.round(c, 9) for c in ("arm_ratio", "arm_length_relative")})


_POLY = ["adult_child", "age", "sex", "handedness"]


@query(
    "m8_feature_products",
    f"WITH {SUBJECTS_SQL} SELECT subject, {', '.join(_POLY)}, "
    + ", ".join(f"{a} * {b} AS {a}_x_{b}" for i, a in enumerate(_POLY) for b in _POLY[i + 1 :])
    + " FROM sub",
)
def feature_products(spark, sf):
    return tf.interactions(subjects(spark, sf), _POLY, ["subject"])


@query(
    "m8_feature_products_with_squares",
    f"WITH {SUBJECTS_SQL} SELECT subject, {', '.join(_POLY)}, "
    + ", ".join(f"{a} * {b} AS {a}_x_{b}" for i, a in enumerate(_POLY) for b in _POLY[i:])
    + " FROM sub",
)
def feature_products_with_squares(spark, sf):
    return tf.interactions(subjects(spark, sf), _POLY, ["subject"], squares=True)


_EMBEDDED = "u AS (SELECT label, 'e' || i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) AS t(i))"
_ANOVA = f"""{_EMBEDDED}, g AS (SELECT feature, label, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM u GROUP BY ALL),
a AS (SELECT feature, avg(v) AS m FROM u GROUP BY feature),
fs AS (SELECT feature, (sum(n * pow(g.m - a.m, 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS f_score
  FROM g JOIN a USING (feature) GROUP BY feature)"""


@query("m9_anova_scores", f"WITH {_ANOVA} SELECT feature, round(f_score, 6) AS f_score FROM fs")
def anova_scores(spark, sf):
    out = tf.anova_scores(feature_table(spark, sf), FEATURES, "label")
    return out.select("feature", F.round("f_score", 6).alias("f_score"))


@query(
    "m9_best_features",
    f"WITH {_ANOVA} SELECT feature, round(f_score, 6) AS f_score FROM fs ORDER BY fs.f_score DESC, feature LIMIT 8",
)
def best_features(spark, sf):
    scores = tf.anova_scores(feature_table(spark, sf), FEATURES, "label")
    return tf.top_features(scores, "f_score", 8).select("feature", F.round("f_score", 6).alias("f_score"))


_MI = f"""{_EMBEDDED}, q AS (SELECT feature, quantile_cont(v, [{", ".join(f"{i / 10}" for i in range(1, 10))}]) AS e FROM u GROUP BY feature),
c AS (SELECT u.feature, label, len(list_filter(e, lambda x: v > x)) AS bin, count(*) AS n FROM u JOIN q ON q.feature = u.feature GROUP BY ALL),
t AS (SELECT feature, label, bin, n, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS nl,
  sum(n) OVER (PARTITION BY feature) AS na FROM c),
mi AS (SELECT feature, sum(n / na * ln(n * na / (nb * nl))) AS mi_score FROM t GROUP BY feature)"""


@query("m10_mutual_information", f"WITH {_MI} SELECT feature, round(mi_score, 9) AS mi_score FROM mi")
def mutual_information(spark, sf):
    out = tf.mutual_information(feature_table(spark, sf), FEATURES, "label")
    return out.select("feature", F.round("mi_score", 9).alias("mi_score"))


def _psi(x: str) -> str:
    y = f"({x} + 8.0)"
    series = f"ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8)"
    return f"({series} - (" + " + ".join(f"1.0 / ({x} + {i})" for i in range(8)) + "))"


#: Left and right neighbours so many places away, the farther of both for every way to take three.
_NEAR = [(f"l{a}" if a else "v", f"r{3 - a}" if a < 3 else "v") for a in range(4)]
_NEIGHBOURS = f"""{_EMBEDDED.replace("SELECT label,", "SELECT vec_id, label,")},
o AS (SELECT feature, label, vec_id, v, count(*) OVER (PARTITION BY feature, label) AS n,
  {", ".join(f"lag(v, {i}) OVER w AS l{i}, lead(v, {i}) OVER w AS r{i}" for i in (1, 2, 3))}
  FROM u WINDOW w AS (PARTITION BY feature, label ORDER BY v, vec_id)),
d AS (SELECT *, {", ".join(f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest(v - {a}, {b} - v) END AS d{i}" for i, (a, b) in enumerate(_NEAR))} FROM o),
e AS (SELECT *, least({", ".join(f"coalesce(d{i}, 'inf'::DOUBLE)" for i in range(4))}) AS d FROM d),
g AS (SELECT *, {", ".join(f"CASE {' '.join(f'WHEN d{i} = d THEN CASE WHEN abs(v - {p[side]}) = d THEN {p[side]} ELSE v {sign} d END' for i, p in enumerate(_NEAR))} END AS {name}" for side, sign, name in ((0, "-", "low"), (1, "+", "high")))} FROM e),
m AS (SELECT g.feature, g.label, g.vec_id, any_value(g.n) AS n,
  count(*) FILTER (WHERE CASE WHEN g.d > 0 THEN x.v > g.low AND x.v < g.high ELSE x.v = g.v END) AS m
  FROM g JOIN u x ON x.feature = g.feature GROUP BY g.feature, g.label, g.vec_id)"""


@query(
    "m10_neighbour_information",
    f"""WITH {_NEIGHBOURS} SELECT feature,
      round(greatest(0, {_psi("count(*)")} + {_psi("3.0")} - avg({_psi("n")}) - avg({_psi("m")})), 8) AS mi_score FROM m GROUP BY feature""",
)
def neighbour_information(spark, sf):
    out = tf.neighbour_information(feature_table(spark, sf), FEATURES, "label", ["vec_id"])
    return out.select("feature", F.round("mi_score", 8).alias("mi_score"))


def _forest_importance(spark, sf):
    df = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(feature_table(spark, sf))
    model = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=20, maxDepth=5, seed=42).fit(df)
    rows = [(n, float(v)) for n, v in zip(FEATURES, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, rf_importance double")


@query("m11_forest_importance")
def forest_importance(spark, sf):
    return _forest_importance(spark, sf)


@query(
    "m12_two_score_ranking",
    f"""WITH {_ANOVA}, {_MI[_MI.index(', q AS') + 2 :]},
    n AS (SELECT feature, (f_score - min(f_score) OVER ()) / (max(f_score) OVER () - min(f_score) OVER ()) AS a,
      mi_score / max(mi_score) OVER () AS b FROM fs JOIN mi USING (feature))
    SELECT feature, round((a + b) / 2, 6) AS combined_score FROM n ORDER BY (a + b) / 2 DESC, feature LIMIT 10""",
)
def two_score_ranking(spark, sf):
    """The ranking on the two scores SQL can repeat."""
    df = feature_table(spark, sf)
    both = tf.anova_scores(df, FEATURES, "label").join(tf.mutual_information(df, FEATURES, "label"), "feature")
    ranked = tf.top_features(combined_scores(both, ["f_score"], ["mi_score"]), "combined_score", 10)
    return ranked.select("feature", F.round("combined_score", 6).alias("combined_score"))


@query("m12_combined_ranking")
def combined_ranking(spark, sf):
    df = feature_table(spark, sf)
    scores = tf.anova_scores(df, FEATURES, "label").join(tf.mutual_information(df, FEATURES, "label"), "feature")
    scores = scores.join(_forest_importance(spark, sf), "feature")
    ranked = combined_scores(scores, ["f_score", "mi_score"], ["rf_importance"])
    return tf.top_features(ranked, "combined_score", 10)


@query("m13_feature_count_search")
def feature_count_search(spark, sf):
    return models.search_feature_count(
        feature_table(spark, sf), FEATURES, "label", ["vec_id"], [4, 8, 16], folds=2, trees=5, depth=4
    )


@query("m14_variant_comparison")
def variant_comparison(spark, sf):
    return models.compare_variants(
        feature_table(spark, sf), FEATURES[:8], "label", ["vec_id"], 4, folds=2, trees=5, depth=4
    )


@query("m14_best_variant_applied")
def best_variant_applied(spark, sf):
    """The best variant of eight entries, fitted on nine tenths of the rows, applied to the other tenth."""
    rows = tf.stratified_folds(feature_table(spark, sf).select("vec_id", "label", *FEATURES[:8]), "label", ["vec_id"], 10)
    train, validation = rows.where("fold <> 0").drop("fold"), rows.where("fold = 0").drop("fold")
    name, _, held = models.best_variant_applied(
        train, validation, FEATURES[:8], "label", ["vec_id"], 4, folds=2, trees=5, depth=4
    )
    values = [c for c in held.columns if c not in ("vec_id", "label")]
    return held.select("vec_id", "label", F.lit(name).alias("variant"), F.array(*[F.round(c, 6) for c in values]).alias("vector"))


_SEQ_HASH = _HASH.format("CAST(sequence_id AS VARCHAR)")
_RANKED = f"""r AS (SELECT sequence_id, truth, row_number() OVER (PARTITION BY {{0}} ORDER BY {_SEQ_HASH}, sequence_id) - 1 AS i,
  count(*) OVER (PARTITION BY {{0}}) AS n FROM pr)"""


@query(
    "m15_stratified_split",
    f"""WITH {PREDICTIONS_SQL}, {_RANKED.format('truth')}, c AS (SELECT *, CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS t FROM r)
    SELECT sequence_id, truth, CASE WHEN i < t THEN 'test' WHEN i < t + floor((n - t) * 0.2 + 0.5) THEN 'valid' ELSE 'train' END AS part FROM c""",
)
def stratified_split(spark, sf):
    return tf.stratified_split(predictions(spark, sf).select("sequence_id", "truth"), "truth", ["sequence_id"])


@query(
    "m16_split_with_fallback",
    f"""WITH {PREDICTIONS_SQL}, {_RANKED.format("1")} SELECT sequence_id, truth,
        CASE WHEN i < floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM r""".replace("FROM pr)", "FROM (SELECT sequence_id, CASE WHEN sequence_id = 3 THEN 77 ELSE truth END AS truth FROM pr))"),
)
def split_with_fallback(spark, sf):
    """One label occurs once, so the split falls back to all rows together."""
    label = F.when(F.col("sequence_id") == 3, 77).otherwise(F.col("truth")).alias("truth")
    return tf.split_with_fallback(predictions(spark, sf).select("sequence_id", label), "truth", ["sequence_id"])


@query(
    "m17_stratified_folds",
    f"""WITH h AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
          ORDER BY {_HASH.format("CAST(event_id AS VARCHAR)")}, event_id) - 1 AS i FROM events)
    SELECT event_id, event_type, CAST(i % 5 AS INTEGER) AS fold FROM h""",
)
def stratified_folds(spark, sf):
    return tf.stratified_folds(table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["event_id"], 5)


_GROUPS = f"""g AS (SELECT user_id, (row_number() OVER (ORDER BY {_HASH.format("CAST(user_id AS VARCHAR)")}, user_id) - 1) % 5 AS fold
  FROM (SELECT DISTINCT user_id FROM events))"""


@query("m18_group_folds", f"WITH {_GROUPS} SELECT event_id, user_id, CAST(fold AS INTEGER) AS fold FROM events JOIN g USING (user_id)")
def group_folds(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id")
    return tf.with_group_folds(df, "user_id", ["event_id"], 5).select("event_id", "user_id", "fold")


@query(
    "m18_plain_folds",
    f"""SELECT sequence_id, CAST((row_number() OVER (ORDER BY {_SEQ_HASH}, sequence_id) - 1) % 4 AS INTEGER) AS fold
    FROM (SELECT vec_id AS sequence_id FROM embeddings)""",
)
def plain_folds(spark, sf):
    return tf.plain_folds(predictions(spark, sf).select("sequence_id"), ["sequence_id"], 4)


@query(
    "m19_first_sequences",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 40)",
)
def first_sequences(spark, sf):
    return tf.first_sequences(table(spark, sf, "events").select("event_id", "user_id"), ["user_id"], 40)

