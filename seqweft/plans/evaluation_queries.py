"""Votes, scores, reports and cross-validated models (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.operators import evaluate as ev
from seqweft.operators import models
from seqweft.plans.adapters import (
    PREDICTIONS_SQL,
    PROBABILITIES_SQL,
    TARGET_CODES,
    predictions,
    probabilities,
    table,
)
from seqweft.plans.registry import query

CLASSES = list(range(10))
FEATURES = [f"e{i}" for i in range(64)]


def feature_table(spark, sf):
    e = F.col("embedding")
    names = [e[i].cast("double").alias(n) for i, n in enumerate(FEATURES)]
    return table(spark, sf, "embeddings").select("vec_id", "label", *names)


@query("e1_cross_validated_forest")
def cross_validated_forest(spark, sf):
    out, _ = models.cross_validated(feature_table(spark, sf), FEATURES, "label", ["vec_id"], trees=10)
    return models.fold_scores(out)


@query("e2_out_of_fold_predictions")
def out_of_fold_predictions(spark, sf):
    out, _ = models.cross_validated(feature_table(spark, sf), FEATURES, "label", ["vec_id"], folds=3, trees=10)
    return out




@query(
    "e3_model_ensemble",
    f"""WITH {PROBABILITIES_SQL}, m AS (SELECT sequence_id, window_id, class, avg(probability) AS p FROM pb GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, window_id ORDER BY p DESC, class) AS i FROM m)
    SELECT sequence_id, window_id, class, round(p, 9) AS confidence FROM r WHERE i = 1""",
)
def model_ensemble(spark, sf):
    out = ev.vote(probabilities(spark, sf), ["sequence_id", "window_id"])
    return out.withColumn("confidence", F.round("confidence", 9))


def _whole(spark, sf):
    """Probabilities as whole thousandths: their sums are exact, so ties are ties in any engine."""
    return probabilities(spark, sf).withColumn("probability", F.round(F.col("probability") * 1000))


_WHOLE_MEANS = f"{PROBABILITIES_SQL}, m AS (SELECT sequence_id, class, avg(round(probability * 1000)) AS p FROM pb GROUP BY ALL)"


@query(
    "e4_window_vote",
    f"""WITH {_WHOLE_MEANS}, r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY p DESC, class) AS i FROM m)
    SELECT sequence_id, class, round(p, 6) AS confidence FROM r WHERE i = 1""",
)
def window_vote(spark, sf):
    return ev.vote(_whole(spark, sf), ["sequence_id"]).withColumn("confidence", F.round("confidence", 6))


@query(
    "e5_top_three_classes",
    f"""WITH {_WHOLE_MEANS}, r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY p DESC, class) AS i FROM m)
    SELECT sequence_id, class, round(p, 6) AS probability, CAST(i AS INTEGER) AS rank FROM r WHERE i <= 3""",
)
def top_three_classes(spark, sf):
    return ev.top_classes(_whole(spark, sf), ["sequence_id"]).withColumn("probability", F.round("probability", 6))


@query(
    "e6_uniform_fallback",
    f"""WITH {PROBABILITIES_SQL} SELECT sequence_id, window_id, class, sequence_id % 4 < 2 AS replaced,
        CASE WHEN sequence_id % 4 < 2 THEN 0.1::DOUBLE ELSE probability END AS probability FROM pb""",
)
def uniform_fallback(spark, sf):
    kind = F.col("sequence_id") % 4
    broken = F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf"))).otherwise(F.col("probability"))
    out = ev.uniform_fallback(probabilities(spark, sf).withColumn("probability", broken), 10)
    return out.select("sequence_id", "window_id", "class", "replaced", "probability")


@query(
    "e6_default_label",
    f"""WITH {PREDICTIONS_SQL} SELECT sequence_id, truth = 7 AS defaulted, CASE WHEN truth = 7 THEN 0 ELSE guess END AS guess FROM pr""",
)
def default_label(spark, sf):
    df = predictions(spark, sf)
    return ev.default_label(df, df.where(F.col("truth") != 7), ["sequence_id"], "guess", 0)


@query("e7_accuracy", f"WITH {PREDICTIONS_SQL} SELECT round(avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pr")
def accuracy(spark, sf):
    pairs = ev.pair_counts(predictions(spark, sf), "truth", "guess")
    return pairs.agg(F.round(ev.accuracy(pairs), 9).alias("accuracy"))


_TARGETS = ", ".join(map(str, TARGET_CODES))
_BINARY = f"""bn AS (SELECT count(*) FILTER (WHERE truth IN ({_TARGETS}) AND guess IN ({_TARGETS})) AS tp,
  count(*) FILTER (WHERE truth IN ({_TARGETS})) AS t, count(*) FILTER (WHERE guess IN ({_TARGETS})) AS g FROM pr)"""


def _macro(name, source, truth="truth", guess="guess"):
    return f"""{name}_c AS (SELECT {truth} AS class FROM {source} UNION SELECT {guess} FROM {source}),
{name} AS (SELECT class, (SELECT count(*) FROM {source} s WHERE s.{truth} = c.class) AS support,
  (SELECT count(*) FROM {source} s WHERE s.{guess} = c.class) AS predicted,
  (SELECT count(*) FROM {source} s WHERE s.{truth} = c.class AND s.{guess} = c.class) AS hits FROM {name}_c c)"""


_COLLAPSED = f"""cl AS (SELECT CASE WHEN truth IN ({_TARGETS}) THEN CAST(truth AS VARCHAR) ELSE 'non_target' END AS truth,
  CASE WHEN guess IN ({_TARGETS}) THEN CAST(guess AS VARCHAR) ELSE 'non_target' END AS guess FROM pr)"""
_F1 = "CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0::DOUBLE * hits / (support + predicted) END"


@query("e8_binary_f1", f"WITH {PREDICTIONS_SQL}, {_BINARY} SELECT round(2.0::DOUBLE * tp / (t + g), 9) AS binary_f1 FROM bn")
def binary_f1(spark, sf):
    pairs = ev.pair_counts(predictions(spark, sf), "truth", "guess")
    return pairs.agg(F.round(ev.binary_f1(pairs, TARGET_CODES), 9).alias("binary_f1"))


@query(
    "e9_collapsed_macro_f1",
    f"WITH {PREDICTIONS_SQL}, {_COLLAPSED}, {_macro('mc', 'cl')} SELECT round(avg({_F1}), 9) AS macro_f1 FROM mc",
)
def collapsed_macro_f1(spark, sf):
    return ev.contest_score(predictions(spark, sf), "truth", "guess", TARGET_CODES).select(F.round("macro_f1", 9).alias("macro_f1"))


def _score_sql(source, prefix):
    return f"""WITH {PREDICTIONS_SQL}, {_COLLAPSED}, {_BINARY}, {_macro('mc', source)},
    p AS (SELECT (SELECT 2.0::DOUBLE * tp / (t + g) FROM bn) AS b, (SELECT avg({_F1}) FROM mc) AS m,
          (SELECT avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END) FROM pr) AS a)
    SELECT round((b + m) / 2, 9) AS score, round(b, 9) AS binary_f1, round(m, 9) AS macro_f1, round(a, 9) AS accuracy FROM p"""


def _score(spark, sf, collapse):
    out = ev.contest_score(predictions(spark, sf), "truth", "guess", TARGET_CODES, collapse)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("e10_contest_score", _score_sql("cl", "cl"))
def contest_score(spark, sf):
    return _score(spark, sf, True)


@query("e11_contest_score_all_classes", _score_sql("pr", "pr"))
def contest_score_all_classes(spark, sf):
    return _score(spark, sf, False)


@query(
    "e12_confusion_matrix",
    f"WITH {PREDICTIONS_SQL} SELECT truth, "
    + ", ".join(f'count(*) FILTER (WHERE guess = {c}) AS "{c}"' for c in CLASSES)
    + " FROM pr GROUP BY truth",
)
def confusion_matrix(spark, sf):
    return ev.confusion(predictions(spark, sf), "truth", "guess", CLASSES)


_SCORES = f"WITH {PREDICTIONS_SQL}, {_macro('mc', 'pr')}"


def _classes(spark, sf):
    return ev.class_scores(ev.pair_counts(predictions(spark, sf), "truth", "guess"))


@query(
    "e13_class_scores",
    f"""{_SCORES} SELECT class, support, predicted, round(coalesce(hits / nullif(predicted, 0), 0), 9) AS precision,
        round(coalesce(hits / nullif(support, 0), 0), 9) AS recall, round({_F1}, 9) AS f1 FROM mc""",
)
def class_scores(spark, sf):
    return _classes(spark, sf).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "e14_averaged_scores",
    f"""{_SCORES} SELECT round(avg({_F1}), 9) AS macro_f1, round(sum({_F1} * support) / sum(support), 9) AS weighted_f1,
        round(avg(coalesce(hits / nullif(predicted, 0), 0)), 9) AS macro_precision,
        round(avg(coalesce(hits / nullif(support, 0), 0)), 9) AS macro_recall FROM mc""",
)
def averaged_scores(spark, sf):
    out = ev.averaged_scores(_classes(spark, sf))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "e15_extreme_classes",
    f"""{_SCORES}, f AS (SELECT class, {_F1} AS f1 FROM mc)
    SELECT (SELECT class FROM f ORDER BY f1 DESC, class LIMIT 1) AS best_class, round(max(f1), 9) AS best_f1,
           (SELECT class FROM f ORDER BY f1, class LIMIT 1) AS worst_class, round(min(f1), 9) AS worst_f1,
           round(avg(f1), 9) AS mean_f1, round(stddev_pop(f1), 9) AS std_f1 FROM f""",
)
def extreme_classes(spark, sf):
    out = ev.extreme_classes(_classes(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("best_f1", "worst_f1", "mean_f1", "std_f1")})


_LONG_IMPORTANCE = """im AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'acc_' WHEN 1 THEN 'rot_' WHEN 2 THEN 'thm_' ELSE 'tof_' END || (l_suppkey % 25) AS feature,
    CAST(l_partkey % 5 AS INTEGER) AS fold, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS importance FROM lineitem GROUP BY ALL)"""


def long_importance(spark, sf):
    """Importance per feature and fold, read off quantities sold."""
    line = F.col("l_linenumber") % 4
    family = F.when(line == 0, "acc_").when(line == 1, "rot_").when(line == 2, "thm_").otherwise("tof_")
    feature = F.concat(family, (F.col("l_suppkey") % 25).cast("string")).alias("feature")
    fold = (F.col("l_partkey") % 5).cast("int").alias("fold")
    amount = F.sum(F.col("l_quantity").cast("long")).cast("double").alias("importance")
    return table(spark, sf, "lineitem").groupBy(feature, fold).agg(amount)


@query(
    "e16_performance_report",
    f"""WITH {PREDICTIONS_SQL}, {_LONG_IMPORTANCE}, {_macro('mc', 'pr')},
    f AS (SELECT feature, avg(importance) AS importance FROM im GROUP BY feature)
    SELECT 'confusion' AS section, truth || '>' || guess AS name, CAST(count(*) AS DOUBLE) AS value FROM pr GROUP BY ALL
    UNION ALL SELECT 'classes', CAST(class AS VARCHAR), round({_F1}, 9) FROM mc
    UNION ALL SELECT 'predictions', CAST(guess AS VARCHAR), CAST(count(*) AS DOUBLE) FROM pr GROUP BY guess
    UNION ALL SELECT 'importance', feature, round(importance, 6) FROM f
    UNION ALL SELECT 'families', substr(feature, 1, 3), round(avg(importance), 6) FROM f GROUP BY substr(feature, 1, 3)""",
)
def performance_report(spark, sf):
    summary = models.importance_summary(long_importance(spark, sf))
    parts = ev.performance_report(predictions(spark, sf), "truth", "guess", summary)
    shown = {
        "confusion": (F.concat_ws(">", "truth", "guess"), F.col("n")),
        "classes": (F.col("class"), F.round("f1", 9)),
        "predictions": (F.col("class"), F.col("n")),
        "importance": (F.col("feature"), F.round("importance", 6)),
        "families": (F.col("family"), F.round("importance", 6)),
    }
    out = None
    for section, (name, value) in shown.items():
        rows = parts[section].select(
            F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "e17_submission",
    f"""WITH {_WHOLE_MEANS}, r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY p DESC, class) AS i FROM m)
    SELECT sequence_id, max(CASE WHEN i = 1 THEN class END) AS gesture, """
    + ", ".join(f"round(max(CASE WHEN class = {c} THEN p END), 6) AS p_{c}" for c in CLASSES)
    + " FROM r GROUP BY sequence_id",
)
def submission(spark, sf):
    probs = _whole(spark, sf)
    out = ev.submission(ev.vote(probs, ["sequence_id"]), probs, "sequence_id", "class", CLASSES)
    return out.withColumns({f"p_{c}": F.round(f"p_{c}", 6) for c in CLASSES})


@query(
    "e18_answer_violations",
    f"""WITH {PREDICTIONS_SQL}, an AS (
      SELECT sequence_id, CASE WHEN truth = 1 THEN NULL WHEN truth = 2 THEN 99 ELSE guess END AS guess FROM pr WHERE truth <> 0
      UNION ALL SELECT sequence_id, guess FROM pr WHERE truth = 3 UNION ALL SELECT sequence_id + 1000000, guess FROM pr WHERE truth = 4)
    SELECT sequence_id, 'missing' AS reason FROM pr WHERE truth = 0 UNION ALL
    SELECT sequence_id, 'null label' FROM pr WHERE truth = 1 UNION ALL SELECT sequence_id, 'unknown label' FROM pr WHERE truth = 2
    UNION ALL SELECT sequence_id, 'repeated' FROM pr WHERE truth = 3 UNION ALL SELECT sequence_id + 1000000, 'unexpected' FROM pr WHERE truth = 4""",
)
def answer_violations(spark, sf):
    df = predictions(spark, sf)
    label = F.when(F.col("truth") == 1, F.lit(None)).when(F.col("truth") == 2, 99).otherwise(F.col("guess"))
    answers = (
        df.where(F.col("truth") != 0)
        .select("sequence_id", label.cast("int").alias("guess"))
        .unionByName(df.where(F.col("truth") == 3).select("sequence_id", "guess"))
        .unionByName(df.where(F.col("truth") == 4).select((F.col("sequence_id") + 1000000).alias("sequence_id"), "guess"))
    )
    return ev.violations(df, answers, "sequence_id", "guess", df.select(F.col("truth").alias("guess")))


@query(
    "e19_two_stage_decision",
    f"""WITH {PROBABILITIES_SQL}, g AS (SELECT sequence_id, sum(CAST(round(probability * 1000) AS BIGINT)) FILTER (WHERE class < 4) AS a,
          sum(CAST(round(probability * 1000) AS BIGINT)) AS b FROM pb GROUP BY sequence_id),
    m AS (SELECT sequence_id, class, avg(round(probability * 1000)) AS p FROM pb WHERE class < 4 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY p DESC, class) AS i FROM m)
    SELECT sequence_id, CAST(CASE WHEN a / b >= 0.4 THEN 2 ELSE 1 END AS INTEGER) AS stage,
           CASE WHEN a / b >= 0.4 THEN class ELSE -1 END AS final FROM g JOIN r USING (sequence_id) WHERE i = 1""",
)
def two_stage_decision(spark, sf):
    probs = _whole(spark, sf)
    weight = F.col("probability").cast("long")
    target = F.sum(F.when(F.col("class") < 4, weight).otherwise(0))
    gate = probs.groupBy("sequence_id").agg((target / F.sum(weight)).alias("gate"))
    decision = ev.vote(probs.where(F.col("class") < 4), ["sequence_id"])
    out = ev.two_stage(gate.join(decision, "sequence_id"), "gate", "class", 0.4, -1)
    return out.select("sequence_id", "stage", "final")
