"""Trial logs, importances and experiment comparison (A22, A27-A32, E20-E22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.operators import models
from seqweft.operators import trials as tr
from seqweft.plans.adapters import TRIALS_SQL, table, trial_values, trials
from seqweft.plans.evaluation_queries import _LONG_IMPORTANCE, long_importance
from seqweft.plans.registry import query
from seqweft.session import scratch_path
from seqweft.sources.writers import write_json


def finished(spark, sf):
    done = trials(spark, sf).where(F.col("state") == "COMPLETE")
    return done.join(trial_values(spark, sf), "trial_id")


_FINISHED = f"{TRIALS_SQL}, fi AS (SELECT * FROM trials JOIN trial_values USING (trial_id) WHERE state = 'COMPLETE')"


@query(
    "a22_parameter_correlation",
    f"""WITH {_FINISHED}, u AS (SELECT 'param' AS name, CAST(param AS DOUBLE) AS x, value FROM fi
      UNION ALL SELECT 'month', CAST(month(datetime_start) AS DOUBLE), value FROM fi UNION ALL SELECT 'constant', 1.0, value FROM fi)
    SELECT name, count(*) AS n, round(corr(x, value), 9) AS r FROM u GROUP BY name HAVING count(*) > 3 AND count(DISTINCT x) > 1""",
)
def parameter_correlation(spark, sf):
    named = finished(spark, sf).select(
        "value",
        F.col("param").cast("double").alias("param"),
        F.month("datetime_start").cast("double").alias("month"),
        F.lit(1.0).alias("constant"),
    )
    out = tr.parameter_correlation(named, ["param", "month", "constant"], "value")
    return out.withColumn("r", F.round("r", 9))


@query(
    "a27_trial_states",
    f"""WITH {TRIALS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE state = 'COMPLETE') AS complete,
        count(*) FILTER (WHERE state = 'PRUNED') AS pruned, count(*) FILTER (WHERE state = 'FAIL') AS failed FROM trials""",
)
def trial_states(spark, sf):
    return spark.sql(
        """SELECT count(*) AS total, count_if(state = 'COMPLETE') AS complete, count_if(state = 'PRUNED') AS pruned,
           count_if(state = 'FAIL') AS failed FROM {trials}""",
        trials=trials(spark, sf),
    )


@query(
    "a28_scores_by_configuration",
    f"""WITH {_FINISHED} SELECT fusion, count(*) AS n, round(avg(value), 9) AS mean, max(value) AS max, min(value) AS min,
        round(stddev_pop(value), 9) AS std_pop, round(stddev_samp(value), 9) AS std_samp FROM fi GROUP BY fusion""",
)
def scores_by_configuration(spark, sf):
    out = tr.group_scores(finished(spark, sf), ["fusion"], "value")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "std_pop", "std_samp")})


@query(
    "a28_best_configuration",
    f"WITH {_FINISHED} SELECT fusion, max(value) AS max FROM fi GROUP BY fusion ORDER BY max DESC, fusion LIMIT 1",
)
def best_configuration(spark, sf):
    out = tr.group_scores(finished(spark, sf), ["fusion"], "value")
    return out.select("fusion", "max").orderBy(F.desc("max"), "fusion").limit(1)


@query(
    "a29_duration_statistics",
    f"""WITH {_FINISHED}, d AS (SELECT date_diff('second', datetime_start, datetime_complete) AS s, value FROM fi)
    SELECT round(avg(s) / 60, 6) AS mean_minutes, min(s) / 60 AS min_minutes, max(s) / 60 AS max_minutes,
           CAST(sum(s) AS BIGINT) / 60 AS total_minutes, max(value) AS best_score, min(value) AS worst_score FROM d""",
)
def duration_statistics(spark, sf):
    minutes = finished(spark, sf).withColumn("m", tr.minutes_between("datetime_start", "datetime_complete"))
    return minutes.agg(
        F.round(F.avg("m"), 6).alias("mean_minutes"),
        F.min("m").alias("min_minutes"),
        F.max("m").alias("max_minutes"),
        F.sum("m").alias("total_minutes"),
        F.max("value").alias("best_score"),
        F.min("value").alias("worst_score"),
    )


@query(
    "a30_importance_over_folds",
    f"""WITH {_LONG_IMPORTANCE} SELECT feature, round(avg(importance), 6) AS importance,
        round(stddev_pop(importance), 6) AS std_importance FROM im GROUP BY feature""",
)
def importance_over_folds(spark, sf):
    out = models.importance_summary(long_importance(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("importance", "std_importance")})


@query(
    "a31_importance_by_family",
    f"""WITH {_LONG_IMPORTANCE}, f AS (SELECT feature, avg(importance) AS importance FROM im GROUP BY feature)
    SELECT substr(feature, 1, 3) AS family, round(avg(importance), 6) AS importance, count(*) AS features FROM f GROUP BY 1""",
)
def importance_by_family(spark, sf):
    out = models.family_importance(models.importance_summary(long_importance(spark, sf)))
    return out.withColumn("importance", F.round("importance", 6))


_FOLDS = """fs AS (SELECT CAST(l_partkey % 5 AS INTEGER) AS fold, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS score
    FROM lineitem GROUP BY 1)"""


@query(
    "a32_fold_summary",
    f"""WITH {_FOLDS} SELECT round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std_pop, round(max(score), 9) AS best,
        round(min(score), 9) AS worst, round(max(score) - min(score), 9) AS range,
        (SELECT fold FROM fs ORDER BY score DESC, fold LIMIT 1) AS best_fold,
        (SELECT fold FROM fs ORDER BY score, fold LIMIT 1) AS worst_fold FROM fs""",
)
def fold_summary(spark, sf):
    scores = (
        table(spark, sf, "lineitem")
        .groupBy((F.col("l_partkey") % 5).cast("int").alias("fold"))
        .agg((F.sum(F.col("l_quantity").cast("long")).cast("double") / F.count(F.lit(1))).alias("score"))
    )
    out = tr.fold_summary(scores)
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "std_pop", "best", "worst", "range")})


@query(
    "e20_experiment_comparison",
    """SELECT o_orderpriority AS run, max(o_orderdate) AS created, count(*) AS trials, CAST(max(o_custkey) AS BIGINT) AS best
    FROM orders GROUP BY o_orderpriority""",
)
def experiment_comparison(spark, sf):
    """Every run writes its own record; the records are read together, newest first."""
    path = scratch_path(spark, "experiments")
    runs = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(
        F.max("o_orderdate").alias("created"), F.count(F.lit(1)).alias("trials"), F.max("o_custkey").alias("best")
    )
    write_json(runs.repartition("run"), path)
    records = spark.read.schema("run string, created timestamp_ntz, trials long, best long").json(f"{path}/*.json")
    return tr.newest_first(records, "created", "run")


@query(
    "e21_best_trial",
    f"""WITH {TRIALS_SQL}, j AS (SELECT * FROM trials LEFT JOIN trial_values USING (trial_id))
    SELECT (SELECT trial_id FROM j WHERE state = 'COMPLETE' AND value IS NOT NULL ORDER BY value DESC, trial_id LIMIT 1) AS trial_id,
           max(value) FILTER (WHERE state = 'COMPLETE') AS value, count(*) FILTER (WHERE state = 'COMPLETE') AS succeeded,
           count(*) FILTER (WHERE state <> 'COMPLETE') AS not_succeeded FROM j""",
)
def best_trial(spark, sf):
    every = trials(spark, sf).join(trial_values(spark, sf), "trial_id", "left")
    return tr.best_trial(every, "trial_id", "value", F.col("state") == "COMPLETE")


@query(
    "e22_improvement_over_benchmark",
    f"""WITH {_FINISHED}, m AS (SELECT fusion, sum(CAST(round(value * 1000) AS BIGINT)) / count(*) AS v FROM fi GROUP BY fusion),
    b AS (SELECT v AS base FROM m WHERE fusion = '1-URGENT')
    SELECT fusion, round(v, 9) AS score, round(v - base, 9) AS gain, round((v - base) / base * 100, 9) AS percent FROM m, b""",
)
def improvement_over_benchmark(spark, sf):
    whole = F.sum(F.round(F.col("value") * 1000).cast("long")) / F.count(F.lit(1))
    means = finished(spark, sf).groupBy("fusion").agg(whole.alias("score"))
    out = tr.improvement(means, "score", means.where(F.col("fusion") == "1-URGENT").select("score").scalar())
    return out.withColumns({c: F.round(c, 9) for c in ("score", "gain", "percent")})


@query(
    "p24_remaining_time",
    f"""WITH {_FINISHED}, d AS (SELECT trial_id, fusion, date_diff('second', datetime_start, datetime_complete) AS s FROM fi)
    SELECT fusion, CAST(sum(s) AS BIGINT) / 60 AS elapsed_minutes, round(CAST(sum(s) AS BIGINT) / 60 / count(*) * (5000 - count(*)), 3) AS remaining_minutes
    FROM d GROUP BY fusion""",
)
def remaining_time(spark, sf):
    minutes = finished(spark, sf).withColumn("m", tr.minutes_between("datetime_start", "datetime_complete"))
    out = tr.remaining_time(minutes, ["fusion"], "m", 5000)
    return out.withColumn("remaining_minutes", F.round("remaining_minutes", 3))


