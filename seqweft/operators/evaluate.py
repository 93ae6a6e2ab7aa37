"""Votes, decisions and scores.

Every score is computed from the (truth, guess) counts: one map-side combined pass over the predictions,
after which only a table of at most classes x classes rows is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.functions.labels import NON_TARGET, TARGET_GESTURES
from seqweft.operators.models import family_importance


def vote(df: DataFrame, keys: Sequence[str], label: str = "class", probability: str = "probability") -> DataFrame:
    """Mean probability per class over windows or models, the best class (lowest code on ties) and its mean."""
    means = df.groupBy(*keys, label).agg(F.avg(probability).alias("_p"))
    best = F.min_by(F.struct(label, "_p"), F.struct(-F.col("_p"), label)).alias("_b")
    return means.groupBy(*keys).agg(best).select(*keys, F.col("_b")[label].alias(label), F.col("_b._p").alias("confidence"))


def top_classes(
    df: DataFrame, keys: Sequence[str], k: int = 3, label: str = "class", probability: str = "probability"
) -> DataFrame:
    means = df.groupBy(*keys, label).agg(F.avg(probability).alias(probability))
    # a key's rows are its classes, a fixed small number
    order = Window.partitionBy(*keys).orderBy(F.desc(probability), label)
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def uniform_fallback(df: DataFrame, classes: int, probability: str = "probability") -> DataFrame:
    """Missing or non-finite probabilities become 1 / classes; `replaced` tells where."""
    p = F.col(probability)
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return df.withColumn("replaced", bad).withColumn(probability, F.when(bad, F.lit(1.0 / classes)).otherwise(p))


def default_label(expected: DataFrame, answers: DataFrame, key: Sequence[str], label: str, default) -> DataFrame:
    """Every expected key with its answer or the default; `defaulted` tells where."""
    joined = expected.select(*key).join(answers.select(*key, label), list(key), "left")
    return joined.withColumn("defaulted", F.col(label).isNull()).withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def pair_counts(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(pairs: DataFrame) -> Column:
    right = F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0))
    return right / F.sum("n")


def class_scores(pairs: DataFrame) -> DataFrame:
    """Support, predictions, precision, recall and F1 of every class seen on either side; 0 if undefined."""
    n = F.col("n")
    hit = F.when(F.col("truth") == F.col("guess"), n).otherwise(0)
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("truth").alias("class"), n.alias("support"), none.alias("predicted"), hit.cast("long").alias("hits")),
        F.struct(F.col("guess").alias("class"), none.alias("support"), n.alias("predicted"), none.alias("hits")),
    )
    both = pairs.select(F.explode(sides).alias("_s")).select("_s.*")
    added = both.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return added.select(
        "class",
        "support",
        "predicted",
        ratio(hits, predicted).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(hits * 2, support + predicted).alias("f1"),
    )


def averaged_scores(scores: DataFrame) -> DataFrame:
    """Plain and support-weighted averages over classes."""
    weight = F.sum("support")
    return scores.agg(
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), weight).alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
    )


def extreme_classes(scores: DataFrame) -> DataFrame:
    """Best and worst class by F1 (the smaller name on ties), with mean and population deviation."""
    return scores.agg(
        F.min_by("class", F.struct(-F.col("f1"), "class")).alias("best_class"),
        F.max("f1").alias("best_f1"),
        F.min_by("class", F.struct("f1", "class")).alias("worst_class"),
        F.min("f1").alias("worst_f1"),
        F.avg("f1").alias("mean_f1"),
        F.stddev_pop("f1").alias("std_f1"),
    )


def binary_f1(pairs: DataFrame, targets: Sequence = TARGET_GESTURES) -> Column:
    """F1 of target against the rest over (truth, guess) counts; 0 if either side has one class only."""
    t, g, n = F.col("truth").isin(list(targets)), F.col("guess").isin(list(targets)), F.col("n")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    two_sided = F.bool_or(t) & F.bool_or(~t) & F.bool_or(g) & F.bool_or(~g)
    f1 = F.try_divide(2 * total(t & g), total(t) + total(g))
    return F.when(two_sided, F.coalesce(f1, F.lit(0.0))).otherwise(F.lit(0.0))


def contest_score(
    df: DataFrame, truth: str, guess: str, targets: Sequence = TARGET_GESTURES, collapse: bool = True
) -> DataFrame:
    """One row: mean of binary F1 and macro F1, both parts, and accuracy.

    With `collapse` all non-target labels count as one class in the macro part.
    """
    pairs = pair_counts(df, truth, guess)

    def merged(c: str) -> Column:
        if not collapse:
            return F.col(c).cast("string")
        return F.when(F.col(c).isin(list(targets)), F.col(c).cast("string")).otherwise(F.lit(NON_TARGET))

    grouped = pairs.groupBy(merged("truth").alias("truth"), merged("guess").alias("guess")).agg(F.sum("n").alias("n"))
    macro = class_scores(grouped).agg(F.avg("f1")).scalar()
    row = pairs.agg(binary_f1(pairs, targets).alias("binary_f1"), accuracy(pairs).alias("accuracy"))
    row = row.withColumn("macro_f1", macro)
    return row.select(((F.col("binary_f1") + F.col("macro_f1")) / 2).alias("score"), "binary_f1", "macro_f1", "accuracy")


def confusion(df: DataFrame, truth: str, guess: str, classes: Sequence | None = None) -> DataFrame:
    """Long counts, or with listed classes a table with a column per predicted class."""
    pairs = pair_counts(df, truth, guess)
    if classes is None:
        return pairs
    return pairs.groupBy("truth").pivot("guess", list(classes)).agg(F.sum("n")).fillna(0)


def violations(expected: DataFrame, answers: DataFrame, key: str, label: str, allowed: DataFrame) -> DataFrame:
    """What is wrong with a batch of answers: one row per key and reason.

    `allowed` holds the label set in a column of the label's name.
    """
    known = allowed.select(F.col(label).alias("_label")).distinct().withColumn("_known", F.lit(True))
    marked = answers.join(known, answers[label] == F.col("_label"), "left")
    null, unknown = F.col(label).isNull(), F.col(label).isNotNull() & F.col("_known").isNull()
    counted = marked.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(null).alias("_null"), F.max(unknown).alias("_unknown"))
    wanted = expected.select(key).distinct().withColumn("_wanted", F.lit(True))
    reasons = {
        "missing": F.col("_n").isNull(),
        "unexpected": F.col("_wanted").isNull(),
        "repeated": F.col("_n") > 1,
        "null label": F.col("_null"),
        "unknown label": F.col("_unknown"),
    }
    listed = F.array_compact(F.array(*[F.when(holds, F.lit(reason)) for reason, holds in reasons.items()]))
    return wanted.join(counted, key, "full").select(key, F.explode(listed).alias("reason"))


def two_stage(df: DataFrame, gate: str, decision: str, threshold: float, negative) -> DataFrame:
    """First stage decides target or not; only positives keep the second stage's class.

    Both branches are one projection: a conditional column needs no filter and union of two scans.
    """
    passed = F.coalesce(F.col(gate) >= threshold, F.lit(False))
    return df.withColumn("stage", F.when(passed, 2).otherwise(1)).withColumn(
        "final", F.when(passed, F.col(decision)).otherwise(F.lit(negative))
    )


def submission(votes: DataFrame, probabilities: DataFrame | None, key: str, label: str, classes: Sequence = ()) -> DataFrame:
    """One row per sequence with its label, and with class probabilities if they are given."""
    out = votes.select(key, F.col(label).alias("gesture"))
    if probabilities is None:
        return out
    wide = probabilities.groupBy(key).pivot(label, list(classes)).agg(F.avg("probability"))
    return out.join(wide.select(key, *[F.col(str(c)).alias(f"p_{c}") for c in classes]), key)


def performance_report(
    df: DataFrame, truth: str, guess: str, importance: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The parts of a report, each a small table."""
    pairs = pair_counts(df, truth, guess)
    parts = {
        "confusion": pairs,
        "classes": class_scores(pairs),
        "predictions": df.groupBy(F.col(guess).alias("class")).agg(F.count(F.lit(1)).alias("n")),
    }
    if importance is not None:
        parts |= {"importance": importance, "families": family_importance(importance)}
    return parts
