"""Trial tables and small score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqweft.functions.expressions import pearson


def minutes_between(start: str, end: str) -> Column:
    """Subtraction, unlike a cast to a zoned timestamp, does not depend on the session's time zone."""
    return (F.col(end) - F.col(start)).cast("interval second").cast("long") / 60


def normal_interval(df: DataFrame, mean: str, std: str, z: float = 1.96) -> DataFrame:
    reach = F.col(std) * z
    return df.withColumns({"low": F.col(mean) - reach, "high": F.col(mean) + reach})


def combined_scores(df: DataFrame, spread: Sequence[str], peak: Sequence[str] = ()) -> DataFrame:
    """Scores scaled to [0, 1] (`spread`: by range, `peak`: by maximum) and their mean.

    The extremes come from one aggregate, not from a window over the whole table.
    """
    ends = df.agg(
        F.struct(*[f(c).alias(f"{n}_{c}") for c in [*spread, *peak] for n, f in (("lo", F.min), ("hi", F.max))])
    ).scalar()
    out = df.select("*", ends.alias("_e"))
    e = F.col("_e")
    scaled = {
        **{f"{c}_norm": F.try_divide(F.col(c) - e[f"lo_{c}"], e[f"hi_{c}"] - e[f"lo_{c}"]) for c in spread},
        **{f"{c}_norm": F.try_divide(F.col(c), e[f"hi_{c}"]) for c in peak},
    }
    out = out.withColumns(scaled).drop("_e")
    total = sum((F.col(c) for c in list(scaled)[1:]), F.col(list(scaled)[0]))
    return out.withColumn("combined_score", total / len(scaled))


def eligible_columns(df: DataFrame) -> DataFrame:
    """Numeric columns and whether all their values are present and finite, by one aggregate over all rows."""
    numeric = [f for f in df.schema if isinstance(f.dataType, T.NumericType)]

    def usable(f: T.StructField) -> Column:
        col = F.col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf"))
        return col.isNotNull()

    row = df.agg(*[F.bool_and(F.coalesce(usable(f), F.lit(False))).alias(f.name) for f in numeric])
    cells = [F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("eligible")) for f in numeric]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def group_scores(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(score).alias("n"),
        F.avg(score).alias("mean"),
        F.max(score).alias("max"),
        F.min(score).alias("min"),
        F.stddev_pop(score).alias("std_pop"),
        F.stddev_samp(score).alias("std_samp"),
    )


def parameter_correlation(df: DataFrame, params: Sequence[str], score: str, more_than: int = 3) -> DataFrame:
    """Correlation of each parameter with the score, where there are enough and differing values."""
    long = df.unpivot([score], list(params), "name", "x").where(F.col("x").isNotNull() & F.col(score).isNotNull())
    out = long.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), pearson("x", score).alias("r"), (F.min("x") < F.max("x")).alias("_varies")
    )
    return out.where((F.col("n") > more_than) & F.col("_varies")).drop("_varies")


def fold_summary(scores: DataFrame, fold: str = "fold", score: str = "score") -> DataFrame:
    s = F.col(score)
    return scores.agg(
        F.avg(s).alias("mean"),
        F.stddev_pop(s).alias("std_pop"),
        F.max(s).alias("best"),
        F.min(s).alias("worst"),
        (F.max(s) - F.min(s)).alias("range"),
        F.min_by(fold, F.struct(-s, fold)).alias("best_fold"),
        F.min_by(fold, F.struct(s, fold)).alias("worst_fold"),
    )


def newest_first(records: DataFrame, created: str, name: str) -> DataFrame:
    return records.orderBy(F.desc(created), name)


def best_trial(df: DataFrame, trial: str, score: str, succeeded: Column) -> DataFrame:
    """The trial of highest score among those that succeeded, and how many did and did not."""
    value = F.when(succeeded, F.col(score))
    order = F.when(value.isNotNull(), F.struct(-value, F.col(trial)))
    return df.agg(
        F.min_by(trial, order).alias(trial),
        F.max(value).alias(score),
        F.count_if(succeeded).alias("succeeded"),
        F.count_if(~succeeded).alias("not_succeeded"),
    )


def improvement(df: DataFrame, score: str, benchmark: Column) -> DataFrame:
    out = df.withColumn("_b", benchmark)
    gain = F.col(score) - F.col("_b")
    return out.withColumns({"gain": gain, "percent": F.try_divide(gain, F.col("_b")) * 100}).drop("_b")


def remaining_time(df: DataFrame, by: Sequence[str], minutes: str, planned: int) -> DataFrame:
    """Time spent, and the mean time per trial times the trials still planned."""
    done = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        F.sum(minutes).alias("elapsed_minutes"), (F.avg(minutes) * (planned - done)).alias("remaining_minutes")
    )
