"""Subject attributes: bins, ratios, interactions and one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: bin edges and names, default attributes, feature order
AGE_BINS = ([0, 12, 18, 25, 35, 100], ["child", "teen", "young_adult", "adult", "senior"])
HEIGHT_BINS = ([0, 160, 170, 180, 200], ["short", "average", "tall", "very_tall"])
DEFAULTS = {
    "adult_child": 1,
    "age": 30,
    "sex": 1,
    "handedness": 1,
    "height_cm": 170.0,
    "shoulder_to_wrist_cm": 55.0,
    "elbow_to_wrist_cm": 25.0,
}
RAW = list(DEFAULTS)
DERIVED = ["arm_ratio", "arm_length_relative", "sex_age_interaction", "handedness_sex"]
ONE_HOT = [f"age_group_{n}" for n in AGE_BINS[1]] + [f"height_cat_{n}" for n in HEIGHT_BINS[1]]
FEATURES = RAW + DERIVED + ONE_HOT


def binned(value: Column, edges: Sequence[float], names: Sequence[str], open_ended: bool = False) -> Column:
    """Right-closed bins; outside them null, or with `open_ended` the first or last name."""
    out = F.when(value > edges[-1], F.lit(names[-1] if open_ended else None))
    if not open_ended:
        out = out.when(value <= edges[0], F.lit(None))
    for name, upper in zip(names, edges[1:]):
        out = out.when(value <= upper, F.lit(name))
    return out


def one_hot(value: Column, names: Sequence[str], prefix: str) -> dict[str, Column]:
    """A 0/1 column for every listed name, also for names that never occur."""
    return {f"{prefix}_{n}": F.coalesce((value == n).cast("int"), F.lit(0)) for n in names}


def with_defaults(df: DataFrame, defaults: dict[str, float] = DEFAULTS) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def attribute_features(df: DataFrame, keep: Sequence[str] = ("subject",), open_ended: bool = False) -> DataFrame:
    """The 20 features of a subject in fixed order, in one projection."""
    age = binned(F.col("age"), *AGE_BINS, open_ended=open_ended)
    height = binned(F.col("height_cm"), *HEIGHT_BINS, open_ended=open_ended)
    made = {
        "arm_ratio": F.try_divide("elbow_to_wrist_cm", "shoulder_to_wrist_cm"),
        "arm_length_relative": F.try_divide("shoulder_to_wrist_cm", "height_cm"),
        "sex_age_interaction": F.col("sex") * F.col("age"),
        "handedness_sex": F.col("handedness") * 2 + F.col("sex"),
        **one_hot(age, AGE_BINS[1], "age_group"),
        **one_hot(height, HEIGHT_BINS[1], "height_cat"),
    }
    return df.select(*keep, *RAW, *[made[n].alias(n) for n in DERIVED + ONE_HOT])
