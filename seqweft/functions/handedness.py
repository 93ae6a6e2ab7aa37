"""Mirror correction for left-handed subjects (handedness 0)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: which channels are mirrored
MIRRORED_V1 = ("acc_y", "acc_z", "rot_y", "rot_z")
MIRRORED_SENSORS_V2 = ("acc", "gyro", "rot", "mag")


def _negated(df: DataFrame, channels: Sequence[str], handedness: str) -> DataFrame:
    left = F.col(handedness) == 0
    return df.withColumns({c: F.when(left, -F.col(c)).otherwise(F.col(c)) for c in channels})


def mirror_left(df: DataFrame, handedness: str = "handedness") -> DataFrame:
    across = [c for c in df.columns if c.startswith("tof_") and c.endswith("_x")]
    return _negated(df, [*MIRRORED_V1, *across], handedness)


def mirror_left_v2(df: DataFrame, handedness: str = "handedness", negate_tof: bool = True) -> DataFrame:
    """Also covers gyroscope and magnetometer and, as the default has it, every distance pixel.

    Run sentinel removal first: negating a -1 sentinel would turn it into a valid distance.
    """
    axes = [f"{s}_{a}" for s in MIRRORED_SENSORS_V2 for a in "yz"]
    chosen = [c for c in df.columns if c in axes or (negate_tof and c.startswith("tof_"))]
    return _negated(df, chosen, handedness)
