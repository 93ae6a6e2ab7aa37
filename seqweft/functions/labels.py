"""Labels: the target set and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the target gestures and the others
TARGET_GESTURES = [
    "Above ear - pull hair",
    "Cheek - pinch skin",
    "Eyebrow - pull hair",
    "Eyelash - pull hair",
    "Forehead - pull hairline",
    "Forehead - scratch",
    "Neck - pinch skin",
    "Neck - scratch",
]
OTHER_GESTURES = [
    "Write name on leg",
    "Wave hello",
    "Glasses on/off",
    "Text on phone",
    "Write name in air",
    "Feel around in tray and pull out an object",
    "Scratch knee/leg skin",
    "Pull air toward your face",
    "Drink from bottle/cup",
    "Pinch knee/leg skin",
]
NON_TARGET = "non_target"


def is_target(label: Column, targets: Sequence = TARGET_GESTURES) -> Column:
    return label.isin(list(targets)).cast("int")


def collapsed(label: Column, targets: Sequence = TARGET_GESTURES) -> Column:
    """Target labels as text; all others become one class."""
    return F.when(label.isin(list(targets)), label.cast("string")).otherwise(F.lit(NON_TARGET))
