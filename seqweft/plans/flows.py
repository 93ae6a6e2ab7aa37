"""Whole preparations, put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.functions import geometry as geo
from seqweft.functions.attributes import FEATURES, attribute_features
from seqweft.functions.channels import families
from seqweft.functions.handedness import mirror_left_v2
from seqweft.operators import clean, windows as win
from seqweft.operators import evaluate as ev
from seqweft.operators import transform as tf
from seqweft.operators.ordered import salted_join, with_positions
from seqweft.sources.writers import write_parquet, write_windows


@dataclass
class TrainingSet:
    """Windows by configuration with label codes, scaled channels and scaled attribute features."""

    windows: DataFrame
    scaler: DataFrame
    attribute_scaler: DataFrame
    codes: DataFrame

    def write(self, folder: str) -> None:
        write_windows(self.windows, f"{folder}/windows")
        for name in ("scaler", "attribute_scaler", "codes"):
            write_parquet(getattr(self, name), f"{folder}/{name}")


def training_set(
    readings: DataFrame,
    attributes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    subject: str,
    label: str,
    channels: Sequence[str],
    config: tuple[int, int],
    name: str,
    min_length: int = win.MIN_LENGTH,
) -> TrainingSet:
    """Derive attributes, rank readings, cut windows, code labels, scale channels and attributes.

    Windows are joined with attributes after cutting, so the attributes are not repeated per reading.
    """
    placed = with_positions(readings, keys, order, length="seq_len", keep_slices=True)
    constants = [c for c in dict.fromkeys([subject, label]) if c not in keys]
    cut = win.sliding_windows(placed, keys, channels, {name: config}, min_length, first_of=constants)
    scaler = tf.fit_reading_scaler(placed, channels, *config, min_length, centre_from=readings)
    features = attribute_features(attributes, keep=[subject])
    attribute_scaler = tf.fit_scaler(features, FEATURES, null_as_zero=True)
    codes = tf.label_codes(readings, label)
    scaled = tf.apply_window_scaler(cut, scaler, channels)
    described = tf.apply_scaler(features, attribute_scaler, FEATURES, null_as_zero=True)
    joined = salted_join(scaled, described, [subject], ["start_idx"])
    return TrainingSet(salted_join(joined, codes, [label], ["start_idx"]), scaler, attribute_scaler, codes)


def cleaned_motion(
    readings: DataFrame,
    attributes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    subject: str,
    limit: float = clean.ACC_LIMIT,
) -> DataFrame:
    """Readings with gaps closed, left-handed subjects mirrored and acceleration in the world frame.

    Distances lose their sentinel before anything is mirrored and are not mirrored themselves. The world
    frame is computed from the cleaned rows. One shuffle: ranking, gap filling and all channels share it.
    """
    hands = attributes.select(subject, "handedness")
    joined = salted_join(readings, hands, [subject], order)
    found = families(joined)
    tidy = clean.clean_families(joined, found, limit)
    mirrored = mirror_left_v2(tidy, negate_tof=False)
    placed = with_positions(mirrored, keys, order, length="seq_len", keep_slices=True)
    closed = clean.clean_by_family(placed, keys, {f: cs for f, cs in found.items() if cs}, order=order)
    return geo.world_frame(closed)


def ensemble_answers(
    probabilities: DataFrame, expected: DataFrame, key: str, label: str, default
) -> tuple[DataFrame, DataFrame]:
    """Votes over models and windows, with the default where no vote came in; and what is wrong with them."""
    votes = ev.vote(probabilities, [key], label)
    answers = ev.default_label(expected, votes, [key], label, default).select(key, label)
    allowed = probabilities.select(label).union(expected.select(F.lit(default).alias(label)).limit(1))
    return answers, ev.violations(expected, answers, key, label, allowed.distinct())
