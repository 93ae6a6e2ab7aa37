"""Answering sequences as they end: attributes, scaler, prediction and checks for each batch of a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqweft.functions.attributes import DEFAULTS, with_defaults
from seqweft.operators.evaluate import violations
from seqweft.operators.ordered import with_positions
from seqweft.operators.transform import apply_scaler

VERSION = "version"


@dataclass
class Serving:
    """What a batch of whole sequences is answered with.

    `attributes` is a folder of snapshots, `version=<n>`, with one row per subject; a subject that the
    snapshot lacks, or a value it lacks, takes the default. `scaler` is a folder with a fitted one-row scaler. `predict`
    gets the scaled readings (keys, pos, seq_len, channels) and one row of attributes per sequence, and
    gives one row per sequence with the label among the `allowed` ones.
    """

    keys: Sequence[str]
    subject: str
    channels: Sequence[str]
    attributes: str
    scaler: str
    predict: Callable[[DataFrame, DataFrame], DataFrame]
    allowed: Sequence[str]
    label: str = "class"


def publish_attributes(attributes: DataFrame, folder: str, version: int) -> None:
    """Adds a snapshot, which batches that start from now on will use."""
    attributes.write.parquet(f"{folder}/{VERSION}={version}")


def pinned_version(spark: SparkSession, serving: Serving, folder: str, number: int) -> int:
    """The snapshot a batch uses: the newest when it first ran, and the same one whenever it runs again."""
    path = f"{folder}/versions/batch={number}"
    newest = spark.read.parquet(serving.attributes).agg(F.max(VERSION).cast("long").alias(VERSION))
    for mode in ("ignore", "overwrite"):  # the second time only if a failure left the place without a row
        newest.coalesce(1).write.mode(mode).parquet(path)
        if row := spark.read.schema(f"{VERSION} long").parquet(path).first():
            return row[0]
    raise ValueError(f"no attributes in {serving.attributes}")


def answer_batch(batch: DataFrame, number: int, serving: Serving, folder: str) -> None:
    """Writes a batch's answers and what is wrong with them, each under a place of the batch's own.

    The rows are written first, so that the state behind them is worked out once. Run again, a batch
    replaces its own rows with the same rows; one in which no sequence ended leaves no answers.
    """
    spark, keys = batch.sparkSession, list(serving.keys)
    place = f"{folder}/rows/batch={number}"
    batch.write.mode("overwrite").parquet(place)
    batch = spark.read.schema(batch.schema).parquet(place)
    if batch.isEmpty():
        return
    version = pinned_version(spark, serving, folder, number)
    snapshot = spark.read.parquet(serving.attributes).where(F.col(VERSION) == version).drop(VERSION)
    snapshot = snapshot.select(F.col(serving.subject).alias("_subject"), *DEFAULTS)
    known = batch.select(*keys).distinct()
    known = with_defaults(known.join(snapshot, F.col(serving.subject) == F.col("_subject"), "left").drop("_subject"))
    rows = batch.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in serving.channels}).withColumnRenamed("pos", "_at")
    readings = with_positions(rows, keys, ["_at"], length="seq_len", keep_slices=True)
    scaled = apply_scaler(readings, spark.read.parquet(serving.scaler), serving.channels, null_as_zero=True)
    serving.predict(scaled, known).write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")
    answers = spark.read.parquet(f"{folder}/answers/batch={number}")
    labels = spark.createDataFrame([(x,) for x in serving.allowed], f"{serving.label} string")
    wrong = violations(known, answers, keys[-1], serving.label, labels)
    wrong.write.mode("overwrite").parquet(f"{folder}/violations/batch={number}")


def serve(whole: DataFrame, serving: Serving, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Answers a stream of whole sequences (`whole_sequences`), batch by batch."""
    writer = whole.writeStream.foreachBatch(lambda batch, number: answer_batch(batch, number, serving, folder))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
