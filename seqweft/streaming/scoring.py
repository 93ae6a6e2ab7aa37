"""Scoring sequences as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Score = Callable[[DataFrame], DataFrame]


def score_arrivals(stream: DataFrame, score: Score, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Scores every micro-batch with a batch function and writes its answers under a folder of its own.

    A batch that is run again after a failure overwrites its own folder, so every sequence is answered
    once. Sequences must arrive whole: one sequence's rows belong to one input file.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
