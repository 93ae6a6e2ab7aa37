"""A sink for predictions that shows all of a run's rows or none.

Tasks write draft files and report what they hold: rows, the range of their keys, and how many labels
are missing, unknown or given twice. The driver compares the reports with what was asked for, and only
then renames the drafts' folder, which makes all rows visible at once. Anything else removes the drafts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "checked_predictions"


@dataclass
class Held(WriterCommitMessage):
    """What one task has written."""

    file: str | None
    rows: int = 0
    first: Any = None
    last: Any = None
    null: int = 0
    unknown: int = 0
    repeated: int = 0


class Drafts(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: pa.Schema) -> None:
        self.path, self.run = options["path"].rstrip("/"), options["run"]
        self.key, self.label = options["key"], options["label"]
        self.allowed, self.expected = json.loads(options["allowed"]), int(options["expected"])
        self.schema = schema

    def place(self, name: str) -> tuple[fs.FileSystem, str]:
        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), f"{self.path}/{name}"
        at = self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
        where, folder = fs.FileSystem.from_uri(at)
        return where, f"{folder}/{name}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Held:
        where, folder = self.place(f"_drafts-{self.run}")
        held, writer, allowed = Held(None), None, pa.array(self.allowed, pa.string())
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None:
                    where.create_dir(folder, recursive=True)
                    held.file = f"part-{uuid.uuid4().hex}.parquet"
                    writer = pq.ParquetWriter(where.open_output_stream(f"{folder}/{held.file}"), batch.schema, compression="zstd")
                keys, labels = batch.column(self.key), batch.column(self.label)
                listed = keys.to_pylist()
                pairs = zip([held.last if held.rows else object(), *listed], listed, strict=False)
                held.repeated += sum(a == b for a, b in pairs)
                held.null += labels.null_count + keys.null_count
                held.unknown += pc.sum(pc.invert(pc.is_in(labels.drop_null(), allowed))).as_py() or 0
                held.first = listed[0] if not held.rows else held.first
                held.last, held.rows = listed[-1], held.rows + len(listed)
                writer.write_batch(batch)
        finally:
            if writer is not None:
                writer.close()
        return held

    def faults(self, reports: list[Held]) -> list[str]:
        rows = sum(r.rows for r in reports)
        out = [] if rows == self.expected else [f"{rows} rows instead of {self.expected}"]
        for what in ("null", "unknown", "repeated"):
            if n := sum(getattr(r, what) for r in reports):
                out.append(f"{n} {what}")
        # Tasks hold ranges of keys, so only neighbours can share one.
        ranges = sorted(((r.first, r.last) for r in reports if r.rows and not r.null), key=lambda x: x[0])
        if n := sum(a[1] >= b[0] for a, b in zip(ranges, ranges[1:], strict=False)):
            out.append(f"{n} overlapping ranges of keys")
        return out

    def commit(self, messages: list[Held | None]) -> None:
        reports = [m for m in messages if m is not None]
        if found := self.faults(reports):
            raise ValueError("predictions refused: " + ", ".join(found))
        where, drafts = self.place(f"_drafts-{self.run}")
        kept = {r.file for r in reports if r.file}
        if not kept:
            return
        for info in where.get_file_info(fs.FileSelector(drafts)):
            if info.base_name not in kept:  # of an attempt that didn't end
                where.delete_file(info.path)
        where.move(drafts, self.place(f"run={self.run}")[1])

    def abort(self, messages: list[Held | None]) -> None:
        where, drafts = self.place(f"_drafts-{self.run}")
        if where.get_file_info(drafts).type != fs.FileType.NotFound:
            where.delete_dir(drafts)


class CheckedPredictions(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> Drafts:
        return Drafts(dict(self.options), schema)


def write_predictions(answers: DataFrame, path: str, key: str, label: str, allowed: Sequence[str], expected: int, run: str | None = None) -> str:
    """Writes one label for each key, under a run of its own; `expected` says for how many keys.

    Refuses, and leaves nothing, if a row is missing or too many, a key or label is null, a label isn't
    allowed or a key comes twice. The path must be one that pyarrow can write to.
    """
    run = run or uuid.uuid4().hex[:12]
    spark = answers.sparkSession
    spark.dataSource.register(CheckedPredictions)
    ordered = answers.repartitionByRange(key).sortWithinPartitions(key)
    options = {"path": path, "run": run, "key": key, "label": label, "allowed": json.dumps(list(allowed)), "expected": str(expected)}
    ordered.write.format(NAME).mode("append").options(**options).save()
    return run


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs that were taken, with the run's name."""
    return spark.read.parquet(path)
