"""Scans: readings and attributes from CSV, Parquet and JSON, with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the readings' own columns and the subject attributes
READING_META = ["row_id", "sequence_type", "sequence_id", "subject", "orientation", "behavior", "phase", "gesture"]
ATTRIBUTES = {
    "subject": "string",
    "adult_child": "int",
    "age": "int",
    "sex": "int",
    "handedness": "int",
    "height_cm": "double",
    "shoulder_to_wrist_cm": "double",
    "elbow_to_wrist_cm": "double",
}

MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# Spark's own CSV default keeps milliseconds only
CSV_FORMATS = {"timestampFormat": MICROSECONDS + "XXX", "timestampNTZFormat": MICROSECONDS}


def sensor_channels() -> list[str]:
    """All 332 channel names: 3 acceleration, 4 orientation, 5 thermal, 5 x 64 distance pixels."""
    names = [f"acc_{a}" for a in "xyz"] + [f"rot_{a}" for a in "wxyz"] + [f"thm_{i}" for i in range(1, 6)]
    return names + [f"tof_{s}_v{p}" for s in range(1, 6) for p in range(64)]


def readings_schema(labelled: bool = True) -> T.StructType:
    meta = READING_META if labelled else ["row_id", "sequence_id", "subject"]
    fields = [T.StructField(n, T.StringType()) for n in meta]
    fields.insert(fields.index(T.StructField("sequence_id", T.StringType())) + 1, T.StructField("sequence_counter", T.IntegerType()))
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in sensor_channels()])


def attributes_schema() -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in ATTRIBUTES.items()))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null everywhere after the scan: NaN would equal itself and sort above every number."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).options(**CSV_FORMATS).csv(path, header=True))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One folder, one file or many: Spark lists them as a single scan."""
    return nan_to_null(spark.read.parquet(*paths))


def read_windows(spark: SparkSession, path: str, config: str | None = None) -> DataFrame:
    """Window sets, one partition per configuration; asking for one prunes the others' files."""
    df = spark.read.parquet(path)
    return df if config is None else df.where(F.col("window_config") == config)


def read_jdbc(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


HISTORY_SCHEMA = """run string, training_metrics struct<loss: array<double>, val_loss: array<double>>,
    loss array<double>, val_loss array<double>"""


def read_histories(spark: SparkSession, path: str, schema: str = HISTORY_SCHEMA, multi_line: bool = True) -> DataFrame:
    """Training histories in either layout (nested under training_metrics, or flat), one row per epoch."""
    raw = spark.read.schema(schema).json(path, multiLine=multi_line)
    series = {c: F.coalesce(f"training_metrics.{c}", c) for c in ("loss", "val_loss")}
    flat = raw.select("run", F.arrays_zip(*[e.alias(c) for c, e in series.items()]).alias("e"))
    return flat.select("run", F.posexplode("e").alias("_at", "_e")).select(
        "run", (F.col("_at") + 1).alias("epoch"), "_e.loss", "_e.val_loss"
    )


def window_integrity(
    windows: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    labels: Sequence[str] = (),
    attributes: Sequence[str] = (),
    width: int | dict[str, int] | None = None,
) -> DataFrame:
    """One row per configuration: counts and array lengths that should agree, and whether they do.

    Every window needs an array without nulls in every channel, all of one length (`width` if it is given,
    for all configurations or by name; one without a width isn't consistent), every label and attribute, and
    a key of its own.
    """
    sizes = [F.coalesce(F.size(c), F.lit(-1)) for c in channels]
    low, high = (F.least(*sizes), F.greatest(*sizes)) if len(sizes) > 1 else (sizes[0], sizes[0])
    whole = [F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()) for c in channels]
    counted = windows.groupBy("window_config", *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(low).alias("low"),
        F.max(high).alias("high"),
        *[F.sum(F.coalesce(w, F.lit(False)).cast("long")).alias(f"_{c}") for c, w in zip(channels, whole, strict=True)],
        *[F.count(c).alias(f"_{c}") for c in [*labels, *attributes]],
    )
    full = F.lit(True)
    for c in [*channels, *attributes]:
        full = full & (F.col(f"_{c}") == F.col("n"))
    out = counted.groupBy("window_config").agg(
        F.sum("n").alias("windows"),
        F.min("low").alias("shortest"),
        F.max("high").alias("longest"),
        *[F.sum(f"_{c}").alias(f"with_{c}") for c in labels],
        (F.max("n") == 1).alias("_own_keys"),
        F.min(full).alias("_full"),
        *[F.max(F.col(f"_{c}") > 0).cast("int").alias(f"_seen_{c}") for c in channels],
    )
    wanted = F.col("longest") if width is None else F.lit(width)
    if isinstance(width, dict):
        wanted = F.element_at(F.create_map(*[F.lit(x) for pair in width.items() for x in pair]), F.col("window_config"))
        wanted = F.coalesce(wanted, F.lit(-1))
    same = (F.col("shortest") == wanted) & (F.col("longest") == wanted) & F.col("_own_keys") & F.col("_full")
    for c in labels:
        same = same & (F.col(f"with_{c}") == F.col("windows"))
    seen = [F.col(f"_seen_{c}") for c in channels]
    present = sum(seen[1:], seen[0])
    return out.select(
        "window_config", "windows", "shortest", "longest", *[f"with_{c}" for c in labels], present.alias("channels"), same.alias("consistent")
    )
