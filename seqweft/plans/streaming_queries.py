"""Streams and user functions (ST, U)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from seqweft.functions.attributes import DEFAULTS
from seqweft.operators import evaluate as ev
from seqweft.operators import features as feat
from seqweft.operators import models, user
from seqweft.operators.ordered import with_positions
from seqweft.operators.transform import fit_scaler
from seqweft.operators.windows import sliding_windows
from seqweft.plans.adapters import EVENT_KEYS, EVENTS_SQL, events, table
from seqweft.plans.registry import query
from seqweft.plans.window_queries import WINDOW_ID, WINDOWS_SQL, event_windows, windows_sql
from seqweft.session import scratch_path
from seqweft.sources.writers import write_parquet
from seqweft.streaming.arrivals import whole_sequences
from seqweft.streaming.scoring import score_arrivals
from seqweft.streaming.serving import Serving, publish_attributes, serve
from seqweft.streaming.windows import stream_windows

WINDOW_FEATURES = ["value_mean", "value_std_pop", "value_range", "value_rms"]


def _stage_whole_sequences(spark, sf) -> str:
    """Events laid out so that each file holds whole sequences, as a feed of finished sequences would."""
    path = scratch_path(spark, "arrivals")
    df = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    write_parquet(df.repartition(4, "user_id"), path)
    return path


def score_sequences(model, names):
    """A batch function: windows without minimum length, features, class probabilities, vote per sequence."""

    def score(batch):
        readings = with_positions(batch, EVENT_KEYS, ["ts", "event_id"], length="seq_len", keep_slices=True)
        windows = sliding_windows(readings, EVENT_KEYS, ["value"], (64, 16), min_length=0)
        scored = model.transform(feat.window_statistics(windows, ["value"], [*WINDOW_ID]))
        classes = F.array(*[F.lit(n) for n in names])
        long = scored.select("user_id", F.posexplode(vector_to_array("_probability")).alias("_i", "probability"))
        long = long.select("user_id", F.get(classes, F.col("_i")).alias("class"), "probability")
        return ev.vote(long, EVENT_KEYS)

    return score


def _fitted(spark, sf):
    windows = feat.window_statistics(event_windows(spark, sf), ["value"], ["event_type"])
    model = models.forest(WINDOW_FEATURES, "event_type", trees=5, depth=4).fit(windows)
    return model, model.stages[0].labelsArray[0]


@query("st1_score_arriving_sequences")
def score_arriving_sequences(spark, sf):
    source, answers = _stage_whole_sequences(spark, sf), scratch_path(spark, "answers")
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    done = score_arrivals(stream, score_sequences(*_fitted(spark, sf)), answers, scratch_path(spark, "progress"))
    done.awaitTermination()
    return spark.read.parquet(answers).select("user_id", "class", "confidence")


def _summaries(batch):
    readings = with_positions(batch, EVENT_KEYS, ["ts", "event_id"], length="seq_len", keep_slices=True)
    windows = sliding_windows(readings, EVENT_KEYS, ["value"], (64, 16), min_length=0)
    stats = feat.window_statistics(windows, ["value"], EVENT_KEYS)
    return stats.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.avg("value_rms"), 6).alias("mean_rms"), F.max("value_range").alias("range")
    )


@query(
    "st1_summaries_of_arriving_sequences",
    f"""WITH {EVENTS_SQL}, {windows_sql('ev', 'user_id', ['value'], 64, 16, -1, 'w')},
    s AS (SELECT user_id, start_idx, sqrt(list_sum(list_transform(value, lambda x: x * x)) / 64) AS rms,
          list_max(value) - list_min(value) AS r FROM w)
    SELECT user_id, count(*) AS windows, round(avg(rms), 6) AS mean_rms, max(r) AS range FROM s GROUP BY user_id""",
)
def summaries_of_arriving_sequences(spark, sf):
    source, answers = _stage_whole_sequences(spark, sf), scratch_path(spark, "summaries")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 2).parquet(source)
    score_arrivals(stream, _summaries, answers, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(answers).drop("batch")


def _stateful(spark, source):
    """The files of a folder as a stream, in a session of its own, which holds the state store's setting."""
    own = spark.newSession()
    own.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    schema = spark.read.parquet(source).schema
    return own.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)


def _pieces(spark, sf) -> str:
    """Sequences in two pieces in different files."""
    source = scratch_path(spark, "pieces")
    readings = events(spark, sf).select(
        "user_id", "pos", "value", (F.col("pos") == F.col("seq_len") - 1).alias("is_last")
    )
    early = F.col("pos") < 45
    write_parquet(readings.where(early).repartition(2, "user_id"), source)
    write_parquet(readings.where(~early).repartition(2, "user_id"), source, mode="append")
    return source


def _scattered(spark, sf) -> str:
    """Sequences whose later rows come first, some twice, and of which every third never says that it has ended.

    A row of another source, long after all others, comes last and lets event time go on.
    """
    source = scratch_path(spark, "scattered")
    last = (F.col("pos") == F.col("seq_len") - 1) & (F.col("user_id") % 3 != 0)
    readings = events(spark, sf).select("user_id", "pos", "value", last.alias("is_last"), "ts")
    thirds = [F.col("pos") >= 50, F.col("pos") < 20, (F.col("pos") >= 15) & (F.col("pos") < 52)]
    for i, part in enumerate(thirds):
        write_parquet(readings.where(part).repartition(2, "user_id"), source, mode="append" if i else "errorifexists")
    after = readings.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("user_id"), F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("value"), F.lit(True).alias("is_last"),
        (F.col("ts") + F.expr("INTERVAL 90 DAYS")).cast(readings.schema["ts"].dataType).alias("ts"),
    )
    write_parquet(after.coalesce(1), source, mode="append")
    return source


PATIENCE = 3_600_000
DELAY = "60 days"


def _windows_from_pieces(spark, source, width, stride, **clock):
    """Every window is emitted once, whatever the pieces its rows come in."""
    out = scratch_path(spark, "stream-windows")
    made = stream_windows(_stateful(spark, source), EVENT_KEYS, "value", width, stride, **clock)
    writer = made.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", out).option("checkpointLocation", scratch_path(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(
    "st2_windows_from_pieces",
    f"""WITH {EVENTS_SQL}, {windows_sql('ev', 'user_id', ['value'], 32, 16, 10, 'w')}
    SELECT user_id, start_idx, padded, value FROM w""",
)
def windows_from_pieces(spark, sf):
    return _windows_from_pieces(spark, _pieces(spark, sf), 32, 16)


@query(
    "st2_windows_apart",
    f"""WITH {EVENTS_SQL}, {windows_sql('ev', 'user_id', ['value'], 12, 20, 10, 'w')}
    SELECT user_id, start_idx, padded, value FROM w""",
)
def windows_apart(spark, sf):
    """A stride beyond the width: rows between two windows are skipped, also across pieces."""
    return _windows_from_pieces(spark, _pieces(spark, sf), 12, 20)


def _taller_needs_more(scaled, attributes):
    """A fixed rule: a window speaks for `high` if its mean exceeds a limit that rises with the subject's height."""
    windows = sliding_windows(scaled, EVENT_KEYS, ["value"], (64, 16), min_length=0)
    means = windows.select("user_id", (F.aggregate("value", F.lit(0.0), lambda a, x: a + x) / 64).alias("mean"))
    high = F.when(F.col("mean") > (F.col("height_cm") - 170) / 100, 1.0).otherwise(0.0)
    each = F.array(F.struct(F.lit("high").alias("class"), high.alias("probability")), F.struct(F.lit("low").alias("class"), (1 - high).alias("probability")))
    long = means.join(attributes.select("user_id", "height_cm"), "user_id").select("user_id", F.explode(each).alias("c"))
    return ev.vote(long.select("user_id", "c.*"), EVENT_KEYS)


def serving_of(spark, sf) -> Serving:
    """Attributes in two versions, of which the newer holds, for three subjects of four; the rest take the defaults."""
    attributes, scaler = scratch_path(spark, "attributes"), scratch_path(spark, "scaler")
    known = _heights(spark, sf)
    publish_attributes(known.withColumn("height_cm", F.col("height_cm") - 60), attributes, 1)
    publish_attributes(known, attributes, 2)
    write_parquet(fit_scaler(table(spark, sf, "events"), ["value"]), scaler)
    return Serving(EVENT_KEYS, "user_id", ["value"], attributes, scaler, _taller_needs_more, ["high", "low"])


def _heights(spark, sf):
    customers = table(spark, sf, "customer").where("c_custkey % 4 <> 0")
    others = [F.lit(v).alias(c) for c, v in DEFAULTS.items() if c != "height_cm"]
    return customers.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") / 100 + 120).alias("height_cm"), *others)


@query(
    "st1_served_sequences",
    f"""WITH {EVENTS_SQL}, m AS (SELECT avg(coalesce(value, 0)) AS a, stddev_pop(coalesce(value, 0)) AS s FROM events),
    sc AS (SELECT user_id, pos, seq_len, (coalesce(value, 0) - a) / s AS value FROM ev, m),
    {windows_sql('sc', 'user_id', ['value'], 64, 16, -1, 'w')},
    p AS (SELECT user_id, avg(CASE WHEN list_sum(value) / 64 > (coalesce(c_acctbal / 100 + 120, 170.0) - 170) / 100 THEN 1.0 ELSE 0.0 END) AS p
      FROM w LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 4 <> 0 GROUP BY user_id)
    SELECT user_id, CASE WHEN p >= 0.5 THEN 'high' ELSE 'low' END AS class, round(greatest(p, 1 - p), 9) AS confidence FROM p""",
)
def served_sequences(spark, sf):
    """Pieces out of order are gathered until a sequence ends, then joined, scaled, answered and checked."""
    serving, answers = serving_of(spark, sf), scratch_path(spark, "served")
    stream = _stateful(spark, _scattered(spark, sf))
    whole = whole_sequences(stream, EVENT_KEYS, ["value"], time="ts", patience=PATIENCE, delay=DELAY)
    serve(whole.where("user_id >= 0"), serving, answers, scratch_path(spark, "progress")).awaitTermination()
    wrong = spark.read.parquet(f"{answers}/violations")
    got = spark.read.parquet(f"{answers}/answers").join(wrong, "user_id", "left_anti")
    return got.select("user_id", "class", F.round("confidence", 9).alias("confidence"))


@query(
    "st2_windows_out_of_order",
    f"""WITH {EVENTS_SQL}, {windows_sql('ev', 'user_id', ['value'], 66, 33, 10, 'w')}
    SELECT user_id, start_idx, padded, value FROM w""",
)
def windows_out_of_order(spark, sf):
    """Pieces out of order, repeated rows, and sequences that never end, which a timer pads."""
    return _windows_from_pieces(spark, _scattered(spark, sf), 66, 33, time="ts", patience=PATIENCE, delay=DELAY)


def _forward_mean(frame: pd.DataFrame) -> pd.DataFrame:
    """Mean of the row and up to four rows after it."""
    ahead = frame["value"][::-1].rolling(5, min_periods=1).mean()[::-1]
    return frame.assign(smooth=ahead).loc[frame["own"], ["user_id", "pos", "smooth"]]


@query(
    "u1_function_per_sequence",
    f"""WITH {EVENTS_SQL} SELECT user_id, pos, round(avg(value) OVER (PARTITION BY user_id ORDER BY pos
        ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 5) AS smooth FROM ev""",
)
def function_per_sequence(spark, sf):
    rows = events(spark, sf).select("user_id", "pos", "value")
    out = user.apply_in_chunks(rows, EVENT_KEYS, _forward_mean, "user_id long, pos long, smooth double", span=512, after=4)
    return out.withColumn("smooth", F.round("smooth", 5))


def _wide_sum(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sum of the row, the forty before it and the twenty after it."""
    own = np.flatnonzero(rows["own"])
    sums = np.concatenate([[0.0], np.cumsum(rows["value"])])
    wide = sums[np.minimum(own + 21, len(sums) - 1)] - sums[np.maximum(own - 40, 0)]
    return {"user_id": rows["user_id"][own], "pos": rows["pos"][own], "wide": wide}


@query(
    "u1_context_beyond_a_chunk",
    f"""WITH {EVENTS_SQL} SELECT user_id, pos, round(sum(value) OVER (PARTITION BY user_id ORDER BY pos
        ROWS BETWEEN 40 PRECEDING AND 20 FOLLOWING), 4) AS wide FROM ev""",
)
def context_beyond_a_chunk(spark, sf):
    rows = events(spark, sf).select("user_id", "pos", "value")
    out = user.apply_in_chunks(rows, EVENT_KEYS, _wide_sum, "user_id long, pos long, wide double", span=16, before=40, after=20, arrays=True)
    return out.withColumn("wide", F.round("wide", 4))


def _part(batch: pd.DataFrame) -> pd.DataFrame:
    over = batch.assign(over=(batch["l_quantity"] > 25).astype("int64"), top=batch["l_extendedprice"])
    return over.groupby("l_suppkey", as_index=False).agg(over=("over", "sum"), top=("top", "max"))


@query(
    "u2_user_aggregate",
    """SELECT l_suppkey, count(*) FILTER (WHERE l_quantity > 25) AS "over", max(l_extendedprice) AS top
    FROM lineitem GROUP BY l_suppkey""",
)
def user_aggregate(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    merges = {"over": "sum", "top": "max"}
    return user.aggregate_in_parts(rows, ["l_suppkey"], _part, merges, "l_suppkey long, over long, top double")


def _ends_and_step(x: np.ndarray) -> np.ndarray:
    return np.array([x[0], x[-1], np.round(np.abs(np.diff(x)).max(), 6)])


@query(
    "u3_function_per_window",
    f"""WITH {WINDOWS_SQL} SELECT user_id, start_idx, [value[1], value[64],
        round(list_max(list_transform(range(1, 64), lambda i: abs(value[i + 1] - value[i]))), 6)] AS vector FROM w""",
)
def function_per_window(spark, sf):
    windows = event_windows(spark, sf).select(*WINDOW_ID, "value")
    return user.window_vector(windows, "value", _ends_and_step, "vector").select(*WINDOW_ID, "vector")


def _make_predict():
    def predict(batch: pd.DataFrame) -> pd.Series:
        peak = batch["value"].map(max)
        limit = batch["c_acctbal"].fillna(0.0) / 20
        return pd.Series(np.where(peak > limit, "high", "low"), index=batch.index)

    return predict


@query(
    "u4_user_prediction",
    f"""WITH {WINDOWS_SQL}, p AS (SELECT user_id, CASE WHEN list_max(value) > coalesce(c_acctbal, 0) / 20 THEN 'high' ELSE 'low' END AS label
      FROM w LEFT JOIN customer ON c_custkey = user_id),
    n AS (SELECT user_id, label, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, label) AS i FROM p GROUP BY user_id, label)
    SELECT user_id, label FROM n WHERE i = 1""",
)
def user_prediction(spark, sf):
    attributes = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    windows = event_windows(spark, sf).select(*WINDOW_ID, "value")
    return user.predict_sequences(windows, attributes, EVENT_KEYS, EVENT_KEYS, _make_predict)
