import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqweft.functions.attributes import DEFAULTS
from seqweft.streaming import arrivals
from seqweft.streaming.arrivals import Gatherer
from seqweft.streaming.serving import Serving, answer_batch, publish_attributes
from seqweft.streaming.windows import WindowCutter


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    """One key's state."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Map())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def frame(rows):
    return pd.DataFrame(rows, columns=["pos", "v", "is_last", "time"])


def windows(values, width, stride, least=10):
    if len(values) < width:
        return [(0, True, values + [0.0] * (width - len(values)))] if len(values) >= least else []
    return [(a, False, values[a : a + width]) for a in range(0, len(values) - width + 1, stride)]


def fed(processor, batches, expire=False):
    handle = Handle()
    processor.init(handle)
    out = []
    for batch in batches:
        frames = [frame(batch[a : a + 7]) for a in range(0, len(batch), 7)]
        for f in processor.handleInputRows(("k",), iter(frames), None):
            assert len(f) <= arrivals.FRAME
            out += f.to_dict("records")
    if expire:
        assert len(handle.timers) == 1
        for f in processor.handleExpiredTimer(("k",), None, None):
            out += f.to_dict("records")
        assert not any(s.exists() if isinstance(s, Value) else s for s in handle.states.values())
    return out, handle


@pytest.mark.parametrize("seed", range(12))
def test_windows_of_scattered_rows(monkeypatch, seed):
    monkeypatch.setattr(arrivals, "SLICE", 8)
    monkeypatch.setattr(arrivals, "FRAME", 2)
    rng = random.Random(seed)
    n, width, stride = rng.choice([5, 12, 40, 90]), rng.choice([12, 16]), rng.choice([4, 16, 30])
    values = [float(rng.randrange(100)) for _ in range(n)]
    ends = seed % 3 > 0
    rows = [(i, v, ends and i == n - 1, 1000 + i) for i, v in enumerate(values)]
    rows += rng.sample(rows, n // 3)
    rng.shuffle(rows)
    cut = sorted(rng.sample(range(len(rows) + 1), 2))
    batches = [b for b in (rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :]) if b]
    got, handle = fed(WindowCutter(width, stride, "v", 10, 0.0, ["key"], 500), batches, expire=True)
    assert sorted((r["start_idx"], r["padded"], list(r["v"])) for r in got) == windows(values, width, stride)
    assert all(r["key"] == "k" for r in got)
    whole, _ = fed(Gatherer(["v"], ["key"], 500), batches, expire=True)
    assert [(r["pos"], r["v"]) for r in whole] == list(enumerate(values))


def test_state_stays_small_and_is_removed():
    values = [float(i) for i in range(5000)]
    rows = [(i, v, i == 4999, 0) for i, v in enumerate(values)]
    cutter = WindowCutter(64, 16, "v", 10, 0.0, ["key"])
    got, handle = fed(cutter, [rows[a : a + 500] for a in range(0, 4500, 500)])
    assert len(got) == (4500 - 64) // 16 + 1 and len(handle.states["kept"].get()[2]) < 64 and not handle.states["waiting"]
    got, handle = fed(WindowCutter(64, 16, "v", 10, 0.0, ["key"]), [rows])
    assert len(got) == (5000 - 64) // 16 + 1 and not any(s.exists() if isinstance(s, Value) else s for s in handle.states.values())


def test_late_rows_and_gaps():
    rows = [(i, float(i), i == 19, i) for i in range(20)]
    late = [(3, 99.0, False, 30), (25, 1.0, False, 31)]
    got, handle = fed(WindowCutter(32, 16, "v", 10, 0.0, ["key"], 100), [rows, late])
    assert [r["padded"] for r in got] == [True] and handle.timers == {131}
    gap = [r for r in rows if r[0] != 7]
    got, _ = fed(WindowCutter(32, 16, "v", 10, -1.0, ["key"], 100), [gap], expire=True)
    assert [list(r["v"]) for r in got] == [[float(r[0]) for r in gap] + [-1.0] * 13]


def test_a_batch_run_again_gives_the_same_rows(spark, tmp_path):
    """The attributes a batch first saw stay its own; what is wrong with its answers stands beside them."""
    folder, attributes, scaler = (str(tmp_path / n) for n in ("out", "attributes", "scaler"))
    subjects = spark.createDataFrame([(1, 150.0), (2, 190.0)], "user_id long, height_cm double")
    others = {c: F.lit(v) for c, v in DEFAULTS.items() if c != "height_cm"}
    publish_attributes(subjects.withColumns(others), attributes, 1)
    spark.createDataFrame([(0.0, 2.0)], "v_mean double, v_std_pop double").write.parquet(scaler)

    def predict(scaled, known):
        total = scaled.groupBy("user_id").agg(F.sum("v").alias("total"), F.max("seq_len").alias("n"))
        tall = F.when(F.col("height_cm") > 180, "tall").when(F.col("user_id") == 4, "odd").otherwise("short")
        return total.join(known, "user_id").select("user_id", tall.alias("class"), "total", "n", "height_cm").where("user_id <> 5")

    rows = [(u, i, float(u) if i else float("nan")) for u in (1, 2, 3, 4, 5) for i in range(3)]
    batch = spark.createDataFrame(rows, "user_id long, pos long, v double")
    serving = Serving(["user_id"], "user_id", ["v"], attributes, scaler, predict, ["tall", "short"])
    read = lambda what: sorted(map(tuple, spark.read.parquet(f"{folder}/{what}").where("batch = 7").drop("batch").collect()))
    answer_batch(batch, 7, serving, folder)
    first = read("answers")
    assert first == [(1, "short", 1.0, 3, 150.0), (2, "tall", 2.0, 3, 190.0), (3, "short", 3.0, 3, 170.0), (4, "odd", 4.0, 3, 170.0)]
    assert read("violations") == [(4, "unknown label"), (5, "missing")]
    publish_attributes(subjects.withColumns(others).withColumn("height_cm", F.lit(200.0)), attributes, 2)
    answer_batch(batch, 7, serving, folder)
    assert read("answers") == first
    answer_batch(batch, 8, serving, folder)
    assert {r["class"] for r in spark.read.parquet(f"{folder}/answers").where("batch = 8 AND user_id < 3").collect()} == {"tall"}
