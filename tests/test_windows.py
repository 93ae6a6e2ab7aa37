import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqweft.functions import geometry as geo
from seqweft.functions.kernels import DB4_HIGH, DB4_LOW
from seqweft.operators import features as feat
from seqweft.operators import user
from seqweft.operators import windows as win
from seqweft.operators.ordered import with_positions

W, S = 8, 4


def make(spark, lengths):
    rows = [(k, i, float(10 * k + i), f"g{k}" if i == 0 else "later") for k, n in enumerate(lengths) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, at long, v double, label string")
    return with_positions(df, ["key"], ["at"], length="seq_len", keep_slices=True)


def expected(lengths, width, stride, minimum):
    out = {}
    for k, n in enumerate(lengths):
        if n < minimum:
            continue
        values = [float(10 * k + i) for i in range(n)] + [0.0] * max(0, width - n)
        for start in range(0, len(values) - width + 1, stride):
            out[k, start] = (values[start : start + width], n < width, n)
    return out


LENGTHS = [1, 2, 3, W - 1, W, W + 1, W + S, 40, 150, 301]


@pytest.mark.parametrize("shape", [(W, S), (W, W), (W, 1), (W, 3), (W, 2 * W)])
def test_windows_match_a_loop(spark, mode, shape):
    got = win.sliding_windows(make(spark, LENGTHS), ["key"], ["v"], shape, min_length=3, first_of=["label"]).collect()
    want = expected(LENGTHS, *shape, 3)
    assert len(got) == len(want)
    for r in got:
        values, padded, length = want[r["key"], r["start_idx"]]
        assert r["v"] == values and r["padded"] == padded and r["original_length"] == length
        assert r["end_idx"] == r["start_idx"] + shape[0] and r["label"] == f"g{r['key']}"


def test_several_configurations_equal_single_ones(spark, mode):
    df = make(spark, LENGTHS)
    shapes = {"a": (8, 4), "b": (16, 6)}
    both = win.sliding_windows(df, ["key"], ["v"], shapes, min_length=3).toPandas()
    for name, shape in shapes.items():
        part = both[both["window_config"] == name]
        want = expected(LENGTHS, *shape, 3)
        assert {(r.key, r.start_idx): list(r.v) for r in part.itertuples()} == {k: v[0] for k, v in want.items()}


def test_edge_windows_and_count_rule(spark, mode):
    df = make(spark, LENGTHS)
    last = {r["key"]: r["v"] for r in win.edge_window(df, ["key"], ["v"], W, "last").collect()}
    first = {r["key"]: r["v"] for r in win.edge_window(df, ["key"], ["v"], W, "first").collect()}
    for k, n in enumerate(LENGTHS):
        values = [float(10 * k + i) for i in range(n)]
        pad = [0.0] * max(0, W - n)
        assert last[k] == values[-W:] + pad and first[k] == values[:W] + pad
    counts = df.groupBy("key").agg(F.max("seq_len").alias("n")).withColumn("c", win.window_count(F.col("n"), W, S)).collect()
    for r in counts:
        assert r["c"] == (0 if r["n"] < W else (r["n"] - W) // S + 1)


def test_chunk_function_sees_its_edges(spark, mode):
    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        smooth = frame["v"].rolling(3, center=True, min_periods=1).mean()
        return frame.assign(smooth=smooth).loc[frame["own"], ["key", "pos", "smooth"]]

    rows = make(spark, LENGTHS).select("key", "pos", "v")
    got = user.apply_in_chunks(rows, ["key"], fn, "key long, pos long, smooth double", span=16, before=1, after=1).toPandas()
    assert len(got) == sum(LENGTHS)
    for k, n in enumerate(LENGTHS):
        want = pd.Series([10.0 * k + i for i in range(n)]).rolling(3, center=True, min_periods=1).mean()
        assert np.allclose(got[got["key"] == k].sort_values("pos")["smooth"], want)


@pytest.mark.parametrize("arrays", [False, True])
@pytest.mark.parametrize("span, before, after", [(4, 9, 5), (16, 1, 0), (3, 0, 7), (64, 40, 20)])
def test_chunk_sees_its_rows_across_blocks_and_batches(spark, monkeypatch, arrays, span, before, after):
    monkeypatch.setattr(user, "BLOCK", 24)
    monkeypatch.setattr(user, "SEEN", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")

    def seen(frame):
        kind = f"{frame['n'].dtype} {frame['flag'].dtype} {frame.index[-1]}"
        out = frame.loc[frame["own"], ["key", "pos", "n", "flag"]]
        return out.assign(first=frame["pos"].iloc[0], last=frame["pos"].iloc[-1], rows=len(frame), kind=kind)

    def seen_arrays(part):
        own, kind = part["own"], f"{part['n'].dtype} {part['flag'].dtype} {len(part['pos']) - 1}"
        same = {"first": part["pos"][0], "last": part["pos"][-1], "rows": len(own), "kind": kind}
        return {c: part[c][own] for c in ("key", "pos", "n", "flag")} | {c: np.full(own.sum(), v) for c, v in same.items()}

    big = 2**53 + 1
    rng = np.random.default_rng(3)
    rows = []
    for k, size in enumerate([1, 5, 23, 24, 25, 48, 130, 131]):
        places = np.flatnonzero(rng.random(size) < (0.6 if k % 2 else 1.1))  # every second sequence has gaps
        for i in places.tolist():
            rows.append((None if k == 3 else big + k, i, None if i % 31 == 7 else big + i, None if i % 31 == 9 else i % 2 == 0))
    try:
        df = spark.createDataFrame(rows, "key long, pos long, n long, flag boolean").repartition(3)
        schema = "key long, pos long, n long, flag boolean, first long, last long, rows long, kind string"
        out = user.apply_in_chunks(df, ["key"], seen_arrays if arrays else seen, schema, span, before, after, arrays=arrays)
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for key, p, n, flag in rows:
        start = p // span * span
        part = sorted(r for r in ((q, m, f) for k, q, m, f in rows if k == key and start - before <= q < start + span + after))
        loose = any(m is None for _, m, _ in part)
        kind = f"{'float64' if loose else 'int64'} {'object' if any(f is None for *_, f in part) else 'bool'} {len(part) - 1}"
        # beside a null a whole number is a double, as pandas has it
        want.append((key, p, int(float(n)) if loose and n is not None else n, flag, part[0][0], part[-1][0], len(part), kind))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_chunks_dont_multiply_the_rows_that_move(spark):
    def seen(frame):
        return frame.loc[frame["own"], ["key", "pos"]].assign(rows=len(frame))

    rows = make(spark, [3000, 40, 41, 42]).select("key", "pos", "v")
    out = user.apply_in_chunks(rows, ["key"], seen, "key long, pos long, rows long", span=16, before=40, after=20)
    assert len(out.collect()) == 3123
    moved, plans = [], [out._jdf.queryExecution().executedPlan().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            plan = plan.plan()
        written = plan.metrics().get("shuffleRecordsWritten")
        moved += [written.get().value()] if written.isDefined() else []
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    assert moved and max(moved) < 1.2 * 3123


def sine_windows(spark):
    t = np.arange(128) / 50.0
    data = {"x": np.sin(2 * np.pi * 1 * t), "y": np.sin(2 * np.pi * 3.125 * t), "z": np.sin(2 * np.pi * 12.5 * t)}
    return spark.createDataFrame([(1, *[v.tolist() for v in data.values()])], "id long, x array<double>, y array<double>, z array<double>"), data


def test_window_statistics_match_numpy(spark):
    df, data = sine_windows(spark)
    got = feat.window_statistics(df, ["x", "y", "z"], ["id"]).first()
    for c, v in data.items():
        assert np.isclose(got[f"{c}_mean"], v.mean()) and np.isclose(got[f"{c}_std_pop"], v.std())
        assert np.isclose(got[f"{c}_rms"], np.sqrt((v**2).mean())) and np.isclose(got[f"{c}_energy"], (v**2).sum())
    size = np.sqrt(sum(v**2 for v in data.values()))
    assert np.isclose(got["mag_mean"], size.mean()) and np.isclose(got["mag_std_pop"], size.std())


def test_energy_lands_in_its_band(spark):
    df, data = sine_windows(spark)
    got = feat.window_band_energy(df, list(data), ["id"]).first()
    for c, band in (("x", 0), ("y", 1), ("z", 3)):
        energies = [got[f"{c}_band{i}"] for i in range(4)]
        assert int(np.argmax(energies)) == band and energies[band] > 0.9 * sum(energies)


def test_wavelet_matches_direct_convolution(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=37)

    def step(v, taps):
        n = len(v)

        def at(i):
            while not 0 <= i < n:
                i = -1 - i if i < 0 else 2 * n - 1 - i
            return v[i]

        return np.array([sum(taps[k] * at(2 * i + 1 - k) for k in range(8)) for i in range((n + 7) // 2)])

    want, low = {}, x
    for level in (1, 2, 3):
        want[f"v_d{level}"] = (step(low, DB4_HIGH) ** 2).sum()
        low = step(low, DB4_LOW)
    want["v_a3"] = (low**2).sum()
    df = spark.createDataFrame([(1, x.tolist())], "id long, v array<double>")
    got = feat.window_wavelet_energy(df, ["v"], ["id"]).first()
    assert all(np.isclose(got[k], v) for k, v in want.items())
    assert np.isclose(sum(np.square(DB4_LOW)), 1.0) and np.isclose(np.dot(DB4_LOW, DB4_HIGH), 0.0)


def test_window_peaks(spark):
    cases = [[1, 3, 3, 2, 5, 4, 4, 6], [1, 1], [2, 2, 2], [1, 2, 1]]
    df = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(cases)], "id long, v array<double>")
    got = {r["id"]: r["v_peaks"] for r in feat.window_peaks(df, ["v"], ["id"]).collect()}
    assert got == {0: 2, 1: 0, 2: 0, 3: 1}


def test_identity_rotation_and_norm(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(20, 4))
    q = np.vstack([[1, 0, 0, 0], q / np.linalg.norm(q, axis=1, keepdims=True)])
    acc = rng.normal(size=(21, 3))
    rows = [tuple(map(float, [*a, *b])) for a, b in zip(q, acc)]
    df = spark.createDataFrame(rows, ["rot_w", "rot_x", "rot_y", "rot_z", "acc_x", "acc_y", "acc_z"])
    got = geo.world_frame(df).toPandas()
    assert np.allclose(got.loc[0, ["acc_w_x", "acc_w_y", "acc_w_z"]].astype(float), acc[0])
    assert np.allclose(got["lin_acc_z"], got["acc_w_z"] - 9.81)
    assert np.allclose(np.linalg.norm(got[["acc_w_x", "acc_w_y", "acc_w_z"]], axis=1), np.linalg.norm(acc, axis=1))


def test_sample_moments(spark, mode):
    values = [1, 2, 2, 7, 11, 30, 4]
    df = spark.createDataFrame([(1, float(v), 3.0) for v in values], "key long, v double, c double")
    got = {r["channel"]: r for r in feat.channel_statistics(df, ["key"], ["v", "c"]).collect()}
    v, c = got["v"], got["c"]
    assert np.isclose(v["skew"], 2.0700197638) and np.isclose(v["kurtosis"], 4.4797332821)
    assert np.isclose(v["std"], 10.2539191114) and v["median"] == 4 and v["q25"] == 2
    assert c["skew"] == 0 and c["kurtosis"] == 0 and c["std"] == 0
