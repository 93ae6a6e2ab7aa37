import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqweft.functions import attributes as att
from seqweft.functions import channels as ch
from seqweft.functions.handedness import mirror_left, mirror_left_v2
from seqweft.functions.labels import OTHER_GESTURES, TARGET_GESTURES
from seqweft.operators import clean, profile
from seqweft.operators import evaluate as ev
from seqweft.operators import models
from seqweft.operators import transform as tf
from seqweft.operators.ordered import salted_join, with_positions
from seqweft.operators.windows import sliding_windows
from seqweft.session import scratch_path
from seqweft.sources import readers, writers


def test_bins(spark):
    ages = [0, 12, 13, 35, 36, 100, 101]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    closed = [r[0] for r in df.select(att.binned(F.col("age"), *att.AGE_BINS)).collect()]
    opened = [r[0] for r in df.select(att.binned(F.col("age"), *att.AGE_BINS, open_ended=True)).collect()]
    assert closed == [None, "child", "teen", "adult", "senior", "senior", None]
    assert opened == ["child", "child", "teen", "adult", "senior", "senior", "senior"]


def test_attribute_features_are_twenty(spark):
    df = spark.createDataFrame([("s", 1, 30, 1, 0, 170.0, 50.0, 25.0)], readers.attributes_schema())
    row = att.attribute_features(df).first().asDict()
    assert len(row) == 21 and row["arm_ratio"] == 0.5 and row["age_group_adult"] == 1 and row["height_cat_average"] == 1


def test_mirroring_twice_is_identity(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0, 5.0), (1, 1.0, 2.0, 3.0, 4.0, 5.0)],
                               "handedness int, acc_y double, acc_z double, rot_y double, rot_z double, tof_1_v0 double")
    for f in (mirror_left, mirror_left_v2):
        assert sorted(f(f(df)).collect()) == sorted(df.collect())
    assert [r["tof_1_v0"] for r in mirror_left_v2(df).orderBy("handedness").collect()] == [-5.0, 5.0]


def test_non_finite_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.0,)], "v double")
    assert [r[0] for r in clean.replace_non_finite(df, ["v"]).collect()] == [0.0, 1.0, -1.0, 0.0, 2.0]
    assert [r[0] for r in readers.nan_to_null(df).collect()][0] is None


def test_pixel_grid(spark):
    df = spark.createDataFrame([(1.0, -1.0, None, 4.0)], "tof_2_v0 double, tof_2_v1 double, tof_2_v2 double, tof_2_v3 double")
    assert ch.pixel_grid(df, fill=9.0).first()["frame"] == [[[1.0, 9.0], [None, 4.0]]]
    with pytest.raises(ValueError):
        ch.pixel_grid(df.toDF("a", "b", "c", "d"))


def test_332_channels():
    assert len(readers.sensor_channels()) == 332 and len(readers.readings_schema()) == 341


def score(spark, pairs):
    return ev.contest_score(spark.createDataFrame(pairs, "t string, p string"), "t", "p").first()


def test_contest_score(spark):
    a, b = TARGET_GESTURES[:2]
    x, y = OTHER_GESTURES[:2]
    got = score(spark, [(a, a), (a, b), (b, x), (x, y), (y, y)])
    assert np.isclose(got["binary_f1"], 4 / 5)
    assert np.isclose(got["macro_f1"], (2 / 3 + 0 + 4 / 5) / 3)
    assert np.isclose(got["accuracy"], 2 / 5) and np.isclose(got["score"], (got["binary_f1"] + got["macro_f1"]) / 2)


def test_one_sided_labels_score_zero(spark):
    a, b = TARGET_GESTURES[:2]
    assert score(spark, [(a, a), (b, b)])["binary_f1"] == 0.0


def test_vote_takes_the_lowest_class_on_ties(spark):
    df = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (1, 9, 0.1)], "k long, class int, probability double")
    assert ev.vote(df, ["k"]).first()["class"] == 2


def test_folds_and_splits(spark, mode):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), (F.col("id") % 40).alias("g"))
    sizes = tf.stratified_folds(df, "label", ["id"], 5).groupBy("label", "fold").count().toPandas()
    assert (sizes.groupby("label")["count"].max() - sizes.groupby("label")["count"].min() <= 1).all()
    groups = tf.with_group_folds(df, "g", ["id"], 4).groupBy("g").agg(F.count_distinct("fold").alias("n"), F.count("*").alias("c"))
    assert groups.agg(F.max("n"), F.sum("c")).first() == (1, 500)
    parts = tf.stratified_split(df, "label", ["id"]).groupBy("part").count().toPandas().set_index("part")["count"]
    assert parts.to_dict() == {"test": 100, "valid": 80, "train": 320}
    again = tf.stratified_split(df.repartition(7), "label", ["id"])
    assert again.exceptAll(tf.stratified_split(df, "label", ["id"])).isEmpty()


def test_violations(spark):
    want = spark.createDataFrame([(i,) for i in range(4)], "id long")
    allowed = spark.createDataFrame([("x",)], "g string")
    got = spark.createDataFrame([(0, "x"), (1, None), (2, "bad"), (2, "x"), (9, "x")], "id long, g string")
    found = {(r["id"], r["reason"]) for r in ev.violations(want, got, "id", "g", allowed).collect()}
    assert found == {(3, "missing"), (9, "unexpected"), (2, "repeated"), (1, "null label"), (2, "unknown label")}


def test_many_channel_correlations_match_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 26)) + 1000
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = 7.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(26)])
    df = readers.nan_to_null(spark.createDataFrame(pdf)).repartition(5)
    got = profile.correlations(df, list(pdf.columns)).toPandas().pivot(index="channel_a", columns="channel_b", values="r")
    want = pdf.corr()
    for a in pdf.columns:
        for b in pdf.columns:
            if a != b:
                r, w = got.loc[a, b], want.loc[a, b]
                assert (np.isnan(r) and (np.isnan(w) or "c3" in (a, b))) or np.isclose(r, w)


def test_constant_channel_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert all(r["r"] is None for r in profile.correlations(df, ["a", "b"]).collect())


def test_histogram_matches_numpy(spark):
    v = np.random.default_rng(0).normal(size=1000)
    got = profile.histogram(spark.createDataFrame(pd.DataFrame({"v": v})), "v", 20).toPandas()
    want = np.histogram(v, 20)[0]
    assert got.set_index("bin")["n"].to_dict() == {i: n for i, n in enumerate(want) if n}


def test_scaler_keeps_constants_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = tf.apply_scaler(df, tf.fit_scaler(df, ["a", "b"]), ["a", "b"]).collect()
    assert [r["a"] for r in got] == [-1.0, 1.0, None] and [r["b"] for r in got] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("shape", [(8, 4), (8, 3), (8, 8), (16, 5)])
def test_scaler_from_readings_equals_scaler_from_windows(spark, mode, shape):
    rng = np.random.default_rng(0)
    rows = [(k, i, float(rng.normal() + 100)) for k, n in enumerate([2, 5, 7, 8, 9, 30, 61]) for i in range(n)]
    raw = spark.createDataFrame(rows, "key long, at long, v double")
    placed = with_positions(raw, ["key"], ["at"], length="seq_len", keep_slices=True)
    windows = sliding_windows(placed, ["key"], ["v"], shape, min_length=3)
    a = tf.fit_window_scaler(windows, ["v"]).first()
    b = tf.fit_reading_scaler(placed, ["v"], *shape, 3).first()
    assert np.allclose(list(a), list(b), rtol=1e-9)


def test_anova_matches_the_formula(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"f": rng.normal(size=90) + 50, "label": np.repeat([0, 1, 2], 30)})
    got = tf.anova_scores(spark.createDataFrame(pdf), ["f"], "label").first()["f_score"]
    groups = [g["f"].to_numpy() for _, g in pdf.groupby("label")]
    between = sum(len(g) * (g.mean() - pdf["f"].mean()) ** 2 for g in groups) / 2
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 87
    assert np.isclose(got, between / within)


def test_components_are_centred_and_uncorrelated(spark):
    x = np.random.default_rng(0).normal(size=(200, 4)) @ np.diag([5, 3, 1, 0.1]) + 10
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(id=range(200)))
    scores, model = models.principal_components(df, list("abcd"), 3, ["id"])
    got = scores.toPandas()[["pc1", "pc2", "pc3"]].to_numpy()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(got.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(np.var(got, axis=0, ddof=1), values[:3])
    assert np.allclose(model.explainedVariance.toArray(), values[:3] / values.sum())


def test_variants_learn_from_training_rows_only(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3)) @ np.diag([4, 2, 1]) + 5
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=range(120), g=["u", "v"] * 60)
    train, held = spark.createDataFrame(pdf[:90]), spark.createDataFrame(pdf[90:])
    variants = models.feature_variants(train, list("abc"), "g", ["id", "g"], 2)
    apply, names = variants["pca"]
    got = apply(held).orderBy("id").toPandas()[names].to_numpy()
    axes = np.linalg.eigh(np.cov(x[:90].T))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs((x[90:] - x[:90].mean(axis=0)) @ axes))
    assert len(variants["polynomial"][1]) == len(models.feature_variants(train, list("abc"), "g", ["id", "g"], 2, most=2)["polynomial"][1]) + 4
    scores = models.compare_variants(train, list("abc"), "g", ["id"], 2, folds=2, trees=3, depth=3).collect()
    assert [r.variant for r in scores if r.best] == [min(scores, key=lambda r: (-r.macro_f1, r.variant)).variant]
    name, _, applied = models.best_variant_applied(train, held, list("abc"), "g", ["id"], 2, folds=2, trees=3, depth=3)
    assert name in variants and applied.count() == 30


def test_salted_join_equals_plain_join(spark, mode):
    left = spark.range(300).select("id", F.when(F.col("id") < 150, 1).otherwise(F.col("id") % 9).alias("k"))
    right = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "k long, name string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = salted_join(left, right, ["k"], ["id"], how)
        want = left.join(right, "k", how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_guarded_table_follows_its_source(spark):
    folder, built = scratch_path(spark, "test-guard"), []
    source = spark.range(10)

    def build(df):
        built.append(1)
        return df.withColumn("x", F.col("id") * 2)

    for df in (source, source.repartition(3), spark.range(11)):
        got = writers.rebuilt_if_changed(spark, df, build, folder)
        assert got.count() == df.count()
    assert len(built) == 2
    other = writers.rebuilt_if_changed(spark, source, lambda df: df.withColumn("y", F.lit(1)), folder)
    assert other.columns == ["id", "y"]


def test_correlation_is_the_same_on_both_paths(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    rows = [[float(v) for v in r] for r in x]
    rows[3][0], rows[4][1], rows[5][2], rows[6][3] = float("nan"), float("inf"), None, float("-inf")
    for r in rows:
        r[3] = 7.0 if r[3] not in (float("-inf"),) else r[3]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    few = {(r.channel_a, r.channel_b): r.r for r in profile.correlations(df, list("abcd")).collect()}
    monkeypatch.setattr(profile, "WIDE_PAIRS", 0)
    many = {(r.channel_a, r.channel_b): r.r for r in profile.correlations(df, list("abcd")).collect()}
    assert few.keys() == many.keys()
    for pair, r in few.items():
        assert (r is None and many[pair] is None) or np.isclose(r, many[pair])
    both = np.array([[r[0], r[1]] for r in rows if np.isfinite(r[0]) and np.isfinite(r[1])])
    assert np.isclose(few["a", "b"], np.corrcoef(both.T)[0, 1]) and few["a", "d"] is None


def test_window_checks_see_broken_sets(spark):
    whole = [("c", k, [1.0, 2.0], [3.0, 4.0], "x", 1.0) for k in range(3)]
    schema = "window_config string, id long, a array<double>, b array<double>, g string, age double"
    flaws = [(1, None), (2, [1.0]), (1, [1.0, None]), (3, None), (4, None), (5, None)]

    def consistent(rows, **kw):
        df = spark.createDataFrame(rows, schema)
        return readers.window_integrity(df, ["id"], ["a", "b"], ["g"], ["age"], **kw).first()

    assert consistent(whole).consistent and consistent(whole, width=2).consistent
    assert not consistent(whole, width=3).consistent
    for at, value in flaws:
        bad = list(whole[1])
        if at == 3:
            bad[4] = None
        elif at == 4:
            bad[5] = None
        elif at == 5:
            bad[1] = 0
        else:
            bad[at + 1] = value
        assert not consistent([whole[0], tuple(bad), whole[2]]).consistent


def test_spectrum_of_long_sequences(spark):
    from seqweft.operators.spectrum import long_amplitudes

    rng, rows, want = np.random.default_rng(1), [], {}
    for k, n in (("a", 1), ("b", 2), ("c", 17), ("d", 997), ("e", 1024)):
        x = rng.normal(size=n)
        rows += [(k, i, float(v) if i != 3 else None) for i, v in enumerate(x)]
        want[k] = np.abs(np.fft.fft(np.where(np.arange(n) == 3, 0, x)))[: n // 2]
    got = long_amplitudes(spark.createDataFrame(rows, "k string, pos long, v double"), ["k"], "v").toPandas()
    for k, amplitudes in want.items():
        assert np.allclose(got[got.k == k].sort_values("bin").amplitude, amplitudes)


def test_history_layouts(spark):
    import json
    import pathlib
    import tempfile

    folder = pathlib.Path(tempfile.mkdtemp())
    (folder / "a.json").write_text(json.dumps({"run": "a", "training_metrics": {"loss": [3, 2], "val_loss": [4, 5]}}, indent=1))
    (folder / "b.json").write_text(json.dumps({"run": "b", "loss": [1.5], "val_loss": [2.5]}, indent=1))
    rows = readers.read_histories(spark, str(folder)).orderBy("run", "epoch").collect()
    assert [tuple(r) for r in rows] == [("a", 1, 3.0, 4.0), ("a", 2, 2.0, 5.0), ("b", 1, 1.5, 2.5)]


@pytest.mark.parametrize("groups,hot", [(3, None), (40, None), (40, "20")])
def test_grouped_many_channel_correlations_match_pandas(spark, monkeypatch, groups, hot):
    """Groups with many rows keep their rows where they are, small ones are brought together, hot ones cut."""
    monkeypatch.setattr(profile, "WIDE_PAIRS", 0)
    rng = np.random.default_rng(groups)
    x = rng.normal(size=(1500, 5)) + 100
    x[rng.random(x.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcde"))
    pdf["g"] = [None if g == 1 else str(g) for g in rng.integers(0, groups, len(pdf))]
    pdf.loc[pdf.g == "2", "c"] = 99.0
    df = readers.nan_to_null(spark.createDataFrame(pdf)).repartition(6)
    if hot:
        spark.conf.set("spark.seqweft.hotRows", hot)
    try:
        got = {(r.g, r.channel_a, r.channel_b): r.r for r in profile.correlations(df, list("abcde"), ["g"]).collect()}
    finally:
        spark.conf.unset("spark.seqweft.hotRows")
    assert len(got) == groups * 20
    for g, part in pdf.groupby("g", dropna=False):
        want = part[list("abcde")].corr()
        for a in "abcde":
            for b in "abcde":
                if a != b:
                    r, w = got[g if isinstance(g, str) else None, a, b], want.loc[a, b]
                    assert (r is None and (np.isnan(w) or "c" in (a, b))) or np.isclose(r, w)
