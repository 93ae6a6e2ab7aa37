import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqweft.operators import clean, sequences
from seqweft.operators.ordered import (
    SLICES,
    exact_quantiles,
    has_hot_key,
    slice_hot_keys,
    with_lag,
    with_positions,
    with_sequence_mean,
)


def random_rows(seed=1, n=400):
    """One key holds over a third of the rows, and its order is full of ties."""
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "key": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 12, n)),
            "at": np.where(rng.random(n) < 0.5, 5, rng.integers(0, 50, n)),
            "id": rng.permutation(n),
            "name": [f"SEQ_{i:06d}" for i in rng.permutation(n)],
            "v": np.round(rng.normal(size=n), 2),
        }
    )


def readings(spark, lists, hot=None):
    rows = [(k, i, None if v is None else float(v)) for k, vs in lists.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "key long, at long, v double")
    return with_positions(df, ["key"], ["at"], length="seq_len", keep_slices=True)


def as_lists(df, column, keys=("key",)):
    out = df.orderBy(*keys, "pos").select(*keys, column).collect()
    got = {}
    for r in out:
        got.setdefault(r[0], []).append(r[1])
    return got


@pytest.mark.parametrize("order", [["at", "id"], ["name"], ["v", "id"]])
def test_positions_match_a_sort(spark, mode, order):
    pdf = random_rows()
    got = with_positions(spark.createDataFrame(pdf), ["key"], order, length="n").toPandas().set_index("id")
    want = pdf.sort_values(["key", *order])
    want = want.assign(pos=want.groupby("key").cumcount(), n=want.groupby("key")["id"].transform("size")).set_index("id")
    assert (got["pos"] == want["pos"].reindex(got.index)).all()
    assert (got["n"] == want["n"].reindex(got.index)).all()


def test_positions_without_key(spark, mode):
    pdf = random_rows()
    got = with_positions(spark.createDataFrame(pdf), [], ["at", "id"]).orderBy("pos").toPandas()
    assert list(got["pos"]) == list(range(len(pdf)))
    assert list(got["id"]) == list(pdf.sort_values(["at", "id"])["id"])


def test_weighted_positions(spark, mode):
    pdf = random_rows().assign(w=lambda d: d["id"] % 4)
    got = with_positions(spark.createDataFrame(pdf), ["key"], ["at", "id"], weight="w").toPandas().set_index("id")
    want = pdf.sort_values(["key", "at", "id"])
    before = (want.groupby("key")["w"].cumsum() - want["w"]).set_axis(want["id"])
    assert (got["pos"] == before.reindex(got.index)).all()


def test_hot_key_is_cut_into_small_slices(spark):
    spark.conf.set("spark.seqweft.hotRows", "50")
    try:
        df = spark.range(2000).select(F.lit(1).alias("key"), (F.col("id") % 3).alias("tie"), "id")
        assert has_hot_key(df, ["key"])
        for order in (["tie", "id"], ["skewed", "id"]):
            made = df.withColumn("skewed", F.pow(F.lit(1.02), F.least(F.col("id"), F.lit(400))))
            sizes = slice_hot_keys(made, ["key"], order).groupBy(*SLICES).count().toPandas()
            assert sizes["count"].sum() == 2000 and sizes["count"].max() <= 60
    finally:
        spark.conf.unset("spark.seqweft.hotRows")


def test_quantiles_match_numpy(spark, mode):
    pdf = random_rows(2)
    pdf.loc[pdf["id"] % 3 == 0, "v"] = 0.5
    got = exact_quantiles(spark.createDataFrame(pdf), ["key"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}).toPandas()
    for row in got.itertuples():
        want = np.quantile(pdf.loc[pdf["key"] == row.key, "v"], [0.1, 0.5, 0.93])
        assert np.allclose([row.a, row.b, row.c], want, atol=1e-12)


def test_gaps_with_limit_two(spark, mode):
    given = [None] * 4 + [1] + [None] * 6 + [8] + [None] * 4
    got = clean.fill_gaps(readings(spark, {1: given}), ["key"], {"v": 2})
    assert as_lists(got, "v")[1] == [None, None, 1, 1, 1, 2, 3, None, None, 6, 7, 8, 8, 8, None, None]


def test_gaps_at_the_limit_and_all_null(spark, mode):
    lists = {1: [0] + [None] * 3 + [4], 2: [0] + [None] * 7 + [8], 3: [None] * 9}
    got = as_lists(clean.fill_gaps(readings(spark, lists), ["key"], {"v": 3}), "v")
    assert got[1] == [0, 1, 2, 3, 4]
    assert [i for i, x in enumerate(got[2]) if x is None] == [4]
    assert got[3] == [None] * 9


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_cleaning_matches_pandas(spark, mode, limit):
    rng = np.random.default_rng(limit)
    lists = {
        k: [None if rng.random() < 0.55 else round(float(x), 3) for x in rng.normal(size=n)]
        for k, n in enumerate([1, 2, 9, 40, 65])
    }
    df = readings(spark, lists)
    filled = as_lists(clean.fill_gaps(df, ["key"], {"v": limit}), "v")
    carried = as_lists(clean.fill_gaps(df, ["key"], {"v": limit}, then_carry=["v"]), "v")
    plain = as_lists(clean.carry_fill(df, ["key"], ["v"]), "v")
    for k, values in lists.items():
        s = pd.Series(values, dtype="float64")
        want = s.interpolate(method="linear", limit=limit, limit_direction="both")
        for got, expected in ((filled, want), (carried, want.ffill().bfill()), (plain, s.ffill().bfill())):
            assert np.allclose(np.array(got[k], dtype="float64"), expected, equal_nan=True, atol=1e-9)


def test_lag_and_mean(spark, mode):
    lists = {1: list(range(30)), 2: [4, 8], 3: [7]}
    df = readings(spark, lists)
    lag = as_lists(with_lag(df, ["key"], ["v"]), "_lag_v")
    mean = as_lists(with_sequence_mean(df, ["key"], ["v"]), "_mean_v")
    for k, values in lists.items():
        assert lag[k] == [None, *values[:-1]]
        assert np.allclose(mean[k], np.mean(values))


@pytest.mark.parametrize(
    "values, peaks",
    [([1, 3, 3, 2, 5, 4, 4, 6], 2), ([1, 1], 0), ([2, 2, 2], 0), ([1, 2, 1], 1), ([1] + [9] * 30 + [1], 1), ([1, 2] * 20, 19)],
)
def test_peaks(spark, mode, values, peaks):
    got = sequences.mark_peaks(readings(spark, {1: values}), ["key"], "v")
    assert got.where("is_peak").count() == peaks


def test_signal_summary_matches_pandas(spark, mode):
    rng = np.random.default_rng(5)
    values = [float(x) for x in rng.integers(0, 6, 60)]
    got = sequences.signal_summary(readings(spark, {1: values}), ["key"], "v").first()
    s = pd.Series(values)
    signs = np.sign(s - s.mean())
    assert got["zero_crossings"] == int((signs.diff().fillna(0) != 0).sum())
    assert np.isclose(got["diff_std"], s.diff().std()) and np.isclose(got["std_samp"], s.std())
    assert np.isclose(got["energy"], (s**2).sum())


def test_running_best(spark, mode):
    pdf = random_rows(3)
    got = sequences.running_best(spark.createDataFrame(pdf), ["at", "id"], "v").toPandas().sort_values(["at", "id"])
    assert np.allclose(got["best_so_far"], pdf.sort_values(["at", "id"])["v"].cummax())


def test_first_rows(spark):
    pdf = random_rows(4)
    got = sequences.first_rows(spark.createDataFrame(pdf), ["key"], ["at", "id"]).toPandas().sort_values("key")
    want = pdf.sort_values(["key", "at", "id"]).groupby("key").first()
    assert list(got["id"]) == list(want["id"])


def test_slices_follow_a_sort_through_nulls_and_odd_numbers(spark):
    """Positions in sliced mode equal a plain sort for nulls, NaN, infinities, ties and numbers beyond 2^53."""
    nan, inf = float("nan"), float("inf")
    doubles = [None, None, nan, inf, -inf, 0.0, 1.5, 1.5, 2.0, 1e300, -1e300, 3.0] * 3
    longs = [None, 2**60, 2**60 + 1, 2**60 + 2, 5, 7, None, -(2**60), 0, 1, 2, 3] * 3
    rows = [(1, d, n, i) for i, (d, n) in enumerate(zip(doubles, longs))]
    rows += [(2, None if i % 2 else 5.0, 40 - i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, d double, n long, i long")
    for order in (["d", "i"], ["n", "i"], ["d", "n", "i"]):
        plain = with_positions(df, ["k"], order, hot=False).collect()
        spark.conf.set("spark.seqweft.hotRows", "7")
        try:
            sliced = with_positions(df, ["k"], order, hot=True).collect()
        finally:
            spark.conf.unset("spark.seqweft.hotRows")
        assert {(r.k, r.i): r.pos for r in plain} == {(r.k, r.i): r.pos for r in sliced}


def test_microseconds_order_slices(spark):
    from datetime import datetime

    rows = [(1, datetime(2024, 1, 1, 0, 0, 0, 40 - i), i) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, i long")
    spark.conf.set("spark.seqweft.hotRows", "7")
    try:
        got = with_positions(df, ["k"], ["t", "i"], hot=True).collect()
    finally:
        spark.conf.unset("spark.seqweft.hotRows")
    assert all(r.pos == 39 - r.i for r in got)
