import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqweft.operators import profile, quantiles
from seqweft.operators.quantiles import channel_quantiles

PROBS = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}


def frame(n=20_000):
    rng = np.random.default_rng(0)
    return pd.DataFrame(
        {
            "k": rng.choice(["a", "b", None, "c"], n, p=[0.7, 0.2, 0.05, 0.05]),
            "u": np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n)),
            "v": rng.integers(0, 4, n).astype(float),
            "w": np.where(rng.random(n) < 0.5, 0.0, rng.exponential(size=n)),
        }
    )


def wanted(pdf, by):
    groups = pdf.groupby("k", dropna=False) if by else [("", pdf)]
    out = {}
    for key, g in groups:
        for c in "uvw":
            x = g[c].dropna()
            out[key if isinstance(key, str) else None, c] = [x.mean(), *np.quantile(x, list(PROBS.values()))]
    return out


@pytest.mark.parametrize("wide", [1, 16])
@pytest.mark.parametrize("hot,gathered", [(None, 1 << 20), ("3000", 1 << 20), ("3000", 60), ("7", 1 << 20)])
def test_equals_numpy(spark, monkeypatch, hot, gathered, wide):
    """Gathered, bracketed, and bracketed with more values inside than one row should hold; null is a key."""
    monkeypatch.setattr(quantiles, "GATHERED", gathered)
    monkeypatch.setattr(quantiles, "WIDE", wide)
    pdf = frame()
    df = spark.createDataFrame(pdf).repartition(5).withColumn("u", F.when(~F.isnan("u"), F.col("u")))
    if hot:
        spark.conf.set("spark.seqweft.hotRows", hot)
    try:
        for by in (["k"], []):
            want = wanted(pdf, by)
            got = {(r.k if by else "", r.channel): [r.mean, *[r[p] for p in PROBS]] for r in channel_quantiles(df, by, ["u", "v", "w"], PROBS, {"mean": F.avg}).collect()}
            assert set(got) == set(want)
            for key in want:
                assert got[key] == pytest.approx(want[key], abs=1e-12), key
    finally:
        spark.conf.unset("spark.seqweft.hotRows")


def test_a_bracket_that_misses_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH", 8)
    monkeypatch.setattr(quantiles, "MARGIN", 1e-9)
    spark.conf.set("spark.seqweft.hotRows", "1000")
    try:
        pdf = frame()
        got = {r.channel: r.mid for r in channel_quantiles(spark.createDataFrame(pdf).repartition(3), [], ["v", "w"], {"mid": 0.31}).collect()}
        assert got == pytest.approx({c: np.quantile(pdf[c], 0.31) for c in "vw"}, abs=1e-12)
    finally:
        spark.conf.unset("spark.seqweft.hotRows")


def test_few_rows_leave_a_bulk_key(spark):
    """What leaves the tasks for a bracketed table is the inside of the brackets, not its rows."""
    spark.conf.set("spark.seqweft.hotRows", "1000")
    try:
        n = 200_000
        df = spark.range(n).select((F.xxhash64("id") / 1e12).alias("v"))
        middle = channel_quantiles(df, [], ["v"], {"mid": 0.5}).first().mid
        assert middle == pytest.approx(np.median(df.toPandas().v), rel=1e-12)
        folder = quantiles.stored(spark.range(1), "where").inputFiles()[0].split("/where-")[0]
        import glob

        newest = max(glob.glob(folder.removeprefix("file://").removeprefix("file:") + "/brackets-*"), key=lambda p: __import__("os").path.getmtime(p))
        kept = spark.read.parquet(newest).agg(F.sum(F.size("within"))).first()[0]
        assert 0 < kept < 0.03 * n
    finally:
        spark.conf.unset("spark.seqweft.hotRows")


def test_odd_values_and_empty_tables(spark):
    rows = [("a", float("nan")), ("a", 1.0), ("a", float("inf")), ("b", None), ("c", float("-inf")), ("c", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for hot in (None, "1"):
        if hot:
            spark.conf.set("spark.seqweft.hotRows", hot)
        got = {r.k: (r.lo, r.hi) for r in channel_quantiles(df, ["k"], ["v"], {"lo": 0.0, "hi": 1.0}).collect()}
        spark.conf.unset("spark.seqweft.hotRows")
        assert got["b"] == (None, None) and got["a"][0] == 1.0 and np.isnan(got["a"][1]) and got["c"][0] == float("-inf")
    assert channel_quantiles(df.limit(0), ["k"], ["v"], {"m": 0.5}).count() == 0
    assert channel_quantiles(df.limit(0), [], ["v"], {"m": 0.5}).count() == 0
    assert profile.outliers(df.limit(0), ["v"]).count() == 0
