import numpy as np
import pytest

from seqweft.operators.transform import neighbour_information


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute(x, y, k=3):
    """The estimator row by row: how far the k-th of the own label is, and how many of all are nearer."""
    rows = [(v, l) for v, l in zip(x, y, strict=True) if v is not None and np.isfinite(v)]
    rows = [(v, l) for v, l in rows if sum(m == l for _, m in rows) > 1]
    terms = []
    for i, (v, l) in enumerate(rows):
        own = sorted(abs(v - w) for j, (w, m) in enumerate(rows) if m == l and j != i)
        near = min(k, len(own))
        d = own[near - 1]
        crowd = sum(abs(v - w) < d if d > 0 else w == v for w, _ in rows)
        terms.append(psi(near) - psi(len(own) + 1) - psi(crowd))
    return max(0.0, psi(len(rows)) + sum(terms) / len(terms))


@pytest.mark.parametrize("hot", [None, "30"])
def test_equals_brute_force(spark, hot):
    rng = np.random.default_rng(6)
    n = 240
    label = rng.choice(["a", "b", "c", "d"], n, p=[0.6, 0.2, 0.19, 0.01]).tolist()
    label[0] = "alone"
    shift = {"a": 0.0, "b": 1.5, "c": 3.0, "d": 0.0, "alone": 0.0}
    u = [float(rng.normal() + shift[l]) for l in label]
    v = [float(rng.integers(0, 5)) for _ in label]  # many ties
    w = [None if rng.random() < 0.2 else float(rng.normal()) for _ in label]
    w[5] = float("inf")
    df = spark.createDataFrame(list(zip(range(n), label, u, v, w, strict=True)), "id long, label string, u double, v double, w double")
    if hot:
        spark.conf.set("spark.seqweft.hotRows", hot)
    try:
        got = {r.feature: r.mi_score for r in neighbour_information(df.repartition(3), ["u", "v", "w"], "label", ["id"]).collect()}
    finally:
        spark.conf.unset("spark.seqweft.hotRows")
    assert got == pytest.approx({"u": brute(u, label), "v": brute(v, label), "w": brute(w, label)}, abs=1e-9)
    assert got["u"] > 0.3
