import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweft.llm import negatives
from seqweft.llm.heaps import Heaps
from seqweft.llm.strassen import multiply

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (64, 64, 64), (65, 33, 97), (100, 64, 130), (0, 4, 3), (2, 0, 3)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    for top in (100, 1 << 30, 1 << 62):
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        assert (multiply(a, b, 4) == a @ b).all()


def test_heaps_keep_the_best_in_any_order():
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 6, (4, 50))
    heaps = Heaps(4, 5)
    ids = rng.permutation(50)
    for at in range(0, 50, 9):
        some = slice(at, at + 9)
        heaps.offer(np.arange(4), scores[:, some], ids[some], np.ones(scores[:, some].shape, bool))
    for r in range(4):
        best = sorted(zip((-scores[r]).tolist(), ids.tolist(), strict=True))[:5]
        own = heaps.row == r
        assert [(-s, i) for s, i in best] == list(zip(heaps.score[own].tolist(), heaps.id[own].tolist(), strict=True))


def brute(rows, every, positives=5, negatives_=3, least=50, most=95):
    known = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v), label)
        if row not in known:
            known.append(row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in known:
        if a[0] % every:
            continue
        same = sorted((-dot(a[1], b[1]), b[0]) for b in known if b is not a and b[2] == a[2])[:positives]
        other = sorted((-dot(a[1], b[1]), b[0]) for b in known if b[2] != a[2])
        for s, p in same:
            fit = [(n, -t) for t, n in other if least * -s <= 100 * -t <= most * -s][:negatives_]
            out += [(a[0], p, r + 1, n, -s, t) for r, (n, t) in enumerate(fit)]
    return sorted(out)


def made(rng, n, labels, width=6):
    return [(i, [rng.uniform(-0.2, 1) for _ in range(width)], rng.choice(labels)) for i in range(n)]


@pytest.mark.parametrize("block", [3, 1024])
@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(negatives, "TILE", 8)
    rng = random.Random(seed)
    rows = made(rng, 120, [0, 0, 0, 1, 2])
    rows += [(200 + i, rows[5][1], rows[5][2]) for i in range(20)]  # ties of one vector
    rows += [rows[0], rows[0], rows[7], (0, rows[3][1], 1)]  # repeats, and an anchor's key with another vector
    rows += [(None, rows[1][1], 1), (300, None, 1), (301, [1.0, None], 1), (310, [float("nan")] * 6, 0), (320, [float("inf")] * 6, 0), (330, rows[1][1], None)]
    rows += [(340, [0.5, 0.5], 0), (341, [], 1)]  # shorter vectors
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("x")).withColumn("ID", F.lit(1))
    got = sorted(map(tuple, negatives.hard_negatives(df, every=10, block=block).collect()))
    assert got == brute(rows, 10) and got


def test_empty_one_label_and_large_numbers(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 0), (1, [1.0], 0)], VECTORS)
    assert negatives.hard_negatives(alone).count() == 0
    huge = spark.createDataFrame([(0, [3e38, 1.0], 0), (1, [3e38, 2.0], 0), (2, [3e38, 1.5], 1)], VECTORS)
    assert negatives.hard_negatives(huge).count() >= 0
