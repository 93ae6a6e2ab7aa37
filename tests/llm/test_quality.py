import random
import re

import numpy as np

from seqweft.llm.quality import STATISTICS, concentrated, consistency, text_statistics, with_verdicts
from tests.llm.helpers import docs


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_equal_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bé", "#", " ", " ", "\n", "\t", "x y z a b c d e ", "漢", "\x0b", "\xa0", "same line\n"]) for _ in range(rng.choice((0, 4, 40, 160))))
        assert text_statistics(text) == brute(text), text
    assert text_statistics(None) == (0, 0, 0, 0, 0)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_outliers_go_and_ordinary_texts_stay(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(60, 400)), "en", f"s{i % 2}") for i in range(600)]
    odd = [(1000 + i, " ".join("#*%$&|<>" * 3 + w for w in prose(rng, 200).split()), "en", "s0") for i in range(20)]
    short = [(2000, "too short", "en", "s0"), (2001, None, None, None), (2002, "same words again and again here now " * 30, "en", "s1")]
    got = {r.doc_id: r for r in with_verdicts(docs(spark, rows + odd + short)).collect()}
    assert sum(got[i].kept for i, *_ in rows) >= 598
    assert not any(got[i].kept for i, *_ in odd + short)
    assert all(got[i].base_failed for i, *_ in short) and not any(got[i].base_failed for i, *_ in odd)


def test_estimate_equals_numpy_steps(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.multivariate_normal([0, 5], [[1, 0.6], [0.6, 2]], 900), rng.normal(30, 1, (100, 2))])
    df = spark.createDataFrame([("c", *map(float, r)) for r in x], "cell string, a double, b double")
    shape = np.array(concentrated(df, ["a", "b"], [0.01, 0.01], steps=6).first()["shape"])
    white = np.zeros((2, 2))
    white[np.tril_indices(2)] = shape[2:]
    cov = np.linalg.inv(white.T @ white)
    assert np.abs(shape[:2] - [0, 5]).max() < 0.2 and np.abs(cov - [[1, 0.6], [0.6, 2]]).max() < 0.35
    assert 1.5 < consistency(0.75, 2) < 2.5


def test_small_cells_nulls_repeats_and_clashing_columns(spark):
    text = prose(random.Random(1), 50)
    rows = [(1, text, None, None), (1, text, None, None), (None, text, "en", None), (2, "", "en", "s")]
    df = docs(spark, rows).withColumnRenamed("n_chars", "kept")
    got = with_verdicts(df).collect()
    assert sorted((r.doc_id or 0, r.kept, r.distance) for r in got) == [(0, True, None), (1, True, None), (1, True, None), (2, False, None)]
    assert set(STATISTICS) < set(with_verdicts(df).columns) and with_verdicts(df.limit(0)).count() == 0
