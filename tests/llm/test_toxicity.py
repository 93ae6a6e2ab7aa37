import random

import numpy as np
import pandas as pd
import pytest
from tests.llm.helpers import docs
from pyspark.sql import functions as F

from seqweft.llm import gated, toxicity
from seqweft.llm.toxicity import Cut, Model, learn_and_score, windows_of

LABELS = "doc_id long, quality int, toxic int"


def small_model(hidden=5, wide=3):
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in gated.start(7, 11, 13, wide, hidden, rng).items()}
    return p, rng


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "WIDE", 3)
    p, _ = small_model()
    vocabulary = toxicity.Vocabulary(Cut(["one two three four five six"]).hashes)
    bags = [(Cut(["one two three nine"]), 1), (Cut(["four five"]), 0), (Cut([""]), 0)]
    for c, _ in bags:
        c.grams %= 11
        c.stems %= 13

    class Never:
        def random(self, n):
            return np.ones(n)

    def loss(q):
        total = 0
        for c, label in bags:
            features = np.concatenate([q["word"][vocabulary.numbers(c.hashes)], gated.spelled(q, c.grams, c.stems, c.starts)], axis=1)
            rows = np.concatenate([gated.inputs(q, features), toxicity.nothing(q)])
            _, begin, size = windows_of(c.firsts[:2])
            z = gated.run(q, *toxicity.laid_out(rows, c.words, begin, size)[:2])[0][0]
            total += np.log1p(np.exp(z)) - label * z
        return total / len(bags)

    g = toxicity.gradients(Model(p, vocabulary), bags, Never())
    for name in p:
        flat = p[name].reshape(-1)
        for at in np.random.default_rng(1).integers(0, flat.size, 6):
            if name in ("word", "stem") and at < 3:
                continue  # the vectors of nothing known stay
            step = 1e-3
            keep = flat[at]
            flat[at] = keep + step
            up = loss(p)
            flat[at] = keep - step
            down = loss(p)
            flat[at] = keep
            assert g[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_words_and_windows_cover_whole_texts():
    texts = ["Ab, cd!e", None, "", "ünï x", " ".join(f"w{i}" for i in range(1000))]
    cut = Cut(texts)
    assert np.diff(cut.firsts[:6]).tolist() == [3, 0, 0, 2, 1000]
    assert cut.hashes[cut.words[0]] == Cut(["x ab"]).hashes[Cut(["x ab"]).words[1]]
    assert len(cut.hashes) == 1005 and len(cut.words) == 1005
    owner, begin, size = windows_of(cut.firsts[:6])
    covered = np.zeros(1005, int)
    for o, b, s in zip(owner, begin, size, strict=True):
        covered[b : b + s] += 1
        assert cut.firsts[o] <= b and b + s <= cut.firsts[o + 1]
    assert covered.min() == 1 and sorted(set(owner.tolist())) == [0, 1, 2, 3, 4]


def test_batches_do_not_change_scores():
    p, rng = gated.start(8, toxicity.GRAMS, toxicity.STEMS, toxicity.WIDE, toxicity.HIDDEN, np.random.default_rng(2)), random.Random(1)
    model = Model(p, toxicity.Vocabulary(Cut(["a b c d e f g"]).hashes))
    texts = [" ".join(rng.choices("abcdefghij", k=rng.choice([0, 1, 5, 70, 300]))) for _ in range(40)]
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts], atol=1e-4)


def corpus(rng, n):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "su", "ta") for b in ("n", "ra", "lit", "mor", "des", "pu", "go")]
    bad = ["vile", "rotten", "fool"]
    rows, labels = [], []
    for i in range(n):
        said = rng.choices(words, k=rng.choice([10, 60, 200, 400]))
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            said.insert(rng.randrange(len(said)), rng.choice(bad))
        rows.append((i, " ".join(said), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_from_rows_that_are_not_held_out(spark):
    rows, labels = corpus(random.Random(4), 900)
    rows += [(5000, None, None, None), (5001, "", None, None), (5002, "!!", "en", "s"), (None, "fool fool", "en", "s"), (5003, "kan fool vile rotten", "en", "s"), (5003, "kan", "en", "s")]
    rows += [(5004, "kan lora " * 30000 + "fool vile rotten fool", "en", "s"), (5005, "kan lora " * 30000, "en", "s")]
    labels += [(None, 1, 1), (5000, 1, 1), (0, 1, None), (7777, 1, 1), (1, 1, 0)]
    df = docs(spark, rows).withColumn("score", F.lit("x")).withColumn("HELD_OUT", F.lit("x")).withColumn("label", F.lit(1))
    got = learn_and_score(df, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("")), sample=200).toPandas()
    hold = next(c for c in got.columns if c.startswith("held_out"))
    truth = got.doc_id.map({d: t for d, _, t in labels if t is not None})
    own = got[(got.doc_id < 900) & got[hold]]
    assert len(own) > 100
    assert (own.predicted == truth[own.index]).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    special = got[got.doc_id >= 5000].sort_values(["doc_id", "score"])[["doc_id", "predicted"]].to_numpy().tolist()
    assert special == [[5000, 0], [5001, 0], [5002, 0], [5003, 0], [5003, 1], [5004, 1], [5005, 0]]


def test_nothing_to_learn_from(spark):
    df = docs(spark, [(1, "a", "en", "s"), (2, None, "en", "s")])
    none = learn_and_score(df, spark.createDataFrame([], LABELS)).toPandas()
    assert none.score.tolist() == [0, 0] and none.predicted.tolist() == [0, 0]
    one = learn_and_score(df, spark.createDataFrame([(1, 1, 1)], LABELS)).toPandas()
    assert one.score.tolist() == [0, 0]
    assert learn_and_score(df.limit(0), spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    from seqweft.llm.toxicity_queries import toxicity as query

    got = query(spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet").merge(got, on="doc_id")
    own = labels[labels.held_out]
    assert len(got) == got.doc_id.nunique() and (own.predicted == own.toxic).mean() > 0.95
