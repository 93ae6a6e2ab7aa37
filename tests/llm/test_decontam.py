import random

import numpy as np
import pytest

from seqweft.llm.decontam import common_length, contaminated, latent_terms, places, without_leaks, words_of
from tests.llm.helpers import docs

ITEMS = "item_id long, text string"


def word(rng):
    return "".join(rng.choice("abcdefghijklmn") for _ in range(rng.randrange(2, 6)))


def corpus():
    rng = random.Random(12)
    common = [word(rng) for _ in range(60)]
    pick = lambda n: [rng.choice(common) if rng.random() < 0.6 else word(rng) for _ in range(n)]
    items = [(k, " ".join(pick(rng.randrange(15, 60))).capitalize() + ".") for k in range(30)]
    rows, planted = [], set()
    for i in range(150):
        text = pick(rng.randrange(20, 400))
        if i % 5 == 0:
            k = rng.randrange(30)
            own = items[k][1].split()
            if i % 10 == 0:
                for _ in range(len(own) // 6):
                    own[rng.randrange(len(own))] = word(rng)
            at = rng.randrange(len(text))
            text[at:at] = own
            planted.add((i, k))
        rows.append((i, " ".join(text)))
    return items, rows, planted


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(best[j] + 1 if x == y else max(best[j + 1], new[j]))
        best = new
    return best[-1]


def test_planted_and_paraphrased_items_are_found_and_no_others(spark):
    items, rows, planted = corpus()
    got = contaminated(docs(spark, [(i, t, None, None) for i, t in rows]), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    texts, benchmark = dict(rows), dict(items)
    for r in got:
        window = words_of(texts[r.doc_id])[r.first_word : r.last_word]
        assert abs(r.covered - lcs(words_of(benchmark[r.item_id]), window) / len(words_of(benchmark[r.item_id]))) < 1e-9


def test_common_length_equals_the_table_form():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(1, 8, rng.integers(1, 30)), rng.integers(0, 8, rng.integers(0, 60))
        assert common_length(places(a), len(a), b) == lcs(a.tolist(), b.tolist())


def test_latent_space_is_that_of_the_whole_matrix(spark):
    rng = np.random.default_rng(4)
    low = rng.random((30, 3)) @ rng.random((3, 25))
    texts = [np.repeat(np.arange(1, 26), np.minimum(2, np.round(r)).astype(int))[:64].astype("<i4").tobytes() for r in low]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "key long, ids binary").repartition(3)
    vectors, weights = latent_terms(df, 26, 5, rounds=12)
    a = np.stack([np.bincount(np.frombuffer(t, "<i4"), minlength=26) for t in texts]) * weights
    right = np.linalg.svd(a)[2][:5].T
    basis = np.divide(vectors, weights[:, None], out=np.zeros_like(vectors), where=weights[:, None] > 0)
    assert np.linalg.norm(right[:, :3] - basis @ (basis.T @ right[:, :3])) < 0.05


def test_every_passage_has_a_part_in_the_space(spark):
    # More passages than a sample of 2^18 of the smallest hashes would take; words 5 and 6 stand in those of the largest ones.
    many = spark.range(1 << 19).selectExpr("id AS key", "IF(id % 2 = 0, X'0100000002000000', X'0300000004000000') AS ids")
    few = spark.range(1 << 20, (1 << 20) + 40).selectExpr("id AS key", "X'0500000006000000' AS ids").where(f"xxhash64(key, ids) > {1 << 62}")
    assert few.count() > 2
    vectors, weights = latent_terms(many.union(few), 7, 4)
    assert (weights[1:] > 0).all() and (np.linalg.norm(vectors[1:], axis=1) > 0.5 * weights[1:]).all()


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    items, rows, planted = corpus()
    i, k = sorted(planted)[1]
    text = dict(rows)[i]
    some = [(i, text, None, None), (i, text, None, None), (None, text, None, None), (500, None, None, None), (501, "", None, None), (502, " ,;", None, None)]
    df = docs(spark, [*[(1000 + j, t, None, None) for j, t in rows if (j % 5)], *some]).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "cosine")
    odd = spark.createDataFrame([*items, (None, items[0][1]), (900, None), (901, " .")], ITEMS)
    got = contaminated(df, odd).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(i, k), (i, k), (None, k)], key=str)
    assert contaminated(df, odd.limit(0)).count() == 0 and contaminated(df.limit(0), odd).count() == 0
    kept = without_leaks(df, odd)
    assert kept.columns == df.columns and kept.count() == df.count() - 2


@pytest.mark.parametrize("block", [400_000, 900])
def test_a_long_item_is_searched_in_pieces(spark, monkeypatch, block):
    import seqweft.llm.decontam as module

    monkeypatch.setattr(module, "LONGEST", 40)
    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(6)
    item = [word(rng) + str(i) for i in range(450)]
    other = [word(rng) for _ in range(300)]
    rows = [(1, other[:100] + item[200:290] + other[100:]), (2, other), (3, item), (4, other[:50] + item[:12] + other[50:])]
    got = contaminated(docs(spark, [(i, " ".join(t), None, None) for i, t in rows]), spark.createDataFrame([(7, " ".join(item)), (8, "unheard of words here")], ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (3, 7)]
    assert all(r.covered > 0.95 for r in got)


def test_the_space_decides_on_paraphrases():
    from seqweft.llm.decontam import Search

    rng = np.random.default_rng(9)
    terms = 2000
    items = [rng.choice(np.arange(1, terms), 40, replace=False) for _ in range(60)]
    weights = np.r_[0, rng.random(terms - 1) + 0.5]
    texts = []
    for item in items:
        said = item.copy()
        said[rng.choice(40, 12, replace=False)] = 0
        beside = np.where(rng.random(48) < 0.5, rng.integers(1, terms, 48), 0)
        texts.append(np.concatenate([beside[:24], said, beside[24:]]).astype("<i4"))
    found = lambda vectors, cosine: sum(k in {h[0] for h in hits} for k, hits in enumerate(Search(list(range(60)), items, vectors, weights, cosine, 0.6, 0.5).hits(texts)))
    good = (rng.standard_normal((terms, 96)) * weights[:, None] / 10).astype(np.float32)
    # A space that knows a few words beside the items only.
    wrong = np.zeros((terms, 96), np.float32)
    wrong[[t for t in range(terms) if not any(t in i for i in items)]] = 1
    assert found(good, None) >= 55 and found(good, 0.3) >= found(good, None) - 1
    assert found(wrong, 0.3) < 10


def test_no_copy_is_lost_to_the_words_beside_it():
    from seqweft.llm.decontam import Search

    rng = np.random.default_rng(8)
    items = [rng.integers(1, 400, n) for n in rng.integers(15, 60, 40)]
    weights = np.r_[0, rng.random(399) + 0.5]
    # A space in which a few loud words outside the items turn every window away.
    vectors = (rng.standard_normal((400, 2)) * 0.01).astype(np.float32)
    loud = [w for w in range(1, 400) if w % 7 == 0]
    vectors[loud] = [9, 9]
    items = [np.where(i % 7 == 0, 1, i) for i in items]
    docs = []
    for item in items:
        text = rng.choice(loud, 60).astype("<i4")
        docs.append(np.concatenate([text[:30], item, text[30:]]).astype("<i4"))
    search = Search(list(range(40)), items, vectors, weights, None, 0.6, 0.5)
    for k, (found, item) in enumerate(zip(search.hits(docs), items, strict=True)):
        got = {h[0]: h[2] for h in found}
        assert got.get(k, 0) >= 1 - 8 / len(item) and k in got
    # With a cosine, windows with words enough for a copy are looked at all the same.
    gated = Search(list(range(40)), items, vectors, weights, 0.99, 0.6, 0.5)
    assert all(k in {h[0] for h in found} for k, found in enumerate(gated.hits(docs)))


def test_a_large_benchmark_is_searched_in_blocks(spark, monkeypatch):
    import seqweft.llm.decontam as module

    items, rows, planted = corpus()
    monkeypatch.setattr(module, "BLOCK", sum(len(t) for _, t in items) // 3)
    got = contaminated(docs(spark, [(i, t, None, None) for i, t in rows]), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(planted)
