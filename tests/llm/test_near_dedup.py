import random

import numpy as np
import pytest

from seqweft.llm.components import components
from seqweft.llm.near_dedup import BLOCK, least_matches, near_duplicates, one_of_each, overlaps, shingles, signature
from tests.llm.helpers import docs


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def brute(rows, n, percent):
    ids = sorted({i for i, t in rows if i is not None})
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def shingled(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").replace("\x0b", " ").split()]
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = [(i, shingled(t)) for i, t in rows if i is not None]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                a_, b_ = find(a), find(b)
                up[max(a_, b_)] = min(a_, b_)
    return {i: (len(s), find(i)) for i, s in sets}


def made_rows():
    rng = random.Random(3)
    rows = []
    for _ in range(40):
        base = words(rng, rng.randrange(5, 120))
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy).capitalize())
    rows += [rows[0]] * 30 + [None, "", " \t\n", "one", "ONE", "two words", "Two  words"]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, n, percent):
    rows = made_rows()
    got = near_duplicates(docs(spark, [(i, t, None, None) for i, t in rows]), words=n, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_family_of_several_blocks_is_whole(spark):
    """Copies that each differ by one word hang together through a list longer than a block."""
    rng = random.Random(5)
    base = words(rng, 80)
    rows = []
    for i in range(BLOCK + 150):
        copy = list(base)
        copy[rng.randrange(80)] = f"y{i}"
        rows.append((i, " ".join(copy), None, None))
    got = near_duplicates(docs(spark, rows)).collect()
    want = brute([r[:2] for r in rows], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_nulls_repeats_and_foreign_columns(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A B C D E"), (2, "something else altogether here"), (3, None)]
    df = docs(spark, [(i, t, None, None) for i, t in rows]).withColumnRenamed("lang", "key").withColumnRenamed("source", "sig")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (2, 2, 2, True), (3, 0, 3, True)], key=str)


def test_one_id_on_two_texts_with_common_long_lists(spark):
    """Both texts of the id stand in lists of more than LONG classes; each is judged by itself."""
    rng = random.Random(9)
    base, alone = words(rng, 120), words(rng, 90)
    rows = []
    for i in range(90):
        copy = list(base)
        copy[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    rows += [(0, " ".join([*base[:100], "other", *base[101:]])), (40, " ".join(alone)), (50, " ".join(base)), (50, " ".join(base))]
    df = docs(spark, [(i, t, None, None) for i, t in rows])
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, 40 if t == " ".join(alone) else 0) for i, t in rows)
    kept = one_of_each(df, words=3, percent=85)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([rows[0], rows[90], (40, " ".join(alone))])


def test_empty_table_and_one_of_each(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, "en", "a"), (4, text.upper(), "en", "b"), (9, "another text of its own with words", None, None), (None, text, None, None)]
    kept = one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(kept.select("doc_id").collect(), key=str) == sorted([(4,), (9,), (None,)], key=str)


def test_signature_agreement_estimates_similarity():
    a, b = (shingles(" ".join(f"w{i}" for i in range(k, k + 4000)), 3) for k in (0, 400))
    share = np.mean(signature(a) == signature(b))
    assert abs(share - 3598 / 4398) < 0.25 and len(signature(a)) == 32
    assert 1 <= least_matches(80) <= least_matches(85) <= 32


def test_overlaps_equal_set_sizes():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 40, 80, 3)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = overlaps(sets)
    assert all(got[i][j] == want[i][j] for i in range(5) for j in range(5) if i != j)


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (201, 200), (200, 201), (202, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
