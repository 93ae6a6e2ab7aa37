import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.helpers import docs
from pyspark.sql import functions as F

from seqweft.llm import lexical

ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(rows, items, best=50):
    known = [(k, split(t)) for k, t in rows]
    known = [(k, t, Counter(t)) for k, t in known if t]
    n_all, l_all = len(known), sum(len(t) for _, t, _ in known)
    out = []
    for i, text in dict.fromkeys(items):
        if i is None:
            continue
        found = []
        for k, t, c in known:
            m = 100 - 50 + (50 * len(t) * n_all) // l_all
            score = 0
            for term in set(split(text)):
                df = sum(term in x for _, _, x in known)
                if df and c[term]:
                    w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1)))
                    score += w * ((1000000000 * c[term]) // (1000 * c[term] + 20 * m))
            if score > 0 and k is not None:
                found.append((-score, k))
        out += [(i, r + 1, k, -s) for r, (s, k) in enumerate(sorted(found)[:best])]
    return sorted(out)


def texts(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÄPFEL", "naïve", "x1y2", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 200]))) for _ in range(n)]


@pytest.mark.parametrize("best,documents", [(3, 16), (50, 1024)])
def test_equals_brute_force(spark, monkeypatch, best, documents):
    monkeypatch.setattr(lexical, "DOCUMENTS", documents)
    monkeypatch.setattr(lexical, "GROUP_TERMS", 12)
    monkeypatch.setattr(lexical, "LOOKUPS", 50)
    monkeypatch.setattr(lexical, "ROWS_AT_ONCE", 7)
    rng = random.Random(best)
    rows = [(i, t) for i, t in enumerate(texts(rng, 150))]
    rows += [(500 + i, rows[3][1]) for i in range(60)] + [rows[0], (0, "w1 w2"), (None, "w1 w1 w59"), (900, None), (901, ""), (902, "!?"), (903, "w1 " * 5000)]
    items = [(1, rows[3][1]), (2, "W1, w1 w58 naïve"), (2, "w2"), (3, ""), (4, None), (None, "w1"), (5, "unheard"), (6, rows[2][1]), (6, rows[2][1]), (7, "日本-ÄPFEL äpfel")]
    df = docs(spark, [(k, t, "en", "s") for k, t in rows]).withColumn("item_id", F.lit(9)).withColumn("rank", F.lit("x"))
    bench = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(1))
    got = sorted(map(tuple, lexical.ranked(df, bench, best=best).collect()))
    assert got == brute(rows, items, best)


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng, 40)))
    items = [(i, t) for i, t in enumerate(texts(rng, 9))]
    df, bench = docs(spark, [(k, t, "en", "s") for k, t in rows]), spark.createDataFrame(items, ITEMS)
    monkeypatch.setattr(lexical, "ITEM_CHARS", 300)
    assert sorted(map(tuple, lexical.ranked(df, bench, best=4).collect())) == brute(rows, items, 4)
    assert lexical.ranked(df.limit(0), bench).count() == 0
    assert lexical.ranked(df, bench.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.ranked(df, bench.limit(0)).count() == 0


def test_bounds_hold_and_exclude(spark):
    rng = random.Random(3)
    said = [lexical.terms_of(t) for t in texts(rng, 300)]
    vocabulary = {t: n + 1 for n, t in enumerate(sorted({x for s in said for x in s}))}
    df = Counter(x for s in said for x in set(s))
    weights = np.array([0, *[math.floor(1000 * math.log((2 * len(said) + 2) / (2 * df[t] + 1))) for t in sorted(vocabulary)]])
    hashes = np.concatenate([np.zeros(1, np.uint64), lexical.hashes_of(sorted(vocabulary))])
    items = [np.array(sorted({vocabulary[x] for x in s})) for s in said[:30]]
    search = lexical.Search(items, weights, hashes, len(said), sum(map(len, said)), 5)
    shelf = lexical.Shelf(1 << 12)
    for k, s in enumerate(said):
        c = Counter(s)
        shelf.add(k, len(s), lexical.hashes_of(c), np.array(list(c.values())), np.array([vocabulary[t] for t in c]))
    block = lexical.Block(type("Row", (), dict(zip(lexical.NAMES, shelf.block(), strict=True))), search)
    pairs = np.array([(i, d) for i in range(30) for d in range(block.n)])
    exact = search.exact(block, pairs[:, 0], pairs[:, 1]).reshape(30, -1)
    terms, table = search.tables[0]
    most = search.bounds(block, terms, table)
    assert (most >= exact).all()
    fifth = np.sort(exact, axis=1)[:, -5]
    assert (most < fifth[:, None]).mean() > 0.5  # most documents are proven not to be among the best
