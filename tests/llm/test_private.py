import random
import re

import pytest

from seqweft.llm import private, tagger
from tests.llm.helpers import docs

FORMS = {
    0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    2: re.compile(r"[0-9]([\x20-]?[0-9])+"),
    3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def fits(kind, said):
    digits = re.sub("[^0-9]", "", said)
    if kind == 1:
        return all(int(p) <= 255 for p in said.split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and private.luhn(digits)
    return kind == 0 or 10 <= len(digits) <= 15


def brute(text):
    found = [(*m.span(), k) for k, form in FORMS.items() for m in form.finditer(text) if fits(k, m.group())]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@+- ()4%x\n0é") for _ in range(rng.choice((0, 3, 20, 90))))
        assert private.base_spans(text) == brute(text), text
    card = "pay 4111 1111 1111 1111, or +1 (427) 555-5262; é a.b@c.example.com 1.2.3.4.5.6.7.8 1.2.3.256"
    assert private.base_spans(card) == brute(card)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000):
        private.base_spans(text)


@pytest.fixture(scope="module")
def fitted():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["house", "garden", "mail ab.cd.12@mail.example.com", "10.2.33.4", "+1 (427) 555-5262", "version 2.0", "tree"]) for _ in range(60)) for _ in range(60)]
    return tagger.train(*private.labelled_windows(texts, 1200), private.SYMBOLS, private.TAGS, epochs=8)


def test_gradients_are_the_slopes_of_the_likelihood():
    windows, truth = private.labelled_windows(["a b.c@d.org and 10.2.3.4 go"], 16)
    p = tagger.start(private.SYMBOLS, private.TAGS, 4, __import__("numpy").random.default_rng(1))
    _, g = tagger.gradients(p, windows, truth)
    for name in ("xf", "hb", "cf", "out", "bias", "move", "first", "last"):
        at = max(range(g[name].size), key=lambda i: abs(g[name].flat[i]))
        ends = []
        for step in (0.02, -0.02):
            q = {k: v.copy() for k, v in p.items()}
            q[name].flat[at] += step
            ends.append(tagger.gradients(q, windows, truth)[0])
        assert abs((ends[0] - ends[1]) / 0.04 - g[name].flat[at]) < 0.05 * abs(g[name].flat[at]) + 0.02


def test_held_out_spans_are_found(fitted):
    windows, truth = private.labelled_windows(["x"], 400, seed=99)
    found = tagger.best_tags(fitted, windows)
    assert ((found > 0) & (truth > 0)).sum() > 0.85 * (truth > 0).sum()
    assert (found[truth == 0] > 0).mean() < 0.03


def test_added_spans_keep_base_ones_and_cross_windows(fitted):
    texts = ["x" * k + " call (415) 555-2671 or 415-555-2671 now, or ab.cd@mail.example.com." for k in range(0, 64, 7)]
    hits = 0
    for text, tags in zip(texts, private.all_tags(fitted, texts), strict=True):
        base = private.base_spans(text)
        more = private.added_spans(text, tags, base)
        assert [text[a:b] for a, b, _ in base] == ["ab.cd@mail.example.com"]
        assert not any(a < d and c < b for a, b, _ in base for c, d, _ in more)
        hits += sum(text[a:b] in ("(415) 555-2671", "415-555-2671") and k == 3 for a, b, k in more)
    assert hits >= len(texts)


def test_clean_text_gets_no_spans(fitted):
    texts = ["Licensed under version 2.0 on 2024-03-05 at 12:30.", 'token = "9765fab7324201a5ddfac0becd9064abbef40be8" is', "we meet @ noon dot", "12 34 56", ""]
    for text, tags in zip(texts, private.all_tags(fitted, texts), strict=True):
        assert private.added_spans(text, tags, private.base_spans(text)) == []


def test_believable_spans():
    yes = [("bob (at) web dot org", 0), ("10[.]1[.]2[.]3", 1), ("4111.1111.1111.1111", 2), ("(415) 555-2671", 3)]
    no = [("bob at home", 0), ("1.2.3", 1), ("1.2.3.999", 1), ("4111.1111.1111.1112", 2), ("4155552671", 3), ("12 34", 3)]
    assert all(private.believable(s, k) for s, k in yes) and not any(private.believable(s, k) for s, k in no)


def test_table_with_nulls_long_texts_and_clashing_columns(spark, fitted):
    rows = [(None, None, "a", "b"), (1, "", None, None), (2, "x@y.org é +1 (427) 555-5262", "a", "b"), (2, "x@y.org é +1 (427) 555-5262", "a", "b"), (3, "word " * 30_000 + "z@y.org", None, None)]
    df = docs(spark, rows).withColumnRenamed("lang", "base").withColumnRenamed("source", "spans")
    got = private.find_private(df, fitted).collect()
    assert sorted((r.doc_id or 0, r.base) for r in got) == [(0, ""), (1, ""), (2, "email:0:7,phone:10:27"), (2, "email:0:7,phone:10:27"), (3, "email:150000:150007")]
    assert private.find_private(df.limit(0), fitted).count() == 0
    out = private.find_private(df, fitted).select(private.masked(private.F.col("text"), private.F.col("base")).alias("t")).collect()
    assert "[email] é [phone]" in {r.t for r in out}


def test_learning_from_a_table_is_bounded_and_works_without_rows(spark):
    empty = docs(spark, [])
    p = private.learn(empty, "doc_id", "text", written=64)
    assert tagger.best_tags(p, private.cut(private.symbols("abc"), __import__("numpy").array([0]))).shape == (1, private.WINDOW)


def test_every_believable_address_has_a_window_over_it():
    forms = ["john at example.com", "JOHN [AT] EXAMPLE [DOT] COM", "John AT Example . Com", "john {  at  } web.org", "john (at) web[.]org", "john at web DOT org", "john at mail.web.org"]
    for said in forms:
        assert private.believable(said, 0)
        for k in (0, 31, 64, 200):
            text = "x" * k + " " + said + " " + "y" * 100
            starts = private.window_starts(text, len(text))
            seen = {at for s in starts.tolist() for at in range(s + private.STRIDE // 2, s + private.STRIDE // 2 + private.STRIDE)}
            assert {*range(k + 1, k + 1 + len(said))} <= seen, (said, k)
