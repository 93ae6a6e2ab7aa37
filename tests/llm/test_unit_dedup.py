import random

from seqweft.llm.unit_dedup import repeated_runs, spans_of, units_of, without_repeats
from tests.llm.helpers import docs


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n)).capitalize() + "."


def prose(rng, n):
    return " ".join(sentence(rng, rng.randrange(6, 14)) for _ in range(n))


def brute(rows, unit, least):
    places = [(i, k, *u) for i, t in rows for k, u in enumerate(units_of(t or "", unit))]
    first = {}
    for i, k, *_, h1, h2, _again in places:
        first[h1, h2] = min(first.get((h1, h2), (i, k)), (i, k))
    out = []
    for i, t in rows:
        run = None
        for k, (_, a, b, n, h1, h2, _again) in enumerate(units_of(t or "", unit)):
            if first[h1, h2] == (i, k):
                run = None
            elif run is None:
                run = [i, a, b, n]
                out.append(run)
            else:
                run[2], run[3] = b, run[3] + n
    return sorted(tuple(r) for r in out if r[3] >= least)


def corpus():
    rng = random.Random(9)
    passages = [prose(rng, 7) for _ in range(3)]
    rows = []
    for i in range(60):
        text = [prose(rng, 3), "\n", prose(rng, 4)]
        if i % 3 == 0:
            text.insert(rng.randrange(4), f" mid sentence {passages[i % 9 // 3]} and on ")
        rows.append((i, "".join(text)))
    return [*rows, (70, ""), (71, None), (72, passages[0] + " " + passages[0]), (73, "é" * 50_000), (74, "\n\n \n")]


def test_runs_equal_brute_force(spark):
    for unit, least in (("sentence", 25), ("line", 3), ("paragraph", 3)):
        got = repeated_runs(docs(spark, [(i, t, None, None) for i, t in corpus()]), unit=unit, least_words=least)
        assert sorted((r.key, r.start, r.end, r.n_words) for r in got.collect()) == brute(corpus(), unit, least)


def test_planted_passages_are_caught_and_others_left(spark):
    got = {r.key for r in repeated_runs(docs(spark, [(i, t, None, None) for i, t in corpus()])).collect()}
    assert got == {i for i in range(9, 60, 3)} | {72}


def test_offsets_cut_the_original(spark):
    df = docs(spark, [(i, t, None, None) for i, t in corpus()]).withColumnRenamed("lang", "removed").withColumnRenamed("source", "row")
    runs = repeated_runs(df)
    spans = {}
    for r in runs.collect():
        spans.setdefault(r.key, []).append((r.start, r.end))
    for r in without_repeats(df, runs).collect():
        text, whole = dict(corpus())[r.doc_id], []
        at = 0
        for a, b in sorted(spans.get(r.doc_id, [])):
            whole.append(text[at:a])
            at = b
        assert r.text == (None if text is None else "".join([*whole, text[at:]]))
        assert [(s.start, s.end) for s in r.removed] == sorted(spans.get(r.doc_id, []))


def test_units_of_each_kind():
    text = "One two three four five. Six seven\n\n eight nine\nten"
    assert [text[a:b] for a, b in spans_of(text, "line")] == ["One two three four five. Six seven", " eight nine", "ten"]
    assert [text[a:b] for a, b in spans_of(text, "paragraph")] == ["One two three four five. Six seven", " eight nine\nten"]
    assert [text[a:b] for a, b in spans_of(text, "sentence") if a < b] == ["One two three four five.", "Six seven", " eight nine", "ten"]


def test_null_repeated_keys_and_empty_tables(spark):
    line = "this is one long line of words that stands in several of the rows for a test of nulls and of repeated keys in them all"
    rows = [(1, line), (1, line), (None, line), (None, line + "\n" + line), (2, line), (1, line + " with an end\n" + line)]
    got = repeated_runs(docs(spark, [(i, t, None, None) for i, t in rows]), unit="line", least_words=5).collect()
    assert sorted(((r.key, r.start, r.n_units) for r in got), key=str) == sorted([(None, 0, 1), (None, 0, 2), (2, 0, 1)], key=str)
    assert repeated_runs(docs(spark, [])).count() == 0


def test_passages_that_begin_and_end_inside_units_are_cut_out_whole(spark):
    rng = random.Random(51)
    rows, planted = [(0, prose(rng, 300))], []
    words = rows[0][1].split()
    for i in range(1, 121):
        a = rng.randrange(len(words) - 51)
        before, after = sentence(rng, 6)[:-1], sentence(rng, 6).lower()
        text = f"{before} " + " ".join(words[a : a + 51]) + f" {after}"
        rows.append((i, text))
        planted.append((i, len(before) + 1, len(text) - len(after) - 1))
    rows.append((200, rows[1][1]))
    df = docs(spark, [(i, t, None, None) for i, t in rows])
    got = repeated_runs(df, into_neighbours=True).collect()
    assert len({(r.key, r.row) for r in got}) == len(got)
    found = {r.key: r for r in got}
    assert set(found) == {*range(1, 121), 200}
    for i, a, b in planted:
        # Words of the texts around may equal those of the first place by chance, one or two at most.
        assert found[i].start <= a and found[i].end >= b, (rows[i][1], found[i])
        assert found[i].n_words <= 54
    assert found[200].start == 0 and found[200].end == len(rows[1][1])


def test_runs_that_meet_do_not_overlap_and_first_places_stay(spark):
    rng = random.Random(3)
    one, two = prose(rng, 5), prose(rng, 5)
    link = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(0, one + " " + link.capitalize() + " one two three."), (1, "One two three four " + link + ". " + two), (2, one + " " + link.capitalize() + ". " + two), (3, "tail end. " + one + " " + one)]
    got = repeated_runs(docs(spark, [(i, t, None, None) for i, t in rows]), into_neighbours=True)
    spans = {}
    for r in got.collect():
        spans.setdefault(r.key, []).append((r.start, r.end))
    for i, t in rows:
        own = sorted(spans.get(i, []))
        assert all(b <= c for (_, b), (c, _) in zip(own, own[1:], strict=False))
        assert all(0 <= a < b <= len(t) for a, b in own)
    assert 0 not in spans and 2 in spans and 3 in spans
