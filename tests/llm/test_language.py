import zlib

from seqweft.llm.language import UNDETERMINED, identify, judged, learn, learn_and_identify, packers
from tests.llm.helpers import docs

ENGLISH = "the house and the garden with an old tree that the children of the town like to climb in summer "
GERMAN = "das haus und der garten mit einem alten baum auf den die kinder der stadt im sommer gern klettern "


def rows():
    out = []
    for i in range(40):
        out.append((2 * i, (ENGLISH if i % 3 else ENGLISH.upper()) * (1 + i % 4), "en", "s"))
        out.append((2 * i + 1, GERMAN * (1 + i % 3), "de", "s"))
    return out


def test_held_out_rows_are_told_apart(spark):
    got = learn_and_identify(docs(spark, rows())).collect()
    assert len(got) == 80
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred == r.lang and 0 <= r.score <= 1 and not r.rejected


def test_nothing_learned_from_held_out_labels(spark):
    own = [r for r in rows() if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    got = learn_and_identify(docs(spark, own)).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in got} == {(UNDETERMINED, 0.0, True)}


def test_nulls_blank_letterless_long_and_repeated(spark):
    made = learn(docs(spark, rows()), "text", "lang", "doc_id")
    odd = [(None, None, None, None), (1, "", "en", None), (2, "12 + 34 = %", None, None), (3, GERMAN, None, "x"), (3, GERMAN, None, "x"), (4, ENGLISH * 3000, None, None)]
    df = docs(spark, odd).withColumnRenamed("source", "margin").withColumnRenamed("n_chars", "score")
    got = identify(df, made).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "und"), (1, "und"), (2, "und"), (3, "de"), (3, "de"), (4, "en")]
    assert sorted(identify(df, made).columns) == sorted(["doc_id", "text", "lang", "lang_pred", "score", "margin", "rejected"])
    assert learn_and_identify(docs(spark, [])).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    df = docs(spark, rows())
    small = learn(df, "text", "lang", "doc_id", sample=3, chars=50)
    assert small == learn(df.repartition(5), "text", "lang", "doc_id", sample=3, chars=50)
    assert all(len(d) <= 3 * 51 for d in small.values())


def test_narrow_margins_are_rejected_only_where_they_can_be_measured(spark):
    made = {"a": b"", "b": b""}
    got = {r.doc_id: r.rejected for r in identify(docs(spark, [(1, ENGLISH * 9, None, None), (2, "Short.", None, None)]), made, least_margin=0.005).collect()}
    assert got == {1: True, 2: False}
    assert judged("abc", packers((("x", b"abc"),))) == ("x", 1.0, 1.0)
