import duckdb

from seqweft.llm.line_dedup import DROP_SQL, drop_boilerplate, spread_lines
from tests.llm.helpers import docs, same_rows


def corpus():
    rows = []
    for i in range(60):
        rows.append((i, f"own text number {i} with several words\nShared footer \n\nmore own words {i}", "en", f"site{i % 12}"))
    for i in range(60, 90):
        rows.append((i, f"other text {i} with words\nfooter of few sites", "en", f"site{i % 3}"))
    rows += [(100 + i, "a text copied to every site\nwith two lines", "en", f"site{i}") for i in range(12)]
    rows += [(200, None, None, None), (201, "", "en", "site1"), (202, "Shared footer", None, None), (203, " \t", "x", "site2"), (204, "a\nShared footer\nb\nShared footer\t", "en", None)]
    rows += [(204, "one of two rows with the same id and words", "en", "site3"), (None, "long enough own words\nShared footer", "en", "site4"), (None, "own words without it", "en", "site4")]
    return rows


def test_equals_sql_on_every_row(spark):
    df = docs(spark, corpus())
    got = [(r.doc_id, r.text, r.n_lines_dropped) for r in drop_boilerplate(df, sites=8).collect()]
    pdf = df.where("text IS NOT NULL").toPandas()  # noqa: F841
    want = duckdb.sql(DROP_SQL.format(docs="pdf", sites=8)).fetchall() + [(200, None, 0)]
    clean = lambda rows: [(None if i is None or i != i else int(i), t, int(n)) for i, t, n in rows]
    assert same_rows(clean(got), clean(want))


def test_copies_stay_whole_and_boilerplate_goes(spark):
    got = {r.doc_id: (r.text, r.n_lines_dropped) for r in drop_boilerplate(docs(spark, corpus()), sites=8).collect() if r.doc_id is not None and r.doc_id != 204}
    assert got[3] == ("own text number 3 with several words\n\nmore own words 3", 1)
    assert got[105] == ("a text copied to every site\nwith two lines", 0)
    assert got[70][1] == 0 and got[202] == ("Shared footer", 0) and got[200] == (None, 0)


def test_threshold_is_exact_on_both_sides(spark):
    rows = []
    for n in range(1, 31):
        rows += [(100 * n + i, f"line on {n} sites", None, f"s{i % n}") for i in range(3 * n)]
    df = docs(spark, rows)
    for sites in (1, 10, 25):
        assert spread_lines(df, "text", "source", sites).distinct().count() == 31 - sites


def test_clashing_columns_and_empty_tables(spark):
    df = docs(spark, corpus()).withColumnRenamed("lang", "bad").withColumnRenamed("n_chars", "lines")
    out = drop_boilerplate(df, sites=8)
    assert sorted(out.columns) == sorted([*df.columns, "n_lines_dropped"]) and out.count() == df.count()
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = drop_boilerplate(docs(spark, corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
