"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import canon

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = tables.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_streamed_answers_equal_batch_answers(spark):
    from seqweft.plans.adapters import table
    from seqweft.plans.streaming_queries import _fitted, score_sequences

    batch = score_sequences(*_fitted(spark, SF))(table(spark, SF, "events"))
    streamed = entry.queries()["st1_score_arriving_sequences"](spark, SF)
    assert sorted(map(tuple, batch.select("user_id", "class").collect())) == sorted(
        map(tuple, streamed.select("user_id", "class").collect())
    )
