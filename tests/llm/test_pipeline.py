import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from seqweft.llm import decontam
from seqweft.llm.common import stored
from seqweft.llm.registry import QUERIES
from seqweft.session import scratch_path
from tests.llm.helpers import docs
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_stages_keep_the_columns_of_documents(spark):
    frame, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        before = frame
        frame = stored(stage(spark, frame, SF), name)
        ids = {r.doc_id for r in frame.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != pipeline.STAGES[-1][0]:
            assert frame.columns == before.columns
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert ids == {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
        if name == "line_dedup":
            assert len(ids) == before.count()
        seen.append(len(ids))
    assert seen[-1] == seen[-2] > 0 and all(r.round_trip for r in frame.collect())
    assert sorted(r.doc_id for r in pipeline.run(spark, SF).select("doc_id").collect()) == sorted(ids)


def test_stages_take_empty_and_odd_tables(spark):
    sf = scratch_path(spark, "odd")
    spark.createDataFrame([(1, None), (None, "x y z")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    good = "plain words of a text that says nothing of note but goes on for a while " * 3
    for rows in ([], [(None, None, None, None), (1, "", None, None), (2, good, "en", None), (2, good, "en", None), (2, good + good[:40], "en", "t"), (3, "x", None, "s")]):
        frame = docs(spark, rows)
        for _, stage in pipeline.STAGES:
            frame = stage(spark, frame, sf)
            assert frame.count() <= len(rows)


def test_leak_search_fits_its_space_to_every_document(spark, monkeypatch):
    # More passages than the 2^18 that the space was once fitted to.
    sf, fitted, multiplied = scratch_path(spark, "many"), [], decontam.multiplied
    monkeypatch.setattr(decontam, "multiplied", lambda coded, *rest: fitted.append(coded.count()) or multiplied(coded, *rest))
    spark.createDataFrame([(1, "the tall heron waits by the old mill")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    many = spark.range(1 << 19).selectExpr("id AS doc_id", "'the old mill' AS text", "'en' AS lang", "'s' AS source", "12L AS n_chars")
    dict(pipeline.STAGES)["decontamination"](spark, many, sf)
    assert fitted and set(fitted) == {1 << 19}


def test_all_queries_are_registered():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
