import os

import pytest
from pyspark.sql import functions as F

from seqweft.sources.predictions import read_predictions, write_predictions


def answers(spark, n=500):
    label = F.when(F.col("id") % 3 == 0, "a").otherwise("b")
    return spark.range(n).select(F.col("id").alias("key"), label.alias("gesture")).repartition(7, "gesture", "key")


def test_written_rows_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    run = write_predictions(answers(spark), path, "key", "gesture", ["a", "b"], 500)
    got = read_predictions(spark, path)
    assert sorted((r.key, r.gesture) for r in got.collect()) == [(i, "b" if i % 3 else "a") for i in range(500)]
    assert {r.run for r in got.select("run").distinct().collect()} == {run}
    write_predictions(answers(spark, 30), path, "key", "gesture", ["a", "b"], 30)
    assert read_predictions(spark, path).count() == 530


BROKEN = {
    "missing": (lambda df: df.where("key <> 77"), "499 rows"),
    "null": (lambda df: df.withColumn("gesture", F.when(F.col("key") != 5, F.col("gesture"))), "1 null"),
    "unknown": (lambda df: df.withColumn("gesture", F.when(F.col("key") == 5, "zzz").otherwise(F.col("gesture"))), "1 unknown"),
    "repeated": (lambda df: df.where("key <> 9").unionByName(df.where("key = 8")), "1 repeated"),
}


@pytest.mark.parametrize("kind", list(BROKEN))
def test_a_violated_check_leaves_nothing(spark, tmp_path, kind):
    change, said = BROKEN[kind]
    path = str(tmp_path / "out")
    write_predictions(answers(spark, 12), path, "key", "gesture", ["a", "b"], 12)
    with pytest.raises(Exception, match=said):
        write_predictions(change(answers(spark)), path, "key", "gesture", ["a", "b"], 500)
    assert read_predictions(spark, path).count() == 12 and len(os.listdir(path)) == 1


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    os.makedirs(path)
    failing = answers(spark).withColumn("gesture", F.when(F.col("key") == 400, F.raise_error(F.lit("lost"))).otherwise(F.col("gesture")))
    with pytest.raises(Exception, match="lost"):
        write_predictions(failing, path, "key", "gesture", ["a", "b"], 500)
    assert os.listdir(path) == []
    write_predictions(answers(spark).limit(0), path, "key", "gesture", ["a", "b"], 0)
    assert os.listdir(path) == []
