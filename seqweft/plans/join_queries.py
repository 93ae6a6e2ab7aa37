"""Joins and set operations (J, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweft.operators import joins, profile
from seqweft.operators.clean import sentinel_to_null
from seqweft.operators.transform import stratified_folds
from seqweft.plans.adapters import (
    PREDICTIONS_SQL,
    SENTINEL_SQL,
    TRIALS_SQL,
    events,
    predictions,
    sentinel_events,
    table,
    trial_values,
    trials,
)
from seqweft.plans.registry import query
from seqweft.plans.window_queries import WINDOW_ID, WINDOWS_SQL, event_windows


def _subjects_of_events(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_nationkey", "c_mktsegment", "c_acctbal"
    )


@query(
    "j1_readings_with_attributes",
    """SELECT event_id, user_id, value, c_nationkey, c_mktsegment, c_acctbal
    FROM events LEFT JOIN customer ON c_custkey = user_id""",
)
def readings_with_attributes(spark, sf):
    readings = table(spark, sf, "events").select("event_id", "user_id", "value")
    return joins.join_attributes(readings, _subjects_of_events(spark, sf), ["user_id"], ["event_id"])


@query(
    "j2_projected_attributes",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_nationkey
    FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""",
)
def projected_attributes(spark, sf):
    readings = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    attributes = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return joins.join_attributes(readings, attributes, ["l_suppkey"], ["l_orderkey", "l_partkey"], ["s_nationkey"])


@query(
    "j3_join_without_clash",
    """SELECT event_id, user_id, CAST(user_id % 2 AS INTEGER) AS c_nationkey, c_mktsegment, c_acctbal
    FROM events LEFT JOIN customer ON c_custkey = user_id""",
)
def join_without_clash(spark, sf):
    readings = table(spark, sf, "events").select(
        "event_id", "user_id", (F.col("user_id") % 2).cast("int").alias("c_nationkey")
    )
    attributes = _subjects_of_events(spark, sf)
    return joins.join_attributes(readings, attributes, ["user_id"], ["event_id"], drop_clashes=True)


@query(
    "j4_complete_trial_values",
    f"WITH {TRIALS_SQL} SELECT trial_id, fusion, value FROM trials JOIN trial_values USING (trial_id) WHERE state = 'COMPLETE'",
)
def complete_trial_values(spark, sf):
    done = trials(spark, sf).where(F.col("state") == "COMPLETE")
    return done.join(trial_values(spark, sf), "trial_id").select("trial_id", "fusion", "value")


@query(
    "j5_rows_of_chosen_sequences",
    """SELECT event_id, user_id, value FROM events
    WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 70)""",
)
def rows_of_chosen_sequences(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    chosen = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 70)
    return joins.rows_of(ev, chosen, ["user_id"], ["event_id"])


@query(
    "j6_subjects_without_attributes",
    "SELECT c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
)
def subjects_without_attributes(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"))
    right = table(spark, sf, "events").select(F.col("user_id").alias("subject"))
    return joins.keys_without(left, right, ["subject"])


@query(
    "j6_documents_without_labels",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def documents_without_labels(spark, sf):
    return joins.keys_without(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query(
    "j7_attributes_of_first_row",
    """WITH f AS (SELECT o_orderpriority AS sequence, o_custkey, row_number() OVER (
          PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
    SELECT sequence, o_custkey AS subject, c_mktsegment, c_acctbal FROM f LEFT JOIN customer ON c_custkey = o_custkey WHERE i = 1""",
)
def attributes_of_first_row(spark, sf):
    first = F.min_by("o_custkey", F.struct("o_orderdate", "o_orderkey")).alias("subject")
    firsts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("sequence")).agg(first)
    attributes = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), "c_mktsegment", "c_acctbal")
    return firsts.join(attributes, "subject", "left").select("sequence", "subject", "c_mktsegment", "c_acctbal")


@query(
    "j8_windows_with_labels",
    f"""WITH {WINDOWS_SQL}, lb AS (
      SELECT user_id, pos AS start_idx, event_type AS label, user_id % 3 AS attribute FROM ev)
    SELECT user_id, start_idx, value, label, attribute FROM w JOIN lb USING (user_id, start_idx)""",
)
def windows_with_labels(spark, sf):
    """Labels and attributes come from another table; each window meets its own by window id."""
    labels = events(spark, sf).select(
        "user_id", F.col("pos").alias("start_idx"), F.col("event_type").alias("label"), (F.col("user_id") % 3).alias("attribute")
    )
    windows = event_windows(spark, sf).select(*WINDOW_ID, "value")
    return joins.positions_match(windows, labels, WINDOW_ID)


@query(
    "j9_before_after_comparison",
    f"""WITH {SENTINEL_SQL} SELECT 'value' AS channel, CAST(0 AS BIGINT) AS nulls_before,
        count(*) FILTER (WHERE value = -1) AS sentinels_before, count(*) FILTER (WHERE value = 0) AS zeros_before,
        count(*) AS rows, count(*) FILTER (WHERE value = -1) AS nulls_after, CAST(0 AS BIGINT) AS sentinels_after,
        count(*) FILTER (WHERE value = 0) AS zeros_after FROM sen""",
)
def before_after_comparison(spark, sf):
    before = sentinel_events(spark, sf)
    return profile.cleaning_effect(before, sentinel_to_null(before, ["value"]), ["value"])


_HASH = "('0x' || substr(md5(CAST(sequence_id AS VARCHAR)), 1, 8))::BIGINT"


@query(
    "j10_fold_parts",
    f"""WITH {PREDICTIONS_SQL}, f AS (SELECT sequence_id, truth,
          (row_number() OVER (PARTITION BY truth ORDER BY {_HASH}, sequence_id) - 1) % 5 AS fold FROM pr)
    SELECT sequence_id, truth, CAST(fold AS INTEGER) AS fold, CASE WHEN fold = 2 THEN 'valid' ELSE 'train' END AS part FROM f""",
)
def fold_parts(spark, sf):
    df = predictions(spark, sf).select("sequence_id", "truth")
    folds = stratified_folds(df, "truth", ["sequence_id"], 5)
    return joins.folds_of(df, folds, ["sequence_id"], 2)


@query(
    "o1_union_all",
    """SELECT o_orderkey AS id, o_totalprice AS amount, 'order' AS kind FROM orders
    UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier
    UNION ALL SELECT c_custkey, c_acctbal, 'customer' FROM customer""",
)
def union_all(spark, sf):
    parts = [("orders", "o_orderkey", "o_totalprice", "order"), ("supplier", "s_suppkey", "s_acctbal", "supplier"),
             ("customer", "c_custkey", "c_acctbal", "customer")]
    frames = [
        table(spark, sf, t).select(F.lit(kind).alias("kind"), F.col(a).alias("amount"), F.col(i).alias("id"))
        for t, i, a, kind in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("o2_set_difference", "SELECT user_id FROM events EXCEPT SELECT l_suppkey FROM lineitem")
def set_difference(spark, sf):
    return table(spark, sf, "events").select("user_id").subtract(table(spark, sf, "lineitem").select("l_suppkey"))


@query("o3_set_intersection", "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey").intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("o4_distinct_values", "SELECT DISTINCT event_type, user_id FROM events")
def distinct_values(spark, sf):
    return table(spark, sf, "events").select("event_type", "user_id").distinct()


@query(
    "o5_largest_rows",
    "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 20",
)
def largest_rows(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    return df.orderBy(F.desc("value"), "event_id").limit(20)


@query("o6_label_union", f"WITH {PREDICTIONS_SQL} SELECT truth AS label FROM pr UNION SELECT guess FROM pr")
def label_union(spark, sf):
    df = predictions(spark, sf)
    return df.select(F.col("truth").alias("label")).union(df.select("guess")).distinct()


