"""Sides of joins that only seem small."""

from __future__ import annotations

from pyspark.sql import functions as F

import workload
from tracemill import session
from tracemill.operators import advisor_rules as ar
from tracemill.operators import workflow_rules as wr
from tracemill.session import broadcast_if_small


def test_exploded_nodes_are_not_broadcast(spark, tmp_path):
    """A file of a few bytes estimates small, whatever ``explode`` makes of its rows."""
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    nodes = ids.select(F.col("id").cast("string").alias("workflow_id"), F.explode(F.array(*map(F.lit, "01234"))).alias("node"))
    nodes = nodes.select("workflow_id", F.col("node").alias("id"), F.col("node").alias("label"), F.lit("ia").alias("type_noeud"))
    recs = ids.select(F.col("id").cast("string").alias("workflow_id"), F.lit("0").alias("noeud_id"), F.lit("0").alias("noeud_label"))
    found = ar.recommendation_violations(recs, recs.select("workflow_id", "noeud_id"), nodes)
    joins = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "HashJoin" in x and "LeftOuter" in x]
    assert not joins
    assert found.groupBy("rule").count().collect() == [("node_not_covered", 400)]


def test_side_above_the_limit_is_shuffled(spark):
    few, many = spark.range(3), spark.range(20)
    plan = many.join(broadcast_if_small(few, 2), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    plan = many.join(broadcast_if_small(few, 3), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_partitions_of_whole_days_follow_the_rows(spark, tmp_path, monkeypatch):
    workload.load()
    day = F.lit("2024-01-01").cast("timestamp")
    orders = spark.range(90).select(F.col("id").alias("o_orderkey"), day.alias("o_orderdate"))
    items = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (day + F.expr("interval 36 hours")).alias("l_shipdate"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    found = workload.QUERIES["c7_whole_days"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 9
    assert [tuple(r) for r in found.groupBy("days", "n").count().collect()] == [(1, 1, 90)]


def test_partitions_of_workflow_rules_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    ids = spark.range(90).select(F.lit("w").alias("workflow_id"), F.col("id").cast("string").alias("id"))
    nodes = ids.select("*", F.lit("a").alias("label"), F.lit("a").alias("description"), F.lit("ia").alias("type_noeud"), F.lit("s").alias("etape_originale"))
    edges = ids.select("workflow_id", F.col("id").alias("de"), F.col("id").alias("vers"))
    found = wr.node_violations(nodes, edges, ids.limit(1))
    assert found.rdd.getNumPartitions() == 9
    assert [tuple(r) for r in found.groupBy("rule").count().collect()] == [("original_step_unknown", 90)]
