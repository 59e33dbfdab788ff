"""Plans and tasks that must not grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators.ranking import with_place, with_start
from shelfspark.rendering import storefront as R


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_and_starts_are_not_broadcast(spark):
    rows = spark.range(200).selectExpr("id % 3 as g", "id as k", "1 as n")
    placed = with_place(rows, ["g"], "k", 10, "place", "total")
    started = with_start(rows, ["g"], "k", 10, "n", "start")
    assert "BroadcastHashJoin" not in _plan(placed) and "BroadcastHashJoin" not in _plan(started)
    assert placed.where(F.col("place") != F.floor(F.col("k") / 3)).isEmpty()
    assert started.where(F.col("start") != F.floor(F.col("k") / 3)).isEmpty()


def test_larger_tables_go_to_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id as k", "'x' as v").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(R, "TASK_ROWS", 20)
    rows = R.table(spark, str(tmp_path), "t")
    assert rows.rdd.getNumPartitions() == 50 and rows.count() == 1000
    monkeypatch.setattr(R, "TASK_ROWS", 100_000)
    assert R.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == R.TASKS
