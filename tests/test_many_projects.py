"""Whole runs over many projects whose paths begin alike."""

import duckdb
import pytest
from pyspark.sql import functions as F

from edgewright.operators import matching
from edgewright.plans import catalog, whole_run
from test_matching_keys import as_planned, most_rows  # noqa: F401

N = 60


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("suppliers"))
    spark.range(N).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return folder


def test_projects_of_a_small_table_of_keys_are_made_by_many_tasks(spark, suppliers):
    made = whole_run.project(spark, suppliers)
    assert made.count() == 4 * N
    assert len(made.select(F.spark_partition_id().alias("task")).distinct().collect()) > 1


def test_calls_of_a_run_meet_only_routes_that_agree(spark, suppliers, as_planned, monkeypatch):  # noqa: F811
    seen, candidates = [], matching.candidates
    monkeypatch.setattr(matching, "candidates", lambda *sides: seen.append(sides) or candidates(*sides))
    rows = whole_run.whole_run_edges(spark, suppliers)
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{suppliers}/supplier.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(rows.columns)} from ({catalog.ORACLES['whole_run_edges']})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    pairs = candidates(*seen[0])
    assert len(pairs.collect()) == sum(k % 3 != 0 for k in range(N))
    plan = pairs._jdf.queryExecution().executedPlan()
    assert most_rows(plan) <= 10 * N and "SortMergeJoin" in plan.toString()
