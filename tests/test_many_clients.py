"""Clients are dealt out once, into more tasks the more there are, and stay so until they are decided."""

import duckdb
import pytest
from pyspark.sql import functions as F

from edgewright.operators import canonical, matching
from edgewright.plans import catalog, observations

DATA = "/root/testdata/sf0.001"


def test_clients_are_dealt_once_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(matching, "MOST_CLIENTS", 100)
    one = F.lit(None)
    clients = spark.range(1000).select(F.col("id").alias("client_id"), F.concat(F.lit("/orders/"), "id").alias("url_value"), F.lit("literal").alias("url_kind"), one.cast("array<struct<kind:string,value:string,source:string>>").alias("url_parts"), F.lit("GET").alias("method"))
    dealt = matching.dealt(clients)
    assert dealt.rdd.getNumPartitions() == 10
    canon, routes = canonical.canonical_clients(dealt), F.broadcast(canonical.canonical_routes(observations.routes(spark)))
    decided = matching.decisions(canon, matching.candidates(canon, routes))
    assert decided.groupBy("status", "route_id").count().collect() == [("strong", 1, 1000)]
    shown = decided._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in shown and shown.count("Exchange hashpartitioning(client_id") == shown.count(", 10), REPARTITION_BY_NUM") > 0


def test_dealing_into_many_tasks_goes_by_parts_that_are_written_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(matching, "MOST_CLIENTS", 4)
    one = F.lit(None)
    clients = spark.range(1000).select(F.col("id").alias("client_id"), F.concat(F.lit("/orders/"), "id").alias("url_value"), F.lit("literal").alias("url_kind"), one.cast("array<struct<kind:string,value:string,source:string>>").alias("url_parts"), F.lit("GET").alias("method"))
    dealt = matching.dealt(clients)
    assert dealt.rdd.getNumPartitions() == 250
    assert sorted(dealt.select(clients.columns).collect()) == sorted(clients.collect())
    canon, routes = canonical.canonical_clients(dealt), F.broadcast(canonical.canonical_routes(observations.routes(spark)))
    decided = matching.decisions(canon, matching.candidates(canon, routes))
    assert decided.groupBy("status", "route_id").count().collect() == [("strong", 1, 1000)]
    shown = decided._jdf.queryExecution().executedPlan().toString()
    assert shown.count(", 200), REPARTITION_BY_NUM") == shown.count(", 250), REPARTITION_BY_NUM") > 0
    assert shown.count("Exchange hashpartitioning(client_id") == 2 * shown.count(", 250), REPARTITION_BY_NUM")


@pytest.mark.parametrize("name", ["ambiguous_clients", "match_status_counts"])
def test_query_dealt_into_many_tasks_equals_its_sql(spark, monkeypatch, name):
    monkeypatch.setattr(matching, "MOST_CLIENTS", 5)
    wanted = -(-observations.clients(spark, DATA).count() // 5)
    assert wanted > 200
    con = duckdb.connect()
    for t in ("orders", "customer", "supplier", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rows = catalog.QUERIES[name](spark, DATA)
    assert sorted(map(tuple, rows.collect())) == sorted(con.execute(catalog.ORACLES[name]).fetchall())
    shown = rows._jdf.queryExecution().executedPlan().toString()
    assert shown.count(", 200), REPARTITION_BY_NUM") == shown.count(f", {wanted}), REPARTITION_BY_NUM") > 0
