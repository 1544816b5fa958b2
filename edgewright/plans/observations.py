"""Observations derived from the driver's tables: clients, routes, graph edges and label records.

Each comes with the SQL that derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright import schemas

#: (route_id, style, methods, path, receiver, handler); a null path is an expression.
ROUTES = (
    (1, "decorator", ["GET"], "/orders/{id}", "get_order"),
    (2, "decorator", ["POST"], "/orders/<int:id>", "post_order"),
    (3, "decorator", ["get"], "/customers/:id/orders", "customer_orders"),
    (4, "decorator", [], "/customers/{id}/orders/", "customer_orders_any"),
    (5, "decorator", [], "/{name}", "by_name"),
    (6, "decorator", ["GET"], "/files/{rest:path}", "files"),
    (7, "url-conf-entry", [], r"^legacy/(\d+)$", "legacy"),
    (8, "url-conf-entry", ["PUT"], "customers/<slug:key>/orders", "put_orders"),
    (9, "decorator", ["GET"], "/suppliers/list", "suppliers"),
    (10, "decorator", ["GET", "HEAD"], "/suppliers/{key}", "supplier"),
    (11, "decorator", ["DELETE"], None, "unknown"),
)

CLIENTS_SQL = """
  select o_orderkey * 10 as client_id, 'orders.ts' as file, cast(o_orderkey as int) as line, '/orders/' || o_orderkey as url,
         case o_orderstatus when 'F' then 'GET' when 'O' then 'POST' end as method
  from orders
  union all
  select c_custkey * 10 + 1, 'customers.ts', cast(c_custkey as int),
         '/customers/' || c_custkey || '/orders' || case when c_custkey % 2 = 0 then '/' else '' end,
         case when c_nationkey % 3 = 0 then 'PUT' when c_nationkey % 3 = 1 then 'get' end
  from customer
  union all
  select s_suppkey * 10 + 2, 'suppliers.ts', cast(s_suppkey as int),
         case when s_suppkey % 2 = 0 then '/suppliers/list?page=' || s_suppkey || '#top' else '/files//deep/' || s_suppkey end, 'GET'
  from supplier
  union all
  select page_id * 10 + 3, 'pages.ts', cast(page_id as int), url, 'GET' from pages
"""

NODE_SQL = """
  select 'region' as kind, r_name as name, r_regionkey as id from region
  union all select 'nation', n_name, 100 + n_nationkey from nation
  union all select 'customer', c_name, 1000 + c_custkey * 10 from customer
  union all select 'supplier', s_name, 1001 + s_suppkey * 10 from supplier
"""
EDGE_SQL = """
  select n_regionkey as source, 100 + n_nationkey as target, 'http-call' as kind, n_nationkey as seq from nation
  union all select 100 + c_nationkey, 1000 + c_custkey * 10, 'orm-access', c_custkey from customer
  union all select 100 + s_nationkey, 1001 + s_suppkey * 10, 'queries', s_suppkey from supplier
  union all select 1000 + c_custkey * 10, 2000000000 + o_orderkey, 'queries', o_orderkey from customer join orders on o_custkey = c_custkey
"""

_LADDER = sorted(set(schemas.CONFIDENCE.values()))
RECORDS_SQL = f"""
  select d.doc_id, d.source as kind, d.lang as provenance,
         case when l.doc_id is null then 'UNVERIFIABLE' when l.quality = 1 and l.toxic = 0 then 'TRUE_POSITIVE' else 'FALSE_POSITIVE' end as label,
         case d.doc_id % {len(_LADDER)} {" ".join(f"when {i} then cast({c} as double)" for i, c in enumerate(_LADDER))} end as confidence
  from documents d left join labels l on d.doc_id = l.doc_id
"""


def views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders", "customer", "supplier", "pages")
    rows = spark.sql(CLIENTS_SQL)
    parts = F.lit(None).cast(f"array<{schemas.PART}>")
    return rows.select(
        "client_id",
        "file",
        F.lit("typescript").alias("language"),
        "line",
        F.lit(None).cast("string").alias("enclosing"),
        "method",
        F.lit("literal").alias("url_kind"),
        F.col("url").alias("url_value"),
        parts.alias("url_parts"),
    )


def routes(spark: SparkSession) -> DataFrame:
    rows = [
        (i, "api.py", "python", i, style, methods, "literal" if path is not None else "dynamic", path, None, "app", handler)
        for i, style, methods, path, handler in ROUTES
    ]
    return spark.createDataFrame(rows, schemas.ROUTE_OBS)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "region", "nation", "customer", "supplier", "orders")
    return spark.sql(EDGE_SQL)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "region", "nation", "customer", "supplier")
    return spark.sql(NODE_SQL)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "documents", "labels")
    return spark.sql(RECORDS_SQL)
