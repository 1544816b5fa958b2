"""Whole runs over a small full-stack project for each supplier, whose key decides where its chain is broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators import run
from edgewright.plans.catalog import query
from edgewright.plans.source_text import MARK, suppliers
from edgewright.sources import files

API = """from app.m@@ import Alpha@@
router = APIRouter(prefix="/s@@")
main = APIRouter()
main.include_router(router, prefix="/v1")

@router.get("PATH/{id}")
def get_item@@(id):
    return Alpha@@.objects.get(id)
"""
MODEL = """class Alpha@@(Base):
    TABLE
"""
CLIENT = """const ROOT = '/v1/s@@'
export async function load@@(id) {
  return fetch(`${ROOT}/items/${id}`, { method: 'GET' })
}
"""
PAGE = """import { load@@ } from './FROM'
export function page@@() {
  return load@@(1)
}
"""
#: Where a supplier's chain is broken: its route, its table, its import.
ROUTE, TABLE, FROM = "s_suppkey % 3 = 0", "s_suppkey % 4 = 1", "s_suppkey % 5 = 2"


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = suppliers(spark, sf_dir)
    put = lambda text, what, on, yes, no: F.replace(F.lit(text), F.lit(what), F.when(F.expr(on), yes).otherwise(no))
    texts = {
        "api/s@@.py": put(API, "PATH", ROUTE, "/other", "/items"),
        "app/m@@.py": put(MODEL, "TABLE", TABLE, "pass", '__tablename__ = "alpha_@@"'),
        "web/api@@.ts": F.lit(CLIENT),
        "web/page@@.ts": put(PAGE, "FROM", FROM, "gone", "api@@"),
    }
    key = F.col("s_suppkey").cast("string")
    made = [F.struct(F.replace(F.lit(p), F.lit(MARK), key).alias("path"), F.replace(t, F.lit(MARK), key).cast("binary").alias("content")) for p, t in texts.items()]
    return files.gate(files.supported(keys.select(F.explode(F.array(*made)).alias("f")).select("f.*")))


_EDGES = f"""
select 'http-call' as kind, 'function load' || s_suppkey as source, 'function get_item' || s_suppkey as target, 0.8::float as confidence, 'web/api' || s_suppkey || '.ts:3' as place,
  'GET /v1/s' || s_suppkey || '/items/{{*}} matched GET /v1/s' || s_suppkey || '/items/{{id}} at api/s' || s_suppkey || '.py:6 (get_item' || s_suppkey || '); exact HTTP method; 3 static segment(s) equal; client value(s) at position(s) 3 not determined' as evidence
  from supplier where not ({ROUTE})
union all select 'call', 'function page' || s_suppkey, 'function load' || s_suppkey, 0.9::float, 'web/page' || s_suppkey || '.ts:3',
  'page' || s_suppkey || ' calls load' || s_suppkey || ' declared at web/api' || s_suppkey || '.ts:2, which issues an HTTP request' from supplier where not ({FROM})
union all select 'orm-access', 'function get_item' || s_suppkey, 'class Alpha' || s_suppkey, 0.9::float, 'api/s' || s_suppkey || '.py:8', 'Alpha' || s_suppkey || '.objects.get(...) in get_item' || s_suppkey || ' at api/s' || s_suppkey || '.py:8' from supplier
union all select 'queries', 'class Alpha' || s_suppkey, 'table alpha_' || s_suppkey, 0.9::float, 'app/m' || s_suppkey || '.py:1', 'Alpha' || s_suppkey || ' maps to table "alpha_' || s_suppkey || '"; __tablename__ = "alpha_' || s_suppkey || '"' from supplier where not ({TABLE})"""


@query(_EDGES)
def whole_run_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a whole run, from source text alone."""
    made = run.analyse(project(spark, sf_dir))
    end = lambda side: made.nodes.select(F.col("id").alias(side), F.concat("kind", F.lit(" "), "name").alias(f"{side}_shown"))
    rows = made.edges.join(end("source"), "source").join(end("target"), "target")
    return rows.select("kind", F.col("source_shown").alias("source"), F.col("target_shown").alias("target"), "confidence", F.concat("file", F.lit(":"), F.col("line").cast("string")).alias("place"), "evidence")
