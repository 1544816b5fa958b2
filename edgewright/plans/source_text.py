"""Queries of the sources and extractors over source files that each supplier stands for, and the facts they must give as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators import canonical, extract, matching, resolution, tokens
from edgewright.operators.rounds import kept
from edgewright.plans.catalog import query
from edgewright.sources import files

#: One Python and one TypeScript file for each supplier; its key stands for the mark.
MARK = "@@"
PYTHON = """import os, sys as system
from app.m@@ import (
    Alpha,
    Beta as B@@,  # renamed
)
from .near import *
router = APIRouter(prefix="/s@@")
main.include_router(
    router,
    prefix="/v1",
)
main.include_router(other, prefix=PREFIX)

@router.get(
    "/items/{id}",
)
async def get_item(id):
    return requests.get(f"/up/@@/{id}")

@app.route("/bulk/@@", methods=["POST", "put"])
def bulk():
    x = Alpha(1)
    return x.run("now")

class Order(Base):
    __tablename__ = "orders_@@"

urlpatterns = [
    path("old/<int:id>/", views.Old.as_view()),
]
__all__ = ["bulk", "Order"]
"""
WEB = """import React, { useState as us, type FC } from 'react';
import * as ns from './ns@@';
import {
  a,
  b as c
} from '@/lib/x@@';
import './side';
export { d as e } from './barrel';
export * from './all';
export async function load(id) {
  const r = await fetch(`/v1/s@@/items/${id}`, {
    method: 'GET'
  });
  return axios.post('/bulk/@@', r);
}
const local = us(1);
const hidden = 2;
export { local };
const req = { url: '/conf/@@', method: 'put' };
class Page extends React.Component {
}
export default Page;
"""
CONFIG = """export default defineConfig({
  resolve: {
    alias: {
      '@': './src@@',
      lib: "lib",
      bad: join(root, "x"),
    },
  },
});
"""


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers, dealt out by key: their small table comes in one task, which would make the files of all of them."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")


def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): files of every supplier, some of them not to be read."""
    keys = suppliers(spark, sf_dir).select(F.col("s_suppkey").cast("string").alias("k"))
    text = lambda t: F.replace(F.lit(t), F.lit(MARK), F.col("k")).cast("binary")
    path = lambda p: F.replace(F.lit(p), F.lit(MARK), F.col("k"))
    made = {"api/s@@.py": PYTHON, "web/s@@.TS": WEB, "web/p@@/vite.config.ts": CONFIG, "node_modules/s@@/x.ts": "x", ".cache/s@@.py": "y", "notes/s@@.md": "z", "web/torn@@.ts": "function f( {\n", "web/p@@/calls.ts": "send({ url: '/sent/@@', method: 'put' });\n"}
    one = [F.struct(path(p).alias("path"), text(t).alias("content")) for p, t in made.items()]
    one.append(F.struct(path("api/bad@@.py").alias("path"), F.unhex(F.lit("C328")).alias("content")))
    return keys.select(F.explode(F.array(*one)).alias("f")).select("f.*")


def source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens(files.gate(files.supported(repository(spark, sf_dir))))


def facts(columns: str, rows: list[tuple]) -> str:
    """SQL of the rows for every supplier, whose key stands for the mark in texts."""

    def show(v: object) -> str:
        return "null" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"

    names = columns.split()
    kept = ", ".join(f"replace({n}, '{MARK}', s_suppkey::varchar) as {n}" if any(isinstance(r[i], str) for r in rows) else n for i, n in enumerate(names))
    return f"select {kept} from supplier, (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({', '.join(names)})"


PY, TS = "api/s@@.py", "web/s@@.TS"


@query(facts("path language status", [(PY, "python", "complete"), (TS, "typescript", "complete"), ("web/p@@/vite.config.ts", "typescript", "complete"), ("web/p@@/calls.ts", "typescript", "complete"), ("web/torn@@.ts", "typescript", "complete"), ("api/bad@@.py", "python", "failed")]))
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported files with their language, those that are not UTF-8 as failed."""
    return files.gate(files.supported(repository(spark, sf_dir))).select("path", "language", "status")


_IMPORTED = [
    (PY, 1, "os", "*", "os"), (PY, 1, "sys", "*", "system"), (PY, 2, "app.m@@", "Alpha", "Alpha"), (PY, 2, "app.m@@", "Beta", "B@@"), (PY, 6, ".near", "*", "*"),
    (TS, 1, "react", "default", "React"), (TS, 1, "react", "useState", "us"), (TS, 1, "react", "FC", "FC"), (TS, 2, "./ns@@", "*", "ns"), (TS, 3, "@/lib/x@@", "a", "a"), (TS, 3, "@/lib/x@@", "b", "c"),
    (TS, 7, "./side", None, None), (TS, 8, "./barrel", "d", "e"), (TS, 9, "./all", "*", "*"),
]


@query(facts("file line specifier imported local", _IMPORTED))
def import_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports and re-exports, over several lines too."""
    return extract.imports(source_tokens(spark, sf_dir))


_SYMBOLS = [
    (PY, 7, "variable", "router", False), (PY, 17, "function", "get_item", False), (PY, 21, "function", "bulk", True), (PY, 25, "class", "Order", True),
    (PY, 26, "variable", "__tablename__", False), (PY, 28, "variable", "urlpatterns", False), (PY, 31, "variable", "__all__", False),
    (TS, 10, "function", "load", True), (TS, 16, "variable", "local", True), (TS, 17, "variable", "hidden", False), (TS, 19, "variable", "req", False), (TS, 20, "class", "Page", True),
    ("web/torn@@.ts", 1, "function", "f", False),
]


@query(facts("file line kind name exported", _SYMBOLS))
def symbol_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations, exported at once or by a later statement."""
    found = source_tokens(spark, sf_dir)
    return extract.with_exports(extract.symbols(found), found).select("file", "line", "kind", "name", "exported")


_HTTP = [(PY, 18, "GET", "template", None, "/up/@@/|id"), (TS, 11, "GET", "template", None, "/v1/s@@/items/|id"), (TS, 14, "POST", "literal", "/bulk/@@", None), ("web/p@@/calls.ts", 1, "PUT", "literal", "/sent/@@", None)]


@query(facts("file line method url_kind url_value parts", _HTTP))
def http_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client calls with their method and URL."""
    rows = extract.http_calls(source_tokens(spark, sf_dir))
    parts = F.when(F.col("url_parts").isNotNull(), F.array_join(F.transform("url_parts", lambda p: F.coalesce(p["value"], p["source"])), "|"))
    return rows.select("file", "line", "method", "url_kind", "url_value", parts.alias("parts"))


@query(facts("file line method url_kind url_value", [("web/p@@/calls.ts", 1, "PUT", "literal", "/sent/@@")]))
def config_request_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests stated as configuration objects."""
    return extract.config_requests(source_tokens(spark, sf_dir)).select("file", "line", "method", "url_kind", "url_value")


@query(facts("dir alias target", [("web/p@@", "@", "web/p@@/src@@"), ("web/p@@", "lib", "web/p@@/lib")]))
def build_alias_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of build files."""
    return extract.build_aliases(source_tokens(spark, sf_dir))


_ROUTES = [
    (PY, 14, "decorator", "GET", "literal", "/items/{id}", "router", "get_item"),
    (PY, 20, "decorator", "POST|PUT", "literal", "/bulk/@@", "app", "bulk"),
    (PY, 29, "url-conf-entry", "", "literal", "old/<int:id>/", None, "views.Old.as_view"),
]


@query(facts("file line style methods path_kind path_value receiver handler", _ROUTES))
def route_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route declarations with their handler."""
    rows = extract.routes(source_tokens(spark, sf_dir))
    return rows.select("file", "line", "style", F.array_join("methods", "|").alias("methods"), "path_kind", "path_value", "receiver", "handler")


@query(facts("file line name prefix prefix_unresolved", [(PY, 7, "router", "/s@@", False)]))
def router_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared routers."""
    return extract.routers(source_tokens(spark, sf_dir))[0]


@query(facts("file line parent child prefix prefix_unresolved", [(PY, 8, "main", "router", "/v1", False), (PY, 12, "main", "other", None, True)]))
def inclusion_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusions of routers."""
    return extract.routers(source_tokens(spark, sf_dir))[1]


_CALLED = [
    (PY, 7, "APIRouter"), (PY, 8, "main.include_router"), (PY, 12, "main.include_router"), (PY, 18, "requests.get"), (PY, 22, "Alpha"), (PY, 23, "x.run"), (PY, 29, "path"), (PY, 29, "views.Old.as_view"),
    (TS, 11, "fetch"), (TS, 14, "axios.post"), (TS, 16, "us"), ("web/p@@/vite.config.ts", 1, "defineConfig"), ("web/p@@/vite.config.ts", 6, "join"), ("web/p@@/calls.ts", 1, "send"),
]


@query(facts("file line callee", _CALLED))
def call_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by dotted name."""
    return extract.calls(source_tokens(spark, sf_dir)).select("file", "line", "callee")


_STRINGS = [
    (PY, 7, "/s@@"), (PY, 10, "/v1"), (PY, 23, "now"), (PY, 26, "orders_@@"), (PY, 29, "old/<int:id>/"), (PY, 31, "bulk"), (PY, 31, "Order"), (TS, 12, "GET"),
    (TS, 14, "/bulk/@@"), (TS, 19, "/conf/@@"), (TS, 19, "put"), ("web/p@@/vite.config.ts", 4, "@"), ("web/p@@/vite.config.ts", 4, "./src@@"), ("web/p@@/vite.config.ts", 5, "lib"), ("web/p@@/vite.config.ts", 6, "x"),
    ("web/p@@/calls.ts", 1, "/sent/@@"), ("web/p@@/calls.ts", 1, "put"),
]


@query(facts("file line value", _STRINGS))
def string_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String literals."""
    return extract.strings(source_tokens(spark, sf_dir)).select("file", "line", "value")


@query(facts("file kind", [("web/torn@@.ts", "unbalanced-brackets")]))
def diagnostic_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not parse."""
    return extract.diagnostics(source_tokens(spark, sf_dir))


#: A file of scopes, calls, chains of + and brackets that do not meet.
MORE = """class Page {
  private async load(id: number): Promise<void> {
    const url = '/a/' + id + "/b";
    await this.api.get(
      url,
      { a: [1, 2], b: f(3, 4) },
    );
    return new Map<string, number>();
  }
  render() { return 1 + 2; }
}
export const top = `x` + 'y';
function outer() {
  function inner(a, b) {
  }
}
open((
)
}
}
"""
MORE_PY = """class A:
    kind = "x" + y
    async def run(self):
        def helper():
            return go(1, "a, b", [2, 3])
"""


def more_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of files of scopes for every supplier."""
    keys = suppliers(spark, sf_dir).select(F.col("s_suppkey").cast("string").alias("k"))
    one = [F.struct(F.replace(F.lit(p), F.lit(MARK), F.col("k")).alias("path"), F.lit(t).cast("binary").alias("content")) for p, t in (("m@@.ts", MORE), ("m@@.py", MORE_PY))]
    return tokens.tokens(files.gate(files.supported(keys.select(F.explode(F.array(*one)).alias("f")).select("f.*"))))


_SCOPED = [
    ("m@@.ts", 1, "class", "Page", None, False), ("m@@.ts", 2, "method", "load", "Page", True), ("m@@.ts", 10, "method", "render", "Page", False), ("m@@.ts", 12, "variable", "top", None, False),
    ("m@@.ts", 13, "function", "outer", None, False), ("m@@.ts", 14, "function", "inner", "outer", False),
    ("m@@.py", 1, "class", "A", None, False), ("m@@.py", 2, "variable", "kind", "A", False), ("m@@.py", 3, "method", "run", "A", True), ("m@@.py", 4, "function", "helper", "run", False),
]


@query(facts("file line kind name enclosing is_async", _SCOPED))
def scoped_symbol_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations with methods and the scope around them."""
    return extract.symbols(more_tokens(spark, sf_dir)).select("file", "line", "kind", "name", "enclosing", "is_async")


_SITES = [
    ("m@@.ts", 4, "this.api.get", False, 2), ("m@@.ts", 6, "f", False, 2), ("m@@.ts", 8, "Map", True, 0), ("m@@.ts", 17, "open", False, 1), ("m@@.py", 5, "go", False, 3),
]


@query(facts("file line callee is_new argument_count", _SITES))
def call_site_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the number of their arguments."""
    return extract.calls(more_tokens(spark, sf_dir)).select("file", "line", "callee", "is_new", "argument_count")


@query(facts("file line parts", [("m@@.ts", 3, "literal:/a/|expression:id|literal:/b"), ("m@@.ts", 12, "expression:`x`|literal:y"), ("m@@.py", 2, "literal:x|expression:y")]))
def concatenation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of + with a string among them."""
    rows = extract.concatenations(more_tokens(spark, sf_dir))
    return rows.select("file", "line", F.array_join(F.transform("parts", lambda p: F.concat(p["kind"], F.lit(":"), p["value"])), "|").alias("parts"))


@query(facts("file line kind", [("m@@.ts", 17, "never-closed"), ("m@@.ts", 19, "never-opened"), ("m@@.ts", 20, "never-opened")]))
def diagnostic_place_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where brackets do not meet."""
    return extract.diagnostic_places(more_tokens(spark, sf_dir))


@query(facts("file name stated", [(PY, "Order", "orders_@@"), (TS, "Page", None)]))
def stated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with the table they state."""
    found = source_tokens(spark, sf_dir)
    return extract.tables(extract.spans(extract.symbols(found), found), found).select("file", "name", F.col("table").alias("stated"))


@query(facts("client_file line status handler", [(TS, 11, "strong", "get_item"), (TS, 14, "exact", "bulk"), ("web/p@@/calls.ts", 1, "no-match", None)]))
def source_to_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From source text to decisions: each supplier's calls meet its handlers through the composed prefix of its router."""
    found = source_tokens(spark, sf_dir)
    declared, included = (kept(x) for x in extract.routers(found))
    mains = included.select("file", "parent").distinct()
    roots = mains.select("file", F.lit(0).alias("line"), F.col("parent").alias("name"), F.lit(None).cast("string").alias("prefix"), F.lit(False).alias("prefix_unresolved"))
    nothing = spark.createDataFrame([], "file string, name string, status string, declared_in string")
    prefixes = kept(resolution.project_prefixes(declared.unionByName(roots), included, nothing))
    routes = kept(resolution.composed_routes(extract.routes(found).withColumn("route_id", F.xxhash64("file", "line")), prefixes))
    clients = kept(extract.http_calls(found.where("language <> 'python'")).withColumn("client_id", F.xxhash64("file", "line"))).hint("merge")  # like routes, they grow with the source
    canon = canonical.canonical_clients(clients)
    results = matching.decisions(canon, matching.candidates(canon, canonical.canonical_routes(routes.hint("merge"))))
    return results.join(clients.select("client_id", F.col("file").alias("client_file"), "line"), "client_id").select("client_file", "line", "status", "handler")
