"""Sources, extraction, and the way from source text to an architecture graph."""

from pyspark.sql import functions as F

from edgewright.functions import paths as P
from edgewright.operators import canonical, extract, matching, orm, resolution, tokens
from edgewright.sources import files

API = """from fastapi import APIRouter as AR, Depends
import os
import db.models as m
from .models import Order, Item as Thing
router = APIRouter(prefix="/api")
other = APIRouter(prefix=PREFIX)
main.include_router(router, prefix="/v1")

@router.get("/orders/{id}")
async def get_order(id):
    return Order.objects.get(id)

@app.route("/items", methods=["POST", "put"])
def items():
    x = Thing(1)
    return requests.get(f"/upstream/{x}")

@staticmethod
def helper():
    pass
"""
WEB = """import React, { useState as us, type FC } from 'react';
import * as ns from './ns';
import './side';
export { a as b } from './barrel';
export const BASE = "/api";
export async function load(id) {
  const r = await fetch(`/v1/api/orders/${id}`, { method: 'GET' });
  axios.post("/items", r);
  cache.get("key");
  return other.get("/things");
}
class Page extends React.Component {
  render() { return us(1); }
}
"""


def repo(spark):
    rows = [("api/app.py", API), ("web/load.ts", WEB), ("bad.py", b"\xc3\x28"), ("node_modules/x.ts", "x"), (".git/y.py", "y"), ("readme.md", "z"), ("broken.ts", "function f( {\nimport { q } from 'q';\n")]
    return files.from_rows(spark, rows)


def test_discovery_and_gate(spark):
    got = {r.path: (r.language, r.status) for r in repo(spark).collect()}
    assert got == {"api/app.py": ("python", "complete"), "web/load.ts": ("typescript", "complete"), "bad.py": ("python", "failed"), "broken.ts": ("typescript", "complete")}


def test_read_repository(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.py").write_text("x = 1\n")
    (tmp_path / "skip.txt").write_text("no")
    rows = files.read_repository(spark, str(tmp_path)).collect()
    assert [(r.path, r.language, r.status) for r in rows] == [("a/m.py", "python", "complete")]


def test_imports(spark):
    got = {(r.file, r.specifier, r.imported, r.local) for r in extract.imports(tokens.tokens(repo(spark))).collect()}
    assert {("api/app.py", "fastapi", "APIRouter", "AR"), ("api/app.py", "fastapi", "Depends", "Depends"), ("api/app.py", "os", "*", "os"), ("api/app.py", "db.models", "*", "m")} <= got
    assert {("api/app.py", ".models", "Order", "Order"), ("api/app.py", ".models", "Item", "Thing")} <= got
    assert {("web/load.ts", "react", "useState", "us"), ("web/load.ts", "react", "FC", "FC"), ("web/load.ts", "react", "default", "React")} <= got
    assert {("web/load.ts", "./ns", "*", "ns"), ("web/load.ts", "./side", None, None), ("web/load.ts", "./barrel", "a", "b"), ("broken.ts", "q", "q", "q")} <= got


def test_symbols_and_spans(spark):
    lines = tokens.tokens(repo(spark))
    found = extract.symbols(lines)
    got = {(r.kind, r.name, r.exported) for r in found.where("file = 'web/load.ts'").collect()}
    assert {("variable", "BASE", True), ("function", "load", True), ("class", "Page", False)} <= got
    ends = {(r.name): (r.start, r.end) for r in extract.spans(found, lines).where("file = 'web/load.ts'").collect()}
    assert ends["load"] == (6, 11) and ends["Page"] == (12, 14)
    python = {(r.name): (r.start, r.end) for r in extract.spans(found, lines).where("file = 'api/app.py'").collect()}
    assert python["get_order"] == (10, 11)


def test_http_calls(spark):
    got = {(r.file, r.line): (r.method, r.url_kind, r.url_value) for r in extract.http_calls(tokens.tokens(repo(spark))).collect()}
    assert got[("web/load.ts", 7)] == ("GET", "template", None)
    assert got[("web/load.ts", 8)] == ("POST", "literal", "/items")
    assert got[("web/load.ts", 10)] == ("GET", "literal", "/things")
    assert got[("api/app.py", 16)] == ("GET", "template", None)
    assert ("web/load.ts", 9) not in got


def test_routes_and_routers(spark):
    lines = tokens.tokens(repo(spark))
    got = {(r.path_value, tuple(r.methods), r.handler, r.receiver) for r in extract.routes(lines).collect()}
    assert got == {("/orders/{id}", ("GET",), "get_order", "router"), ("/items", ("POST", "PUT"), "items", "app")}
    declared, included = extract.routers(lines)
    assert {(r.name, r.prefix, r.prefix_unresolved) for r in declared.collect()} == {("router", "/api", False), ("other", None, True)}
    assert [(r.parent, r.child, r.prefix) for r in included.collect()] == [("main", "router", "/v1")]


def test_calls_strings_diagnostics(spark):
    lines = tokens.tokens(repo(spark))
    assert {("Order", "get"), ("Thing", None)} <= {(r.root, r.property) for r in extract.calls(lines).collect()}
    assert "/items" in {r.value for r in extract.strings(lines).collect()}
    assert "broken.ts" in {r.file for r in extract.diagnostics(lines).collect()}


LONG_PY = """from a.b import (  # names
    One,  # first
    Two as Zwei,
)
from c import d, \\
    e
class Order(
    Base,
):
    __tablename__ = "orders"
class Item(models.Model):
    class Meta:
        db_table = 'items'
class Bare(Base):
    pass
@app.route(
    "/long",
    methods=[
        "PUT",
    ],
)
""" + "# a remark\n" * 30 + """def far():
    return requests.get(
        "/up"
    ) or client.post("/a") or client.put("/b")
child = APIRouter(
    prefix="/child",
)
"""
LONG_TS = """import {
  a, // don't (
  type B as C,
} from './ab';
const r = fetch(
  "/x",
  {
    method: "DELETE",
  },
);
fetch("/plain").then(() => {
  fetch("/inner", { method: "PUT" });
});
axios
  .post(`/y/${r}`, { a: fetch("/z") });
Promise.all([axios.get("/one"), axios.put("/two")]);
fetch("/never", {
"""


def test_constructs_over_lines(spark):
    lines = tokens.tokens(files.from_rows(spark, [("l.py", LONG_PY), ("l.ts", LONG_TS)]))
    got = {(r.line, r.specifier, r.imported, r.local) for r in extract.imports(lines).collect()}
    assert got == {(1, "a.b", "One", "One"), (1, "a.b", "Two", "Zwei"), (5, "c", "d", "d"), (5, "c", "e", "e"), (1, "./ab", "a", "a"), (1, "./ab", "B", "C")}
    calls = extract.http_calls(lines).collect()
    assert sorted((r.line, r.method, r.url_value) for r in calls if r.language == "python") == [(53, "GET", "/up"), (55, "POST", "/a"), (55, "PUT", "/b")]
    web = {(r.line, r.method, r.url_value) for r in calls if r.language == "typescript"}
    assert web == {(5, "DELETE", "/x"), (11, None, "/plain"), (12, "PUT", "/inner"), (14, "POST", None), (15, None, "/z"), (16, "GET", "/one"), (16, "PUT", "/two"), (17, None, "/never")}
    assert [(r.line, r.path_value, r.methods, r.handler) for r in extract.routes(lines).collect()] == [(16, "/long", ["PUT"], "far")]
    assert [(r.name, r.prefix, r.prefix_unresolved) for r in extract.routers(lines)[0].collect()] == [("child", "/child", False)]
    found = extract.tables(extract.spans(extract.symbols(lines), lines), lines)
    assert {(r.name, tuple(r.bases), r.table) for r in found.collect()} == {("Order", ("Base",), "orders"), ("Item", ("models.Model",), "items"), ("Meta", (), None), ("Bare", ("Base",), None)}


def test_source_to_match(spark):
    """Client call in TypeScript to handler in Python, through the composed router prefix."""
    lines = tokens.tokens(repo(spark))
    declared, included = extract.routers(lines)
    routers = declared.union(spark.createDataFrame([("main.py", 0, "main", None, False)], declared.schema))
    bound = spark.createDataFrame([("api/app.py", "main", "declared", "main.py")], "file string, name string, status string, declared_in string")
    prefixes = resolution.project_prefixes(routers, included, bound)
    assert {r.name: (r.status, r.prefix) for r in prefixes.collect()}["router"] == ("known", "/v1/api")
    routes = resolution.composed_routes(extract.routes(lines).withColumn("route_id", F.xxhash64("file", "line")), prefixes)
    clients = canonical.canonical_clients(extract.http_calls(lines).withColumn("client_id", F.xxhash64("file", "line")))
    results = matching.decisions(clients, matching.candidates(clients, canonical.canonical_routes(routes)))
    where = clients.where("language = 'typescript'").select("client_id", F.col("line").alias("at"))
    got = {r["at"]: (r.status, r.handler, round(r.confidence or 0, 2)) for r in results.join(where, "client_id").collect()}
    assert got == {7: ("strong", "get_order", 0.8), 8: ("exact", "items", 0.98), 10: ("no-match", None, 0.0)}


def test_orm_models(spark):
    lines = tokens.tokens(files.from_rows(spark, [("a.py", "class Order(Base):\n    pass\nclass Item(models.Model):\n    pass\n"), ("b.py", "class Item(Base):\n    pass\n")]))
    classes = extract.symbols(lines).where("kind = 'class'").withColumn("table", F.lit(None).cast("string"))
    known, twice = orm.models(classes)
    assert [(r.name, r.flavour) for r in known.collect()] == [("Order", "sqlalchemy")] and [r.name for r in twice.collect()] == ["Item"]


def test_path_functions(spark):
    row = spark.range(1).select(
        P.join_paths(F.lit("/a/"), F.lit("b")).alias("a"), P.join_paths(F.lit("/a"), F.lit("/")).alias("b"), P.join_paths(F.lit("/a"), F.lit("")).alias("c"),
        P.fold_relative(F.lit("x/y"), F.lit("../z")).alias("d"), P.fold_relative(F.lit("x"), F.lit("../../z")).alias("e"),
        P.suffix_match(F.lit("src/a/b.ts"), F.lit("./a/b.ts")).alias("f"), P.suffix_match(F.lit("src/aa/b.ts"), F.lit("a/b.ts")).alias("g"),
        P.valid_location(F.lit("../x"), F.lit(1)).alias("h"), P.valid_location(F.lit("a/x"), F.lit(1)).alias("i"), P.environment_variable(F.lit("process.env.API_URL")).alias("j"),
        P.quoted_literal(F.lit("'ab'")).alias("k"), P.valid_commit(F.lit("ABCDEF1")).alias("l"),
    ).first()
    assert tuple(row) == ("/a/b", "/a/", "/a", "x/z", None, True, False, False, True, "API_URL", "ab", "abcdef1")


def test_reach_goes_to_the_fixpoint(spark):
    calls = spark.createDataFrame([(f"f{k + 1}", f"f{k}") for k in range(7)] + [("f0", "f7"), ("x", "y")], "caller string, callee string")
    got = orm.reaching(calls, spark.createDataFrame([("f0",)], "name string")).collect()
    assert sorted(r.name for r in got) == [f"f{k}" for k in range(8)]


def test_strings_over_lines_declare_nothing(spark):
    doc = '"""Usage:\n\n@router.post("/tokens")\n"""\nx = """one"""  # it\'s "plain"\nSQL = \'\'\'\n@app.get("/no")\n\'\'\'; y = 1\n@app.get("/yes")\ndef f():\n    """open\n@app.get("/never")\n'
    read = files.from_rows(spark, [("d.py", doc)])
    got = [(r.line, r.code) for r in files.lines(read).orderBy("line").collect()]
    assert len(got) == doc.count("\n") + 1 == files.lines(read, raw=True).count()
    assert got[0] == (1, "''") and got[4] == (5, 'x = """one"""  # it\'s "plain"') and got[5] == (6, "SQL = ''") and got[7] == (8, "; y = 1")
    assert [(r.line, r.path_value, r.handler) for r in extract.routes(tokens.tokens(read)).collect()] == [(9, "/yes", "f")]


def test_many_diagnostics_are_cut_and_said(spark):
    rows = tokens.tokens(files.from_rows(spark, [("a.ts", ")\n" * 40), ("b.ts", ")\n" * 25), ("c.ts", "f(')')\n")]))
    got = extract.diagnostic_places(rows).collect()
    assert sorted(r.line for r in got if r.file == "b.ts") == list(range(1, 26))
    assert [(r.line, r.kind) for r in got if r.file == "a.ts" and r.kind == "truncated"] == [(None, "truncated")] and len([r for r in got if r.file == "a.ts"]) == 26
    assert not [r for r in got if r.file == "c.ts"]
