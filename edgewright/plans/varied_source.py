"""Queries of the extractors over source that differs from supplier to supplier: its key decides which constructs a file holds, and so on which lines they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators import extract, tokens
from edgewright.plans.catalog import query
from edgewright.plans.source_text import MARK, suppliers
from edgewright.sources import files

#: (language, code, facts): facts by query as rows of (line within the code, values); the supplier's key stands for the mark.
SNIPPETS: list[tuple[str, str, dict[str, list[tuple]]]] = [
    ("py", "import os@@; import sys\n", {"imports": [(0, "os@@", "*", "os@@"), (0, "sys", "*", "sys")]}),
    ("py", "from a@@ import b; from .c import (d as e,\n  f)\n", {"imports": [(0, "a@@", "b", "b"), (0, ".c", "d", "e"), (0, ".c", "f", "f")]}),
    ("py", 'text = "call foo(1)"  # bar(2)\n', {"symbols": [(0, "variable", "text", None)], "strings": [(0, "call foo(1)")]}),
    ("py", "def k@@(): return go(@@)\n", {"symbols": [(0, "function", "k@@", None)], "calls": [(0, "go", False, 1)]}),
    ("py", "if flag:\n    y@@ = 1\nelse: z = 2\n", {"symbols": [(1, "variable", "y@@", None), (2, "variable", "z", None)]}),
    (
        "py",
        '@self.app.get("/x@@")\ndef handler@@(a=f(1)):\n    local = 1\n',
        {"routes": [(0, "decorator", "GET", "literal", "/x@@", "self.app", "handler@@")], "symbols": [(1, "function", "handler@@", None)]},
    ),
    ("py", '@app.get(path="/kw@@")\ndef kw():\n    pass\n', {"symbols": [(1, "function", "kw", None)]}),
    (
        "py",
        'urlpatterns = [path("a@@/", views.one), re_path(r"^b/$", Two.as_view(), name="two"),\n  path("c/" "d/", three)]\n',
        {
            "routes": [(0, "url-conf-entry", "", "literal", "a@@/", None, "views.one"), (0, "url-conf-entry", "", "literal", "^b/$", None, "Two.as_view"), (1, "url-conf-entry", "", "dynamic", None, None, "three")],
            "symbols": [(0, "variable", "urlpatterns", None)],
            "calls": [(0, "path", False, 2), (0, "re_path", False, 3), (0, "Two.as_view", False, 0), (1, "path", False, 2)],
            "strings": [(0, "a@@/"), (0, "^b/$"), (0, "two"), (1, "c/"), (1, "d/")],
        },
    ),
    (
        "py",
        'r@@ = fastapi.APIRouter(prefix="/in")\napi.include_router(APIRouter(prefix="/made"))\napi.include_router(child@@, prefix=f"/{v}")\n',
        {
            "routers": [(0, None, "r@@", "/in", False), (2, "api", "child@@", None, True)],
            "symbols": [(0, "variable", "r@@", None)],
            "calls": [(0, "fastapi.APIRouter", False, 1), (1, "api.include_router", False, 1), (1, "APIRouter", False, 1), (2, "api.include_router", False, 2)],
            "strings": [(0, "/in"), (1, "/made")],
        },
    ),
    (
        "py",
        'requests.get(f"/up/{id}/@@", timeout=3)\nclient.session.post(url="/kw", data={"a": 1})\nstore.get("/path@@")\ncache.get("key")\n',
        {
            "requests": [(0, "requests.get", "GET", "template", None, None), (2, "store.get", "GET", "literal", "/path@@", None)],
            "calls": [(0, "requests.get", False, 2), (1, "client.session.post", False, 2), (2, "store.get", False, 1), (3, "cache.get", False, 1)],
            "strings": [(1, "/kw"), (1, "a"), (2, "/path@@"), (3, "key")],
        },
    ),
    (
        "py",
        'class M@@(Base, models.Model):\n    """requests.get("/doc")"""\n    kind: str = "x" + suffix\n    def run(self):\n        inner = "no"\n',
        {
            "symbols": [(0, "class", "M@@", None), (2, "variable", "kind", "M@@"), (3, "method", "run", "M@@")],
            "strings": [(1, 'requests.get("/doc")'), (4, "no")],
            "chains": [(2, "literal:x|expression:suffix")],
        },
    ),
    ("py", 's = "it\\"s"\nt = f"plain@@"\nu = f"{a} b"\n', {"symbols": [(0, "variable", "s", None), (1, "variable", "t", None), (2, "variable", "u", None)], "strings": [(0, 'it\\"s'), (1, "plain@@")]}),
    ("ts", "const h@@ = 1, j = 2;\n", {"symbols": [(0, "variable", "h@@", None), (0, "variable", "j", None)]}),
    (
        "ts",
        "list.map(async (id) => { await fetch(`/x/${id}/${key(1)}`); });\n",
        {"calls": [(0, "list.map", False, 1), (0, "fetch", False, 1), (0, "key", False, 1)], "requests": [(0, "fetch", None, "template", None, None)]},
    ),
    ("ts", "/* fetch('/block')\n*/ // axios.get('/line')\n", {}),
    ("ts", "const re = /[\"'(]/;\nconst cfg = { url: '/none', method: 'put' };\n", {"symbols": [(0, "variable", "re", None), (1, "variable", "cfg", None)], "strings": [(1, "/none"), (1, "put")]}),
    (
        "ts",
        "send({ headers: { a: 1 }, url: '/conf/@@', method: 'put' });\n",
        {"calls": [(0, "send", False, 1)], "requests": [(0, "send", "PUT", "literal", "/conf/@@", None)], "strings": [(0, "/conf/@@"), (0, "put")]},
    ),
    ("ts", ";(options?.client ?? client).get({ url: '/gen/@@' });\n", {"requests": [(0, "get", "GET", "literal", "/gen/@@", None)], "strings": [(0, "/gen/@@")]}),
    ("ts", "app.get('/route', handler, (req, res) => { res.send('x'); });\n", {"calls": [(0, "app.get", False, 3), (0, "res.send", False, 1)], "strings": [(0, "/route"), (0, "x")]}),
    (
        "ts",
        "function outer@@(a = init()) {\n  const local = 1;\n  function inner() { return run(a); }\n}\n",
        {"symbols": [(0, "function", "outer@@", None), (2, "function", "inner", "outer@@")], "calls": [(2, "run", False, 1)]},
    ),
    (
        "ts",
        'export default class Page@@ extends Base {\n  size = 3\n  handle = () => { api.post(\'/h@@\', 1) }\n  async load(id: number): Promise<void> { return this.http.get("/m"); }\n}\n',
        {
            "symbols": [(0, "class", "Page@@", None), (3, "method", "load", "Page@@")],
            "calls": [(2, "api.post", False, 2), (3, "this.http.get", False, 1)],
            "requests": [(2, "api.post", "POST", "literal", "/h@@", "Page@@"), (3, "this.http.get", "GET", "literal", "/m", "load")],
            "strings": [(2, "/h@@"), (3, "/m")],
        },
    ),
    ("ts", "export { a@@ as b } from './m@@'; import x, { type T, y as z } from './n';\n", {"imports": [(0, "./m@@", "a@@", "b"), (0, "./n", "default", "x"), (0, "./n", "T", "T"), (0, "./n", "y", "z")]}),
    ("ts", "const s = 'it\\'s' + name + \"@@\";\n", {"symbols": [(0, "variable", "s", None)], "chains": [(0, "literal:it\\'s|expression:name|literal:@@")]}),
    ("ts", "const t = `a ${fn(`b ${c}`)} d`\nnew Set<string>([next()])\n", {"symbols": [(0, "variable", "t", None)], "calls": [(0, "fn", False, 1), (1, "Set", True, 1), (1, "next", False, 0)]}),
]


def held(key: str, snippet: str) -> str:
    """Whether a supplier's file holds a snippet, the same in both dialects."""
    return f"(({key} * 7 + {snippet} * 5) % 4 <> 0)"


def varied_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a Python and a TypeScript file for each supplier."""
    keys = suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("k"))
    made = []
    for language in ("py", "ts"):
        parts = [F.when(F.expr(held("k", str(i))), F.lit(code)).otherwise("") for i, (of, code, _) in enumerate(SNIPPETS) if of == language]
        text = F.replace(F.concat(*parts), F.lit(MARK), F.col("k").cast("string"))
        made.append(F.struct(F.concat(F.lit("varied/"), F.col("k").cast("string"), F.lit(f".{language}")).alias("path"), text.cast("binary").alias("content")))
    return tokens.tokens(files.gate(files.supported(keys.select(F.explode(F.array(*made)).alias("f")).select("f.*"))))


def varied(kind: str, columns: str) -> str:
    """SQL of one kind of facts: those of the snippets that a file holds, behind the lines of the snippets before."""

    def show(v: object) -> str:
        return "null" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"

    names = columns.split()
    rows = [(i, *row) for i, (_, _, facts) in enumerate(SNIPPETS) for row in facts.get(kind, [])]
    texts = [n for k, n in enumerate(names, 2) if any(isinstance(r[k], str) for r in rows)]
    shown = ", ".join(f"replace({n}, '{MARK}', k::varchar) as {n}" if n in texts else n for n in names)
    heights = ", ".join(f"({i}, '{of}', {code.count(chr(10))})" for i, (of, code, _) in enumerate(SNIPPETS))
    return f"""
with snippets(i, language, height) as (values {heights}),
held as (select s_suppkey as k, i, language, sum(height) over (partition by s_suppkey, language order by i) - height as above from supplier, snippets where {held("s_suppkey", "i")}),
facts(i, line, {", ".join(names)}) as (values {", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)})
select 'varied/' || k || '.' || language as file, cast(above + line + 1 as integer) as line, {shown} from held join facts using (i)"""


@query(varied("imports", "specifier imported local"))
def varied_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, several on a line and one over lines."""
    return extract.imports(varied_tokens(spark, sf_dir))


@query(varied("symbols", "kind name enclosing"))
def varied_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations with the scope around; locals of functions are none."""
    return extract.symbols(varied_tokens(spark, sf_dir)).select("file", "line", "kind", "name", "enclosing")


@query(varied("calls", "callee is_new argument_count"))
def varied_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls outside comments, strings, decorators and parameter lists, those in templates too."""
    return extract.calls(varied_tokens(spark, sf_dir)).select("file", "line", "callee", "is_new", "argument_count")


@query(varied("requests", "callee method url_kind url_value enclosing"))
def varied_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by call or by configuration object, with the function around; registrations of handlers are none."""
    found = varied_tokens(spark, sf_dir)
    around = extract.symbols(found).where("kind in ('function', 'class', 'method')").select("file", F.col("stmt").alias("scope"), F.col("name").alias("enclosing"))
    return extract.http_calls(found).join(around, ["file", "scope"], "left").select("file", "line", "callee", "method", "url_kind", "url_value", "enclosing")


@query(varied("routes", "style methods path_kind path_value receiver handler"))
def varied_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route declarations: receivers of several names, keyword paths, entries on one line."""
    rows = extract.routes(varied_tokens(spark, sf_dir))
    return rows.select("file", "line", "style", F.array_join("methods", "|").alias("methods"), "path_kind", "path_value", "receiver", "handler")


@query(varied("routers", "parent name prefix prefix_unresolved"))
def varied_routers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routers, and with a parent their inclusions; what is built in place is included by nobody."""
    declared, included = extract.routers(varied_tokens(spark, sf_dir))
    rows = declared.withColumn("parent", F.lit(None).cast("string")).unionByName(included.withColumnRenamed("child", "name"))
    return rows.select("file", "line", "parent", "name", "prefix", "prefix_unresolved")


@query(varied("strings", "value"))
def varied_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String literals with their escapes as written, docstrings too."""
    return extract.strings(varied_tokens(spark, sf_dir)).select("file", "line", "value")


@query(varied("chains", "parts"))
def varied_concatenations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of + with a string among them."""
    rows = extract.concatenations(varied_tokens(spark, sf_dir))
    return rows.select("file", "line", F.array_join(F.transform("parts", lambda p: F.concat(p["kind"], F.lit(":"), p["value"])), "|").alias("parts"))
