"""Queries of the second reading: enumeration, scopes, labels of edges and their endpoints, over the suppliers' source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators import extract, labelling, report, tokens
from edgewright.operators.rounds import kept
from edgewright.plans.catalog import query
from edgewright.plans.observations import views
from edgewright.plans.source_text import MARK, PY, TS, facts, repository, suppliers
from edgewright.sources import files

DOCUMENTED = '''"""Usage:

@router.post("/tokens")
"""
# @app.get("/no")
@expose("/list/@@")
x = """one line"""
class V(APIView):
    pass
app.add_url_rule("/r", v)
re_path("^a/$", v)
rest_path("users/@@", GET=v)
\'\'\'
path("hidden")
'''
DOC = "doc/s@@.py"


def stated(spark: SparkSession, sf_dir: str, schema: str, rows: list[tuple]) -> DataFrame:
    """The rows for every supplier, whose key stands for the mark in texts."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    keys = suppliers(spark, sf_dir).select(F.col("s_suppkey").cast("string").alias("k"))
    show = lambda v, kind: F.replace(F.lit(v), F.lit(MARK), F.col("k")) if isinstance(v, str) else F.lit(v).cast(kind)
    each = [F.struct(*(show(v, k).alias(n) for v, n, k in zip(r, names, kinds, strict=True))) for r in rows]
    return keys.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the suppliers' files and of one that holds examples in strings and comments."""
    more = stated(spark, sf_dir, "path string, content string", [(DOC, DOCUMENTED)]).withColumn("content", F.col("content").cast("binary"))
    read = files.supported(repository(spark, sf_dir).unionByName(more)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return kept(files.lines(files.gate(read), raw=True), "lines")


_ENUMERATED = [
    (PY, 14, "verb_decorator", "IN_SCOPE", "IN-BE-1"), (PY, 20, "route_decorator", "IN_SCOPE", "IN-BE-2"), (PY, 29, "urlconf", "IN_SCOPE", "IN-BE-3"),
    (DOC, 6, "expose", "UNSUPPORTED", "OUT-2"), (DOC, 8, "class_based_view", "UNSUPPORTED", "OUT-2"), (DOC, 10, "imperative", "UNSUPPORTED", "OUT-3"),
    (DOC, 11, "urlconf", "UNSUPPORTED", "OUT-4"), (DOC, 12, "urlconf_helper", "UNSUPPORTED", "OUT-9"),
]


@query(facts("file line kind classification rule", _ENUMERATED))
def declared_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route declarations that a plain reading finds, and the scope each is in; examples in strings and comments are none."""
    rows = labelling.enumerated(read_lines(spark, sf_dir).where("language = 'python'"), labelling.route_kind)
    callee = F.regexp_extract("text", r"^@?([\w.]+)", 1)
    return rows.select("file", "line", "kind", labelling.route_scope(F.col("kind"), callee).alias("s")).select("file", "line", "kind", "s.*")


@query(facts("file line kind", [(TS, 11, "fetch"), (TS, 14, "verb_call"), (TS, 19, "url_property"), ("web/p@@/calls.ts", 1, "url_property")]))
def enumerated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client calls that a plain reading finds."""
    return labelling.enumerated(read_lines(spark, sf_dir).where("language = 'typescript'"), labelling.call_kind).select("file", "line", "kind")


@query(facts("path test", [("a/tests/x@@.py", True), ("a/test_@@.py", True), ("b@@_tests.py", True), ("b@@_test.py", True), ("atests/x@@.py", False), ("a/x_test@@.ts", False), ("testing/@@", True)]))
def test_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are test code."""
    paths = ["a/tests/x@@.py", "a/test_@@.py", "b@@_tests.py", "b@@_test.py", "atests/x@@.py", "a/x_test@@.ts", "testing/@@"]
    return stated(spark, sf_dir, "path string", [(p,) for p in paths]).select("path", labelling.in_test_code(F.col("path")).alias("test"))


_MODELS = """select p_partkey as id, case p_partkey % 4 when 0 then 'Base' else 'M' || p_partkey end as model, case p_size % 4 when 0 then 'django' when 1 then 'sqlalchemy' when 2 then 'peewee' else 'sqlmodel' end as flavour,
  case when p_partkey % 3 = 0 then 't' || p_partkey end as tab, case when p_partkey % 3 = 0 then '__tablename__' when p_partkey % 3 = 1 then '__tablename__ is not a literal' end as origin from part"""


@query(
    f"""with m as ({_MODELS}) select id,
  case when flavour in ('peewee', 'sqlmodel') then case when model = 'Base' and tab is null then 'SAFE_REFUSAL' else 'UNSUPPORTED' end when tab is not null then 'IN_SCOPE' else 'SAFE_REFUSAL' end as classification,
  case when model = 'Base' and tab is null then 'SR-2' when flavour in ('peewee', 'sqlmodel') then 'OUT-1' when tab is not null then case flavour when 'django' then 'IN-ORM-2' else 'IN-ORM-1' end
    when origin is not null then 'SR-2' when flavour = 'django' then 'SR-6' else 'SR-2' end as rule,
  case when flavour in ('peewee', 'sqlmodel') then 'ORM flavour outside the two M06 declared' when tab is not null then origin || ' declares the table' when origin is not null then 'table name is not a string literal'
    when flavour = 'django' then 'no Meta.db_table; Django''s default needs the app label' else 'no table declared in this class' end as reason from m"""
)
def model_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by the scope that the ground truth puts them in."""
    views(spark, sf_dir, "part")
    scope = labelling.model_scope(*(F.col(c) for c in ("model", "flavour", "tab", "origin")))
    return spark.sql(_MODELS).select("id", scope.alias("s")).select("id", "s.*")


_NODES = [
    ("order:@@", "class", "Order", PY, 25), ("table:@@", "table", "orders_@@", None, None), ("other:@@", "table", "other", None, None), ("alpha:@@", "class", "Alpha", "lib/app/m@@.py", 3),
    ("item:@@", "function", "get_item", PY, 14), ("bulk:@@", "function", "bulk", PY, 20), ("load:@@", "function", "load", TS, 10), ("lost:@@", "class", "Page", None, None), ("gone:@@", "function", "gone", PY, 14),
]
#: Edge, kind, source, target, file, line, evidence; then its label and why.
_EDGES = [
    ("e00:@@", "queries", "order:@@", "table:@@", PY, 25, "", "TRUE_POSITIVE", "Order declares orders_@@"),
    ("e01:@@", "queries", "order:@@", "other:@@", PY, 25, "", "FALSE_POSITIVE", "source declares 'orders_@@', edge says 'other'"),
    ("e02:@@", "queries", "lost:@@", "other:@@", PY, 25, "", "UNVERIFIABLE", "model node has no file"),
    ("e03:@@", "queries", "alpha:@@", "other:@@", PY, 25, "", "UNVERIFIABLE", "no literal table declared in this class"),
    ("e04:@@", "orm-access", "bulk:@@", "alpha:@@", PY, 22, "Alpha(...) in bulk at api/s@@.py:22", "TRUE_POSITIVE", "imported from app.m@@, which declares it"),
    ("e05:@@", "orm-access", "bulk:@@", "order:@@", PY, 25, "Order.x(...) in bulk at api/s@@.py:25", "TRUE_POSITIVE", "declared in this file"),
    ("e06:@@", "orm-access", "bulk:@@", "alpha:@@", PY, 25, "Order(...) in bulk at api/s@@.py:25", "FALSE_POSITIVE", "a local declaration shadows the model"),
    ("e07:@@", "orm-access", "bulk:@@", "alpha:@@", PY, 23, "Alpha(...) in bulk at api/s@@.py:23", "FALSE_POSITIVE", "the expression is not at the cited line"),
    ("e08:@@", "orm-access", "load:@@", "alpha:@@", TS, 14, "axios.post(...) in load at web/s@@.TS:14", "FALSE_POSITIVE", "a Python ORM model cannot be used from this file"),
    ("e09:@@", "orm-access", "bulk:@@", "alpha:@@", PY, 22, "odd", "UNVERIFIABLE", "evidence not in the expected shape"),
    ("e10:@@", "orm-access", "item:@@", "alpha:@@", PY, 18, "requests.get(...) in get_item at api/s@@.py:18", "UNVERIFIABLE", "bound by a star import"),
    ("e11:@@", "orm-access", "bulk:@@", "order:@@", PY, 22, "Alpha(...) in bulk at api/s@@.py:22", "UNVERIFIABLE", "imported from app.m@@; re-export not followed by this reader"),
    ("e12:@@", "orm-access", "bulk:@@", "alpha:@@", DOC, 8, "APIView(...) in V at doc/s@@.py:8", "UNVERIFIABLE", "the name is not bound by any import this reader sees"),
    ("e13:@@", "call", "bulk:@@", "item:@@", PY, 18, "", "FALSE_POSITIVE", "get_item is not called at the cited line"),
    ("e14:@@", "call", "bulk:@@", "bulk:@@", PY, 20, "", "TRUE_POSITIVE", "callee declared in this file"),
    ("e15:@@", "call", "bulk:@@", "alpha:@@", PY, 20, "", "TRUE_POSITIVE", "callee imported from app.m@@"),
    ("e16:@@", "call", "bulk:@@", "alpha:@@", PY, 999, "", "UNVERIFIABLE", "cited line not readable"),
    ("e17:@@", "http-call", "load:@@", "item:@@", TS, 11, "", "TRUE_POSITIVE", "GET /v1/s@@/items/{*} is served here"),
    ("e18:@@", "http-call", "load:@@", "bulk:@@", TS, 14, "", "FALSE_POSITIVE", "method POST != served GET"),
    ("e19:@@", "http-call", "load:@@", "load:@@", TS, 14, "", "FALSE_POSITIVE", "target is not Python"),
    ("e20:@@", "http-call", "load:@@", "lost:@@", TS, 14, "", "UNVERIFIABLE", "target has no source location"),
    ("e21:@@", "http-call", "load:@@", "item:@@", TS, 1, "", "UNVERIFIABLE", "no literal URL at the client site"),
    ("e22:@@", "http-call", "load:@@", "item:@@", TS, 14, "", "FALSE_POSITIVE", "client /bulk/@@ does not reach served /v1/s@@/items/{*}"),
    ("e23:@@", "http-call", "load:@@", "order:@@", TS, 14, "", "UNVERIFIABLE", "served path not derivable: prefix is not a literal"),
    ("e24:@@", "http-call", "load:@@", "gone:@@", TS, 999, "", "UNVERIFIABLE", "no literal URL at the client site"),
    ("e25:@@", "http-call", "load:@@", "gone:@@", TS, 11, "", "TRUE_POSITIVE", "GET /v1/s@@/items/{*} is served here"),
    ("e26:@@", "imports", "load:@@", "item:@@", TS, 1, "", "UNVERIFIABLE", "no labeller for imports"),
]


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = stated(spark, sf_dir, "id string, kind string, source string, target string, file string, line int, evidence string", [e[:7] for e in _EDGES])
    return edges, stated(spark, sf_dir, "id string, kind string, name string, file string, line int", _NODES)


@query(facts("id kind label why", [(e[0], e[1], e[7], e[8]) for e in _EDGES]))
def edge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of edges of every kind from the source that they cite."""
    lines = read_lines(spark, sf_dir)
    edges, nodes = _graph(spark, sf_dir)
    declared = labelling.stated_tables(lines)
    clients = labelling.stated_requests(lines, edges.where("kind = 'http-call'"))
    served = stated(spark, sf_dir, "file string, line int, method string, path string, refusal string", [(PY, 14, "GET", "/v1/s@@/items/{id}", None), (PY, 20, "GET", "/bulk/{x}", None), (PY, 25, None, None, "prefix is not a literal")])
    return labelling.label_edges(edges, nodes, lines, declared, clients, served)


_OUTCOMES = {"e17": "confirmed", "e18": "confirmed", "e19": "missing", "e20": "unverifiable", "e21": "confirmed", "e22": "confirmed", "e23": "confirmed", "e24": "unverifiable", "e25": "missing"}


@query(facts("id outcome", [(f"{e}:@@", o) for e, o in _OUTCOMES.items()]))
def endpoint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both ends of each client edge stand where they are said to."""
    return labelling.endpoint_checks(*_graph(spark, sf_dir), read_lines(spark, sf_dir))


@query(
    """select n * 7 as files, n * 5 as files_clean, n as files_with_diagnostics, n as files_failed, n as diagnostics, n * 15 as symbols, n * 4 as routes, n as routes_composed, n * 4 as http_observations, exact, 0 as strong, ambiguous, no_match,
  0 as unsupported, resolved as dynamic_resolved, partial as dynamic_partial, parts as orm_models, tabled as orm_tables, 25 as orm_ambiguous, n * 9 as nodes, n * 27 as edges, n * 9 as http_call_edges, n * 4 as client_call_edges, n * 13 as orm_edges,
  n * 9 as cross_language_edges from (select count(*) as n from supplier), (select count(*) filter (o_orderstatus = 'F') as exact, count(*) filter (o_orderstatus = 'O') as ambiguous, count(*) filter (o_orderstatus = 'P') as no_match from orders),
  (select count(*) filter (c_custkey % 2 = 0) as resolved, count(*) filter (c_custkey % 2 = 1) as partial from customer), (select count(*) as parts, count(*) filter (p_partkey % 3 = 0) as tabled from part)"""
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a whole run."""
    views(spark, sf_dir, "orders", "customer", "part", "nation")
    more = stated(spark, sf_dir, "path string, content string", [(DOC, DOCUMENTED)]).withColumn("content", F.col("content").cast("binary"))
    read = files.gate(files.supported(repository(spark, sf_dir))).unionByName(files.gate(files.supported(more)))
    found = tokens.tokens(read)
    results = spark.sql("select case o_orderstatus when 'F' then 'exact' when 'O' then 'ambiguous' else 'no-match' end as status from orders")
    folded = spark.sql("select case c_custkey % 2 when 0 then 'resolved' else 'partial' end as status from customer")
    models = spark.sql(_MODELS).withColumnRenamed("tab", "table")
    edges, nodes = _graph(spark, sf_dir)
    routes = extract.routes(found).withColumn("composed", F.col("receiver") == "router")
    cross = edges.withColumn("cross", F.col("kind") == "http-call")
    return report.run_totals(read, extract.diagnostics(found), extract.symbols(found), routes, extract.http_calls(found), results, folded, models, spark.table("nation"), nodes, cross)
