"""Queries that link names, constants, calls and graphs across files, and of the scalar rules behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.functions import paths as P
from edgewright.operators import canonical, extract, linking, matching, report, resolution, tokens
from edgewright.operators.rounds import kept
from edgewright.plans.catalog import query
from edgewright.plans.observations import views
from edgewright.plans.source_text import repository
from edgewright.sources import files


@query(
    """select 'n' || n_nationkey as file, 'x' as name, case when n_nationkey % 7 = 0 and n_regionkey in (1, 2, 3) then 'ambiguous' when n_nationkey % 7 <> 0 and n_regionkey = 4 then 'unresolved' else 'declared' end as status,
  case when n_nationkey % 7 = 0 and n_regionkey in (0, 4) then 'r0' when n_nationkey % 7 <> 0 and n_regionkey < 4 then 'r' || n_regionkey end as declared_in from nation"""
)
def wildcard_barrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' barrels re-export all of a package, which re-exports all of a region; some re-export a second region."""
    views(spark, sf_dir, "nation", "region")
    stars = spark.sql(
        """select 'n' || n_nationkey as file, 'p' || n_regionkey as to_file from nation union all select 'p' || r_regionkey, 'r' || r_regionkey from region
        union all select 'n' || n_nationkey, 'r0' from nation where n_nationkey % 7 = 0 union all select 'p1', 'p1' from region"""
    )
    declared = spark.sql("select 'r' || r_regionkey as file, 'x' as name from region where r_regionkey < 4")
    return linking.follow_wildcards(spark.sql("select 'n' || n_nationkey as file, 'x' as name from nation"), declared, stars)


@query(
    """select c_custkey as id, case when c_custkey % 5 = 0 then '/local' when n_nationkey % 3 = 0 then '{unknown}' else '/n' || n_nationkey end || '/c' as shown from customer join nation on c_nationkey = n_nationkey"""
)
def imported_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' URLs start with a constant of their nation's file, if it exports it, or with their own of that name."""
    views(spark, sf_dir, "customer", "nation")
    part = lambda kind, text: f"named_struct('kind', '{kind}', 'text', {text})"
    constants = spark.sql(
        f"""select 'n' || n_nationkey as file, 'ROOT' as name, 0 as seq, array({part("literal", "'/n' || n_nationkey")}) as parts, n_nationkey % 3 <> 0 as exported from nation
        union all select 'c' || c_custkey, 'BASE', 0, array({part("literal", "'/local'")}), false from customer where c_custkey % 5 = 0"""
    )
    imports = spark.sql("select 'c' || c_custkey as file, 'BASE' as local, 'n' || c_nationkey as target, 'ROOT' as imported from customer")
    values = spark.sql(f"select c_custkey as id, 'c' || c_custkey as file, array({part('ref', "'BASE'")}, {part('literal', "'/c'")}) as parts from customer")
    return resolution.fold(values, linking.scopes(constants, imports)).select("id", "shown")


@query(
    """select c_custkey as id, case c_custkey % 3 when 0 then 'literal' else 'template' end as url_kind, case c_custkey % 3 when 0 then '/a/b' end as url_value,
  case c_custkey % 3 when 1 then 'process.env.API|/a/b' when 2 then '/x|id|/y' end as parts from customer"""
)
def url_re_expressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded URLs as literals or templates again."""
    views(spark, sf_dir, "customer")
    part = lambda kind, text: f"named_struct('kind', '{kind}', 'text', '{text}')"
    cases = [[part("literal", "/a"), part("literal", "/b")], [part("env", "API"), part("literal", "/a"), part("literal", ""), part("literal", "/b")], [part("literal", "/x"), part("ref", "id"), part("literal", "/y")]]
    parts = " ".join(f"when {i} then array({', '.join(c)})" for i, c in enumerate(cases))
    rows = spark.sql(f"select c_custkey as id, case c_custkey % 3 {parts} end as parts from customer")
    rows = rows.select("id", linking.re_expressed(F.col("parts")).alias("u")).select("id", "u.*")
    shown = F.when(F.col("url_parts").isNotNull(), F.array_join(F.transform("url_parts", lambda p: F.coalesce(p["value"], p["source"])), "|"))
    return rows.select("id", "url_kind", "url_value", shown.alias("parts"))


@query(
    """select 'f' || (o_custkey % 20) as file, 'fn' || (o_orderkey % 9) as caller, case o_orderkey % 4 when 0 then 'lib' || (o_custkey % 20 % 3) else 'f' || (o_custkey % 20) end as callee_file,
  case o_orderkey % 4 when 0 then 'send' else 'fn3' end as callee, cast(o_orderkey as int) as line from orders
  where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and (o_orderkey % 4 = 0 or (o_orderkey % 4 = 1 and o_orderkey % 9 <> 3))"""
)
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of imported clients and of functions of the own file; Python calls, calls at module level and unknown names make none."""
    views(spark, sf_dir, "orders")
    calls = spark.sql(
        """select 'f' || (o_custkey % 20) as file, case when o_orderkey % 5 = 0 then 'python' else 'tsx' end as language, cast(o_orderkey as int) as line, 0 as seq,
          case when o_orderkey % 7 <> 0 then 'fn' || (o_orderkey % 9) end as enclosing, case o_orderkey % 4 when 0 then 'client' when 1 then 'fn3' when 2 then 'twice' else 'nowhere' end as root,
          case o_orderkey % 4 when 0 then 'send' end as property from orders"""
    )
    bound = spark.sql(
        """select distinct 'f' || (o_custkey % 20) as file, 'client' as name, 'declared' as status, 'lib' || (o_custkey % 20 % 3) as declared_in from orders
        union all select distinct 'f' || (o_custkey % 20), 'fn3', 'declared', 'f' || (o_custkey % 20) from orders
        union all select distinct 'f' || (o_custkey % 20), 'twice', 'ambiguous', null from orders"""
    )
    return linking.resolved_calls(calls, bound).drop("seq")


@query(
    """select 'f' || (c_custkey % 30) as file, 'fn' || (c_custkey % 7) as name, min(cast(c_nationkey as int)) as line from customer where c_custkey % 4 <> 0 and c_custkey % 3 <> 0 group by 1, 2"""
)
def client_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that issue requests, at their first declaration."""
    views(spark, sf_dir, "customer")
    requests = spark.sql("select 'f' || (c_custkey % 30) as file, case when c_custkey % 4 = 0 then 'python' else 'typescript' end as language, case when c_custkey % 3 <> 0 then 'fn' || (c_custkey % 7) end as enclosing from customer")
    found = spark.sql("select 'f' || (c_custkey % 30) as file, 'function' as kind, 'fn' || (c_custkey % 7) as name, cast(c_nationkey as int) as line from customer where c_custkey % 4 <> 0 and c_custkey % 3 <> 0 union all select 'f1', 'class', 'fn1', -1")
    return linking.client_functions(requests, found)


_PRODUCED = """
  with http as (select 'function' as sk, 'f' || (c_custkey % 40) as sn, 'web.ts' as sf, 'route' as tk, '/n' || c_nationkey as tn, cast(null as varchar(9)) as tf, 'http-call' as kind from customer group by 2, 5),
  orm as (select 'route' as sk, '/n' || n_nationkey as sn, cast(null as varchar(9)) as sf, 'model' as tk, 'M' || n_regionkey as tn, 'm.py' as tf, 'orm-access' as kind from nation),
  call as (select 'function' as sk, 'g' || (s_suppkey % 9) as sn, 'lib.ts' as sf, 'function' as tk, 'f' || (s_suppkey % 9) as tn, 'web.ts' as tf, 'call' as kind from supplier group by 2, 5)
"""


@query(
    _PRODUCED
    + """, e as (select * from http union all select * from orm union all select * from call),
  n as (select distinct sk as kind, sn as name, sf as file from e union select distinct tk, tn, tf from e)
  select e.kind, sn as source, tn as target, s.kind || '>' || t.kind as kinds, (select count(*) from n) as nodes from e
  join n s on s.kind = sk and s.name = sn and s.file is not distinct from sf join n t on t.kind = tk and t.name = tn and t.file is not distinct from tf"""
)
def assembled_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, model accesses and calls of three producers in one graph with one id a node."""
    views(spark, sf_dir, "customer", "nation", "supplier")
    sql = _PRODUCED.replace("varchar(9)", "string")
    parts = [spark.sql(f"{sql} select * from {name}") for name in ("http", "orm", "call")]
    ends = lambda e, x: e.select(F.col(f"{x}k").alias("kind"), F.col(f"{x}n").alias("name"), F.col(f"{x}f").alias("file"), F.lit(1).alias("line"), F.lit(0).alias("seq"))
    key = lambda x: F.struct(F.col(f"{x}k").alias("kind"), F.col(f"{x}n").alias("name"), F.col(f"{x}f").alias("file"))
    edges = [e.select(key("s").alias("source"), key("t").alias("target"), "kind") for e in parts]
    nodes, out = linking.assembled([ends(e, x) for e in parts for x in "st"], edges)
    ids = lambda n: nodes.select(F.col("id").alias(f"{n}_id"), F.col("kind").alias(f"{n}_kind"))
    met = out.join(ids("source"), "source_id").join(ids("target"), "target_id")
    return met.select("kind", F.col("source.name").alias("source"), F.col("target.name").alias("target"), F.concat_ws(">", "source_kind", "target_kind").alias("kinds"), F.lit(nodes.count()).alias("nodes"))


@query("select count(*) * 6 as files, count(*) * 4 as parsed_clean, count(*) as parsed_with_errors, count(*) as failed, count(*) * 2 as diagnostics, count(*) * 14 as imports, count(*) * 4 as http_observations, count(*) * 3 as route_observations from supplier")
def parse_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the files that every supplier stands for."""
    read = files.gate(files.supported(repository(spark, sf_dir)))
    found = tokens.tokens(read)
    return linking.parse_totals(read, extract.diagnostics(found), imports=extract.imports(found), http_observations=extract.http_calls(found), route_observations=extract.routes(found))


_TEMPLATES = """select c_custkey as client_id, 'a.ts' as file, 'typescript' as language, c_custkey as line, cast(null as string) as enclosing, 'GET' as method,
  case c_custkey % 4 when 3 then 'dynamic' when 0 then 'literal' else 'template' end as url_kind, case when c_custkey % 4 = 0 then concat('/a//b/', c_custkey, '?q') end as url_value,
  case c_custkey % 4 when 1 then array(named_struct('kind', 'text', 'value', '/o/', 'source', cast(null as string)), named_struct('kind', 'expression', 'value', cast(null as string), 'source', 'id'), named_struct('kind', 'text', 'value', '/x/', 'source', cast(null as string)))
    when 2 then array(named_struct('kind', 'expression', 'value', cast(null as string), 'source', 'base'), named_struct('kind', 'text', 'value', concat('/c', c_custkey), 'source', cast(null as string))) end as url_parts from customer"""


@query(
    """select c_custkey as client_id, case c_custkey % 4 when 3 then 'unsupported' when 0 then 'exact' else 'partial' end as status,
  case c_custkey % 4 when 0 then '/a/b/' || c_custkey when 1 then '/o/{*}/x/' when 2 then '/{*}/c' || c_custkey else '/' end as shape,
  case c_custkey % 4 when 0 then '/a//b/' || c_custkey || '?q' when 1 then '/o/${id}/x/' when 2 then '${base}/c' || c_custkey end as raw_path,
  case c_custkey % 4 when 0 then 'query-separated|empty-segments-dropped' when 1 then 'template-substitution-unresolved' when 2 then 'template-substitution-unresolved|template-prefix-unknown' else 'dynamic-path-not-interpreted' end as notes from customer"""
)
def template_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical literals, templates and expressions of clients, with their raw text."""
    views(spark, sf_dir, "customer")
    rows = canonical.canonical_clients(spark.sql(_TEMPLATES))
    return rows.select("client_id", "status", P.shape(F.col("segments"), F.col("trailing_slash")).alias("shape"), "raw_path", F.array_join("notes", "|").alias("notes"))


@query("select case c_custkey % 4 when 3 then 'unsupported' when 0 then 'exact' else 'partial' end as status, count(*) as n from customer group by 1")
def normalise_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by outcome of canonicalisation."""
    views(spark, sf_dir, "customer")
    return report.count_by(canonical.canonical_clients(spark.sql(_TEMPLATES)), "status")


@query(
    """select c_custkey as id, c_custkey % 3 = 0 as same from customer"""
)
def same_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two routes differ in names only."""
    views(spark, sf_dir, "customer")
    parts = lambda p: F.transform(P.segments(p), P.classify_segment)
    rows = spark.sql("select c_custkey as id, '/a/{id}/b' as l, case c_custkey % 3 when 0 then '/a/:other/b' when 1 then '/a/x/b' else '/a/{id}' end as r from customer")
    return rows.select("id", P.same_shape(parts(F.col("l")), parts(F.col("r"))).alias("same"))


_SCALARS = {
    "joined": (lambda: P.join_paths(F.concat(F.lit("/a"), F.when(F.col("k") % 2 == 0, "/").otherwise("")), F.element_at(F.array(F.lit(""), F.lit("/"), F.lit("b"), F.lit("/b")), (F.col("k") % 4 + 1).cast("int"))), "case k % 4 when 0 then '/a' when 1 then '/a/' else '/a/b' end"),
    "relative": (lambda: P.fold_relative(F.concat(F.lit("x/y"), F.col("k")), F.element_at(F.array(F.lit("./z"), F.lit("../z"), F.lit("../../../z")), (F.col("k") % 3 + 1).cast("int"))), "case k % 3 when 0 then 'x/y' || k || '/z' when 1 then 'x/z' end"),
    "suffix": (lambda: P.suffix_match(F.concat(F.lit("src/a"), F.col("k") % 2, F.lit("/b.ts")), F.lit("./a1/b.ts")), "k % 2 = 1"),
    "located": (lambda: P.valid_location(F.element_at(F.array(F.lit("a/b.py"), F.lit("../b.py"), F.lit("c:\\b.py"), F.lit("/b.py"), F.lit(" ")), (F.col("k") % 5 + 1).cast("int")), F.col("k") % 7), "k % 5 = 0 and k % 7 >= 1"),
    "env": (lambda: P.environment_variable(F.element_at(F.array(F.concat(F.lit("process.env.A"), F.col("k")), F.lit("os.getenv('B')"), F.lit("import.meta.env.C"), F.lit("x.env.D")), (F.col("k") % 4 + 1).cast("int"))), "case k % 4 when 0 then 'A' || k when 1 then 'B' when 2 then 'C' end"),
    "quoted": (lambda: P.quoted_literal(F.element_at(F.array(F.lit("'a b'"), F.lit('"c"'), F.lit("'d\""), F.lit("e")), (F.col("k") % 4 + 1).cast("int"))), "case k % 4 when 0 then 'a b' when 1 then 'c' end"),
    "identifier": (lambda: P.plain_identifier(F.element_at(F.array(F.lit("_a1"), F.lit("$b"), F.lit("1c"), F.lit("d.e")), (F.col("k") % 4 + 1).cast("int"))), "k % 4 < 2"),
    "commit": (lambda: P.valid_commit(F.element_at(F.array(F.lit("ABCDEF1"), F.lit("abc"), F.lit("xyzxyzx")), (F.col("k") % 3 + 1).cast("int"))), "case k % 3 when 0 then 'abcdef1' end"),
    "sure": (lambda: P.valid_confidence(F.col("k") / 10), "k / 10.0 between 0 and 1"),
}


@query("select k, " + ", ".join(f"{sql} as {name}" for name, (_, sql) in _SCALARS.items()) + " from (select cast(s_suppkey as bigint) as k from supplier)")
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path joins, relative paths, places, environment variables, literals, identifiers, commits and confidences."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    return rows.select("k", *(made().alias(name) for name, (made, _) in _SCALARS.items()))


@query(
    """select o_orderkey * 10 as client_id, case o_orderstatus when 'F' then 'GET' when 'O' then 'POST' else 'UNKNOWN' end || ' /orders/' || o_orderkey || ' matched ' || case o_orderstatus when 'O' then 'POST' else 'GET' end || ' /orders/{id} at api.py:' || case o_orderstatus when 'O' then 2 else 1 end
  || case o_orderstatus when 'O' then ' (post_order); ' else ' (get_order); ' end || case when o_orderstatus in ('F', 'O') then 'exact HTTP method' else 'client declared no method' end || '; 1 static segment(s) equal; declared parameter(s) at position(s) 1 bound to concrete values' as evidence from orders"""
)
def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that explains each order client's first candidate."""
    from edgewright.plans import observations as O

    c, r = canonical.canonical_clients(matching.dealt(O.clients(spark, sf_dir).where("file = 'orders.ts'"))), F.broadcast(canonical.canonical_routes(O.routes(spark)))
    first = matching.ranked(matching.candidates(c, r)).where("rank = 1")
    return matching.evidence(first, c, r).select("client_id", "evidence")
