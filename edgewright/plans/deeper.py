"""Queries of spans and points, constant evaluation, whole import resolution, traces as asked, and the scores of accesses, chains and labelled sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.operators import evaluation, labelling, modules, resolution, scores, tracing
from edgewright.operators.rounds import shared_folder
from edgewright.plans import observations
from edgewright.plans.catalog import _FIG, _NAMES, _REC, _SUM, _VP, query
from edgewright.plans.observations import views
from edgewright.sources import files

# ---- spans and points

_STABBED = "select 'all' as file, c_custkey as seq, c_name as name, c_custkey as start, c_custkey + c_nationkey * c_custkey % 97 as \"end\" from customer"


@query(
    f"""with s as ({_STABBED}), m as (select o_orderkey as point_id, s.name, row_number() over (partition by o_orderkey order by s."end" - s.start, s.seq) as k
  from orders left join s on o_custkey between s.start and s."end") select point_id, name from m where k = 1"""
)
def span_stabbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest span around every point, all of one file."""
    views(spark, sf_dir, "customer", "orders")
    spans = spark.sql(_STABBED.replace('"end"', "`end`"))
    points = spark.sql("select 'all' as file, o_orderkey as point_id, o_custkey as line from orders")
    return resolution.innermost(points, spans).select("point_id", "name")


@query(
    """with o as (select c_custkey as outer_id, c_custkey as start, c_custkey + c_nationkey % 5 as upto, c_nationkey % 10 as col from customer)
  select outer_id, min(o_orderkey) as seq from o join orders on o_custkey >= start and o_custkey + o_orderkey % 3 <= upto and o_orderkey % 12 >= col group by outer_id"""
)
def initialiser_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first string within a declaration, whose column must not lie before the declaration's, all of one file."""
    views(spark, sf_dir, "customer", "orders")
    outer = spark.sql("select 'all' as file, c_custkey as outer_id, c_custkey as start, c_custkey + c_nationkey % 5 as end, c_nationkey % 10 as start_column from customer")
    inner = spark.sql("select 'all' as file, o_orderkey as seq, o_custkey as start, o_custkey + o_orderkey % 3 as end, o_orderkey % 12 as start_column, o_orderstatus as value from orders")
    return resolution.first_contained(outer, inner).select("outer_id", "seq")


# ---- constants

_BOUND = """select n_nationkey as k, case when n_nationkey % 6 = 0 then 'literal' when n_nationkey % 6 = 5 then 'env' when n_nationkey = 7 then 'lost' when n_nationkey % 6 = 3 then 'both' else 'ref' end as kind,
  case when n_nationkey % 6 = 0 then '/k' || n_nationkey when n_nationkey % 6 = 5 then 'E' || n_nationkey when n_nationkey = 7 then 'zz' when n_nationkey % 6 = 3 then 'n' || (n_nationkey + 1) % 25 else 'n' || (n_nationkey * 3 + 1) % 25 end as text from nation"""


@query(
    f"""with recursive b as ({_BOUND}),
walk(id, name, used, shown, seen, verdict) as (
  select c_custkey, 'n' || (c_custkey % 27), 0, '/c', ['n' || (c_custkey % 27)], null::varchar from customer
  union all
  select id, case when next then text else name end, used + cost,
    shown || case when kind is null then '{{unknown}}' when used + cost >= 8 then case kind when 'both' then '{{unknown}}{{unknown}}' else '{{unknown}}' end
      else case kind when 'both' then '/p' || k else '' end || case kind when 'literal' then text when 'env' then '{{env:' || text || '}}' else case when cycle then '{{unknown}}' else '' end end end,
    list_append(seen, text), case when kind is null then 'unknown' when used + cost >= 8 then 'depth' when kind = 'literal' then 'resolved' when kind = 'env' then 'environment' when cycle then 'cycle' end
  from (select w.*, b.k, b.kind, b.text, case b.kind when 'both' then 2 else 1 end as cost, list_contains(w.seen, b.text) as cycle,
      b.kind in ('ref', 'both', 'lost') and not list_contains(w.seen, b.text) as next from walk w left join b on w.name = 'n' || b.k where w.verdict is null))
select id, shown, case when verdict = 'resolved' then shown end as value, verdict from walk where verdict is not null"""
)
def evaluation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs by constants that lead to literals, variables of the environment, each other in rings, too deep, or nowhere."""
    views(spark, sf_dir, "customer", "nation")
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), text.alias("text"))
    bound = spark.sql(_BOUND)
    own = F.when(F.col("kind").isin("lost", "both"), "ref").otherwise(F.col("kind"))
    parts = F.when(F.col("kind") == "both", F.array(part("literal", F.concat(F.lit("/p"), F.col("k").cast("string"))), part("ref", F.col("text")))).otherwise(F.array(part(own, F.col("text"))))
    bindings = bound.select(F.lit("f").alias("file"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("name"), F.lit(0).alias("seq"), parts.alias("parts"))
    name = F.concat(F.lit("n"), (F.col("c_custkey") % 27).cast("string"))
    values = spark.table("customer").select(F.col("c_custkey").alias("id"), F.lit("f").alias("file"), F.array(part("literal", F.lit("/c")), part("ref", name)).alias("parts"))
    return resolution.evaluate(values, bindings).drop("file", "parts")


# ---- imports

_MODULE = "case when k % 2 = 0 then 'app/' || k || '/mod.ts' else 'app/' || k || '/mod/index.tsx' end"


@query(
    f"""with s as (select s_suppkey as k, {_MODULE.replace("k", "s_suppkey")} as mod from supplier)
select 'app/' || k || '/main.ts' as file, 'T' as name,
  case when k % 4 > 1 then 'unresolved' when k % 3 = 2 and k % 7 = 0 then 'not-bound' else 'declared' end as status,
  case when k % 4 > 1 or k % 3 = 2 and k % 7 = 0 then null when k % 3 = 2 then 'lib/' || k || '.ts' else mod end as declared_in,
  case when k % 4 = 2 then 'is a package, and no build configuration aliases it' when k % 4 = 3 then 'does not resolve to a file this project contains' end as reason,
  case when k % 4 > 1 or k % 3 = 2 and k % 7 = 0 then null else '`from "' || case k % 4 when 0 then './mod' else '@/mod' end || '"`' || case when k % 3 = 2 then ' then `from "../' || case when k % 2 = 0 then '' else '../' end || '../lib/' || k || '"`' else '' end end as route from s
union all select 'pkg/' || k || '/use.py', 'X', case when k % 3 < 2 and k % 2 = 0 then 'declared' else 'unresolved' end, case when k % 3 < 2 and k % 2 = 0 then 'pkg/' || k || '/core.py' end,
  case when k % 3 = 2 then 'is not a module this project contains' when k % 2 = 1 then 'does not declare or re-export `X`' end,
  case when k % 3 < 2 and k % 2 = 0 then case k % 3 when 0 then '`from .core import X`' else '`from . import X` then `from .core import X`' end end from s
union all select 'star/' || k || '.ts', 'W', case k % 3 when 0 then 'declared' when 1 then 'ambiguous' else 'not-bound' end, case when k % 3 = 0 then 'star/a' || k || '.ts' end, null,
  case when k % 3 = 0 then '`export * from "./a' || k || '"`' end from s"""
)
def import_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names through relative files, folders, build aliases, packages, Python's dots and barrels, for every supplier."""
    views(spark, sf_dir, "supplier")
    spark.sql(f"select s_suppkey as k, {_MODULE.replace('k', 's_suppkey')} as mod from supplier").createOrReplaceTempView("import_walk_keys")
    files = spark.sql(
        """select explode(array(concat('app/', k, '/main.ts'), mod, concat('lib/', k, '.ts'), concat('pkg/', k, '/__init__.py'), concat('pkg/', k, '/core.py'), concat('pkg/', k, '/use.py'),
        concat('star/', k, '.ts'), concat('star/a', k, '.ts'), concat('star/b', k, '.ts'))) as file from import_walk_keys"""
    )
    declared = spark.sql(
        """select mod as file, 'Thing' as name, 3 as line from import_walk_keys where k % 3 <> 2 union all select concat('lib/', k, '.ts'), 'Base', 1 from import_walk_keys where k % 7 <> 0
        union all select concat('pkg/', k, '/core.py'), 'X', 5 from import_walk_keys where k % 2 = 0 union all select concat('star/a', k, '.ts'), 'W', 1 from import_walk_keys where k % 3 < 2
        union all select concat('star/b', k, '.ts'), 'W', 2 from import_walk_keys where k % 3 = 1"""
    )
    imports = spark.sql(
        """select concat('app/', k, '/main.ts') as file, 0 as seq, case k % 4 when 0 then './mod' when 1 then '@/mod' when 2 then 'react' else '../../../x' end as specifier, 'Thing' as imported, 'T' as local from import_walk_keys
        union all select concat('app/', k, '/main.ts'), 1, './never', 'Other', 'T' from import_walk_keys
        union all select mod, 0, concat(case when k % 2 = 0 then '../' else '../../' end, '../lib/', k), 'Base', 'Thing' from import_walk_keys where k % 3 = 2
        union all select concat('pkg/', k, '/use.py'), 0, case k % 3 when 0 then '.core' when 1 then '.' else concat('pkg.', k, '.gone') end, 'X', 'X' from import_walk_keys
        union all select concat('pkg/', k, '/__init__.py'), 0, '.core', 'X', 'X' from import_walk_keys
        union all select concat('star/', k, '.ts'), 0, concat('./a', k), '*', '*' from import_walk_keys union all select concat('star/', k, '.ts'), 1, concat('./b', k), '*', '*' from import_walk_keys"""
    )
    aliases = spark.sql("select concat('app/', k) as dir, '@' as alias, concat('app/', k) as target from import_walk_keys")
    names = spark.sql("select explode(array(struct(concat('app/', k, '/main.ts') as file, 'T' as name), struct(concat('pkg/', k, '/use.py') as file, 'X' as name), struct(concat('star/', k, '.ts') as file, 'W' as name))) as x from import_walk_keys").select("x.*")
    return modules.resolve_names(names, imports, declared, files, aliases).select("file", "name", "status", "declared_in", "reason", "route")


# ---- traces

_EDGES = """select c_custkey as id, 100 + c_nationkey as source, c_custkey % 40 as target, case c_custkey % 3 when 0 then 'http-call' when 1 then 'call' else 'queries' end as kind from customer where c_custkey <= 150
  union all select 1000 + n_nationkey, n_nationkey, 100 + n_regionkey, 'orm-access' from nation where n_nationkey % 4 = 0"""
_RANK = "case kind when 'call' then 0 when 'http-call' then 2 when 'queries' then 3 when 'orm-access' then 4 end"


def _traced(edges: str) -> str:
    return f"""with recursive e as (select id, source, target, {_RANK} as rank from ({edges})), outs as (select distinct source from e),
walk(start, node, branch, path, depth, stop) as (
  select distinct 100 + n_nationkey, (100 + n_nationkey)::bigint, []::bigint[][], [(100 + n_nationkey)::bigint], 0, null::varchar from nation
  union all
  select w.start, e.target, list_append(w.branch, [e.rank::bigint, e.target::bigint, e.id::bigint]), list_append(w.path, e.target), w.depth + 1,
    case when list_contains(w.path, e.target) then 'cycle' when o.source is null then 'chain-end' when w.depth + 1 >= 4 then 'max-depth' end
  from walk w join e on e.source = w.node left join outs o on o.source = e.target where w.stop is null)
select start::bigint as start, row_number() over (partition by start order by branch) as place, depth, branch[-1][3] as edge, node, stop from walk where depth > 0"""


def _told(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("start").orderBy("branch")).cast("long")
    return rows.select("start", place.alias("place"), "depth", "edge", "node", "stop")


@query(_traced(_EDGES))
def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step from every nation, in the order in which branches are walked, cycles and spent depth told."""
    views(spark, sf_dir, "customer", "nation")
    starts = spark.sql("select cast(100 + n_nationkey as bigint) as node from nation")
    edges = spark.sql(f"select cast(id as bigint) as id, cast(source as bigint) as source, cast(target as bigint) as target, kind from ({_EDGES})")
    return _told(tracing.trace_steps(edges, starts, 4))


_LEADING = f"""with recursive x as ({_EDGES}), back(node, far) as (select 3, 0 union select x.source, far + 1 from back join x on x.target = back.node where far < 3)
  select * from x where target in (select node from back)"""


@query(_traced(_LEADING))
def trace_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what leads to node 3, found backwards first."""
    views(spark, sf_dir, "customer", "nation")
    starts = spark.sql("select cast(100 + n_nationkey as bigint) as node from nation")
    edges = spark.sql(f"select cast(id as bigint) as id, cast(source as bigint) as source, cast(target as bigint) as target, kind from ({_EDGES})")
    return _told(tracing.trace_steps(edges, starts, 4, spark.sql("select cast(3 as bigint) as node")))


_NAMED = """select n_nationkey as id, 'function' as kind, n_name as name, 'src/r' || n_regionkey || '/m.py' as file, n_nationkey as line from nation
  union all select 1000 + s_suppkey, 'class', 'S' || s_nationkey, 'src/s' || s_suppkey % 3 || '/m.py', s_suppkey from supplier union all select 100000 + r_regionkey, 'table', r_name, null, null from region"""
_ASKED = """select case n_nationkey % 6 when 0 then n_name when 1 then 'r' || n_regionkey || '/m.py:' || n_name when 2 then 'S' || n_nationkey when 3 then lower(n_name) when 4 then substr(n_name, 1, 4)
  else './src/r' || (n_regionkey + 1) || '/m.py:' || n_name end as symbol from nation union all select r_name || '!' from region union all select lower(r_name) from region"""


@query(
    f"""with nodes as ({_NAMED}), asked as (select distinct symbol, regexp_extract(symbol, '^(.+):([^:]+)$', 1) as hint, case when symbol like '_%:_%' then regexp_extract(symbol, '^(.+):([^:]+)$', 2) else symbol end as wanted from ({_ASKED})),
shown as (select *, name || '  (' || kind || ')' || coalesce('  ' || file || ':' || line, '') as text from nodes),
hits as (select a.symbol, n.* from asked a join shown n on n.name = a.wanted where a.hint = '' or n.file = regexp_replace(a.hint, '^\\./', '') or n.file like '%/' || regexp_replace(a.hint, '^\\./', '')),
found as (select symbol, count(*) as n, min(id) as node, string_agg(text, '; ' order by coalesce(file, ''), coalesce(line, 0), id) as texts from hits group by symbol),
near as (select distinct a.symbol, s.text from asked a join shown s on lower(s.name) = lower(a.wanted) or length(a.wanted) >= 3 and contains(s.name, a.wanted) where a.symbol not in (select symbol from found)),
best as (select symbol, string_agg(text, '; ' order by text) as texts from (select *, row_number() over (partition by symbol order by text) as k from near) where k <= 10 group by symbol)
select a.symbol, case when f.n = 1 then 'found' when f.n > 1 then 'ambiguous' else 'not-found' end as status, case when f.n = 1 then f.node end as node,
  case when f.n > 1 then f.texts when f.n is null then coalesce(b.texts, '') end as candidates from asked a left join found f using (symbol) left join best b using (symbol)"""
)
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by name, by file and name, in other case, in part, and of nothing."""
    views(spark, sf_dir, "nation", "supplier", "region")
    rows = tracing.resolve_symbols(spark.sql(_NAMED), spark.sql(_ASKED))
    return rows.withColumn("candidates", F.array_join("candidates", "; "))


# ---- scores

_TRUTH = """select p_partkey as id, 'M' || p_partkey as model, 'f' || p_partkey % 9 || '.py' as file, case when p_partkey % 3 = 0 then 't' || p_partkey end as tab,
  case p_partkey % 3 when 0 then 'IN_SCOPE' when 1 then 'SAFE_REFUSAL' else 'UNSUPPORTED' end as classification, 'R' || p_partkey % 3 as rule from part"""
_MADE = """select ps as seq, 'M' || ps as model, case when ps % 11 <> 0 then 'f' || ps % 9 || '.py' end as file, case when ps % 4 = 0 then 'odd' else 't' || ps end as tab from (select p_partkey as ps from part where p_partkey % 5 < 2)"""


@query(
    f"""with t as ({_TRUTH}), p as ({_MADE}) select t.id,
  case when classification = 'IN_SCOPE' then case when p.tab = t.tab then 'TRUE_POSITIVE' when p.tab is not null then 'FALSE_POSITIVE' else 'FALSE_NEGATIVE' end when p.tab is not null then 'FALSE_POSITIVE' else classification end as outcome,
  case classification when 'IN_SCOPE' then t.tab when 'UNSUPPORTED' then 'no edge (out of scope ORM)' else 'no edge' end as expected, p.tab as produced, t.rule from t left join p on p.model = t.model and p.file = t.file"""
)
def declaration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared models against produced table edges."""
    views(spark, sf_dir, "part")
    return scores.score_declarations(spark.sql(_TRUTH).withColumnRenamed("tab", "table"), spark.sql(_MADE).withColumnRenamed("tab", "table"))


_CODE = """select 'a' || c_custkey % 3 || case c_custkey % 13 when 0 then '.ts' else '.py' end as file, c_custkey as line,
  case c_custkey % 4 when 0 then '    x = M' || c_nationkey || '(1)' when 1 then '    return M' || c_nationkey || '.objects.get(M' || (c_nationkey + 1) || '(2))' when 2 then 'def h' || c_custkey || '(a):' else '    pass' end as code from customer"""
_MODELS = "select 'M' || n_nationkey as model, 'app/m' || n_regionkey || '.py' as file, case when n_nationkey % 5 <> 4 then 't' || n_nationkey end as tab from nation"
_BINDS = """select distinct f.file, 'M' || n_nationkey as name, case n_nationkey % 7 when 0 then '*' when 1 then 'here' when 2 then 'other.m' else 'app.m' || n_regionkey end as binding from nation, (select distinct file from code) f where n_nationkey % 6 <> 5"""
_CITED = """select c_custkey as id, case when c_custkey % 17 = 0 then 'odd' else 'M' || c_nationkey || case when c_custkey % 2 = 0 then '.objects.get' else '' end || '(...) in h at a' || c_custkey % 3 || case c_custkey % 13 when 0 then '.ts' else '.py' end || ':' || (c_custkey - c_custkey % 3 % 2) end as evidence,
  'M' || case when c_custkey % 5 = 0 then (c_nationkey + 1) % 25 else c_nationkey end as model from customer"""
_USED = """used as (select distinct u.model, u.file, u.line, m.file as declared, m.tab from (select file, line, unnest(list_concat(regexp_extract_all(code, '\\b(\\w+)\\s*\\(', 1), regexp_extract_all(code, '\\b(\\w+)\\.objects\\.\\w+\\s*\\(', 1))) as model from code) u
  join models m on m.model = u.model and m.tab is not null join binds b on b.file = u.file and b.name = u.model and b.binding not in ('*', 'here')
  where m.file like '%' || replace(b.binding, '.', '/') || '.py' or m.file like '%' || replace(b.binding, '.', '/') || '/__init__.py')"""
_SOURCES = f"code as ({_CODE}), models as ({_MODELS}), binds as ({_BINDS})"


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    views(spark, sf_dir, "customer", "nation", "orders")
    code = spark.sql(_CODE).withColumn("line", F.col("line").cast("int"))
    return code, spark.sql(_MODELS).withColumnRenamed("tab", "table"), spark.sql(f"with code as ({_CODE}) {_BINDS}")


@query(
    f"""with {_SOURCES}, e as ({_CITED}), p as (select *, regexp_extract(evidence, '^(\\S+)\\(\\.\\.\\.\\) in (\\S+) at (.+):(\\d+)$', 3) as f, regexp_extract(evidence, ':(\\d+)$', 1) as l, regexp_extract(evidence, '^(M\\d+)', 1) as n from e),
  j as (select p.*, code.code, b.binding, m.file as declared, replace(replace(m.file, '.py', ''), '/', '.') as own from p left join code on code.file = p.f and code.line::varchar = p.l left join binds b on b.file = p.f and b.name = p.n left join models m on m.model = p.model),
  o as (select *, case when f = '' then 'unverifiable' when code is null or not contains(code, n) then 'not-at-line' when binding is null then 'wrong-symbol'
    when binding not in ('*', 'here') and not (ends_with(own, binding) or ends_with(binding, split_part(own, '.', -1)) or contains(own, binding) or contains(binding, own)) then 'wrong-symbol' else 'confirmed' end as outcome from j)
  select id, outcome, case when outcome <> 'wrong-symbol' then null when binding is null then 'the name is neither defined nor imported in this file' else 'imported from ' || binding || ', but the model is declared in ' || declared end as why,
    f <> '' and f not like '%.py' as not_python from o"""
)
def access_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Produced accesses against the source they cite."""
    code, models, binds = _sources(spark, sf_dir)
    told = binds.select("file", "name", F.when(F.col("binding") == "here", "defined").when(F.col("binding") == "*", "star").otherwise("imported").alias("binding"), F.when(~F.col("binding").isin("here", "*"), F.col("binding")).alias("origin"))
    return scores.check_accesses(spark.sql(_CITED), code, told, models)


@query(
    f"""with {_SOURCES}, {_USED}, e as ({_CITED}), hit as (select distinct regexp_extract(evidence, ' at (.+):(\\d+)$', 1) as file, regexp_extract(evidence, ':(\\d+)$', 1) as line from e where evidence <> 'odd')
  select u.model, count(*) as expected, count(h.file) as recovered, count(*) - count(h.file) as missed, round(count(h.file) / count(*)::double, 4) as recall from used u left join hit h on h.file = u.file and h.line = u.line::varchar group by u.model"""
)
def access_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of models that source states, and how many of them were produced, by model."""
    code, models, binds = _sources(spark, sf_dir)
    return scores.recall(scores.access_recall(scores.model_uses(code, binds, models), spark.sql(_CITED)), ["model"])


_SERVED = "select 'c' || o_orderkey as client, 'GET' as method, '/o/' || o_orderkey as url, 'a' || o_custkey % 3 || '.py' as file, o_custkey as line from orders where o_orderkey % 3 = 0"
_GRAPH = """select 'http-call' as kind, 0 as source, 1000 + c_custkey as target from customer where c_custkey % 4 = 2 union all select 'orm-access', 1000 + c_custkey, 1 + (c_custkey + 2) % 25 from customer where c_custkey % 4 = 2
  union all select 'orm-access', 1000 + c_custkey, 1 + c_nationkey from customer where c_custkey % 8 = 2 union all select 'queries', 1 + n_nationkey, 100 + n_nationkey from nation where n_nationkey % 3 <> 1"""
_NODES = "select 1000 + c_custkey as id, 'h' || c_custkey as name from customer union all select 1 + n_nationkey, 'M' || n_nationkey from nation union all select 100 + n_nationkey, 't' || n_nationkey from nation"


@query(
    f"""with {_SOURCES}, {_USED}, served as ({_SERVED}), defs as (select file, line as at, regexp_extract(code, '^def (\\w+)', 1) as handler from code where code like 'def %'),
  places as (select distinct file, line from served), d as (select p.file, p.line, min(x.at) as at from places p join defs x on x.file = p.file and x.at between p.line and p.line + 30 group by p.file, p.line),
  h as (select d.*, x.handler from d join defs x on x.file = d.file and x.at = d.at), b as (select distinct h.file, h.line, h.handler, u.model, u.tab from h join used u on u.file = h.file and u.line between h.at and h.at + 79),
  g as ({_GRAPH}), n as ({_NODES}), made as (select distinct x.name as handler, y.name as model, z.name as tab from g a join g o on o.source = a.target and o.kind = 'orm-access' join g q on q.source = o.target and q.kind = 'queries'
    join n x on x.id = a.target join n y on y.id = o.target join n z on z.id = q.target where a.kind = 'http-call')
  select s.client, s.method, s.url, b.handler, b.model, b.tab as "table", m.handler is not null as recovered from served s join b on b.file = s.file and b.line = s.line left join made m on m.handler = b.handler and m.model = b.model and m.tab = b.tab"""
)
def chain_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains from operation to table that source shows, and whether the graph has them."""
    code, models, binds = _sources(spark, sf_dir)
    served = spark.sql(_SERVED).withColumn("line", F.col("line").cast("int"))
    return scores.chain_recall(served, code, scores.model_uses(code, binds, models), spark.sql(_NODES), spark.sql(_GRAPH))


_RECORDS = """select 'r' || s_nationkey % 3 as repository, case s_suppkey % 4 when 0 then 'http-call' when 1 then 'orm-access' when 2 then 'queries' else 'call' end as kind, 'f.py:' || s_suppkey as "at", 'a -> é' || s_suppkey as edge,
  cast(s_suppkey as double) / power(10, s_suppkey % 23) as confidence, case when s_suppkey % 9 <> 8 then 'route-matcher' end as provenance, case s_suppkey % 3 when 0 then 'TRUE_POSITIVE' when 1 then 'FALSE_POSITIVE' else 'UNVERIFIABLE' end as label,
  case when s_suppkey % 4 = 0 then 'holdout' else 'development' end as split from supplier"""


@query(
    """select * from (values ('records unchanged', false), ('counts match the records', true), ('splits are disjoint', true), ('unverifiable records kept', true), ('every kind is represented', true),
  ('no accuracy without verified records', false), ('small samples are flagged', true)) t("check", passed) union all select 'confidence, provenance and place kept', count(*) = 0 from supplier where s_suppkey % 9 = 8"""
)
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a labelled set with a wrong digest, missing provenance and an accuracy of nothing."""
    views(spark, sf_dir, "supplier")
    records = spark.sql(_RECORDS.replace('"at"', "at"))
    counts = records.groupBy(F.lit("label").alias("what"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    counts = counts.unionByName(records.groupBy(F.lit("split").alias("what"), F.col("split").alias("name")).agg(F.count("*").alias("n")))
    groups = spark.sql("select '0.9' as name, 0 as verified, 0.5D as observed_accuracy, false as sample_adequate union all select '0.8', 10, 0.7D, false")
    return scores.integrity(records, "0" * 64, ["at"], counts, groups, evaluation.WEAK_SAMPLE)


_OLD = "select p_partkey as id, 'old' || p_partkey as model, 'f.py' as file, p_partkey as line, 'IN_SCOPE' as classification, 'OLD' as rule, 'kept' as reason, cast(null as varchar(9)) as note from part where p_partkey % 2 = 0"


@query(
    f"""with o as ({_OLD}), m as (select p_partkey as id, 'M' || p_partkey as model, 'g.py' as file, p_partkey as line, case when p_partkey % 6 = 0 then 't' end as tab from part where p_partkey % 3 = 0)
  select id, model, file, line, case when tab is not null then 'IN_SCOPE' else 'SAFE_REFUSAL' end as classification, case when tab is not null then 'IN-ORM-1' else 'SR-2' end as rule,
    case when tab is not null then '__tablename__ declares the table' else 'no table declared in this class' end as reason, case when line % 2 = 1 then 'read anew' end as note from m
  union all select * from o where id not in (select id from m)"""
)
def merged_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models read anew take the place of older records of their id."""
    views(spark, sf_dir, "part")
    fresh = spark.sql("select p_partkey as id, 'M' || p_partkey as model, 'g.py' as file, p_partkey as line, case when p_partkey % 6 = 0 then 't' end as tab, case when p_partkey % 2 = 1 then 'read anew' end as note from part where p_partkey % 3 = 0")
    scope = labelling.model_scope(F.col("model"), F.lit("sqlalchemy"), F.col("tab"), F.when(F.col("tab").isNotNull(), "__tablename__"))
    return scores.merged_truth(spark.sql(_OLD.replace("varchar(9)", "string")), fresh.withColumn("scope", scope))


@query(
    """select 'a' || s_suppkey || '/r.py' as file, 1 as line, case when s_suppkey % 7 = 3 or s_suppkey % 5 = 4 then null else 'GET' end as method,
  case when s_suppkey % 7 = 3 or s_suppkey % 5 = 4 then null when s_suppkey % 4 = 1 then '/r' || s_suppkey || '/x' else '/hub/v' || s_suppkey || '/r' || s_suppkey || '/x' end as path,
  case when s_suppkey % 7 = 3 then 'prefix is not a literal' when s_suppkey % 5 = 4 then 'mounted in several places' end as refusal from supplier
  union all select 'a' || s_suppkey || '/z.py', 2, null, null, '`router` is not a router this project declares' from supplier where s_suppkey % 3 = 0"""
)
def served_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served paths as labellers read them: every supplier has a router of the same name, mounted once, twice alike, twice apart, or on what is no router."""
    views(spark, sf_dir, "supplier")
    routers = spark.sql(
        """select concat('a', s_suppkey, '/r.py') as file, 'router' as name, case when s_suppkey % 7 <> 3 then concat('/r', s_suppkey) end as prefix, s_suppkey % 7 = 3 as prefix_unresolved from supplier
        union all select 'b/__init__.py', 'hub', '/hub', false from (select max(s_suppkey) from supplier)"""
    )
    inclusions = spark.sql(
        """select concat('a', s_suppkey, '/m.py') as file, case when s_suppkey % 4 = 1 and s_suppkey % 5 <> 4 then 'app' else 'hub' end as parent, 'router' as child, concat('/v', s_suppkey) as prefix, false as prefix_unresolved from supplier
        union all select concat('a', s_suppkey, '/m.py'), case when s_suppkey % 4 = 1 and s_suppkey % 5 <> 4 then 'app' else 'hub' end, 'router', concat('/v', s_suppkey), false from supplier where s_suppkey % 2 = 0
        union all select concat('a', s_suppkey, '/m.py'), 'hub', 'router', '/other', false from supplier where s_suppkey % 5 = 4"""
    )
    bound = spark.sql("select concat('a', s_suppkey, '/m.py') as file, 'router' as name, concat('a', s_suppkey, '.r') as binding from supplier union all select concat('a', s_suppkey, '/m.py'), 'hub', 'b' from supplier union all select concat('a', s_suppkey, '/z.py'), 'router', '*' from supplier")
    routes = spark.sql("select concat('a', s_suppkey, '/r.py') as file, 1 as line, 'router' as receiver, 'get' as method, '/x' as path from supplier union all select concat('a', s_suppkey, '/z.py'), 2, 'router', 'get', '/y' from supplier where s_suppkey % 3 = 0")
    return labelling.served_paths(routes, routers, inclusions, bound)


@query(_REC + f"g as (select kind, provenance, {_SUM} from r group by kind, provenance), h as (select {_VP} from g) select kind, provenance, {_NAMES}, {_FIG} from h")
def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents by kind of edge, written as JSON to the shared folder, and their groups read back."""
    made = scores.score_documents(observations.records(spark, sf_dir), ["kind"], "provenance")
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    made.select("json").write.option("maxRecordsPerFile", 1).text(path)  # a document a file
    group = "provenance string, produced long, true_positive long, false_positive long, unverifiable long, verified long, unverifiable_share double, observed_accuracy double, ci_low double, ci_high double, sample_adequate boolean"
    shape = "kind string, groups array<struct<" + ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in group.split(", ")).replace("long", "bigint") + ">>"
    return files.read_documents(spark, path, shape, "groups")
