"""Queries of the resolution operators over names, modules, routers and models that the driver's tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgewright.operators import orm, resolution
from edgewright.plans.catalog import query
from edgewright.plans.observations import views

_SPANS = "select cast(conv_id as varchar(20)) as file, turn as seq, 's' || turn as name, turn as start, turn + turn % 3 as \"end\" from conversations"


@query(
    f"""with s as ({_SPANS}), p as (select cast(conv_id as varchar) as file, turn as line from conversations),
  r as (select p.file, p.line, s.name, row_number() over (partition by p.file, p.line order by s."end" - s.start, s.seq, s.name) as k
        from p join s on p.file = s.file and p.line between s.start and s."end") select file, line, name from r where k = 1"""
)
def innermost_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest span of turns around every turn."""
    views(spark, sf_dir, "conversations")
    spans = spark.sql(_SPANS.replace('"end"', "`end`").replace("varchar(20)", "string"))
    points = spark.sql("select cast(conv_id as string) as file, turn as line, conv_id * 1000 + turn as point_id from conversations").distinct()
    return resolution.innermost(points, spans).select("file", "line", "name")


@query(
    """with o as (select conv_id, turn, turn + 2 as upto from conversations where role = 'user')
  select cast(o.conv_id as varchar) as file, o.turn as outer_id, min(c.turn) as seq from o join conversations c
  on o.conv_id = c.conv_id and c.turn between o.turn and o.upto and c.role <> 'user' group by o.conv_id, o.turn"""
)
def first_initialiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer within two turns of every question, as an initialiser within its variable."""
    views(spark, sf_dir, "conversations")
    outer = spark.sql("select cast(conv_id as string) as file, turn as outer_id, turn as start, turn + 2 as end from conversations where role = 'user'")
    inner = spark.sql("select cast(conv_id as string) as file, turn as seq, turn as start, turn as end, text as value from conversations where role <> 'user'")
    return resolution.first_contained(outer, inner).select("file", "outer_id", "seq")


_FILES = "select 'n' || s_nationkey || '/s' || (s_suppkey % 40) || case when s_suppkey % 3 = 0 then '/__init__.py' else '.py' end as file from supplier group by 1"
_WANTED = "select 's' || n_nationkey as module from nation union all select 'n' || (n_nationkey % 25) || '.s' || (n_nationkey + 7) from nation union all select 'none' || n_nationkey from nation"


@query(
    f"""with f as ({_FILES}), w as ({_WANTED}),
  t as (select module, 0 as tier, replace(module, '.', '/') || '.py' as suffix from w union all select module, 1, replace(module, '.', '/') || '/__init__.py' from w),
  m as (select module, tier, count(*) as n, min(file) as file from t join f on file = suffix or ends_with(file, '/' || suffix) group by module, tier),
  b as (select *, row_number() over (partition by module order by tier) as k from m)
  select w.module, case when b.n is null then 'unresolved' when b.n > 1 then 'ambiguous' else 'declared' end as status, case when b.n = 1 then b.file end as file
  from w left join b on w.module = b.module and k = 1"""
)
def suffix_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted modules to the one file that ends in them."""
    views(spark, sf_dir, "supplier", "nation")
    return resolution.suffix_modules(spark.sql(_WANTED), spark.sql(_FILES))


_IMPORTS = "select 'r' || (c_nationkey % 5) || '/n' || c_nationkey || '/c.ts' as file, case c_custkey % 3 when 0 then '@/x' || c_custkey when 1 then '@/lib/y' || c_custkey else './z' end as specifier from customer"
_ALIASES = "select '' as dir, '@' as alias, 'src' as target union all select 'r' || r_regionkey, '@', 'r' || r_regionkey || '/src' from region where r_regionkey < 3 union all select 'r1', '@/lib', 'shared/lib'"


@query(
    f"""with i as ({_IMPORTS}), a as ({_ALIASES}), d as (select distinct file, specifier from i),
  m as (select d.*, a.dir, a.alias, a.target, row_number() over (partition by file, specifier order by length(dir) desc, length(alias) desc, alias) as k
        from d join a on (dir = '' or starts_with(file, dir || '/')) and (specifier = alias or starts_with(specifier, alias || '/')))
  select i.file, i.specifier, coalesce(m.target || substr(i.specifier, length(m.alias) + 1), i.specifier) as resolved
  from i left join m on i.file = m.file and i.specifier = m.specifier and k = 1"""
)
def alias_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifiers by the nearest build alias."""
    views(spark, sf_dir, "customer", "region")
    return resolution.nearest_alias(spark.sql(_IMPORTS), spark.sql(_ALIASES))


@query(
    """with n as (select 'c' || c_custkey as file, 'x' as name, c_nationkey as k from customer), x as (select n_nationkey, n_regionkey from nation)
  select file, name, case when k % 7 = 0 then 'ambiguous' when n_regionkey = 4 then 'unresolved' else 'declared' end as status,
         case when k % 7 <> 0 and n_regionkey <> 4 then 'r' || n_regionkey end as declared_in from n join x on k = n_nationkey"""
)
def reexport_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers import from nations, which re-export from regions; one region declares nothing, some nations re-export twice."""
    views(spark, sf_dir, "customer", "nation", "region")
    names = spark.sql("select 'c' || c_custkey as file, 'x' as name from customer")
    exports = spark.sql(
        """select 'c' || c_custkey as file, 'x' as name, 'n' || c_nationkey as to_file, 'x' as to_name from customer
        union all select 'n' || n_nationkey, 'x', 'r' || n_regionkey, 'x' from nation
        union all select 'n' || n_nationkey, 'x', 'elsewhere', 'x' from nation where n_nationkey % 7 = 0"""
    )
    declared = spark.sql("select 'r' || r_regionkey as file, 'x' as name from region where r_regionkey <> 4")
    return resolution.follow(names, declared, exports).select("file", "name", "status", "declared_in")


@query(
    """select 'r' || r_regionkey as router, 'known' as status, '/r' || r_regionkey as prefix from region
  union all select 'n' || n_nationkey, case when n_nationkey % 5 = 3 then 'unresolved: prefix is not a literal' else 'known' end,
    case when n_nationkey % 5 <> 3 then '/r' || n_regionkey || '/v1' || '/n' || n_nationkey end from nation
  union all select 'c' || c_custkey, case when n_nationkey % 5 = 3 then 'unresolved: prefix is not a literal' else 'known' end,
    case when n_nationkey % 5 <> 3 then '/r' || n_regionkey || '/v1' || '/n' || n_nationkey || '/c' end from customer join nation on c_nationkey = n_nationkey
  union all select 's' || s_suppkey, 'ambiguous', null from supplier"""
)
def prefix_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routers of customers below nations below regions; suppliers are mounted twice."""
    views(spark, sf_dir, "customer", "nation", "region", "supplier")
    routers = spark.sql(
        """select 'r' || r_regionkey as router, '/r' || r_regionkey as prefix, false as prefix_unresolved from region
        union all select 'n' || n_nationkey, '/n' || n_nationkey, n_nationkey % 5 = 3 from nation
        union all select 'c' || c_custkey, '/c', false from customer union all select 's' || s_suppkey, null, false from supplier"""
    )
    mounts = spark.sql(
        """select 'n' || n_nationkey as child, 'r' || n_regionkey as parent, '/v1' as prefix, false as prefix_unresolved from nation
        union all select 'c' || c_custkey, 'n' || c_nationkey, null, false from customer
        union all select 's' || s_suppkey, 'n' || s_nationkey, null, false from supplier union all select 's' || s_suppkey, 'r0', null, false from supplier"""
    )
    return resolution.compose_prefixes(routers, mounts).select("router", "status", "prefix")


@query(
    """select c_custkey as id, case when n_regionkey = 2 then '{env:API}' else '/r' || n_regionkey end || '/n' || n_nationkey || '/c' || case when c_custkey % 4 = 0 then '{unknown}' else '' end as shown,
  case when n_regionkey <> 2 and c_custkey % 4 <> 0 then '/r' || n_regionkey || '/n' || n_nationkey || '/c' end as value from customer join nation on c_nationkey = n_nationkey"""
)
def url_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of customers through two levels of constants; one region's base is an environment variable."""
    views(spark, sf_dir, "customer", "nation")
    part = lambda kind, text: f"named_struct('kind', '{kind}', 'text', {text})"
    values = spark.sql(
        f"""select c_custkey as id, 'n' || c_nationkey as file, case when c_custkey % 4 = 0 then array({part("ref", "'PATH'")}, {part("literal", "'/c'")}, {part("ref", "'missing'")})
        else array({part("ref", "'PATH'")}, {part("literal", "'/c'")}) end as parts from customer"""
    )
    bindings = spark.sql(
        f"""select 'n' || n_nationkey as file, 'PATH' as name, 1 as seq, array({part("ref", "'BASE'")}, {part("literal", "'/n' || n_nationkey")}) as parts from nation
        union all select 'n' || n_nationkey, 'BASE', 0, array({part("literal", "'/old'")}) from nation
        union all select 'n' || n_nationkey, 'BASE', 2, case when n_regionkey = 2 then array({part("env", "'API'")}) else array({part("literal", "'/r' || n_regionkey")}) end from nation"""
    )
    return resolution.fold(values, bindings).select("id", "shown", "value")


@query("select p_name as name, count(*) as declared from part group by p_name having count(*) > 1")
def name_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that are declared more than once, as models."""
    views(spark, sf_dir, "part")
    return orm.models(spark.sql("select cast(p_partkey as string) as file, p_name as name, p_size as line, array('Base') as bases, p_type as table from part"))[1]


_CALLS = """select 'f' || (o_custkey % 60) as file, cast(o_orderkey as int) as line, case when o_orderkey % 4 = 0 then null else 'fn' || (o_orderkey % 9) end as enclosing,
  'M' || (o_orderkey % 50) as root, case when o_orderstatus = 'F' then 'objects.filter' when o_orderstatus = 'P' then '' when o_orderkey % 3 = 0 then 'objects.create'
  when o_orderkey % 3 = 1 then 'objects.save' else 'get' end as rest, o_orderkey % 4 as way from orders"""
#: A name of a model leads to models.py through three of four files' imports; in the others nothing binds it, or it leads elsewhere.
_BOUND = """select distinct 'f' || (o_custkey % 60) as file, 'M' || (o_orderkey % 50) as name, case when o_custkey % 60 % 5 = 1 then 'ambiguous' else 'declared' end as status,
  case when o_custkey % 60 % 5 = 2 then 'views.py' when o_custkey % 60 % 5 <> 1 then 'models.py' end as declared_in from orders where o_custkey % 60 % 5 <> 3"""
_ACCESS = f"""with c as ({_CALLS}), v as (select distinct 'f' || (s_suppkey % 60) as file, 'M' || s_nationkey as root from supplier), k as (select 'M' || n_nationkey as root from nation),
  a as (select c.*, case rest when 'objects.filter' then 'query' when '' then 'persist' when 'objects.create' then 'persist' end as access from c join k on c.root = k.root
        where cast(substr(c.file, 2) as int) % 5 not in (1, 2) and not exists (select 1 from v where v.file = c.file and v.root = c.root)) """


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders", "supplier", "nation")
    calls = spark.sql(f"select *, split(case when rest = '' then root else concat(root, '.', rest) end, '[.]') as path from ({_CALLS})")
    known = spark.sql("select 'M' || n_nationkey as name, 'models.py' as file from nation")
    return orm.accesses(calls, known, spark.sql("select 'f' || (s_suppkey % 60) as file, 'M' || s_nationkey as name from supplier"), spark.sql(_BOUND))


@query(_ACCESS + "select file, line, root, access from a where access is not null")
def anti_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses of models, but for files that shadow the model's name or whose imports lead elsewhere."""
    return _accesses(spark, sf_dir).select("file", "line", "root", "access")


@query(_ACCESS + "select file, enclosing, root as model, min(line) as line from a where access is not null and enclosing is not null group by file, enclosing, root")
def access_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One access edge for each function and model."""
    return orm.access_edges(_accesses(spark, sf_dir)).select("file", "enclosing", "model", "line")


@query(
    """select 'u' || (user_id % 50) as caller, event_type as callee, min(cast(event_id as int)) as line from events
  where 'u' || (user_id % 50) <> event_type group by 1, 2"""
)
def call_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct calls at their first site."""
    views(spark, sf_dir, "events")
    calls = spark.sql("select 'u' || (user_id % 50) as caller, event_type as callee, 'f' as file, cast(event_id as int) as line, event_id as seq from events")
    return orm.call_edges(calls).select("caller", "callee", "line")


@query(
    """select 'r1' as name union all select 'n' || n_nationkey from nation where n_regionkey = 1
  union all select 'c' || c_custkey from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1"""
)
def requester_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that reach a requester: nations call regions, customers call nations."""
    views(spark, sf_dir, "customer", "nation")
    calls = spark.sql("select 'n' || n_nationkey as caller, 'r' || n_regionkey as callee from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer")
    return orm.reaching(calls, spark.sql("select 'r1' as name"))


@query(
    """select 'f' || n_nationkey || '.py' as file, 'router' as name, case when n_nationkey % 4 = 3 then 'unresolved: included with a prefix that is not a literal' when n_nationkey % 4 = 2 then 'ambiguous' else 'known' end as status,
    case when n_nationkey % 4 = 0 then '/api' || '/v' || n_regionkey || '/n' || n_nationkey when n_nationkey % 4 = 1 then '/n' || n_nationkey end as prefix from nation
  union all select 'main.py', 'app', 'known', '/api'"""
)
def router_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's file declares a ``router`` of its own, which main.py's or its package's app may include by import; names alone would mix them up."""
    views(spark, sf_dir, "nation")
    routers = spark.sql("select 'f' || n_nationkey || '.py' as file, 'router' as name, '/n' || n_nationkey as prefix, false as prefix_unresolved from nation union all select 'main.py', 'app', '/api', false")
    mounts = spark.sql(
        """select 'p' || n_nationkey || '.py' as file, 'router' as child, 'app' as parent, case when n_nationkey % 4 < 3 then '/v' || n_regionkey end as prefix, n_nationkey % 4 = 3 as prefix_unresolved
        from nation where n_nationkey % 4 <> 1
        union all select 'p' || n_nationkey || '.py', 'router', 'app', '/again', false from nation where n_nationkey % 4 = 2
        union all select 'p' || n_nationkey || '.py', 'stranger', 'app', '/no', false from nation"""
    )
    bound = spark.sql(
        """select 'p' || n_nationkey || '.py' as file, 'router' as name, 'declared' as status, 'f' || n_nationkey || '.py' as declared_in from nation
        union all select 'p' || n_nationkey || '.py', 'app', 'declared', 'main.py' from nation"""
    )
    return resolution.project_prefixes(routers, mounts, bound).select("file", "name", "status", "prefix")


_CLASSES = """select 'm' || n_nationkey || '.py' as file, 'C' || n_nationkey as name, case when n_nationkey % 3 = 0 then 'sqlalchemy' when n_nationkey % 3 = 1 then 'django' else 'model' end as flavour, 10 as start, 30 as end from nation"""


@query(
    """select 'C' || n_nationkey as name, case when n_nationkey % 3 < 2 and n_regionkey < 3 then 't' || n_nationkey end as "table",
  case when n_nationkey % 3 = 2 then 'table not resolved: the ORM this class belongs to is not determined'
       when n_regionkey < 3 then case when n_nationkey % 3 = 0 then '__tablename__' else 'db_table' end || ' = "t' || n_nationkey || '"'
       when n_regionkey = 3 then 'table not resolved: ' || case when n_nationkey % 3 = 0 then '__tablename__' else 'db_table' end || ' is not a string literal'
       when n_nationkey % 3 = 0 then 'table not resolved: no __tablename__' else 'table not resolved: no Meta.db_table; the default needs the app label' end as table_reason from nation"""
)
def table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that classes state: in themselves or in a nested Meta, as a literal or not, or not at all; another class's Meta is no answer."""
    views(spark, sf_dir, "nation")
    classes = spark.sql(_CLASSES)
    symbols = spark.sql(
        """select 'm' || n_nationkey || '.py' as file, 'variable' as kind, case when n_nationkey % 3 = 0 then '__tablename__' else 'db_table' end as name,
               case when n_nationkey % 3 = 1 then 'Meta' else 'C' || n_nationkey end as enclosing, 12 as start, 12 as end from nation where n_regionkey < 4
        union all select 'm' || n_nationkey || '.py', 'class', 'Meta', 'C' || n_nationkey, 11, 13 from nation
        union all select 'm' || n_nationkey || '.py', 'variable', 'db_table', 'Meta', 52, 52 from nation
        union all select 'm' || n_nationkey || '.py', 'class', 'Meta', 'Other', 51, 53 from nation"""
    )
    strings = spark.sql(
        """select 'm' || n_nationkey || '.py' as file, 12 as line, 0 as seq, 't' || n_nationkey as value from nation where n_regionkey < 3
        union all select 'm' || n_nationkey || '.py', 52, 0, 'other' from nation"""
    )
    return orm.declared_tables(classes, symbols, strings).select("name", "table", "table_reason")


@query("select 'M' || p_partkey as model, 't' || (p_partkey % 50) as \"table\", p_size as line from part where p_partkey % 4 <> 0")
def model_table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each model to the table it states."""
    views(spark, sf_dir, "part")
    known = spark.sql("select 'm.py' as file, 'M' || p_partkey as name, p_size as line, case when p_partkey % 4 <> 0 then 't' || (p_partkey % 50) end as table from part")
    return orm.table_edges(known).select("model", "table", "line")


@query(
    """select p_partkey as id, case p_partkey % 5 when 0 then 'django' when 1 then 'sqlalchemy' when 2 then 'sqlalchemy' when 3 then 'model' end as flavour from part"""
)
def base_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ORM that a class's bases tell, by the order of evidence."""
    views(spark, sf_dir, "part")
    bases = "case p_partkey % 5 when 0 then array('Mixin', 'models.Model') when 1 then array('Base') when 2 then array('db.Model', 'Model') when 3 then array('Model') else array('object') end"
    rows = spark.sql(f"select p_partkey as id, {bases} as bases from part")
    return rows.select("id", orm.model_base(rows["bases"]).alias("flavour"))
