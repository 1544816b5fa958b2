"""Queries of ground-truth scoring and audits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators import evaluation, groundtruth
from edgewright.plans import observations as O
from edgewright.plans.catalog import query
from edgewright.plans.observations import views
from edgewright.plans.resolving import _ACCESS, _accesses

_AUDIT = """select o_orderkey as id, case when o_orderkey % 7 <> 0 then 0.9 end as confidence, case when o_orderstatus <> 'P' then o_orderstatus end as provenance,
  case when o_custkey % 5 <> 0 then 'seen' end as evidence, 'f' || o_custkey as file, cast(o_orderkey as int) as line from orders"""


@query(
    f"""with e as ({_AUDIT}) select id, concat_ws(',', case when confidence is null then 'confidence' end, case when provenance is null then 'provenance' end,
  case when evidence is null then 'evidence' end) as missing from e where confidence is null or provenance is null or evidence is null"""
)
def edge_attribute_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without a confidence, provenance or evidence."""
    views(spark, sf_dir, "orders")
    return groundtruth.edge_audit(spark.sql(_AUDIT)).select("id", F.array_join("missing", ",").alias("missing"))


@query("select l_orderkey, l_linenumber from lineitem where (l_partkey, l_suppkey) in (select p_partkey, p_partkey % 10 from part where p_size > 40)")
def must_not_produce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of pairs that are forbidden."""
    views(spark, sf_dir, "lineitem", "part")
    rows = spark.sql("select l_orderkey, l_linenumber, l_partkey as model, l_suppkey as file from lineitem")
    return groundtruth.must_not_produce(rows, spark.sql("select p_partkey as model, p_partkey % 10 as file from part where p_size > 40"), ["model", "file"]).select("l_orderkey", "l_linenumber")


_DECLARED = "select distinct 'f' || (o_custkey % 300) as file, cast(o_orderkey % 500 as int) as line from orders where o_orderstatus = 'F'"
_PRODUCED = "select distinct 'f' || (o_custkey % 300) as file, cast(o_orderkey % 500 as int) as line from orders where o_orderstatus <> 'F'"


@query(
    f"""with d as ({_DECLARED}), p as ({_PRODUCED}),
  m as (select d.*, p.line as produced_line, row_number() over (partition by d.file, d.line order by abs(p.line - d.line), p.line) as k from d join p on d.file = p.file and abs(p.line - d.line) <= 2)
  select d.file, d.line, case when m.produced_line = d.line then 'tp' when m.produced_line is not null then 'near' else 'fn' end as outcome, m.produced_line
  from d left join m on d.file = m.file and d.line = m.line and k = 1"""
)
def score_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared lines against produced ones, near misses told."""
    views(spark, sf_dir, "orders")
    return groundtruth.score_lines(spark.sql(_DECLARED), spark.sql(_PRODUCED))


@query(f"with d as ({_DECLARED}), p as ({_PRODUCED}) select file, line from p except select file, line from d")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return groundtruth.unmatched(spark.sql(_DECLARED), spark.sql(_PRODUCED))


@query(
    """with t as (select distinct 'GET' as method, '/n' || c_nationkey || '/{}' as key from customer), p as (select distinct 'GET' as method, '/n' || s_nationkey || '/{}' as key from supplier where s_acctbal > 5000)
  select count(*) as truth, count(p.key) as found, round(count(p.key) / count(*)::double, 4) as recall from t left join p on t.key = p.key"""
)
def request_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that were found, by erased path."""
    views(spark, sf_dir, "customer", "supplier")
    truth = spark.sql("select 'get' as method, '/n' || c_nationkey || '/:' || c_custkey || '?q' as path from customer")
    return groundtruth.request_recall(truth, spark.sql("select 'GET' as method, '/n' || s_nationkey || '/{id}' as path from supplier where s_acctbal > 5000"))


@query(
    """select c_custkey, case c_custkey % 6 when 0 then case when c_nationkey = 7 then 'agree' else 'disagree' end when 1 then 'agree' when 2 then 'undecided'
  when 3 then 'disagree' when 4 then 'undecided' else 'disagree' end as outcome from customer"""
)
def path_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labeller's own comparison: a route's parameter takes anything, an open segment against a literal decides nothing."""
    views(spark, sf_dir, "customer")
    rows = spark.sql(
        """select c_custkey, case c_custkey % 6 when 0 then array('n' || c_nationkey, '1') when 1 then array('{nation}', '1') when 2 then array(concat('$', '{x}'), '1')
          when 3 then array('n7') when 4 then array('n7', '{id}') else array('12', '34') end as c,
        case c_custkey % 6 when 1 then array(':nation', '{n}.json') when 4 then array('n7', 'orders') when 5 then array('12', '56') else array('n7', '<int:id>') end as r from customer"""
    )
    return rows.select("c_custkey", groundtruth.paths_agree(F.col("c"), F.col("r")).alias("outcome"))


@query(
    """select c_custkey, case c_custkey % 4 when 0 then '/n/12/{*}/' when 1 then '/a/{*}' when 2 then '/' else '/x/{*}' end as erased from customer"""
)
def labeller_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as the labeller erases them: digits are values, anything with a brace, < or : is open."""
    views(spark, sf_dir, "customer")
    path = """case c_custkey % 4 when 0 then '/n/12/<int:id>/' when 1 then 'https://h.example/a/{n}.json?q=1#f' when 2 then 'https://h.example' else concat('/x/v$', '{y}') end"""
    rows = spark.sql(f"select c_custkey, {path} as path from customer")
    return rows.select("c_custkey", groundtruth.canonical_key(F.col("path")).alias("erased"))


@query("""select count(*) as records, sha256('[' || string_agg('[' || n_nationkey || ',"' || n_name || '",' || (n_regionkey / 4.0::double) || ']', ',' order by n_nationkey) || ']') as digest from nation""")
def records_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of labelled records as compact JSON."""
    views(spark, sf_dir, "nation")
    return evaluation.records_digest(spark.sql("select n_nationkey as id, n_name as name, cast(n_regionkey / 4 as double) as confidence from nation"), ["id", "name", "confidence"], ["id"])


@query(
    _ACCESS
    + """, e as (select file, enclosing, root as model, min(line) as line from a where access is not null and enclosing is not null group by file, enclosing, root)
  select model, count(*) as accesses, string_agg(file || ':' || line || ' ' || enclosing, '; ' order by file, line, enclosing) as accessed_by from e group by model"""
)
def accessed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessors of each model."""
    from edgewright.operators import orm

    return groundtruth.accessed_by(orm.access_edges(_accesses(spark, sf_dir)))


@query(
    """with r as (select 'f' || (o_custkey % 50) as file, cast(o_orderkey as int) as line, o_orderstatus as reason from orders where o_orderstatus <> 'O'),
  p as (select 'f' || (c_custkey % 50) as file, c_custkey as point_id from customer where c_acctbal > 9000),
  m as (select p.*, r.line, r.reason, row_number() over (partition by p.file, p.point_id order by r.line, r.reason) as place from p join r on p.file = r.file)
  select point_id, line, reason, place from m where place <= 3"""
)
def refusals_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first refusals in the file where a trace broke off."""
    views(spark, sf_dir, "orders", "customer")
    refused = spark.sql("select 'f' || (o_custkey % 50) as file, cast(o_orderkey as int) as line, o_orderstatus as reason from orders where o_orderstatus <> 'O'")
    points = spark.sql("select 'f' || (c_custkey % 50) as file, c_custkey as point_id from customer where c_acctbal > 9000")
    return groundtruth.refusals_near(points, refused).select("point_id", "line", "reason", F.col("place").cast("long").alias("place"))


@query(
    """select n_nationkey as id, '{"id":' || n_nationkey || ',"name":"' || n_name || '"' || case when n_regionkey <> 2 then ',"region":' || n_regionkey else '' end || '}' as json from nation"""
)
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON, absent attributes left out."""
    views(spark, sf_dir, "nation")
    return groundtruth.as_json(spark.sql("select n_nationkey as id, n_name as name, case when n_regionkey <> 2 then n_regionkey end as region from nation"))


@query(f"with r as ({O.RECORDS_SQL}) select label, held_out, count(*) as n from (select label, ('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint % 4 = 0 as held_out from r) group by 1, 2")
def label_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by label and split."""
    held = evaluation.holdout(F.col("doc_id").cast("string")).alias("held_out")
    return O.records(spark, sf_dir).select("label", held).groupBy("label", "held_out").agg(F.count("*").alias("n"))
