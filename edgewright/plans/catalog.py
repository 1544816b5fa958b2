"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.functions import paths as P
from edgewright.operators import canonical, evaluation, graph, matching, report
from edgewright.plans import observations as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- paths and canonical routes

_URL_PARTS = r"""
with u as (select page_id, url, regexp_extract(url, '^([A-Za-z0-9+.\-]+)://([^/]*)(.*)$', 1) as sc,
  regexp_extract(url, '^([A-Za-z0-9+.\-]+)://([^/]*)(.*)$', 2) as au,
  case when regexp_matches(url, '^[A-Za-z0-9+.\-]+://') then regexp_extract(url, '^([A-Za-z0-9+.\-]+)://([^/]*)(.*)$', 3) else url end as rest from pages),
p as (select *, split_part(split_part(rest, '#', 1), '?', 1) as path, split_part(rest, '#', 1) as noflag from u)
"""


@query(
    _URL_PARTS
    + r"""select page_id, case when sc <> '' then lower(sc) end as scheme, case when sc <> '' then au end as authority, path,
  case when strpos(rest, '#') > 0 then substr(rest, strpos(rest, '#') + 1) end as fragment,
  case when strpos(noflag, '?') > 0 then substr(noflag, strpos(noflag, '?') + 1) end as query,
  (length(path) > 1 and path like '%/') as trailing_slash,
  cast(len(list_filter(string_split(path, '/'), lambda x: x <> '')) as bigint) as arity,
  array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '|') as segments from p"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme, authority, query, fragment, segments and trailing slash of every page's URL."""
    rest = P.after_authority(F.col("url"))
    path = P.plain_path(rest)
    return _read(spark, sf_dir, "pages").select(
        "page_id",
        P.scheme(F.col("url")).alias("scheme"),
        P.authority(F.col("url")).alias("authority"),
        path.alias("path"),
        P.fragment(rest).alias("fragment"),
        P.query(rest).alias("query"),
        P.trailing_slash(path).alias("trailing_slash"),
        F.size(P.segments(path)).cast("long").alias("arity"),
        F.array_join(P.segments(path), "|").alias("segments"),
    )


@query(
    """select page_id, method, case when upper(method) in ('GET','POST','PUT','PATCH','DELETE','HEAD','OPTIONS') then upper(method) end as verb
    from (select page_id, case page_id % 5 when 0 then 'get' when 1 then 'Post' when 2 then 'TRACE' when 3 then 'delete' end as method from pages)"""
)
def method_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method names to verbs."""
    k = F.col("page_id") % 5
    method = F.when(k == 0, "get").when(k == 1, "Post").when(k == 2, "TRACE").when(k == 3, "delete")
    return _read(spark, sf_dir, "pages").select("page_id", method.alias("method"), P.parse_method(method).alias("verb"))


_DECLARED_ROUTES = """select cast(s_suppkey as bigint) as route_id, concat('r', s_suppkey % 3, '.py') as file, 'python' as language, cast(s_suppkey as int) as line,
  case when s_suppkey % 6 in (1, 2) then 'url-conf-entry' else 'decorator' end as style, array('get') as methods, case when s_suppkey % 6 = 5 then 'dynamic' else 'literal' end as path_kind,
  case s_suppkey % 6 when 0 then concat('/s', s_suppkey, '/{id}') when 1 then concat('files/', s_suppkey, '/<path:rest>') when 2 then '^x/(y)$' when 3 then concat('/a//', s_suppkey, '/:id/') when 4 then concat('/w/', s_suppkey, '/**') end as path_value,
  cast(null as array<struct<kind:string,value:string,source:string>>) as path_parts, 'app' as receiver, 'h' as handler from supplier"""


@query(
    """select s_suppkey as route_id, case s_suppkey % 6 when 0 then '/s' || s_suppkey || '/{*}' when 1 then '/files/' || s_suppkey || '/{**}' when 3 then '/a/' || s_suppkey || '/{*}/' when 4 then '/w/' || s_suppkey || '/{**}' else '/' end as shape,
  case when s_suppkey % 6 in (2, 5) then 'unsupported' else 'exact' end as status from supplier"""
)
def route_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape and status of the routes that suppliers declare in five dialects, the refused ones too."""
    _read(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    rows = canonical.canonical_routes(spark.sql(_DECLARED_ROUTES))
    return rows.select("route_id", P.shape(F.col("segments"), F.col("trailing_slash")).alias("shape"), "status")


_CLIENTS = f"""
clients as ({O.CLIENTS_SQL}),
c0 as (select *, case when upper(method) in ('GET','POST','PUT') then upper(method) end as m,
  regexp_matches(url, '^[A-Za-z0-9+.\\-]+://') as absolute, split_part(split_part(url, '#', 1), '?', 1) as path from clients),
c as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as s, (length(path) > 1 and path like '%/') as slash from c0),
"""
#: Each route as a predicate on a client's segments: (id, display, methods, test, static matches, path, slash).
_R = (
    (1, "/orders/{id}", "['GET']", "len(s)=2 and s[1]='orders'", 1, "parameter-bound"),
    (2, "/orders/{id}", "['POST']", "len(s)=2 and s[1]='orders'", 1, "parameter-bound"),
    (3, "/customers/{id}/orders", "['GET']", "len(s)=3 and s[1]='customers' and s[3]='orders'", 2, "parameter-bound"),
    (4, "/customers/{id}/orders/", "null", "len(s)=3 and s[1]='customers' and s[3]='orders'", 2, "parameter-bound"),
    (5, "/{name}", "null", "len(s)=1", 0, "parameter-bound"),
    (6, "/files/{rest...}", "['GET']", "len(s)>=2 and s[1]='files'", 1, "wildcard-suffix"),
    (8, "/customers/{key}/orders", "['PUT']", "len(s)=3 and s[1]='customers' and s[3]='orders'", 2, "parameter-bound"),
    (9, "/suppliers/list", "['GET']", "len(s)=2 and s[1]='suppliers' and s[2]='list'", 2, "exact-static"),
    (10, "/suppliers/{key}", "['GET','HEAD']", "len(s)=2 and s[1]='suppliers'", 1, "parameter-bound"),
)
_BASE = {"exact-static": 0.98, "parameter-bound": 0.90, "wildcard-suffix": 0.65}
_PAIRS = " union all ".join(
    f"""select client_id, {i} as route_id, '{show}' as route, '{path}' as path, {static} > 0 as discriminating,
    case when m is not null and {ms} is not null then cast({_BASE[path]} as float) else cast(cast({_BASE[path]} as float) * cast(0.8 as float) as float) end as confidence,
    (m is not null and {ms} is not null) as sure from c where not absolute and ({test}) and (m is null or {ms} is null or list_contains({ms}, m))"""
    for i, show, ms, test, static, path in _R
)
_MATCH = f"""
with {_CLIENTS} pairs as ({_PAIRS}),
ranked as (select *, row_number() over (partition by client_id order by confidence desc, route, route_id) as rank,
  max(confidence) over (partition by client_id) as best from pairs),
tied as (select client_id, count(*) as tied from ranked where abs(confidence - best) < 1.1920929e-7 group by client_id),
results as (select c.client_id, c.file, c.line,
  case when absolute then 'unsupported' when r.client_id is null then 'no-match' when not r.discriminating or t.tied > 1 then 'ambiguous'
       when r.path = 'exact-static' and r.sure then 'exact' else 'strong' end as status,
  r.route_id, r.route, r.confidence, case when absolute then 'client-targets-absolute-host' end as unsupported_reason
  from c left join ranked r on c.client_id = r.client_id and r.rank = 1 left join tied t on c.client_id = t.client_id)
"""


def _canonical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # The routes are those of ROUTES, a fixed few.
    return canonical.canonical_clients(matching.dealt(O.clients(spark, sf_dir))), F.broadcast(canonical.canonical_routes(O.routes(spark)))


def _decide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, r = _canonical(spark, sf_dir)
    return c, matching.decisions(c, matching.candidates(c, r))


@query(_MATCH + "select client_id, status, cast(route_id as bigint) as route_id, route, round(cast(confidence as double), 6) as confidence, unsupported_reason from results")
def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision for each client call."""
    _, results = _decide(spark, sf_dir)
    confidence = F.round(F.col("confidence").cast("double"), 6).alias("confidence")
    return results.select("client_id", "status", "route_id", "route", confidence, "unsupported_reason")


@query(_MATCH + "select status, count(*) as n from results group by status")
def match_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.count_by(_decide(spark, sf_dir)[1], "status")


@query(_MATCH + "select client_id, cast(route_id as bigint) as route_id, route, path, round(cast(confidence as double), 6) as confidence, cast(rank as bigint) as rank from ranked")
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all clients, ranked."""
    rows = matching.ranked(matching.candidates(*_canonical(spark, sf_dir)))
    return rows.select("client_id", "route_id", "route", "path", F.round(F.col("confidence").cast("double"), 6).alias("confidence"), F.col("rank").cast("long").alias("rank"))


@query(_MATCH + "select client_id, route from results where status = 'ambiguous'")
def ambiguous_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decide(spark, sf_dir)[1].where("status = 'ambiguous'").select("client_id", "route")


@query(_MATCH + "select unsupported_reason, count(*) as n from results where unsupported_reason is not null group by unsupported_reason")
def refusal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.count_by(_decide(spark, sf_dir)[1].where("unsupported_reason is not null"), "unsupported_reason")


@query(_MATCH + "select client_id, route_id::bigint as route_id from results where status in ('exact', 'strong')")
def accepted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.accepted(_decide(spark, sf_dir)[1]).select("client_id", "route_id")


@query(
    _MATCH
    + """, refused as (select *, row_number() over (partition by file order by line, client_id) as place from results
  where status in ('unsupported', 'ambiguous', 'no-match'))
  select file, client_id, status, cast(place as bigint) as place from refused where place <= 3"""
)
def top_k_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three refused clients of each file."""
    clients, results = _decide(spark, sf_dir)
    return report.top_refusals(results, clients).select("file", "client_id", "status", F.col("place").cast("long").alias("place"))


@query(
    r"""with h as (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="(/[^"]*)"', 1)) as href from pages)
    select page_id, href, count(*) as n from h group by page_id, href"""
)
def href_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local links of every page, as client observations."""
    found = F.explode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="(/[^"]*)"'), F.lit(1))).alias("href")
    return _read(spark, sf_dir, "pages").select("page_id", found).groupBy("page_id", "href").agg(F.count("*").alias("n"))


# ---- graph


@query(
    """select event_type as kind, cast(user_id as varchar) as name, min(event_id) as seq, cast(arg_min(event_id % 97, event_id) as bigint) as line
    from events group by event_type, user_id"""
)
def node_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First proposal of every node: event types and users as kinds and names."""
    rows = _read(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("name"), F.lit(None).cast("string").alias("file"),
        F.col("event_id").alias("seq"), (F.col("event_id") % 97).alias("line"),
    )
    return graph.node_identity(rows).select("kind", "name", "seq", "line")


@query("select user_id, event_type, min(event_id) as event_id from events group by user_id, event_type")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each user and event type: the first."""
    return graph.first_edges(_read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query(f"with e as ({O.EDGE_SQL}) select source, target, kind, row_number() over (order by kind, source, target, seq) - 1 as id from e")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges numbered in order without meeting in one task."""
    return graph.with_ids(O.edges(spark, sf_dir), "kind", "source", "target", "seq").select("source", "target", "kind", "id")


@query(f"with e as ({O.EDGE_SQL}) select target, kind from e where source = 105")
def neighbours_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours_out(O.edges(spark, sf_dir), 105).select("target", "kind")


@query(f"with e as ({O.EDGE_SQL}) select source, kind from e where target = 105")
def neighbours_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours_in(O.edges(spark, sf_dir), 105).select("source", "kind")


@query(f"with e as ({O.EDGE_SQL}), n as ({O.NODE_SQL}) select source, target, kind, 'target' as missing from e where target not in (select id from n)")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose end is no node: the orders, which are not among the nodes."""
    return graph.dangling(O.edges(spark, sf_dir), O.nodes(spark, sf_dir)).select("source", "target", "kind", "missing")


@query(
    f"""with e as ({O.EDGE_SQL}) select a.source as n0, a.target as n1, b.target as n2, c.target as n3
    from e a join e b on a.target = b.source join e c on b.target = c.source where a.kind = 'http-call' and b.kind = 'orm-access' and c.kind = 'queries'"""
)
def chain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a call, an access and a table."""
    return graph.chains(O.edges(spark, sf_dir))


@query(
    f"""with e as ({O.EDGE_SQL}), n as ({O.NODE_SQL}) select e.source, e.target, a.kind as from_language, b.kind as to_language
    from e join n a on a.id = e.source join n b on b.id = e.target where a.kind <> b.kind"""
)
def cross_language_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between files of different languages: kinds stand for both here."""
    nodes = O.nodes(spark, sf_dir)
    files = nodes.select(F.col("kind").alias("file"), F.col("kind").alias("language")).distinct()
    rows = graph.cross_language(O.edges(spark, sf_dir), nodes.withColumn("file", F.col("kind")), files)
    return rows.select("source", "target", "from_language", "to_language")


_TRACE = f"""with recursive e as (select distinct source, target from ({O.EDGE_SQL} {{more}})),
w(path, node, depth, cycle) as (
  select [r_regionkey], cast(r_regionkey as bigint), 0, false from region where r_regionkey = 1
  union all
  select list_append(w.path, e.target), e.target, w.depth + 1, list_contains(w.path, e.target) from w join e on w.node = e.source
  where not w.cycle and w.depth < {{deep}})
select array_to_string(path, '>') as path, cast(depth as bigint) as depth, case when cycle then 'cycle'
  when node not in (select source from e) then 'chain-end' else 'max-depth' end as stop
from w where cycle or node not in (select source from e) or depth = {{deep}}"""


def _trace(spark: SparkSession, sf_dir: str, depth: int, back: bool) -> DataFrame:
    edges = O.edges(spark, sf_dir).select("source", "target")
    if back:
        edges = edges.union(spark.sql("select 100 + n_nationkey, n_regionkey from nation where n_nationkey < 10"))
    rows = graph.trace(edges.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")), spark.sql("select cast(1 as bigint) as node"), depth)
    return rows.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.col("depth").cast("long").alias("depth"), "stop")


@query(_TRACE.format(more="", deep=10))
def trace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths from one region to their ends."""
    return _trace(spark, sf_dir, 10, False)


@query(_TRACE.format(more="union all select 100 + n_nationkey, n_regionkey, 'back', 0 from nation where n_nationkey < 10", deep=10))
def cycle_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that come back to a node end there."""
    return _trace(spark, sf_dir, 10, True)


@query(_TRACE.format(more="", deep=2))
def max_depth_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths cut at a depth of two."""
    return _trace(spark, sf_dir, 2, False)


@query(
    f"""with e as ({O.EDGE_SQL}), h1 as (select distinct target as node from e where source = 1),
    h2 as (select distinct target as node from e where source in (select node from h1))
    select 1::bigint as node, 0::bigint as distance union all select node, 1 from h1 union all select node, 2 from h2"""
)
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops of a region."""
    rows = graph.reachable(O.edges(spark, sf_dir), spark.sql("select cast(1 as bigint) as node"), 2)
    return rows.select("node", F.col("distance").cast("long").alias("distance"))


@query(f"with e as ({O.EDGE_SQL}) select kind, count(*) as n from e group by kind")
def count_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.count_by(O.edges(spark, sf_dir), "kind")


@query(
    _MATCH
    + f""", e as ({O.EDGE_SQL}), n as ({O.NODE_SQL}) select count(*) as clients, count(*) filter (status = 'exact') as exact, count(*) filter (status = 'strong') as strong,
  count(*) filter (status = 'ambiguous') as ambiguous, count(*) filter (status = 'no-match') as no_match, count(*) filter (status = 'unsupported') as unsupported,
  (select count(*) from n) as nodes, (select count(*) from e) as edges, (select count(distinct kind) from e) as edge_kinds from results"""
)
def totals_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counters of the whole analysis."""
    return report.totals(_decide(spark, sf_dir)[1], O.nodes(spark, sf_dir), O.edges(spark, sf_dir))


# ---- evaluation

_REC = f"with r as ({O.RECORDS_SQL}), "
_SUM = """count(*) as produced, count(*) filter (label = 'TRUE_POSITIVE') as true_positive, count(*) filter (label = 'FALSE_POSITIVE') as false_positive,
  count(*) filter (label = 'UNVERIFIABLE') as unverifiable"""
_FIG = """true_positive + false_positive as verified, round(unverifiable / nullif(produced, 0), 4) as unverifiable_share,
  round(true_positive / nullif(true_positive + false_positive, 0), 4) as observed_accuracy,
  case when v is not null then round(greatest(0.0, (ph + 1.96*1.96/(2*v)) / (1 + 1.96*1.96/v) - 1.96 * sqrt(ph*(1-ph)/v + 1.96*1.96/(4*v*v)) / (1 + 1.96*1.96/v)), 4) end as ci_low,
  case when v is not null then round(least(1.0, (ph + 1.96*1.96/(2*v)) / (1 + 1.96*1.96/v) + 1.96 * sqrt(ph*(1-ph)/v + 1.96*1.96/(4*v*v)) / (1 + 1.96*1.96/v)), 4) end as ci_high,
  true_positive + false_positive >= 30 as sample_adequate"""
_VP = "*, nullif(true_positive + false_positive, 0)::double as v, true_positive / nullif(true_positive + false_positive, 0)::double as ph"
_NAMES = "produced, true_positive, false_positive, unverifiable"


@query(_REC + f"g as (select kind, provenance, {_SUM} from r group by kind, provenance), h as (select {_VP} from g) select kind, provenance, {_NAMES}, {_FIG} from h")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, accuracy and Wilson interval by kind and provenance."""
    return evaluation.group_summary(O.records(spark, sf_dir), ["kind", "provenance"])


@query(_REC + f"g as (select confidence, {_SUM} from r group by confidence), h as (select {_VP} from g) select confidence, {_NAMES}, {_FIG} from h")
def by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.group_summary(O.records(spark, sf_dir), ["confidence"])


@query(
    _REC
    + f"""b as (select cast(range as int) as bin from range(10)), x as (select *, cast(least(floor(confidence / 0.1::double), 9) as int) as bin from r),
  g as (select b.bin, count(x.label) as produced, count(*) filter (label = 'TRUE_POSITIVE') as true_positive, count(*) filter (label = 'FALSE_POSITIVE') as false_positive,
  count(*) filter (label = 'UNVERIFIABLE') as unverifiable, round(avg(confidence), 4) as mean_confidence from b left join x on b.bin = x.bin group by b.bin),
  h as (select {_VP} from g) select bin, {_NAMES}, mean_confidence, {_FIG} from h"""
)
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equal widths of confidence, empty ones too."""
    return evaluation.reliability_bins(O.records(spark, sf_dir))


@query(
    _REC
    + """g as (select confidence, count(*) as n, avg(case when label = 'TRUE_POSITIVE' then 1.0 else 0.0 end) as a from r where label <> 'UNVERIFIABLE' group by confidence)
  select round(sum(n * abs(a - confidence)) / sum(n), 4) as ece, round(max(abs(a - confidence)), 4) as mce, cast(sum(n) as bigint) as verified from g"""
)
def ece_mce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration errors."""
    return evaluation.calibration_error(O.records(spark, sf_dir))


_T = ", ".join(f"({t}::double)" for t in evaluation.THRESHOLDS)


@query(
    _REC
    + f"""t(threshold) as (values {_T}), a as (select count(*) filter (label = 'TRUE_POSITIVE') as tp, count(*) filter (label <> 'UNVERIFIABLE') as v from r),
  k as (select threshold, count(*) filter (confidence >= threshold and label = 'TRUE_POSITIVE') as tp, count(*) filter (confidence >= threshold and label = 'FALSE_POSITIVE') as fp from t, r group by threshold)
  select threshold, k.tp + k.fp as kept, round((k.tp + k.fp) / v::double, 4) as coverage_of_verified, round(k.tp / nullif(k.tp + k.fp, 0)::double, 4) as precision,
  round(k.tp / a.tp::double, 4) as retained_true_positives, k.fp as false_positives_admitted from k, a"""
)
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and coverage as the threshold rises."""
    return evaluation.threshold_curve(O.records(spark, sf_dir))


@query(
    _REC
    + """g as (select kind, count(*) filter (label = 'TRUE_POSITIVE') as tp, count(*) filter (label = 'FALSE_POSITIVE') as fp, count(*) filter (label = 'UNVERIFIABLE') as fn from r group by kind),
  h as (select *, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall from g)
  select *, case when precision > 0 and recall > 0 then 2 * precision * recall / (precision + recall) end as f1 from h"""
)
def pr_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 by kind."""
    outcome = F.when(F.col("label") == evaluation.TP, "tp").when(F.col("label") == evaluation.FP, "fp").otherwise("fn")
    return evaluation.precision_recall(O.records(spark, sf_dir).withColumn("outcome", outcome), ["kind"])


@query(
    _REC
    + """h as (select doc_id, ('0x' || substr(sha256(kind || '|' || provenance || '|' || doc_id), 1, 8))::bigint % 4 = 0 as held_out from r) select * from h"""
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split by hash."""
    return O.records(spark, sf_dir).select("doc_id", evaluation.holdout(F.col("kind"), F.col("provenance"), F.col("doc_id").cast("string")).alias("held_out"))


_STRIDE = """x as (select doc_id, kind, row_number() over ({part} order by doc_id) - 1 as i, count(*) over ({part}) as n from r),
  j as (select unnest(range(0, 25)) as j) select distinct doc_id, kind from x, j where n <= 25 or i = cast(floor(j * (n / 25.0::double)) as bigint)"""


@query(_REC + _STRIDE.format(part=""))
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 evenly spaced records."""
    return evaluation.stride_sample(O.records(spark, sf_dir), 25, ["doc_id"]).select("doc_id", "kind")


@query(_REC + _STRIDE.format(part="partition by kind"))
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 evenly spaced records of each kind."""
    return evaluation.stride_sample(O.records(spark, sf_dir), 25, ["doc_id"], ["kind"]).select("doc_id", "kind")


@query(
    """select c_nationkey as nation, 'declared-only' as side from (select c_nationkey from customer where c_acctbal > 9900 except select s_nationkey from supplier where s_acctbal > 8000)
  union all select s_nationkey, 'scored-only' from (select s_nationkey from supplier where s_acctbal > 8000 except select c_nationkey from customer where c_acctbal > 9900)"""
)
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of rich customers and of rich suppliers, where they differ."""
    c = _read(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
    s = _read(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("nation"))
    return evaluation.set_difference(c, s)


@query(_REC + "h as (select * from r) select cast(round(confidence * 100) as int) as confidence_pct, count(*) as n from h group by 1")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.confidence_histogram(O.records(spark, sf_dir))
