"""One run from source files to an evidenced graph: facts, names, routes, requests, matches, calls, models, and the counters of it all."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright import schemas
from edgewright.functions import paths as P
from edgewright.operators import canonical, extract, linking, matching, modules, orm, report, resolution, tokens
from edgewright.operators.graph import cross_language, with_ids
from edgewright.operators.rounds import kept

SCHEMA_VERSION = "1.0"
_PARTS = "array<struct<kind:string,text:string>>"


class Run(NamedTuple):
    """Tables of a run; nodes (id, kind, name, file, line), edges (id, source, target, kind, confidence, provenance, evidence, file, line)."""

    files: DataFrame
    symbols: DataFrame
    routes: DataFrame
    clients: DataFrame
    results: DataFrame
    models: DataFrame
    nodes: DataFrame
    edges: DataFrame
    totals: DataFrame


def _part(source: Column) -> Column:
    """An expression as a part: a quoted text, a variable of the environment, a name, or what is none of these."""
    quoted, env = P.quoted_literal(source), P.environment_variable(source)
    kind = F.when(quoted.isNotNull(), "literal").when(env.isNotNull(), "env").when(P.plain_identifier(source), "ref").otherwise("unknown")
    return F.struct(kind.alias("kind"), F.coalesce(quoted, env, source).alias("text"))


def _template(parts: Column) -> Column:
    text = lambda p: F.struct(F.lit("literal").alias("kind"), p["value"].alias("text"))
    return F.transform(parts, lambda p: F.when(p["kind"] == "text", text(p)).otherwise(_part(p["source"])))


def constants(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name, seq, parts, exported) of module variables by the first string, template or chain of ``+`` of their declaration behind their name."""
    facts = found.where("kind in ('string', 'template') and not decorator and not header").select("file", "stmt", "seq", F.when(F.col("kind") == "string", F.array(F.struct(F.lit("literal").alias("kind"), F.col("value").alias("text")))).otherwise(_template(F.col("parts"))).alias("parts"))
    chains = extract.concatenations(found)
    stmts = found.select("file", "seq", "stmt")
    joined = chains.join(stmts, ["file", "seq"]).select("file", "stmt", "seq", F.transform("parts", lambda p: F.when(p["kind"] == "literal", F.struct(F.lit("literal").alias("kind"), p["value"].alias("text"))).otherwise(_part(p["value"]))).alias("parts"))
    own = symbols.where("kind = 'variable' and enclosing is null").select("file", "stmt", "name", "exported")
    names = found.where("kind = 'name'").select("file", "stmt", F.col("text").alias("name"), F.col("seq").alias("at")).groupBy("file", "stmt", "name").agg(F.min("at").alias("at"))
    met = own.join(names, ["file", "stmt", "name"]).join(facts.unionByName(joined), ["file", "stmt"]).where(F.col("seq") >= F.col("at"))
    first = met.groupBy("file", "stmt", "name", "exported").agg(F.min(F.struct("seq", -F.size("parts"), "parts")).alias("f"))
    return first.select("file", "name", F.col("stmt").alias("seq"), F.col("f.parts").cast(_PARTS).alias("parts"), "exported")


def analyse(files: DataFrame, aliases: DataFrame | None = None) -> Run:
    """Run over gated files (path, language, status, text). Build aliases are read from the files unless given.

    Refusals stay in ``results``. A node of one kind, name and file is one. Edges: a request to the route that serves it, a call towards a function that requests, a model to its table,
    a function to the model it uses. Tables that several steps read are written once to the shared folder.
    """
    found = tokens.tokens(files)
    symbols = kept(extract.with_exports(extract.symbols(found), found), "symbols")
    imports = kept(extract.imports(found).withColumn("seq", F.col("line")), "imports")
    aliases = kept(extract.build_aliases(found), "aliases") if aliases is None else aliases
    declared = symbols.where("enclosing is null and kind in ('class', 'function', 'variable')").select("file", "name", "line")
    scopes = symbols.where("kind in ('function', 'class', 'method')").select("file", F.col("stmt").alias("scope"), F.col("name").alias("enclosing"))
    paths = files.select(F.col("path").alias("file"))
    languages = files.select(F.col("path").alias("file"), "language")
    calls = kept(extract.calls(found).join(scopes, ["file", "scope"], "left").join(languages, "file"), "calls")

    made, put = (kept(x, "routers") for x in extract.routers(found))
    names = calls.select("file", F.col("root").alias("name")).unionByName(put.select("file", F.col("child").alias("name"))).unionByName(put.select("file", F.col("parent").alias("name")))
    bound = kept(modules.resolve_names(names, imports, declared, paths, aliases), "bound")
    leads = bound.withColumn("status", F.when(F.col("status") == "local", "declared").otherwise(F.col("status")))

    prefixes = kept(resolution.project_prefixes(made, put, leads.where("status = 'declared'")), "prefixes")
    declared_routes = kept(with_ids(extract.routes(found), "file", "seq", name="route_id"), "declared-routes")
    routes = resolution.composed_routes(declared_routes, prefixes)
    before = declared_routes.select("route_id", F.col("path_value").alias("__own"))
    routes = kept(routes.join(before, "route_id").withColumn("composed", ~F.col("path_value").eqNullSafe(F.col("__own"))).drop("__own"), "routes")

    requests = kept(with_ids(extract.http_calls(found).join(scopes, ["file", "scope"], "left"), "file", "seq", name="client_id"), "requests")
    own = constants(found, symbols)
    targets = modules.typescript_targets(imports.where("file not like '%.py'"), paths, aliases).where("target is not null").select("file", "specifier", "target")
    brought = imports.where("imported is not null and imported <> '*'").join(targets, ["file", "specifier"]).select("file", "local", "target", "imported")
    bindings = kept(linking.scopes(own, brought), "bindings")
    open_ = requests.where("url_kind <> 'literal'").select(F.col("client_id").alias("id"), "file", F.when(F.col("url_kind") == "template", _template(F.col("url_parts"))).otherwise(F.array(_part(F.col("url_source")))).cast(_PARTS).alias("parts"), "url_kind")
    folded = kept(resolution.evaluate(open_, bindings).join(open_.select("id", "url_kind"), "id"), "folded")
    # A name that leads nowhere stays the expression it is.
    shown = folded.where("url_kind = 'template' or verdict in ('resolved', 'environment')").select(F.col("id").alias("client_id"), linking.re_expressed(F.col("parts")).alias("u"))
    clients = requests.join(shown, "client_id", "left")
    pick = lambda c: F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(c)).alias(c)
    clients = kept(clients.select("client_id", "file", "language", "line", "seq", "enclosing", "method", pick("url_kind"), pick("url_value"), pick("url_parts")), "clients")

    canon, served = kept(canonical.canonical_clients(clients), "canonical-clients"), kept(canonical.canonical_routes(routes), "canonical-routes")
    pairs = kept(matching.candidates(canon.hint("merge"), served.hint("merge")), "pairs")  # both grow with the source
    results = kept(matching.decisions(canon, pairs), "results")
    good = matching.accepted(results).select("client_id", "route_id")
    told = matching.evidence(pairs.join(good, ["client_id", "route_id"], "left_semi"), canon, served).select("client_id", "route_id", "confidence", "evidence")
    at = routes.select("route_id", F.col("file").alias("to_file"), F.col("line").alias("to_line"), F.col("handler").alias("to_handler"))
    display = served.select("route_id", F.concat(P.show_methods(F.col("methods")), F.lit(" "), P.display(F.col("segments"), F.col("trailing_slash"), F.col("scheme"), F.col("authority"))).alias("shown"))
    met = told.join(clients.select("client_id", "file", "line", "seq", "enclosing"), "client_id").join(at, "route_id").join(display, "route_id")
    node = lambda kind, name, file: F.struct(kind.alias("kind"), name.alias("name"), file.alias("file"))
    inside = F.col("enclosing").isNotNull()
    http = met.select(
        F.lit("http-call").alias("kind"), node(F.when(inside, "function").otherwise("file"), F.coalesce("enclosing", "file"), F.col("file")).alias("source"), F.when(inside, F.col("line")).otherwise(1).alias("source_line"),
        node(F.when(F.col("to_handler").isNull(), "route").otherwise("function"), F.coalesce("to_handler", "shown"), F.col("to_file")).alias("target"), F.col("to_line").alias("target_line"),
        F.col("confidence").cast("float").alias("confidence"), F.lit("route-matcher").alias("provenance"), "evidence", "file", "line", F.col("seq").alias("order"), F.lit(0).alias("phase"),
    )

    lines = symbols.where("kind in ('function', 'method', 'variable')").groupBy("file", "name").agg(F.min("line").alias("line"))
    steps = linking.resolved_calls(calls, leads)
    key = lambda file, name: F.concat(F.col(file), F.lit("#"), F.col(name))
    asking = requests.where("language <> 'python' and enclosing is not null").select(key("file", "enclosing").alias("name")).distinct()
    links = kept(steps.withColumns({"from": key("file", "caller"), "to": key("callee_file", "callee")}), "links")
    reach = orm.reaching(links.select(F.col("from").alias("caller"), F.col("to").alias("callee")), asking)
    direct = asking.withColumnRenamed("name", "to").withColumn("direct", F.lit(True))
    sites = links.join(reach.withColumnRenamed("name", "to"), "to", "left_semi").groupBy("from", "to", "file", "caller", "callee_file", "callee").agg(F.min(F.struct("line", "seq")).alias("s")).join(direct, "to", "left")
    sites = sites.join(lines.select("file", F.col("name").alias("caller"), F.col("line").alias("source_line")), ["file", "caller"]).join(lines.select(F.col("file").alias("callee_file"), F.col("name").alias("callee"), F.col("line").alias("target_line")), ["callee_file", "callee"])
    does = F.when(F.col("direct"), "issues an HTTP request").otherwise("reaches one through a call it makes")
    sure = F.lit(schemas.CONFIDENCE["static-import-resolution"]).cast("float")
    called = sites.select(
        F.lit("call").alias("kind"), node(F.lit("function"), F.col("caller"), F.col("file")).alias("source"), "source_line", node(F.lit("function"), F.col("callee"), F.col("callee_file")).alias("target"), "target_line", sure.alias("confidence"),
        F.lit("static-import-resolution").alias("provenance"), F.concat("caller", F.lit(" calls "), "callee", F.lit(" declared at "), "callee_file", F.lit(":"), F.col("target_line").cast("string"), F.lit(", which "), does).alias("evidence"), "file", F.col("s.line").alias("line"), F.col("s.seq").alias("order"), F.lit(1).alias("phase"),
    )

    spans = kept(extract.tables(extract.spans(symbols, found), found).where("language = 'python'"), "classes")
    models, twice = (kept(x, "models") for x in orm.models(spans.select("file", "name", F.col("start").alias("line"), "bases", "table")))
    variables = symbols.where("kind = 'variable'").select("file", "name")
    prior = F.lit(schemas.CONFIDENCE["static-import-resolution"]).cast("float")
    model_line = models.select(F.col("name").alias("root"), F.col("line").alias("target_line"))
    uses = orm.accesses(calls, models, variables, leads).where("enclosing is not null").join(model_line, "root")
    first = uses.groupBy("file", "enclosing", "root", "model_file", "target_line").agg(F.min(F.struct("line", "seq", "callee")).alias("s"))
    used = first.select(
        F.lit("orm-access").alias("kind"), node(F.lit("function"), F.col("enclosing"), F.col("file")).alias("source"), F.col("s.line").alias("source_line"), node(F.lit("class"), F.col("root"), F.col("model_file")).alias("target"), "target_line", prior.alias("confidence"),
        F.lit("orm-resolution").alias("provenance"), F.concat("s.callee", F.lit("(...) in "), "enclosing", F.lit(" at "), "file", F.lit(":"), F.col("s.line").cast("string")).alias("evidence"), "file", F.col("s.line").alias("line"), F.col("s.seq").alias("order"), F.lit(3).alias("phase"),
    )
    attribute = F.when(F.col("flavour") == "django", "db_table").otherwise("__tablename__")
    tabled = models.where("table is not null").select(
        F.lit("queries").alias("kind"), node(F.lit("class"), F.col("name"), F.col("file")).alias("source"), F.col("line").alias("source_line"), node(F.lit("table"), F.col("table"), F.lit(None).cast("string")).alias("target"), F.lit(None).cast("int").alias("target_line"), prior.alias("confidence"),
        F.lit("orm-resolution").alias("provenance"), F.concat("name", F.lit(' maps to table "'), "table", F.lit('"; '), attribute, F.lit(' = "'), "table", F.lit('"')).alias("evidence"), "file", "line", F.lit(0).alias("order"), F.lit(2).alias("phase"),
    )

    all_ = kept(http.unionByName(called).unionByName(tabled).unionByName(used), "edge-proposals")
    side = lambda end, role: all_.select(F.col(f"{end}.kind").alias("kind"), F.col(f"{end}.name").alias("name"), F.col(f"{end}.file").alias("file"), F.col(f"{end}_line").cast("int").alias("line"), F.struct("phase", F.col("file").alias("at"), "order", F.lit(role).alias("role")).alias("seq"))
    nodes, edges = linking.assembled([side("source", 0), side("target", 1)], [all_])
    nodes = kept(nodes.select("id", "kind", "name", "file", "line"), "nodes")
    edges = with_ids(edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind", "confidence", "provenance", "evidence", "file", "line", "phase", "order"), "phase", "file", "order", "source", "target")
    edges = kept(edges.select("id", "source", "target", "kind", "confidence", "provenance", "evidence", "file", "line"), "edges")
    cross = cross_language(edges, nodes, languages).select("id").withColumn("cross", F.lit(True))
    told_edges = edges.join(cross, "id", "left").withColumn("cross", F.coalesce("cross", F.lit(False)))
    parts = folded.select(F.when(F.col("verdict") == "resolved", "resolved").when(F.col("url_kind") == "template", "partial").otherwise("none").alias("status"))
    totals = kept(report.run_totals(files, extract.diagnostic_places(found), symbols, routes, requests, results, parts, models, twice, nodes, told_edges), "totals")
    return Run(files, symbols, routes, clients, results, models, nodes, edges, totals)


def envelope(run: Run, command: str) -> DataFrame:
    """(json): one document of a run: version, command, counters, and nodes and edges in order of their ids; absent attributes are left out.

    A document of one text is for what a reader can hold; larger graphs are read as the tables they are.
    """
    listed = lambda rows, name: rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name))
    one = run.totals.select(F.struct(*run.totals.columns).alias("summary")).join(listed(run.nodes, "nodes")).join(listed(run.edges, "edges"))  # rows of one are paired
    return one.select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(command).alias("command"), "summary", "nodes", "edges")).alias("json"))
