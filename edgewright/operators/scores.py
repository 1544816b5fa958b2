"""Scores of produced edges against ground truth and source: declarations, accesses, recall of accesses and chains, and the integrity of a labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.operators import graph
from edgewright.operators.evaluation import group_summary, records_digest
from edgewright.operators.labelling import ACCESS_EVIDENCE

# Fixed values.
EDGE_KINDS = ("http-call", "orm-access", "queries", "call")
RECORD = ["repository", "kind", "at", "edge", "confidence", "provenance", "label", "split"]
HANDLER_LINES, BODY_LINES = 31, 80


def score_declarations(truth: DataFrame, produced: DataFrame) -> DataFrame:
    """(id, outcome, expected, produced, rule) of declared models (id, model, file, table, classification, rule) against produced edges (seq, model, file, table).

    A declaration meets one edge of its model and file, the last; any edge for what must not have one is a false positive. Each declaration has one outcome.
    """
    last = produced.where("file is not null").groupBy("model", "file").agg(F.max_by("table", "seq").alias("found"))
    rows = truth.join(last, ["model", "file"], "left")
    scope, found = F.col("classification"), F.col("found").isNotNull()
    right = found & F.col("found").eqNullSafe(F.col("table"))
    outcome = F.when(scope == "IN_SCOPE", F.when(right, "TRUE_POSITIVE").when(found, "FALSE_POSITIVE").otherwise("FALSE_NEGATIVE")).when(found, "FALSE_POSITIVE").otherwise(scope)
    expected = F.when(scope == "IN_SCOPE", F.col("table")).when(scope == "UNSUPPORTED", "no edge (out of scope ORM)").otherwise("no edge")
    return rows.select("id", outcome.alias("outcome"), expected.alias("expected"), F.col("found").alias("produced"), "rule")


def _module(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def check_accesses(edges: DataFrame, lines: DataFrame, bindings: DataFrame, declaring: DataFrame) -> DataFrame:
    """(id, outcome, why, not_python) of access edges (id, evidence, model), read from the lines (file, line, code) that their evidence cites.

    bindings (file, name, binding, origin) tell whether a file defines, imports or lacks a name; declaring (model, file) where models are declared. An imported name must come from
    the declaring module, by either's end or part. Names are those before the first dot of the cited expression.
    """
    part = lambda k: F.regexp_extract("evidence", ACCESS_EVIDENCE, k)
    fits = F.col("evidence").rlike(ACCESS_EVIDENCE)
    rows = edges.withColumns({"name": F.when(fits, F.split_part(part(1), F.lit("."), F.lit(1))), "file": F.when(fits, part(3)), "line": F.when(fits, part(4).cast("int"))})
    rows = rows.join(lines.select("file", "line", "code"), ["file", "line"], "left").join(bindings, ["file", "name"], "left").join(declaring.select("model", F.col("file").alias("declared")), "model", "left")
    own = _module(F.col("declared"))
    near = F.endswith(own, F.col("origin")) | F.endswith("origin", F.element_at(F.split(own, r"\."), -1)) | F.contains(own, F.col("origin")) | F.contains("origin", own)
    strange = (F.col("binding") == "imported") & F.col("declared").isNotNull() & F.col("origin").isNotNull() & ~near
    absent = F.coalesce(F.col("binding"), F.lit("absent")) == "absent"
    outcome = F.when(F.col("file").isNull(), "unverifiable").when(F.col("code").isNull() | ~F.contains("code", "name"), "not-at-line").when(absent | F.coalesce(strange, F.lit(False)), "wrong-symbol").otherwise("confirmed")
    why = F.when(outcome != "wrong-symbol", None).when(absent, "the name is neither defined nor imported in this file").otherwise(F.concat(F.lit("imported from "), "origin", F.lit(", but the model is declared in "), "declared"))
    return rows.select("id", outcome.alias("outcome"), why.alias("why"), (F.col("file").isNotNull() & ~F.endswith("file", F.lit(".py"))).alias("not_python"))


def model_uses(lines: DataFrame, bindings: DataFrame, models: DataFrame) -> DataFrame:
    """(model, file, line, declared, table): lines that call a model (model, file, table) or its manager, in files that bind the name to the model's own module (bindings: file, name, binding).

    Star imports and the file's own names say nothing; each use counts once a line.
    """
    called = F.regexp_extract_all("code", F.lit(r"\b(\w+)\s*\("), F.lit(1))
    managed = F.regexp_extract_all("code", F.lit(r"\b(\w+)\.objects\.\w+\s*\("), F.lit(1))
    uses = lines.select("file", "line", F.explode(F.array_distinct(F.concat(called, managed))).alias("model"))
    known = models.where("table is not null").select("model", F.col("file").alias("declared"), "table")
    met = uses.join(known, "model").join(bindings.where("binding not in ('*', 'here')").select("file", F.col("name").alias("model"), "binding"), ["file", "model"])
    tail = F.replace("binding", F.lit("."), F.lit("/"))
    return met.where(F.endswith("declared", F.concat(tail, F.lit(".py"))) | F.endswith("declared", F.concat(tail, F.lit("/__init__.py")))).select("model", "file", "line", "declared", "table").distinct()


def access_recall(uses: DataFrame, edges: DataFrame) -> DataFrame:
    """(model, file, line, recovered) of expected uses: whether some access edge (evidence) cites that place."""
    part = lambda k: F.regexp_extract("evidence", ACCESS_EVIDENCE, k)
    cited = edges.where(F.col("evidence").rlike(ACCESS_EVIDENCE)).select(part(3).alias("file"), part(4).cast("int").alias("line"), F.lit(True).alias("hit")).distinct()
    return uses.join(cited, ["file", "line"], "left").select("model", "file", "line", F.coalesce("hit", F.lit(False)).alias("recovered"))


def chain_recall(served: DataFrame, lines: DataFrame, uses: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(client, method, url, handler, model, table, recovered) of chains that source shows: a client's operation, its route, the handler below it, and the models that the handler's body uses.

    served (client, method, url, file, line): operations with the place of the route that serves them. The handler is the first ``def`` of HANDLER_LINES lines from there, its body
    BODY_LINES lines from its own; bands of lines meet uses by line. A chain is recovered if the graph has one of that handler, model and table through shared nodes.
    """
    defined = F.nullif(F.regexp_extract("code", r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", 1), F.lit(""))
    defs = lines.withColumn("handler", defined).where("handler is not null").select("file", F.col("line").alias("at"), "handler")
    probes = served.select("file", "line").distinct().withColumn("at", F.explode(F.sequence(F.col("line"), F.col("line") + HANDLER_LINES - 1)))
    first = probes.join(defs, ["file", "at"]).groupBy("file", "line").agg(F.min(F.struct("at", "handler")).alias("d"))
    bodies = first.select("file", "line", "d.handler", F.explode(F.sequence(F.col("d.at"), F.col("d.at") + BODY_LINES - 1)).alias("at"))
    used = bodies.join(uses.select("file", F.col("line").alias("at"), "model", "table"), ["file", "at"]).select("file", "line", "handler", "model", "table").distinct()
    expected = served.join(used, ["file", "line"])
    name = lambda k, c: nodes.select(F.col("id").alias(k), F.col("name").alias(c))
    made = graph.chains(edges).join(name("n1", "handler"), "n1").join(name("n2", "model"), "n2").join(name("n3", "table"), "n3").select("handler", "model", "table").distinct()
    return expected.join(made.withColumn("hit", F.lit(True)), ["handler", "model", "table"], "left").select("client", "method", "url", "handler", "model", "table", F.coalesce("hit", F.lit(False)).alias("recovered"))


def recall(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Expected, recovered, missed and the share recovered, to four places, of rows with ``recovered``."""
    hit = F.count(F.when(F.col("recovered"), 1))
    return rows.groupBy(*keys).agg(F.count("*").alias("expected"), hit.alias("recovered"), (F.count("*") - hit).alias("missed"), F.round(hit / F.count("*"), 4).alias("recall"))


def integrity(records: DataFrame, digest: str, order: list[str], counts: DataFrame, groups: DataFrame, weak: int) -> DataFrame:
    """(check, passed): what must hold of a labelled set (RECORD) and the results computed from it.

    The digest is computed again in ``order``; recorded counts (what: label or split, name, n) must equal those present; splits must not share an edge; groups (name, verified, observed_accuracy,
    sample_adequate) must claim no accuracy without verified records and flag those below ``weak``. Each check is an aggregate.
    """
    spark = records.sparkSession
    one = lambda rows, name: rows.select(F.lit(name).alias("check"), "passed")
    again = records_digest(records, RECORD, order).select((F.col("digest") == digest).alias("passed"))
    now = records.groupBy(F.lit("label").alias("what"), F.col("label").alias("name")).agg(F.count("*").alias("n")).unionByName(records.groupBy(F.lit("split").alias("what"), F.col("split").alias("name")).agg(F.count("*").alias("n")))
    stated = counts.select("what", "name", F.col("n").cast("long").alias("n"))
    apart = now.exceptAll(stated).unionByName(stated.exceptAll(now)).agg((F.count("*") == 0).alias("passed"))
    facts = records.agg(
        F.coalesce(F.bool_or(F.col("label") == "UNVERIFIABLE"), F.lit(False)).alias("refused"),
        (F.size(F.array_intersect(F.collect_set("kind"), F.array(*map(F.lit, EDGE_KINDS)))) == len(EDGE_KINDS)).alias("kinds"),
        (F.count(F.when(F.col("confidence").isNull() | (F.coalesce("provenance", F.lit("")) == "") | (F.coalesce("at", F.lit("")) == ""), 1)) == 0).alias("whole"),
    )
    both = records.groupBy("repository", "kind", "at", "edge").agg(F.countDistinct("split").alias("n")).agg((F.count(F.when(F.col("n") > 1, 1)) == 0).alias("passed"))
    claims = groups.agg(
        (F.count(F.when((F.col("verified") == 0) & F.col("observed_accuracy").isNotNull(), 1)) == 0).alias("claims"),
        (F.count(F.when((F.col("verified") > 0) & (F.col("verified") < weak) & F.col("sample_adequate"), 1)) == 0).alias("flags"),
    )
    out = one(again, "records unchanged").unionByName(one(apart, "counts match the records")).unionByName(one(both, "splits are disjoint"))
    for rows, column, name in ((facts, "refused", "unverifiable records kept"), (facts, "kinds", "every kind is represented"), (facts, "whole", "confidence, provenance and place kept"), (claims, "claims", "no accuracy without verified records"), (claims, "flags", "small samples are flagged")):
        out = out.unionByName(one(rows.select(F.col(column).alias("passed")), name))
    return out


def merged_truth(kept: DataFrame, models: DataFrame) -> DataFrame:
    """(id, model, file, line, classification, rule, reason, note) of a ground truth's models: those read anew (id, model, file, line, scope) take the place of records (same columns but scope) of their id; others stay."""
    fresh = models.select("id", "model", "file", "line", "scope.*", "note", F.lit(0).alias("order"))
    old = kept.select(*[c for c in fresh.columns if c != "order"], F.lit(1).alias("order"))
    rest = [c for c in fresh.columns if c not in ("id", "order")]
    first = fresh.unionByName(old).groupBy("id").agg(F.min_by(F.struct(*rest), "order").alias("r"))
    return first.select("id", "r.*")


def score_documents(records: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, json): a result document for each key: its figures, those of its groups by ``by`` in order, and the labels there are.

    Groups are summed before they meet, so a document gathers a row for each group; absent figures are null, not left out.
    """
    figures = group_summary(records, keys)
    groups = group_summary(records, [*keys, by])
    fields = [c for c in groups.columns if c not in keys]
    listed = groups.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("groups"))
    labels = records.groupBy(*keys).agg(F.sort_array(F.collect_set("label")).alias("labels"))
    whole = figures.join(listed, keys).join(labels, keys)
    shown = F.struct(*keys, F.struct(*(c for c in figures.columns if c not in keys)).alias("summary"), "groups", "labels")
    return whole.select(*keys, F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))
