"""Names to declarations across files, constants and URLs across files, and three producers' facts in one graph."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.operators.graph import node_identity, with_ids
from edgewright.operators.resolution import HOPS


def follow_wildcards(names: DataFrame, declared: DataFrame, stars: DataFrame, hops: int = HOPS) -> DataFrame:
    """Look for (file, name) behind the wildcard re-exports (file, to_file) of a file, in at most ``hops`` hops.

    All re-exports of a file are looked behind; one file that declares the name answers, several make it ambiguous, none leaves
    it unresolved. A file that declares the name itself is not looked behind.
    """
    own = declared.select(F.col("file").alias("at"), "name").distinct().withColumn("here", F.lit(True))
    step = stars.select(F.col("file").alias("at"), "to_file").distinct()
    front = names.select("file", "name").distinct().withColumn("at", F.col("file"))
    found = None
    for hop in range(hops + 1):
        seen = front.join(own, ["at", "name"], "left")
        hit = seen.where("here").select("file", "name", "at")
        found = hit if found is None else found.unionByName(hit)
        if hop < hops:
            front = seen.where("here is null").join(step, "at").select("file", "name", F.col("to_file").alias("at")).distinct()
    counted = found.groupBy("file", "name").agg(F.countDistinct("at").alias("n"), F.min("at").alias("at"))
    joined = names.select("file", "name").distinct().join(counted, ["file", "name"], "left")
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("declared")
    return joined.select("file", "name", status.alias("status"), F.when(F.col("n") == 1, F.col("at")).alias("declared_in"))


def scopes(constants: DataFrame, imports: DataFrame) -> DataFrame:
    """The constants (file, name, seq, parts, exported) that each file sees, its own and imported ones: (file, name, seq, parts).

    An import (file, local, target, imported) binds an exported constant of the file ``target``, already resolved. A local
    constant of the same name wins.
    """
    last = lambda rows: rows.groupBy("file", "name").agg(F.max(F.struct("seq", "parts")).alias("c")).select("file", "name", "c.seq", "c.parts")
    own, shown = last(constants), last(constants.where("exported"))
    there = shown.select(F.col("file").alias("target"), F.col("name").alias("imported"), "seq", "parts")
    brought = imports.join(there, ["target", "imported"]).groupBy("file", F.col("local").alias("name")).agg(F.min(F.struct("seq", "parts")).alias("c"))
    far = brought.select("file", "name", "c.seq", "c.parts").join(own.select("file", "name"), ["file", "name"], "left_anti")
    return own.unionByName(far)


def re_expressed(parts: Column) -> Column:
    """A folded URL as an observation: a struct of url_kind, url_value and url_parts.

    All literal: a literal. Else a template: neighbouring literals are one text, empty ones go, an environment variable
    stands as ``process.env.NAME``, anything else by its own text; the template's open places stay open.
    """
    source = lambda p: F.when(p["kind"] == "env", F.concat(F.lit("process.env."), p["text"])).otherwise(p["text"])
    whole = F.forall(parts, lambda p: p["kind"] == "literal")
    kind = "array<struct<kind:string,value:string,source:string>>"

    def add(done: Column, p: Column) -> Column:
        text = F.struct(F.lit("text").alias("kind"), p["text"].alias("value"), F.lit(None).cast("string").alias("source"))
        open_ = F.struct(F.lit("expression").alias("kind"), F.lit(None).cast("string").alias("value"), source(p).alias("source"))
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(F.lit("text").alias("kind"), F.concat(last["value"], p["text"]).alias("value"), F.lit(None).cast("string").alias("source"))
        before = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when((p["kind"] == "literal") & (p["text"] == ""), done)
            .when((p["kind"] == "literal") & F.coalesce(last["kind"] == "text", F.lit(False)), F.array_append(before, joined))
            .when(p["kind"] == "literal", F.array_append(done, text))
            .otherwise(F.array_append(done, open_))
        )

    made = F.aggregate(parts, F.array().cast(kind), add)
    literal = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    return F.struct(
        F.when(whole, "literal").otherwise("template").alias("url_kind"), F.when(whole, literal).alias("url_value"), F.when(~whole, made).alias("url_parts")
    )


def resolved_calls(calls: DataFrame, bound: DataFrame) -> DataFrame:
    """Calls (file, language, line, seq, enclosing, root, property) to the declaration their root leads to, by ``bound`` (file, name, status, declared_in).

    Python calls, calls outside any function, roots that lead nowhere for certain and calls of a function by itself make no row.
    The callee is named by the property called, or the root itself; each (file, root) is looked up once.
    """
    sites = calls.where("language <> 'python' and enclosing is not null")
    lead = bound.where("status = 'declared'").select("file", F.col("name").alias("root"), F.col("declared_in").alias("callee_file")).distinct()
    met = sites.join(lead, ["file", "root"]).withColumn("callee", F.coalesce("property", "root"))
    return met.where((F.col("file") != F.col("callee_file")) | (F.col("enclosing") != F.col("callee"))).select(
        "file", F.col("enclosing").alias("caller"), "callee_file", "callee", "line", "seq"
    )


def client_functions(requests: DataFrame, found: DataFrame) -> DataFrame:
    """(file, name, line): functions outside Python that issue a request (file, language, enclosing), at their first declaration."""
    lines = found.where("kind in ('function', 'method', 'variable')").groupBy("file", "name").agg(F.min("line").alias("line"))
    own = requests.where("language <> 'python' and enclosing is not null").select("file", F.col("enclosing").alias("name")).distinct()
    return own.join(lines, ["file", "name"], "left")


def assembled(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One graph of several producers' proposals: nodes (kind, name, file, line, seq) and edges between (source, target) structs of kind, name and file.

    Nodes of one identity are one, at the first proposal; an edge's other columns stay. Edges whose ends nobody proposed are left
    to dangling(): their ids are null.
    """
    union = functools.partial(functools.reduce, lambda a, b: a.unionByName(b, allowMissingColumns=True))
    known = with_ids(node_identity(union(nodes)), "kind", "name", "file")
    out = union(edges)
    for end in ("source", "target"):
        own = known.select(F.struct("kind", "name", F.coalesce("file", F.lit("")).alias("file")).alias("__key"), F.col("id").alias(f"{end}_id"))
        key = F.struct(F.col(f"{end}.kind"), F.col(f"{end}.name"), F.coalesce(F.col(f"{end}.file"), F.lit("")).alias("file"))
        out = out.withColumn("__key", key).join(own, "__key", "left").drop("__key")
    return known, out


def parse_totals(files: DataFrame, diagnostics: DataFrame, **facts: DataFrame) -> DataFrame:
    """One row of counters of a parsed project: files by outcome, diagnostics, and the number of each kind of fact.

    A file is clean without a diagnostic; a failed one counts as a file with a diagnostic too.
    """
    bad = diagnostics.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("__n"))
    seen = files.select("path", "status").join(bad, "path", "left")
    failed, torn = F.col("status") == "failed", F.col("__n") > 0
    count = lambda on: F.count(F.when(on, 1))
    one = seen.agg(
        F.count("*").alias("files"),
        count(~failed & F.col("__n").isNull()).alias("parsed_clean"),
        count(~failed & torn).alias("parsed_with_errors"),
        count(failed).alias("failed"),
        (F.coalesce(F.sum("__n"), F.lit(0)) + count(failed & F.col("__n").isNull())).alias("diagnostics"),
    )
    for name, rows in facts.items():  # rows of one are paired
        one = one.join(rows.agg(F.count("*").alias(name)))
    return one
