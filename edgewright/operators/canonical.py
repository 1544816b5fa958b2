"""Canonical routes of client calls and route declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.functions import paths as P

_HOLE = "\u0000"
_NO_SEGMENTS = "array<struct<kind:string,value:string,name:string,constraint:string,source:string>>"


def _fill(parts: Column, sources: Column) -> Column:
    """Static segments with placeholders become dynamic; each takes the next expressions' sources."""

    def step(done: Column, s: Column) -> Column:
        count = F.when(s["kind"] == "static", F.length(s["value"]) - F.length(F.replace(s["value"], F.lit(_HOLE)))).otherwise(0)
        own = F.slice(sources, done["at"] + 1, count)
        made = F.when(count > 0, P.segment("dynamic", source=F.array_join(own, ", "))).otherwise(s)
        return F.struct(F.array_append(done["out"], made).alias("out"), (done["at"] + count).cast("int").alias("at"))

    start = F.struct(F.array().cast(_NO_SEGMENTS).alias("out"), F.lit(0).alias("at"))
    return F.aggregate(parts, start, step)["out"]


def canonicalise(obs: DataFrame, declared: bool, kind: str = "path_kind", value: str = "path_value", parts: str = "path_parts") -> DataFrame:
    """Add status, segments, trailing_slash, scheme, authority, query, fragment, notes and raw_path to observations.

    ``declared`` routes hold parameters, a client's literal never does. A template is partial, an expression or (with
    style ``url-conf-entry``) a regular expression unsupported. Refused rows stay, with their reason among the notes.
    """
    regex = F.lit(False)
    if declared and "style" in obs.columns:
        regex = (F.col("style") == "url-conf-entry") & (F.col(kind) == "literal") & P.looks_like_regex(F.col(value))
    template = F.col(kind) == "template"
    text = F.array_join(F.transform(parts, lambda p: F.when(p["kind"] == "text", p["value"]).otherwise(F.lit(_HOLE))), "")
    raw = F.array_join(
        F.transform(parts, lambda p: F.when(p["kind"] == "text", p["value"]).otherwise(F.concat(F.lit("${"), p["source"], F.lit("}")))), ""
    )
    refused = regex | ~F.col(kind).isin("literal", "template")
    rows = obs.withColumn("raw_path", F.when(template, raw).otherwise(F.col(value)))
    rows = rows.withColumn("__regex", F.coalesce(regex, F.lit(False))).withColumn("__refused", F.coalesce(refused, F.lit(True)))
    rows = rows.withColumn("__text", F.when(~F.col("__refused"), F.when(template, text).otherwise(F.col(value))))
    rows = P.once(rows, __text=F.col("__text"), __rest=P.after_authority(F.col("__text")), __path=P.plain_path(P.after_authority(F.col("__text"))))
    sources = F.transform(F.filter(parts, lambda p: p["kind"] != "text"), lambda p: p["source"])
    classify = P.classify_segment if declared else P.static_segment
    pieces = F.transform(P.segments(F.col("__path")), classify)
    rows = P.once(rows, segments=F.coalesce(F.when(template, _fill(pieces, sources)).otherwise(pieces), F.array().cast(_NO_SEGMENTS)))
    note = lambda on, name: F.when(on, F.lit(name))
    notes = [
        note(template & ~F.col("__refused"), "template-substitution-unresolved"),
        note(template & (F.element_at(F.col(parts), 1)["kind"] != "text"), "template-prefix-unknown"),
        note(P.authority(F.col("__text")).isNotNull(), "authority-separated"),
        note(P.fragment(F.col("__rest")).isNotNull(), "fragment-separated"),
        note(P.query(F.col("__rest")).isNotNull(), "query-separated"),
        note(P.interior_empties(F.col("__path")) > 0, "empty-segments-dropped"),
        note(F.col("__regex"), "regex-not-interpreted"),
        note(F.col("__refused") & ~F.col("__regex"), "dynamic-path-not-interpreted"),
    ]
    rows = rows.withColumns(
        {
            "status": F.when(F.col("__refused"), "unsupported").when(template, "partial").otherwise("exact"),
            "trailing_slash": F.coalesce(P.trailing_slash(F.col("__path")), F.lit(False)),
            "scheme": P.scheme(F.col("__text")),
            "authority": P.authority(F.col("__text")),
            "query": P.query(F.col("__rest")),
            "fragment": P.fragment(F.col("__rest")),
            "notes": F.array_compact(F.array(*notes)),
        }
    )
    return rows.drop("__regex", "__refused", "__text", "__rest", "__path")


def canonical_routes(routes: DataFrame) -> DataFrame:
    """Canonical rows of route observations; methods become a sorted set, null where unknown."""
    return canonicalise(routes, declared=True).withColumn("methods", P.method_set(F.col("methods")))


def canonical_clients(clients: DataFrame) -> DataFrame:
    """Canonical rows of client observations; the method hint becomes a set of one, null where unknown."""
    return canonicalise(clients, False, "url_kind", "url_value", "url_parts").withColumn("methods", P.method_set(F.array("method")))
