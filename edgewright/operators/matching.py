"""Matching client calls to routes: candidates, ranking, and one decision for each client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright import schemas
from edgewright.functions import paths as P


#: Clients that one task ranks and decides.
MOST_CLIENTS = 100_000


def dealt(clients: DataFrame) -> DataFrame:
    """Client observations dealt out by client_id, into more partitions the more there are.

    Where routes are few enough to be sent to all tasks, candidates, ranks, decisions and evidence keep this dealing: observations are shuffled before
    they grow by segments, candidates and reasons, and what a task holds does not grow with the table. Counting reads no text.
    A shuffle into at most ``spark.shuffle.sort.bypassMergeThreshold`` partitions writes rows as they come; one into more first gathers all rows of a task.
    So where there are more, clients are dealt in two steps: first into that many, then each of these small parts into all.
    """
    conf = clients.sparkSession.conf
    wanted = max(int(conf.get("spark.sql.shuffle.partitions")), -(-clients.count() // MOST_CLIENTS))
    streamed = int(conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if 0 < streamed < wanted:
        clients = P.once(clients.repartition(streamed, "client_id"), client_id=F.col("client_id"))  # else the two become one
    return clients.repartition(wanted, "client_id")


def unsupported_reason() -> Column:
    """Why a canonical client is not matched at all, in the order of the checks; null if it is."""
    return (
        F.when(F.col("status") == "unsupported", "client-path-not-canonical")
        .when(F.array_contains("notes", "template-prefix-unknown"), "client-prefix-unresolved")
        .when(F.col("authority").isNotNull(), "client-targets-absolute-host")
    )


def _pair(c: Column, r: Column) -> Column:
    """How one pair of segments agrees; null where it cannot."""
    return (
        F.when((c["kind"] == "static") & (r["kind"] == "static") & (c["value"] == r["value"]), "static")
        .when((c["kind"] == "static") & (r["kind"] == "parameter"), "bound")
        .when((c["kind"] == "dynamic") & (r["kind"] == "parameter"), "unknown")
        .when((c["kind"] == "dynamic") & (r["kind"] == "static"), "unknown-literal")
    )


#: Groups of neighbours that a route's static segments are keyed by, since each doubles its keys; up to so many segments, each is a group.
MOST_GROUPS = 8


def _static_places(segments: Column) -> Column:
    return F.filter(F.transform(segments, lambda s, i: F.when(s["kind"] == "static", i)), lambda i: i.isNotNull())


def _grouped(places: Column) -> Column:
    """Places in at most MOST_GROUPS groups, all but the last of one size."""
    width = F.greatest(F.lit(1), F.ceil(F.size(places) / MOST_GROUPS).cast("int"))
    return F.filter(F.transform(places, lambda p, i: F.when(i % width == 0, F.slice(places, i + 1, width))), lambda g: g.isNotNull())


def _stated(segments: Column) -> Column:
    """Static segments as a key has them; null for others. Segments have no slashes."""
    return F.transform(segments, lambda s: F.when(s["kind"] == "static", F.concat(F.lit("/="), s["value"])))


def _key_of_client(shape: Column, stated: Column, groups: Column) -> Column:
    """The shape, and of each group what the client states, if it states all of it."""
    at = lambda i: F.get(stated, i)
    whole = lambda g: F.when(F.size(g) == 1, at(F.get(g, F.lit(0)))).when(F.forall(g, lambda i: at(i).isNotNull()), F.array_join(F.transform(g, at), ""))
    return F.concat(shape, F.array_join(F.transform(groups, whole), "", "/*"))


def _keys_of_route(shape: Column, stated: Column, groups: Column) -> Column:
    """The keys that any client's can be equal to: each group stated, or not known to the client."""
    whole = lambda g: F.array_join(F.transform(g, lambda i: F.get(stated, i)), "")
    return F.aggregate(groups, F.array(shape), lambda keys, g: F.concat(F.transform(keys, lambda k: F.concat(k, whole(g))), F.transform(keys, lambda k: F.concat(k, F.lit("/*")))))


def candidates(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """Every possible pair of a supported client and an admitted route, with reasons, confidence and whether it tells routes apart.

    One equi-join on all segments that are static on both sides. A route's shape is its length and the places of its static segments. Shapes are few, so a client
    meets them first, by its length, and has one key for each; a route ending in a wildcard fits all lengths from its own. Which of its static segments a client
    knows, a route cannot tell, so it has a key for every choice. A client's segments are made once, a route's once too.
    """
    c = clients.where(unsupported_reason().isNull()).select(
        "client_id", F.col("segments").alias("cs"), F.col("methods").alias("cm"), F.col("trailing_slash").alias("ct"), F.size("segments").alias("n")
    )
    r = routes.where("status <> 'unsupported'").select(
        "route_id", F.col("segments").alias("rs"), F.col("methods").alias("rm"), F.col("trailing_slash").alias("rt"), F.size("segments").alias("m"), "handler"
    )
    r = r.withColumn("route", P.display(F.col("rs"), F.col("rt")))
    early = F.exists(F.slice("rs", F.lit(1), F.greatest(F.col("m") - 1, F.lit(0))), lambda s: s["kind"] == "wildcard")
    tail = F.coalesce(F.get("rs", F.col("m") - 1)["kind"] == "wildcard", F.lit(False))
    r = r.where(~early).withColumn("wild", tail)
    r = r.withColumn("fixed", F.col("m") - F.col("wild").cast("int"))
    r = P.once(r, places=_static_places(F.slice("rs", F.lit(1), F.col("fixed"))))
    r = P.once(r, groups=_grouped(F.col("places"))).withColumn("size", F.when(F.col("wild"), -1).otherwise(F.col("m")))
    r = r.withColumn("shape", F.concat(F.when(F.col("wild"), "w").otherwise(""), F.col("m").cast("string"), F.lit(":"), F.col("groups").cast("string")))
    shapes = F.broadcast(r.select("size", F.col("m").alias("least"), "shape", "groups").distinct())
    r = r.withColumn("key", F.explode(_keys_of_route(F.col("shape"), _stated(F.col("rs")), F.col("groups")))).drop("size", "places", "groups", "shape")
    c = c.withColumn("stated", _stated(F.col("cs"))).withColumn("size", F.explode(F.array("n", F.lit(-1)))).join(shapes, "size").where("least <= n")
    c = c.withColumn("key", _key_of_client(F.col("shape"), F.col("stated"), F.col("groups"))).drop("size", "least", "groups", "shape", "stated")
    met = c.join(r, (c["key"] == r["key"]) & P.methods_compatible(F.col("cm"), F.col("rm"))).drop("key")

    agree = F.zip_with(F.slice("cs", F.lit(1), F.col("fixed")), F.slice("rs", F.lit(1), F.col("fixed")), _pair)
    met = P.once(met, agree=agree).where(F.forall("agree", lambda x: x.isNotNull()))
    count = lambda kind: F.size(F.filter("agree", lambda x: x == kind))
    met = P.once(met, static=count("static"), loose=F.exists("agree", lambda x: F.startswith(x, F.lit("unknown"))))
    static = F.col("static")
    path = (
        F.when(F.col("wild"), "wildcard-suffix")
        .when(static == F.col("m"), "exact-static")
        .when(F.col("loose"), "variable-aligned")
        .otherwise("parameter-bound")
    )
    method = (
        F.when(F.col("cm").isNotNull() & F.col("rm").isNotNull(), "exact")
        .when(F.col("rm").isNotNull(), "client-unknown")
        .when(F.col("cm").isNotNull(), "server-unknown")
        .otherwise("both-unknown")
    )
    met = met.withColumns({"path": path, "method": method, "discriminating": (static > 0) | (F.col("m") == 0)})
    base = F.lit(None).cast("float")
    for name, value in schemas.MATCH_CONFIDENCE.items():
        base = F.when(F.col("path") == name, F.lit(value).cast("float")).otherwise(base)
    confidence = F.when(F.col("method") == "exact", base).otherwise((base * F.lit(schemas.UNDECLARED_METHOD).cast("float")).cast("float"))
    named = {"static": "static-segments-agree", "bound": "parameter-bound-to-literal", "unknown": "client-value-unknown", "unknown-literal": "unknown-value-against-literal"}
    words = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
    each = F.transform("agree", lambda x, i: F.concat(words[x], F.lit("@"), i.cast("string")))
    each = F.when(F.col("path") == "exact-static", F.array(F.lit("static-path-exact"))).otherwise(each)
    extra = F.array_compact(
        F.array(
            F.when(F.col("wild"), F.concat(F.lit("wildcard-consumed-suffix@"), (F.col("n") - F.col("fixed")).cast("string"))),
            F.when(~F.col("discriminating"), "no-discriminating-static-segment"),
            F.when(F.col("ct") != F.col("rt"), "trailing-slash-differs"),
        )
    )
    told = F.when(F.col("method") == "exact", "method-exact").otherwise(F.concat(F.lit("method-undeclared:"), F.col("method")))
    met = met.withColumns({"confidence": confidence, "reasons": F.concat(F.array(told), each, extra)})
    return met.select("client_id", "route_id", "route", "handler", "path", "method", "confidence", "discriminating", "reasons")


def ranked(pairs: DataFrame) -> DataFrame:
    """Candidates with ``rank`` (confidence, then route, then route_id), the best confidence and how many tie with it."""
    own = Window.partitionBy("client_id")
    order = own.orderBy(F.desc("confidence"), "route", "route_id")
    rows = pairs.withColumns({"rank": F.row_number().over(order), "best": F.max("confidence").over(own)})
    near = F.abs(F.col("confidence") - F.col("best")) < F.lit(schemas.FLOAT_EPSILON).cast("float")
    return rows.withColumn("tied", F.count(F.when(near, 1)).over(own))


def decisions(clients: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each client: status, the best candidate, and why an unsupported one is refused."""
    best = F.struct((-F.col("confidence")).alias("order"), "route", "route_id", "handler", "path", "method", "discriminating", "reasons")
    own = pairs.groupBy("client_id").agg(F.min(best).alias("b"), F.collect_list("confidence").alias("all"))  # a client's routes are few
    near = F.filter("all", lambda x: F.abs(x + F.col("b.order")) < F.lit(schemas.FLOAT_EPSILON).cast("float"))
    status = (
        F.when(~F.col("b.discriminating") | (F.size(near) > 1), "ambiguous")
        .when((F.col("b.path") == "exact-static") & (F.col("b.method") == "exact"), "exact")
        .otherwise("strong")
    )
    first = own.select("client_id", status.alias("status"), "b.route_id", "b.route", "b.handler", (-F.col("b.order")).alias("confidence"), "b.reasons")
    all_clients = clients.select("client_id", unsupported_reason().alias("unsupported_reason"))
    joined = all_clients.join(first.hint("merge"), "client_id", "left")  # both grow with the clients
    return joined.withColumn("status", F.when(F.col("unsupported_reason").isNotNull(), "unsupported").otherwise(F.coalesce("status", F.lit("no-match"))))


def evidence(pairs: DataFrame, clients: DataFrame, routes: DataFrame) -> DataFrame:
    """Add ``evidence`` to candidates: what matched what, where, and the reasons as a sentence; repeated reasons are told together."""
    shown = lambda: F.concat(P.show_methods(F.col("methods")), F.lit(" "), P.display(F.col("segments"), F.col("trailing_slash"), F.col("scheme"), F.col("authority")))
    c = clients.select("client_id", shown().alias("__client"))
    r = routes.select("route_id", shown().alias("__route"), F.concat("file", F.lit(":"), F.col("line").cast("string")).alias("__at"))
    rows = pairs.join(c.hint("merge"), "client_id").join(r, "route_id")
    places = lambda kind: F.transform(F.filter("reasons", lambda x: F.substring_index(x, "@", 1) == kind), lambda x: F.substring_index(x, "@", -1))
    has = lambda kind: F.array_contains("reasons", kind)
    several = lambda kind, text: F.when(F.size(places(kind)) > 0, F.concat(F.lit(text[0]), F.array_join(places(kind), ", "), F.lit(text[1])))
    statics = F.size(places("static-segments-agree"))
    told = [
        F.when(has("method-exact"), "exact HTTP method")
        .when(F.col("method") == "client-unknown", "client declared no method")
        .when(F.col("method") == "server-unknown", "route declared no method")
        .otherwise("neither side declared a method"),
        F.when(has("static-path-exact"), "every path segment static and equal"),
        several("wildcard-consumed-suffix", ("route wildcard consumed ", " trailing segment(s)")),
        F.when(has("no-discriminating-static-segment"), "no shared static segment"),
        F.when(has("trailing-slash-differs"), "trailing slash differs"),
        F.when(statics > 0, F.concat(statics.cast("string"), F.lit(" static segment(s) equal"))),
        several("parameter-bound-to-literal", ("declared parameter(s) at position(s) ", " bound to concrete values")),
        several("client-value-unknown", ("client value(s) at position(s) ", " not determined")),
        several("unknown-value-against-literal", ("client value(s) at position(s) ", " compared against literal segment(s), unverified")),
    ]
    head = F.concat("__client", F.lit(" matched "), "__route", F.lit(" at "), "__at", F.coalesce(F.concat(F.lit(" ("), "handler", F.lit(")")), F.lit("")))
    return rows.withColumn("evidence", F.concat_ws("; ", head, *told)).drop("__client", "__route", "__at")


def accepted(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin("exact", "strong"))
