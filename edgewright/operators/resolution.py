"""Following names through imports, aliases, barrels and routers, and folding URL strings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions import paths as P
from edgewright.operators.intervals import stabbed
from edgewright.operators.rounds import kept

#: Fixed bounds: hops through re-exports, inclusions of routers, substitutions of constants.
HOPS, INCLUSIONS, SUBSTITUTIONS = 4, 12, 8


def first_contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """For each outer span (file, outer_id, start, end) the inner span of the least ``seq`` within it, with its ``value``.

    Where both have a ``start_column`` the inner one's must not be less, on whatever line. Inner spans look for the outer ones around their start in
    dyadic cells; the first is a partial minimum, not a sort.
    """
    columns = "start_column" in outer.columns and "start_column" in inner.columns
    o = outer.select("file", "outer_id", F.col("start").alias("from"), F.col("end").alias("to"), *([F.col("start_column").alias("from_column")] if columns else []))
    inside = stabbed(inner.select("file", "seq", "start", "end", "value", *(["start_column"] if columns else [])), o, ["file"], "start", "from", "to").where(F.col("end") <= F.col("to"))
    inside = inside.where(F.col("start_column") >= F.col("from_column")) if columns else inside
    return inside.groupBy("file", "outer_id").agg(F.min(F.struct("seq", "value")).alias("v")).select("file", "outer_id", F.col("v.seq").alias("seq"), F.col("v.value").alias("value"))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """For each point (file, point_id, line) the shortest span (file, seq, name, start, end) around it, the first of equals; null without one.

    Lines and spans meet in dyadic cells, each line once and each cell with its shortest span alone; then points take what their line has found.
    """
    shortest = F.struct(F.col("end") - F.col("start"), "seq", "name")
    met = stabbed(points.select("file", "line").distinct(), spans.select("file", "seq", "name", "start", "end"), ["file"], "line", "start", "end", least=shortest)
    around = met.groupBy("file", "line").agg(F.min("least").alias("b"))
    best = points.select("file", "point_id", "line").join(around, ["file", "line"]).groupBy("file", "point_id").agg(F.min("b").alias("b"))
    return points.join(best.select("file", "point_id", F.col("b.name").alias("name")), ["file", "point_id"], "left")


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path in whole segments, itself included."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def suffix_modules(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve dotted modules (module) to files (file): ``a.b`` is a/b.py or, failing that, a/b/__init__.py, by unique suffix.

    Suffixes are listed once for each file, so the match is an equi-join.
    """
    ends = files.select("file", F.explode(path_suffixes(F.col("file"))).alias("suffix"))
    base = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    tiers = F.posexplode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("tier", "suffix")
    found = wanted.select("module").distinct().select("module", tiers).join(ends, "suffix")
    counted = found.groupBy("module", "tier").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    first = counted.groupBy("module").agg(F.min(F.struct("tier", "n", "file")).alias("f"))
    joined = wanted.join(first, "module", "left")
    status = F.when(F.col("f").isNull(), "unresolved").when(F.col("f.n") > 1, "ambiguous").otherwise("declared")
    return joined.select(*wanted.columns, status.alias("status"), F.when(F.col("f.n") == 1, F.col("f.file")).alias("file"))


def nearest_alias(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rewrite specifiers (file, specifier) by the build alias (dir, alias, target) of the nearest directory, then the longest alias.

    Directories above a file and prefixes of its specifier are listed, so aliases meet by equality.
    """
    parts, spec = F.split(P.directory(F.col("file")), "/", -1), F.split("specifier", "/", -1)
    above = F.array_append(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.lit(""))
    heads = F.transform(F.sequence(F.lit(1), F.size(spec)), lambda i: F.array_join(F.slice(spec, F.lit(1), i), "/"))
    rows = imports.select("file", "specifier").distinct().withColumn("dir", F.explode(F.array_distinct(above))).withColumn("alias", F.explode(heads))
    met = rows.join(aliases, ["dir", "alias"])
    best = met.groupBy("file", "specifier").agg(F.min(F.struct(-F.length("dir"), -F.length("alias"), "alias", "target")).alias("b"))
    rest = F.substring(F.col("specifier"), F.length("b.alias") + 1, F.length("specifier"))
    joined = imports.join(best, ["file", "specifier"], "left")
    return joined.select(*imports.columns, F.coalesce(F.concat("b.target", rest), "specifier").alias("resolved"))


def follow(names: DataFrame, declared: DataFrame, exports: DataFrame, hops: int = HOPS) -> DataFrame:
    """Follow (file, name) to the file that declares it, through re-exports (file, name, to_file, to_name) in at most ``hops`` hops.

    Adds status declared, ambiguous (several re-exports answer), unresolved (hops run out or the trail ends) or not-bound, the
    declaring file and the trail.
    """
    own = declared.select(F.col("file").alias("at"), F.col("name").alias("as"), F.lit(True).alias("here")).distinct()
    step = exports.groupBy(F.col("file").alias("at"), F.col("name").alias("as")).agg(
        F.countDistinct("to_file", "to_name").alias("answers"), F.min(F.struct("to_file", "to_name")).alias("next")
    )
    walk = names.select("file", "name").distinct().withColumns({"at": F.col("file"), "as": F.col("name"), "trail": F.col("file"), "status": F.lit(None).cast("string")})
    for hop in range(hops + 1):
        met = walk.join(own, ["at", "as"], "left").join(step, ["at", "as"], "left")
        ended = (
            F.when(F.col("status").isNotNull(), F.col("status"))
            .when(F.col("here"), "declared")
            .when(F.col("answers") > 1, "ambiguous")
            .when(F.col("answers").isNull(), "not-bound" if hop == 0 else "unresolved")
        )
        on = ended.isNull()
        walk = met.select(
            "file",
            "name",
            F.when(on, F.col("next.to_file")).otherwise(F.col("at")).alias("at"),
            F.when(on, F.col("next.to_name")).otherwise(F.col("as")).alias("as"),
            F.when(on, F.concat("trail", F.lit(" > "), F.col("next.to_file"))).otherwise(F.col("trail")).alias("trail"),
            ended.alias("status"),
        )
    status = F.coalesce("status", F.lit("unresolved"))
    return walk.select("file", "name", status.alias("status"), F.when(status == "declared", F.col("at")).alias("declared_in"), "trail")


def compose_prefixes(routers: DataFrame, mounts: DataFrame) -> DataFrame:
    """Prefix of every router (router, prefix, prefix_unresolved) through its mounts (child, parent, prefix, prefix_unresolved).

    Known prefixes run from the outermost router inwards. A prefix that is no literal, a cycle or too deep a chain makes it
    unresolved, several mounts ambiguous; equal mounts count each. Refused routers stay, with the reason.
    """
    spark, view = routers.sparkSession, f"routers_{uuid.uuid4().hex}"
    counted = mounts.groupBy("child").agg(F.count("*").alias("n"), F.min(F.struct("parent", "prefix", "prefix_unresolved")).alias("m"))
    r = routers.select("router", F.coalesce("prefix", F.lit("")).alias("own"), "prefix_unresolved")
    r.join(counted, r["router"] == counted["child"], "left").select(
        "router",
        "own",
        F.col("prefix_unresolved").alias("own_lost"),
        F.coalesce("n", F.lit(0)).alias("mounts"),
        F.col("m.parent").alias("parent"),
        F.coalesce(F.col("m.prefix"), F.lit("")).alias("at_mount"),
        F.coalesce(F.col("m.prefix_unresolved"), F.lit(False)).alias("mount_lost"),
    ).createOrReplaceTempView(view)
    walked = spark.sql(f"""
      with recursive walk(router, at, prefix, chain, depth, status) max recursion level {INCLUSIONS + 3} as (
        select router, cast(router as string), cast('' as string), array(cast(router as string)), 0, cast(null as string) from {view}
        union all
        select w.router, cast(coalesce(r.parent, r.router) as string), concat(case when r.mounts = 1 then r.at_mount else '' end, r.own, w.prefix),
               case when r.mounts = 1 and not r.own_lost and not r.mount_lost then array_append(w.chain, cast(r.parent as string)) else w.chain end, w.depth + 1,
               case when r.own_lost then 'unresolved: prefix is not a literal'
                    when r.mounts = 0 then 'known'
                    when r.mounts > 1 then 'ambiguous'
                    when r.mount_lost then 'unresolved: included with a prefix that is not a literal'
                    when array_contains(w.chain, cast(r.parent as string)) or w.depth >= {INCLUSIONS} then 'unresolved: cycle or too deep' end
        from walk w join {view} r on w.at = cast(r.router as string)
        where w.status is null
      )
      select * from walk where status is not null limit all
    """)
    lost = routers.select("router").join(walked.select("router"), "router", "left_anti").withColumns(
        {"status": F.lit("unresolved: not a router of this project"), "prefix": F.lit(None).cast("string"), "chain": F.lit(None).cast("array<string>")}
    )
    known = F.col("status") == "known"
    rows = walked.select("router", "status", F.when(known, F.col("prefix")).alias("prefix"), F.when(known, F.reverse("chain")).alias("chain"))
    return rows.unionByName(lost.select("router", "status", "prefix", "chain"))


def project_prefixes(routers: DataFrame, inclusions: DataFrame, bound: DataFrame, distinct: bool = False) -> DataFrame:
    """(file, name, status, prefix, chain) of routers (file, name, prefix, prefix_unresolved) through inclusions (file, child, parent, prefix, prefix_unresolved).

    A router is known by its file and name. A name at an inclusion is the file's own router, else the one of that name in
    the file its import leads to (``bound``: file, name, status, declared_in); an inclusion of any other name says nothing.
    ``distinct`` counts equal mounts once, as labellers do.
    """
    known = routers.select("file", "name").distinct()
    lead = bound.where("status = 'declared'").select(F.col("file").alias("at"), "name", F.col("declared_in").alias("file")).join(known, ["file", "name"])
    here = known.select(F.col("file").alias("at"), "name", "file", F.lit(0).alias("order")).unionByName(lead.select("at", "name", "file", F.lit(1).alias("order")))
    means = here.groupBy("at", "name").agg(F.min(F.struct("order", "file")).alias("m"))
    key = lambda file, name: F.concat(file, F.lit("#"), name)
    side = lambda s: means.select(F.col("at").alias("file"), F.col("name").alias(s), key(F.col("m.file"), F.col("name")).alias(f"{s}_id"))
    met = inclusions.join(side("child"), ["file", "child"]).join(side("parent"), ["file", "parent"])
    mounts = met.select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent"), "prefix", "prefix_unresolved")
    ids = routers.select(key(F.col("file"), F.col("name")).alias("router"), "prefix", "prefix_unresolved", "file", "name")
    composed = compose_prefixes(ids, mounts.distinct() if distinct else mounts)
    return ids.select("router", "file", "name").join(composed, "router").drop("router")


def composed_routes(routes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Routes (file, receiver, path_value) with the known prefix of their file's receiver set before; any other route keeps its path."""
    known = prefixes.where("status = 'known' and prefix <> ''").select("file", F.col("name").alias("receiver"), F.col("prefix").alias("__prefix"))
    joined = routes.join(known, ["file", "receiver"], "left")
    path = F.when(F.col("__prefix").isNotNull(), P.join_paths(F.col("__prefix"), F.col("path_value"))).otherwise(F.col("path_value"))
    return joined.withColumn("path_value", path).drop("__prefix").select(*routes.columns)


def fold(values: DataFrame, bindings: DataFrame, depth: int = SUBSTITUTIONS) -> DataFrame:
    """Fold (id, file, parts) where a part is literal, ref (a name), env or unknown, by bindings (file, name, parts).

    Each round puts the parts of all bound names in place; a name bound to itself runs out of rounds. What is then no literal
    is shown as {name}, {env:NAME} or {unknown}; ``value`` is the text if all is literal, else null. Of equal names the last seq wins.
    """
    last = bindings.groupBy("file", F.col("name").alias("text")).agg(F.max(F.struct("seq", "parts")).alias("b")).select("file", "text", F.col("b.parts").alias("bound"))
    rows = values.select("id", "file", "parts")
    for _ in range(depth):
        flat = rows.select("id", "file", F.posexplode("parts").alias("pos", "part"))
        key = F.when(flat["part.kind"] == "ref", flat["part.text"])
        met = flat.withColumn("text", key).join(last, ["file", "text"], "left")
        new = F.coalesce("bound", F.array("part"))
        rows = met.groupBy("id", "file").agg(F.sort_array(F.collect_list(F.struct("pos", new.alias("new")))).alias("x"))
        rows = rows.select("id", "file", F.flatten(F.transform("x", lambda e: e["new"])).alias("parts"))
    shown = F.transform(
        "parts",
        lambda p: F.when(p["kind"] == "literal", p["text"]).when(p["kind"] == "env", F.concat(F.lit("{env:"), p["text"], F.lit("}"))).otherwise("{unknown}"),
    )
    whole = F.forall("parts", lambda p: p["kind"] == "literal")
    return rows.select("id", "file", F.array_join(shown, "").alias("shown"), F.when(whole, F.array_join(shown, "")).alias("value"))


def evaluate(values: DataFrame, bindings: DataFrame, depth: int = SUBSTITUTIONS) -> DataFrame:
    """(id, file, shown, value, verdict, parts) of values (id, file, parts) whose parts are literal, ref, env or unknown, by bindings (file, name, seq, parts).

    Each name put in its place costs one of ``depth``, in a binding of several parts two; parts beyond are unknown, and all of a binding that begins there. The names on
    the way to a part are carried, so a name met again is a cycle and ends at once. ``verdict`` is resolved, or the first that holds of cycle, depth, unknown and environment. Rounds end
    when no name is left; only open parts are joined again.
    """
    last = bindings.groupBy("file", F.col("name").alias("text")).agg(F.max(F.struct("seq", "parts")).alias("b")).select("file", "text", F.col("b.parts").alias("bound"))
    flat = values.select("id", "file", F.posexplode("parts").alias("pos", "p"))
    state = lambda kind, text, why, used, seen, place: [kind.alias("kind"), text.alias("text"), why.alias("why"), used.cast("int").alias("used"), seen.alias("seen"), place.alias("place")]
    none, ref = F.lit(None).cast("string"), F.col("p.kind") == "ref"
    rows = flat.select("id", "file", *state(F.col("p.kind"), F.col("p.text"), F.when(F.col("p.kind") == "unknown", "unknown"), F.lit(0), F.when(ref, F.array("p.text")).otherwise(F.array().cast("array<string>")), F.array("pos")))
    done = []
    for _ in range(depth + 1):
        rows = kept(rows, "parts")
        done.append(rows.where("kind <> 'ref'"))
        live = rows.where("kind = 'ref'")
        if live.isEmpty():
            break
        met = live.join(last, ["file", "text"], "left")
        cost = F.col("used") + F.when(F.size("bound") == 1, 1).otherwise(2)
        spent = (F.col("used") >= depth) | (cost >= depth)
        lost = met.where(F.col("bound").isNull()).select("id", "file", *state(F.lit("unknown"), F.col("text"), F.lit("unknown"), F.col("used"), F.col("seen"), F.col("place")))
        open_ = met.where(F.col("bound").isNotNull()).select("id", "file", "seen", "place", cost.alias("cost"), spent.alias("spent"), F.posexplode("bound").alias("k", "p"))
        again = ref & F.array_contains("seen", F.col("p.text"))
        kind = F.when(F.col("spent") | again, "unknown").otherwise(F.col("p.kind"))
        why = F.when(F.col("spent"), "depth").when(again, "cycle").when(F.col("p.kind") == "unknown", "unknown")
        seen = F.when(ref, F.array_append("seen", F.col("p.text"))).otherwise(F.col("seen"))
        more = open_.select("id", "file", *state(kind, F.col("p.text"), why, F.col("cost"), seen, F.array_append("place", F.col("k"))))
        rows = lost.unionByName(more)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    shown = F.when(F.col("kind") == "literal", F.col("text")).when(F.col("kind") == "env", F.concat(F.lit("{env:"), "text", F.lit("}"))).otherwise("{unknown}")
    has = lambda w: F.max((F.coalesce("why", F.when(F.col("kind") == "env", "environment")) == w).cast("int")) == 1
    verdict = F.when(has("cycle"), "cycle").when(has("depth"), "depth").when(has("unknown"), "unknown").when(has("environment"), "environment").otherwise("resolved")
    listed = F.sort_array(F.collect_list(F.struct("place", "kind", "text", shown.alias("shown"))))
    told = out.groupBy("id", "file").agg(listed.alias("all"), verdict.alias("verdict"))
    text, parts = F.array_join(F.transform("all", lambda x: x["shown"]), ""), F.transform("all", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text")))
    return told.select("id", "file", text.alias("shown"), F.when(F.col("verdict") == "resolved", text).alias("value"), "verdict", parts.alias("parts"))
