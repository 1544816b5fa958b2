"""Imports followed from a name to the file that declares it: specifiers become files within each hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.functions import paths as P
from edgewright.operators.resolution import HOPS, nearest_alias, path_suffixes
from edgewright.operators.rounds import kept

# Fixed values.
PACKAGE = "is a package, and no build configuration aliases it"
NO_FILE = "does not resolve to a file this project contains"
NO_MODULE = "is not a module this project contains"


def typescript_targets(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file, specifier, target, reason) of TypeScript's specifiers: the first file there is among name.ts, .tsx, /index.ts, /index.tsx and the name itself.

    A specifier that begins with a dot starts from the importing file's folder, another from the root by its build alias; one without an alias is a package.
    """
    wanted = imports.select("file", "specifier").distinct()
    dotted = F.startswith("specifier", F.lit("."))
    led = nearest_alias(wanted.where(~dotted), aliases).withColumn("aliased", F.col("resolved") != F.col("specifier"))
    base = wanted.where(dotted).select("file", "specifier", P.fold_relative(P.directory(F.col("file")), F.col("specifier")).alias("base"), F.lit(True).alias("led"))
    base = base.unionByName(led.select("file", "specifier", F.when(F.col("aliased"), P.fold_relative(F.lit(""), F.col("resolved"))).alias("base"), F.col("aliased").alias("led")))
    ends = F.array(*(F.lit(e) for e in (".ts", ".tsx", "/index.ts", "/index.tsx", "")))
    tried = base.select("file", "specifier", F.posexplode(F.transform(ends, lambda e: F.concat("base", e))).alias("rank", "candidate")).where("candidate is not null")
    found = tried.join(files.select(F.col("file").alias("candidate")).distinct(), "candidate").groupBy("file", "specifier").agg(F.min_by("candidate", "rank").alias("target"))
    met = base.join(found, ["file", "specifier"], "left")
    return met.select("file", "specifier", "target", F.when(~F.col("led"), PACKAGE).when(F.col("target").isNull(), NO_FILE).alias("reason"))


def python_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, specifier, target, reason) of Python's specifiers: the one file whose path ends in the module's, a module before a package.

    Leading dots climb from the importing file's folder, one less than there are; what then is relative is looked for among all paths as well. Several files
    are none.
    """
    wanted = imports.select("file", "specifier").distinct()
    dots = F.length("specifier") - F.length(F.ltrim(F.col("specifier"), F.lit(".")))
    rest = F.replace(F.ltrim(F.col("specifier"), F.lit(".")), F.lit("."), F.lit("/"))
    folders = F.filter(F.split(P.directory(F.col("file")), "/", -1), lambda d: d != "")
    climbed = F.when(dots - 1 <= F.size(folders), F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - dots + 1, F.lit(0))), "/"))
    base = F.when(dots == 0, rest).when(rest == "", climbed).when(climbed == "", rest).otherwise(F.concat(climbed, F.lit("/"), rest))
    tried = wanted.select("file", "specifier", F.posexplode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("tier", "suffix")).where("suffix is not null")
    ends = files.select(F.col("file").alias("target"), F.explode(path_suffixes(F.col("file"))).alias("suffix"))
    counted = tried.join(ends, "suffix").groupBy("file", "specifier", "tier").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    first = counted.groupBy("file", "specifier").agg(F.min(F.struct("tier", "n", "target")).alias("f"))
    met = wanted.join(first, ["file", "specifier"], "left")
    target = F.when(F.col("f.n") == 1, F.col("f.target"))
    return met.select("file", "specifier", target.alias("target"), F.when(target.isNull(), NO_MODULE).alias("reason"))


def _python(file: Column) -> Column:
    return file.rlike(r"(?i)\.pyi?$")


def resolve_names(names: DataFrame, imports: DataFrame, declared: DataFrame, files: DataFrame, aliases: DataFrame, hops: int = HOPS) -> DataFrame:
    """(file, name, status, declared_in, line, module, reason, route) of names (file, name), followed through imports in at most ``hops`` hops.

    imports (file, seq, specifier, imported, local), declared (file, name, line) at module scope, files (file), build aliases (dir, alias, target). The first import that
    binds a name decides; in TypeScript, where none does, all wildcard re-exports are looked behind, and what several files answer is ambiguous. Status is
    local, declared, ambiguous, unresolved with module and reason, or not-bound. Each hop is kept as a table, so plans do not grow with the hops.
    """
    own = declared.groupBy(F.col("file").alias("at"), F.col("name").alias("as")).agg(F.min("line").alias("line"))
    py = _python(F.col("file"))
    targets = kept(python_targets(imports.where(py), files).unionByName(typescript_targets(imports.where(~py), files, aliases)), "targets")
    known = imports.join(targets, ["file", "specifier"])
    binds = (F.col("local").isNotNull()) & ((F.col("imported") != "*") | ((F.col("local") != "*") & ~py))
    exported = F.when((F.col("imported") == "*"), F.col("local")).otherwise(F.col("imported"))
    step = known.where(binds).groupBy(F.col("file").alias("at"), F.col("local").alias("as")).agg(F.min(F.struct("seq", exported.alias("exported"), "specifier", "target", "reason")).alias("b"))
    stars = known.where((F.col("imported") == "*") & (F.col("local") == "*") & ~py & F.col("target").isNotNull()).select(F.col("file").alias("at"), "specifier", "target").distinct()
    step, stars = kept(step.select("at", "as", "b.*"), "bindings"), kept(stars, "stars")
    none = lambda kind: F.lit(None).cast(kind)
    start = names.select("file", "name").distinct().join(own.select(F.col("at").alias("file"), F.col("as").alias("name"), "line"), ["file", "name"], "left")
    ended = [start.where("line is not null").select("file", "name", F.lit("local").alias("status"), F.col("file").alias("declared_in"), "line", none("string").alias("module"), none("string").alias("reason"), none("string").alias("route"), F.lit(False).alias("star"))]
    front = kept(start.where("line is null").select("file", "name", F.col("file").alias("at"), F.col("name").alias("as"), F.lit("").alias("route"), none("string").alias("via"), F.lit(False).alias("star")), "front")

    def fails(rows: DataFrame, module: Column, reason: Column) -> DataFrame:
        return rows.select("file", "name", F.lit("unresolved").alias("status"), none("string").alias("declared_in"), none("int").alias("line"), module.alias("module"), reason.alias("reason"), none("string").alias("route"), "star")

    then = F.when(F.col("route") == "", "").otherwise(" then ")
    for hop in range(hops):
        met = front.join(step, ["at", "as"], "left")
        python = _python(F.col("at"))
        ended.append(fails(met.where("reason is not null"), F.col("specifier"), F.col("reason")))
        lost = met.where(F.col("specifier").isNull() & python & F.lit(hop > 0))
        ended.append(fails(lost, F.col("via"), F.concat(F.lit("does not declare or re-export `"), "as", F.lit("`"))))
        taken = F.when(python, F.concat(F.lit("`from "), "specifier", F.lit(" import "), "exported", F.lit("`"))).otherwise(F.concat(F.lit('`from "'), "specifier", F.lit('"`')))
        moved = met.where("target is not null").select("file", "name", F.col("target").alias("at"), F.col("exported").alias("as"), F.concat("route", then, taken).alias("route"), F.col("specifier").alias("via"), "star")
        behind = met.where(F.col("specifier").isNull() & ~python).select("file", "name", "at", "as", "route").join(stars, "at")
        shown = F.concat("route", then, F.lit('`export * from "'), "specifier", F.lit('"`'))
        behind = behind.select("file", "name", F.col("target").alias("at"), "as", shown.alias("route"), F.col("specifier").alias("via"), F.lit(True).alias("star"))
        seen = kept(moved.unionByName(behind).join(own, ["at", "as"], "left"), "seen")
        ended.append(seen.where("line is not null").select("file", "name", F.lit("declared").alias("status"), F.col("at").alias("declared_in"), "line", none("string").alias("module"), none("string").alias("reason"), "route", "star"))
        front = seen.where("line is null").drop("line")
        if front.isEmpty():
            break
    ended.append(fails(front, F.col("at"), F.lit(f"re-export chain exceeded {hops} hops")))
    out = ended[0]
    for rows in ended[1:]:
        out = out.unionByName(rows)
    good = F.when(F.col("status").isin("local", "declared"), F.struct("declared_in", "line", "route", "status"))
    bad = F.when((F.col("status") == "unresolved") & ~F.col("star"), F.struct("module", "reason"))
    told = out.groupBy("file", "name").agg(F.countDistinct(F.when(good.isNotNull(), F.col("declared_in"))).alias("n"), F.min(good).alias("g"), F.min(bad).alias("b"))
    rows = names.select("file", "name").distinct().join(told, ["file", "name"], "left")
    status = F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, F.col("g.status")).when(F.col("b").isNotNull(), "unresolved").otherwise("not-bound")
    one = lambda c: F.when(F.col("n") == 1, F.col(c))
    lost = lambda c: F.when(status == "unresolved", F.col(c))
    return rows.select("file", "name", status.alias("status"), one("g.declared_in").alias("declared_in"), one("g.line").alias("line"), lost("b.module").alias("module"), lost("b.reason").alias("reason"), one("g.route").alias("route"))
