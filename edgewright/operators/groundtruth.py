"""Produced facts against ground truth, and audits of produced edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions import paths as P

#: Lines by which a produced fact may miss a declared one and still count as a near miss.
NEAR = 2


def edge_audit(edges: DataFrame, columns: tuple[str, ...] = ("confidence", "provenance", "evidence", "file", "line")) -> DataFrame:
    """Edges that lack any of these attributes, with the names of those missing."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))
    return edges.withColumn("missing", missing).where(F.size("missing") > 0)


def must_not_produce(produced: DataFrame, forbidden: DataFrame, keys: list[str]) -> DataFrame:
    """Produced rows that the ground truth forbids; must be empty."""
    return produced.join(forbidden.select(*keys).distinct(), keys, "left_semi")


def score_lines(declared: DataFrame, produced: DataFrame) -> DataFrame:
    """Outcome of each declared (file, line): tp at the same line, near within NEAR lines, else fn.

    Each declared row probes its lines one by one, so the band is an equi-join; the nearest produced line is kept, the lower first.
    """
    offset = F.explode(F.array(*(F.lit(k) for k in range(-NEAR, NEAR + 1)))).alias("off")
    probes = declared.select("file", "line").distinct().select("file", F.col("line").alias("declared"), offset).withColumn("line", F.col("declared") + F.col("off"))
    hits = probes.join(produced.select("file", "line").distinct(), ["file", "line"])
    best = hits.groupBy("file", F.col("declared").alias("line")).agg(F.min(F.struct(F.abs("off").alias("distance"), "line")).alias("b"))
    joined = declared.join(best, ["file", "line"], "left")
    outcome = F.when(F.col("b.distance") == 0, "tp").when(F.col("b").isNotNull(), "near").otherwise("fn")
    return joined.select(*declared.columns, outcome.alias("outcome"), F.col("b.line").alias("produced_line"))


def unmatched(declared: DataFrame, produced: DataFrame) -> DataFrame:
    """Produced (file, line) that nothing declares: false positives."""
    return produced.join(declared.select("file", "line").distinct(), ["file", "line"], "left_anti")


def is_parameter(segment: Column) -> Column:
    """Whether the source leaves a segment's value open: it starts with < or :, or holds a { anywhere."""
    return F.startswith(segment, F.lit("<")) | F.startswith(segment, F.lit(":")) | F.contains(segment, F.lit("{"))


def request_path(url: Column) -> Column:
    """The path that a request names: without fragment, query, scheme and host."""
    return F.when(P.authority(url).isNotNull() & (P.plain_path(P.after_authority(url)) == ""), "/").otherwise(P.plain_path(P.after_authority(url)))


def canonical_key(path: Column) -> Column:
    """A path with its open segments erased, for an independent comparison by equality; a trailing slash stays."""
    parts = F.transform(P.segments(request_path(path)), lambda s: F.when(is_parameter(s), "{*}").otherwise(s))
    slash = F.when(F.endswith(path, F.lit("/")) & (F.length(path) > 1), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(parts, "/"), slash)


def request_recall(truth: DataFrame, produced: DataFrame) -> DataFrame:
    """One row: requests (method, path) in the truth, and how many of them were produced, by method and erased path."""
    key = lambda rows: rows.select(F.upper("method").alias("method"), canonical_key(F.col("path")).alias("key"))
    known = key(produced).distinct().withColumn("found", F.lit(1))
    joined = key(truth).distinct().join(known, ["method", "key"], "left")
    return joined.agg(F.count("*").alias("truth"), F.count("found").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("truth"), 4))


def paths_agree(client: Column, route: Column) -> Column:
    """agree, disagree or undecided for two lists of segments.

    A route's parameter takes any segment; an open segment of the client against a literal decides nothing; two literals must be equal.
    """
    each = F.zip_with(client, route, lambda c, r: F.when(is_parameter(r), 1).when(is_parameter(c), 0).when(c == r, 1).otherwise(-1))
    return (
        F.when(F.size(client) != F.size(route), "disagree").when(F.exists(each, lambda x: x == -1), "disagree").when(F.exists(each, lambda x: x == 0), "undecided").otherwise("agree")
    )


def accessed_by(found: DataFrame) -> DataFrame:
    """For each model its accessors in order of file and line, joined to a text; at most as long as a model's accesses are many."""
    rows = found.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("file", "line", "enclosing"))).alias("x"))
    shown = F.transform("x", lambda e: F.concat(e["file"], F.lit(":"), e["line"].cast("string"), F.lit(" "), e["enclosing"]))
    return rows.select("model", F.size("x").cast("long").alias("accesses"), F.array_join(shown, "; ").alias("accessed_by"))


def refusals_near(points: DataFrame, refused: DataFrame, k: int = 3) -> DataFrame:
    """For each point (file, point_id) the first k refusals (file, line, reason) of its file by line: a file's are picked once for all its points."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("line", "reason"))
    first = refused.select("file", "line", "reason").withColumn("place", place).where(F.col("place") <= k)
    return points.select("file", "point_id").join(first, "file")


def as_json(edges: DataFrame) -> DataFrame:
    """(id, json): each edge as a JSON object whose absent attributes are left out."""
    return edges.select("id", F.to_json(F.struct(*edges.columns)).alias("json"))
