"""Traces as asked: a symbol by name and file, its paths in branch order, and only those that lead to a table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions import paths as P
from edgewright.operators.graph import reachable
from edgewright.operators.rounds import kept

# Edge kinds in the order in which branches are told.
KINDS = ("call", "import", "http-call", "queries", "orm-access", "event", "inherits", "implements")
SUGGESTIONS = 10
MAX_DEPTH = 10


def described(kind: Column, name: Column, file: Column, line: Column) -> Column:
    """A node as candidates show it."""
    return F.concat(name, F.lit("  ("), kind, F.lit(")"), F.when(file.isNull(), "").otherwise(F.concat(F.lit("  "), file, F.lit(":"), line.cast("string"))))


def resolve_symbols(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, status, node, candidates) of symbols asked for, as ``name`` or ``file:name``, among nodes (id, kind, name, file, line).

    One node of that name, in a file that ends in the given one by whole folders, is found; several make it ambiguous, in order of file, line and id, and
    none is not-found with the first SUGGESTIONS nodes of that name in other case, or that hold it if it has three letters. Symbols asked for are few and meet all
    nodes in the second case only.
    """
    parts = F.regexp_extract("symbol", r"^(.+):([^:]+)$", 1), F.regexp_extract("symbol", r"^(.+):([^:]+)$", 2)
    asked = symbols.select("symbol").distinct().select("symbol", F.nullif(parts[0], F.lit("")).alias("hint"), F.when(parts[0] == "", F.col("symbol")).otherwise(parts[1]).alias("wanted"))
    hint = F.replace(F.regexp_replace("hint", r"^(?:\./)+", ""), F.lit("\\"), F.lit("/"))
    met = asked.join(nodes.withColumn("wanted", F.col("name")), "wanted").where(F.col("hint").isNull() | F.coalesce(P.suffix_match(F.col("file"), hint), F.lit(False)))
    shown = described(F.col("kind"), F.col("name"), F.col("file"), F.col("line"))
    order = F.struct(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), "id", shown.alias("shown"))
    found = met.groupBy("symbol").agg(F.count("*").alias("n"), F.min("id").alias("node"), F.transform(F.sort_array(F.collect_list(order)), lambda o: o["shown"]).alias("matches"))
    rows = asked.join(found, "symbol", "left")
    lost = F.broadcast(rows.where("n is null").select("symbol", "wanted"))  # a stated set of queries
    near = nodes.join(lost, (F.lower("name") == F.lower("wanted")) | ((F.length("wanted") >= 3) & F.contains("name", "wanted"))).select("symbol", shown.alias("shown")).distinct()
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("shown"))).where(F.col("k") <= SUGGESTIONS)
    near = first.groupBy("symbol").agg(F.sort_array(F.collect_list("shown")).alias("near"))
    status = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("not-found")
    candidates = F.when(F.col("n") > 1, F.col("matches")).when(F.col("n").isNull(), F.coalesce("near", F.array().cast("array<string>")))
    return rows.join(near, "symbol", "left").select("symbol", status.alias("status"), F.when(F.col("n") == 1, F.col("node")).alias("node"), candidates.alias("candidates"))


def leading_to(edges: DataFrame, ends: DataFrame, hops: int = MAX_DEPTH) -> DataFrame:
    """The edges from which a node of ``ends`` (node) is reached in at most ``hops`` edges, each edge counted: found backwards, so what leads nowhere is never walked."""
    back = reachable(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), ends, hops - 1)
    return edges.join(back.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select(*edges.columns)


def trace_steps(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, ends: DataFrame | None = None) -> DataFrame:
    """(start, branch, depth, edge, node, stop): every step of every path from ``starts`` (node); ``branch`` lists the ranks of the edges taken, so that ordering by it tells branches as they are walked.

    Branches go by kind of edge, target and edge. A step back to a node of its path is a cycle; a node without further edges is a chain-end, one beyond which the depth is spent is
    max-depth; any other step has no stop. With ``ends`` (node) only edges that lead to them are walked. Paths grow as the graph's do, so dense graphs need ``ends`` or a small depth.
    """
    spark = edges.sparkSession
    if ends is not None:
        edges = kept(leading_to(edges, ends, max_depth), "leading")
    rank = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)), F.lit(len(KINDS)))
    on = edges.select(F.col("source").alias("target"), F.lit(True).alias("on")).distinct()
    steps = edges.join(on, "target", "left").select("source", F.struct(rank.alias("kind"), F.col("target").alias("node"), F.col("id").alias("edge")).alias("key"), F.coalesce("on", F.lit(False)).alias("on"))
    views = [f"trace_{uuid.uuid4().hex}" for _ in range(2)]
    kept(steps, "steps").createOrReplaceTempView(views[0])
    starts.select("node").distinct().createOrReplaceTempView(views[1])
    walked = spark.sql(f"""
      with recursive walk(start, node, branch, path, depth, stop) max recursion level {max_depth + 1} as (
        select node, node, cast(array() as array<struct<kind: int, node: bigint, edge: bigint>>), array(node), 0, cast(null as string) from {views[1]}
        union all
        select w.start, s.key.node, array_append(w.branch, s.key), array_append(w.path, s.key.node), w.depth + 1,
          case when array_contains(w.path, s.key.node) then 'cycle' when not s.on then 'chain-end' when w.depth + 1 >= {max_depth} then 'max-depth' end
        from walk w join {views[0]} s on s.source = w.node where w.stop is null
      )
      select * from walk where depth > 0 limit all
    """)
    rows = walked.select("start", "branch", "depth", F.element_at("branch", -1)["edge"].alias("edge"), "node", "stop")
    out = kept(rows, "walked")
    for v in views:
        spark.catalog.dropTempView(v)
    return out
