"""Graphs as two tables: node identity, edges, neighbours, chains and path traces."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.operators.rounds import kept

IDENTITY = ["kind", "name", "file"]


def node_identity(proposals: DataFrame) -> DataFrame:
    """One node for each (kind, name, file), null files alike; its line is that of the proposal of the least ``seq``.

    A partial minimum, so a much-proposed node costs a row for each task.
    """
    first = F.min(F.struct("seq", "line")).alias("first")
    return proposals.groupBy(*IDENTITY).agg(first).select(*IDENTITY, F.col("first.line").alias("line"), F.col("first.seq").alias("seq"))


def with_ids(rows: DataFrame, *order: Column | str, name: str = "id") -> DataFrame:
    """Add 0, 1, 2, ... in the given order; ties must not occur.

    Rows are sorted by range and written once with their range and their place in it, so that neither pruned columns nor a second plan of the same
    ranges can deal them differently; the number is the place behind the rows of the ranges before. One shuffle, and one row for each range to join.
    """
    spot = F.monotonically_increasing_id()  # the range in the high bits, the place in the low 33
    placed = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__spot", spot), "numbered")
    placed = placed.withColumn("__part", F.shiftright("__spot", 33))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    numbered = placed.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__ahead") + F.col("__spot").bitwiseAND((1 << 33) - 1))
    return numbered.drop("__part", "__ahead", "__spot")


def first_edges(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of edges with equal keys the one that comes first; all columns kept."""
    rest = [c for c in edges.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return edges.groupBy(*keys).agg(first).select(*keys, *(F.col(f"first.{c}").alias(c) for c in [*order, *rest])).select(*edges.columns)


def neighbours_out(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("source") == node)


def neighbours_in(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("target") == node)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges one of whose ends is no node; must be empty in a sound graph."""
    ids = nodes.select(F.col("id").alias("known"))
    lost = [edges.join(ids, edges[end] == ids["known"], "left_anti").withColumn("missing", F.lit(end)) for end in ("source", "target")]
    return lost[0].unionByName(lost[1])


def chains(edges: DataFrame, kinds: tuple[str, ...] = ("http-call", "orm-access", "queries")) -> DataFrame:
    """(n0, n1, ...) of every path whose edges are of these kinds in turn."""
    out = None
    for i, kind in enumerate(kinds):
        step = edges.where(F.col("kind") == kind).select(F.col("source").alias(f"n{i}"), F.col("target").alias(f"n{i + 1}"))
        out = step if out is None else out.join(step, f"n{i}")
    return out.select(*(f"n{i}" for i in range(len(kinds) + 1)))


def cross_language(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose ends lie in files of different languages; an end without a file never counts."""
    where = nodes.join(files, "file").select("id", "language")
    ends = edges.join(where.select(F.col("id").alias("source"), F.col("language").alias("from_language")), "source")
    ends = ends.join(where.select(F.col("id").alias("target"), F.col("language").alias("to_language")), "target")
    return ends.where("from_language <> to_language").select(*edges.columns, "from_language", "to_language")


def trace(edges: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """Every path from ``starts`` (node): (path, depth, node, stop), one row where a path ends.

    ``stop`` is chain-end (no edge leads on), else max-depth, or cycle where the next node is on the path already.
    A recursive query, so its number of paths grows as the graph's does: dense graphs need a small depth.
    """
    spark, links, begins = edges.sparkSession, *(f"trace_{uuid.uuid4().hex}" for _ in range(2))
    edges.select("source", "target").distinct().createOrReplaceTempView(links)
    starts.select("node").distinct().createOrReplaceTempView(begins)
    walked = spark.sql(f"""
      with recursive walk(path, node, depth, cycle) max recursion level {max_depth + 1} as (
        select array(node), node, 0, false from {begins}
        union all
        select array_append(w.path, e.target), e.target, w.depth + 1, array_contains(w.path, e.target)
        from walk w join {links} e on w.node = e.source
        where not w.cycle and w.depth < {max_depth}
      )
      select path, node, depth, cycle from walk limit all
    """)
    on = edges.select(F.col("source").alias("on")).distinct()
    ends = walked.join(on, F.col("node") == F.col("on"), "left")
    stop = F.when(F.col("cycle"), "cycle").when(F.col("on").isNull(), "chain-end").when(F.col("depth") >= max_depth, "max-depth")
    return ends.withColumn("stop", stop).where("stop is not null").select("path", "depth", "node", "stop")


def reachable(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Nodes within so many hops of ``starts`` (node), starts included, each once with its distance.

    Only the frontier is joined in each hop; its rows are kept in the checkpoint folder, so plans do not grow.
    """
    links = kept(edges.select("source", "target").distinct())
    found = frontier = kept(starts.select("node").distinct().withColumn("distance", F.lit(0)))
    for hop in range(1, hops + 1):
        ahead = frontier.join(links, frontier["node"] == links["source"]).select(F.col("target").alias("node")).distinct()
        frontier = kept(ahead.join(found, "node", "left_anti").withColumn("distance", F.lit(hop)))
        found = found.unionByName(frontier)
    return found
