"""Totals and counts of a finished analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_by(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name))


def confidence_histogram(edges: DataFrame) -> DataFrame:
    """Edges by confidence in whole hundredths."""
    return edges.groupBy(F.round(F.col("confidence").cast("double") * 100).cast("int").alias("confidence_pct")).agg(F.count("*").alias("n"))


def totals(results: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counters over decisions and graph."""
    status = F.col("status")
    counts = {s.replace("-", "_"): F.count(F.when(status == s, 1)) for s in ("exact", "strong", "ambiguous", "no-match", "unsupported")}
    one = results.agg(F.count("*").alias("clients"), *(c.alias(k) for k, c in counts.items()))
    more = [nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"), F.countDistinct("kind").alias("edge_kinds"))]
    for m in more:  # rows of one are paired
        one = one.join(m)
    return one


def run_totals(
    files: DataFrame,
    diagnostics: DataFrame,
    symbols: DataFrame,
    routes: DataFrame,
    requests: DataFrame,
    results: DataFrame,
    folded: DataFrame,
    models: DataFrame,
    shared_names: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
) -> DataFrame:
    """One row with the 25 counters of a run.

    files (path, status), diagnostics (file), routes (composed), results (status), folded URLs (status resolved or partial), models
    (table), edges (kind, cross: whether its ends are in different languages); of the other tables rows are counted.
    """
    count = lambda on: F.count(F.when(on, 1))
    torn = diagnostics.select(F.col("file").alias("path")).groupBy("path").agg(F.count("*").alias("__n"))
    seen = files.select("path", "status").join(torn, "path", "left")
    failed, kind = F.col("status") == "failed", F.col("kind")
    one = seen.agg(
        F.count("*").alias("files"),
        count(~failed & F.col("__n").isNull()).alias("files_clean"),
        count(F.col("__n") > 0).alias("files_with_diagnostics"),
        count(failed).alias("files_failed"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("diagnostics"),
    )
    more = [
        symbols.agg(F.count("*").alias("symbols")),
        routes.agg(F.count("*").alias("routes"), count(F.col("composed")).alias("routes_composed")),
        requests.agg(F.count("*").alias("http_observations")),
        results.agg(*(count(F.col("status") == s).alias(s.replace("-", "_")) for s in ("exact", "strong", "ambiguous", "no-match", "unsupported"))),
        folded.agg(*(count(F.col("status") == s).alias(f"dynamic_{s}") for s in ("resolved", "partial"))),
        models.agg(F.count("*").alias("orm_models"), F.count("table").alias("orm_tables")),
        shared_names.agg(F.count("*").alias("orm_ambiguous")),
        nodes.agg(F.count("*").alias("nodes")),
        edges.agg(
            F.count("*").alias("edges"),
            count(kind == "http-call").alias("http_call_edges"),
            count(kind == "call").alias("client_call_edges"),
            count(kind.isin("orm-access", "queries")).alias("orm_edges"),
            count(F.col("cross")).alias("cross_language_edges"),
        ),
    ]
    for m in more:  # rows of one are paired
        one = one.join(m)
    return one


def top_refusals(results: DataFrame, clients: DataFrame, k: int = 3) -> DataFrame:
    """The first refused clients of each file by line."""
    refused = results.where("status in ('unsupported', 'ambiguous', 'no-match')").select("client_id", "status", "unsupported_reason")
    rows = refused.join(clients.select("client_id", "file", "line"), "client_id")
    place = F.row_number().over(Window.partitionBy("file").orderBy("line", "client_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)
