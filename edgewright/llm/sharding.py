"""Sharding by proportional stratified interleaving: every shard holds each source in the mixture's share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewright.llm.shared import written

#: About so many rows are ranked together.
ROWS_A_BUCKET = 4096
OVERHEAD = 16


def _ranked(rows: DataFrame, keys: list[str], bucket: str, order: list) -> DataFrame:
    """Add ``rank`` (from 0) of each row in its keys' order and ``total`` of the keys; buckets follow that order.

    Bucket sizes are summed first, so only a bucket's rows meet in a task, however large its keys' group is.
    """
    sizes = rows.groupBy(*keys, bucket).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    ahead = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, bucket, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(group).alias("total"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    joined = rows.join(sizes, [*keys, bucket])
    return joined.withColumn("rank", F.col("ahead") + F.row_number().over(inside) - 1).drop("ahead", bucket)


def stratified_shards(docs: DataFrame, shards: int = 40, seed: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``rows``: counts at most one apart.

    Rows of a source are shuffled by a seeded hash and ranked; rank over the source's count, moved by a phase of the
    source so that small sources spread, orders all rows, and equal cuts of that order are the shards. The hash covers
    doc_id and text: equal texts fall anywhere, repeated rows are told apart by nothing and take neighbouring places.
    A null source is a source of its own; null texts count no bytes. ``grown_shard`` is null under this law. Texts of any length are read only for their
    size and checksum; an empty table gives an empty one; other columns are left out, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.xxhash64(F.col("source").isNull(), "source").alias("source"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("hash"),
    )
    rows, _ = written(rows, "shard-rows")
    count = rows.count()
    buckets = max(1, count // ROWS_A_BUCKET)
    place = (F.shiftright("hash", 32) + (1 << 31)) * buckets
    rows = rows.withColumn("bucket", F.shiftright(place, 32))
    ranked = _ranked(rows, ["source"], "bucket", ["hash", "doc_id", "text_crc32"])
    phase = F.pmod(F.xxhash64(F.lit(seed), F.lit("phase"), "source"), F.lit(1 << 20)) / float(1 << 20)
    ranked = ranked.withColumn("place", (F.col("rank") + phase) / F.col("total")).drop("rank", "total")
    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("place") * buckets), F.lit(buckets - 1)))
    ordered = _ranked(ranked, [], "bucket", ["place", "source", "hash", "doc_id", "text_crc32"])
    shard = F.expr(f"(rank * {shards}) div total")
    ordered = ordered.withColumn("shard", shard)
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ordered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
