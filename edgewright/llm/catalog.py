"""Queries over the driver's tables that apply each operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm import bpe_codec, conversations, licences, lines, media, mixing, near, phrases, quality, rollup, sharding, token_io, toxicity
from edgewright.llm.shared import new_path, written

#: Where the vocabulary file of the BPE queries lies.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.compression_bands(docs, bands=quality.fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licenses(documents(spark, sf_dir))


def op3_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.token_file_digest(documents(spark, sf_dir), TOKENIZER)


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, choices = mixing.pareto_mix(documents(spark, sf_dir))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixing.copies(rows, choices).select("doc_id", "size", "source_size", "target", taken)


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(documents(spark, sf_dir), TOKENIZER)


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(documents(spark, sf_dir))


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_as_avi(documents(spark, sf_dir)))


def op9_t_occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_components(documents(spark, sf_dir))


#: Tokenizer versions of the rollup.
COUNTED = {"byte-bpe-50k": TOKENIZER, "piece-bpe-32k": public_tokenizers.path("piece_bpe_32k.model")}


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: all documents counted by the first tokenizer; those labelled of low quality deleted; those labelled
    toxic revised to a blanked text, which has no tokens; all documents counted by the second. The second and third are committed twice."""
    counts = [rollup.token_count(F.col("text"), file).alias(f"t{k}") for k, file in enumerate(COUNTED.values())]
    counted, _ = written(documents(spark, sf_dir).select("doc_id", "source", "lang", *counts), "token-counts")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    first, second = COUNTED

    def deltas(rows: DataFrame, tokenizer: str, change: str, tokens: str, old: str | None = None) -> DataFrame:
        before = F.col(old) if old else F.lit(None).cast("long")
        return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(change).alias("change"), F.col(tokens).alias("tokens"), before.alias("old_tokens"))

    low = counted.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    toxic = counted.join(labels.where("toxic = 1 and quality <> 0").select("doc_id"), "doc_id", "left_semi").withColumn("blank", F.lit(0))
    total = rollup.TokenRollup(spark, new_path(spark, "token-totals"))
    total.commit("0-insert", deltas(counted, first, "insert", "t0"))
    for _ in range(2):
        total.commit("1-delete", deltas(low, first, "delete", "t0"))
        total.commit("2-revise", deltas(toxic, first, "revise", "blank", "t0"))
    total.commit("3-insert", deltas(counted, second, "insert", "t1"))
    return total.totals()


def op11_repair_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.kept_digests(documents(spark, sf_dir))


def op13_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_compression_bands,
        op2_license_join,
        op3_orc_token_ids,
        op4_pareto_mix,
        op5_trie_bpe,
        op6_stratified_shards,
        op7_subword_toxicity,
        op8_motion_jpeg,
        op9_t_occurrence_join,
        op10_token_rollup,
        op11_repair_audits,
        op12_line_bitmaps,
        op13_suffix_collocations,
    )
}
#: What SQL can say; tests hold the other operators against brute force.
ORACLES: dict[str, str] = {"op2_license_join": licences.oracle(), "op11_repair_audits": conversations.oracle(), "op12_line_bitmaps": lines.oracle(), "op13_suffix_collocations": phrases.oracle()}
