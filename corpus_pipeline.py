"""A corpus pipeline: quality rules, toxicity, near duplicates, mixing, BPE; each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm import bpe_codec, catalog, mixing, near, quality, toxicity
from edgewright.llm.shared import intermediates, new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the base rules and the compression bands, fitted on the labelled rows of all documents, keep.

    Null and empty texts have no words and go. Repeated rows are judged each, long texts whole. Other columns stay, whatever their names.
    """
    bands = quality.fit_bands(catalog.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.passing(docs, bands=bands)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, fitted on the labelled rows of all documents, does not call toxic.

    Null and empty texts are scored as texts without words. Repeated rows are judged each, long texts whole. Other columns stay.
    """
    model = toxicity.fit(catalog.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 of their five-word shingles keep the one of the smallest doc_id.

    Of that doc_id's rows in the component the one of the least text hash stays, of rows of one text the least; its rows in
    other components stand for those. A null doc_id is no copy of anything and stays.
    """
    heads = near.component_heads(docs, words=5, p=4, q=5).select("doc_id", "text_key")
    # A whole row is one column, so that no column of its own can meet those made here.
    row = F.struct(*docs.columns)
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("text_key"), row.alias("row"))
    known = keyed.join(heads.withColumnRenamed("doc_id", "key"), ["key", "text_key"], "left_semi").groupBy("key", "text_key").agg(F.min("row").alias("row")).select("row.*")
    return known.unionByName(docs.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null source is one of its own, null and empty texts weigh nothing and are not taken; repeated rows share a decision. Other columns stay.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix; null texts count as empty ones, repeated rows stay."""
    return bpe_codec.encode_decode(docs, catalog.TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither zstandard ratios nor the classifier nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written to the shared folder and read again."""
    docs = catalog.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with intermediates(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
