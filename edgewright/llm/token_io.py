"""Token ids in ORC: run-length encoded integers in stripes, with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.llm import bpe
from edgewright.llm import kernels as K
from edgewright.llm.shared import new_path, written

END_ID = 2
OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "5000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
_FILE = "doc_id {id}, part int, place long, n_tokens long, ids array<int>"


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    part, place = TaskContext.get().partitionId(), 0
    encode = bpe.encoder(path, trie=False)
    for batch in batches:
        for a, b, buf, offs in K.chunks(batch.column(1)):
            ids, begins = encode.ids(buf, offs)
            values = np.insert(ids, begins[1:], END_ID)
            offsets = begins + np.arange(b - a + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.full(b - a, part, np.int32)),
                    pa.array(place + offsets[:-1]),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32))),
                ],
                names=["doc_id", "part", "place", "n_tokens", "ids"],
            )
            place += int(offsets[-1])


def write_ids(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text (null: empty), append END_ID, and write an ORC table in ascending order of document id.

    File k holds the k-th range of ids; ``part`` is k and ``place`` the number of ids before a document in its
    file, so a document's global start needs only the files' totals. Equal document ids are ordered by the hash of their
    text, null ids come first; equal rows stay rows of their own. Texts of any length are encoded whole, an empty table gives a table without rows.
    Extra columns are left out, whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(lambda it: _encode(it, tokenizer), _FILE.format(id=docs.schema[doc_id].dataType.simpleString()))
        .write.options(**OPTIONS)
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a table of write_ids; filters on doc_id prune files, stripes and row groups."""
    rows = spark.read.orc(path)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids"))  # a row for each file
    offsets = totals.select("part", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("offset"))
    offsets, _ = written(offsets, "file-starts")  # its size is known, so Spark broadcasts it while it is small
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        begins, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(begins).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_file_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of all documents, read the files back, and digest each document's ids."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write_ids(docs, tokenizer, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = read_ids(spark, path).select("doc_id", "start", "ids")
    return rows.mapInArrow(_digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
