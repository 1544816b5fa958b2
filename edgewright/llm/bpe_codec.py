"""BPE encoding and decoding by a prefix-sharing trie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from edgewright.llm import bpe
from edgewright.llm import kernels as K


def _written(vocabulary: bpe.Vocabulary):
    """Of a word: its ids in decimal, joined by commas, and the bytes its ids decode to."""
    token = vocabulary.bytes
    return lambda word, ids: (",".join(map(str, ids)).encode(), b"".join([token[i] for i in ids]))


def _codec(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = bpe.encoder(path, trie=True, derive=_written)
    for batch in batches:
        for a, b, buf, offs in K.chunks(batch.column(1)):
            slots, first = encode(buf, offs)
            counts = K.sums(encode.cache.lengths[slots], first)
            shown, plain = (c[slots].tolist() for c in encode.cache.derived) if len(slots) else ([], [])
            ids_sha, text_sha = [], []
            for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                ids_sha.append(hashlib.sha256(b",".join(shown[i:j])).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(plain[i:j]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def encode_decode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and return a digest of both, one row for each input row.

    A null text counts as empty: no ids, and the digests of the empty string. Texts of any length are encoded whole. Repeated rows give repeated
    results, an empty table an empty one; other columns are left out, whatever their names.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(lambda it: _codec(it, tokenizer), schema)


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = bpe.encoder(path, trie=True)
    for batch in batches:
        for a, b, buf, offs in K.chunks(batch.column(1)):
            ids, begins = encode.ids(buf, offs)
            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "ids"])


def encode_ids(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; null counts as empty."""
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return source.mapInArrow(lambda it: _ids(it, tokenizer), f"doc_id {kind}, ids array<int>")


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    token = bpe.encoder(path, trie=True).vocabulary.bytes
    for batch in batches:
        lists = batch.column(1).to_pylist()
        plain = [None if x is None else b"".join([token[i] for i in x]).decode("utf-8", "replace") for x in lists]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.string())], names=["doc_id", "text"])


def decode_ids(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give null, broken UTF-8 the replacement character."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(lambda it: _texts(it, tokenizer), f"doc_id {kind}, text string")
