"""Exact line deduplication: hashes sorted by range, first occurrences streamed, decisions kept as bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from edgewright.llm.shared import written

WHITE = " \t\n\x0b\f\r"
#: Keys of fewer code points are never looked for elsewhere.
LEAST_POINTS = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), _UPPER, _LOWER)


def _text_key(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key): rows of one doc_id are told apart by their text; other columns are left out, whatever their names."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))


_FOUND = "hash binary, doc_id {id}, text_key long, line int, known boolean"


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether values are equal, null equal to null."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(both, pc.fill_null(pc.equal(a, b), False)).to_numpy(zero_copy_only=False)


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (hash, doc_id, text_key, line): those that are not in the first document of their hash, ``known`` true.

    A hash may have begun in a range before, so of the range's first hash every row is given too, ``known`` false; so is the first row
    of its last hash (``line`` null), which may go on in the next range. What is held between batches is one row.
    """
    open_, first_hash = None, None

    def head(row: pa.RecordBatch) -> pa.RecordBatch:
        nothing = pa.array([None], row.schema.field("line").type)
        return pa.RecordBatch.from_arrays([row.column(0), row.column(1), row.column(2), nothing, pa.array([False])], names=["hash", "doc_id", "text_key", "line", "known"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        begun = open_ is not None
        rows = pa.Table.from_batches([open_, batch]).combine_chunks().to_batches()[0] if begun else batch
        hashes, docs = rows.column(0), rows.column(1)
        new = np.ones(len(rows), dtype=bool)
        new[1:] = ~_same(hashes.slice(1), hashes.slice(0, len(rows) - 1))
        begin = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        again = ~_same(docs, docs.take(pa.array(begin)))
        if first_hash is None:
            first_hash = hashes[0].as_py()
        unsure = np.zeros(len(rows), dtype=bool)
        if hashes[0].as_py() == first_hash:
            unsure = begin == 0
        give = again | unsure
        give[: int(begun)] = False
        at = pa.array(np.flatnonzero(give))
        out = rows.take(at)
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(~unsure[at.to_numpy()])], names=["hash", "doc_id", "text_key", "line", "known"])
        open_ = rows.slice(int(begin[-1]), 1)
    if open_ is not None:
        yield head(open_)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line): every line, counted from 0, whose key is in a document before, in order of doc_id.

    128-bit digests of the keys of at least LEAST_POINTS code points are dealt out by ranges of (digest, doc_id, text, line) and sorted,
    so a digest that a third of all lines share is spread over as many ranges as it needs. Ranges are joined by two rows each: the
    first document of a digest is the least one that any range tells.
    Rows of one doc_id are one document; a null doc_id is a document after all others.
    """
    texts = _text_key(docs)
    lines = texts.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("line", "code")).withColumn("key", line_key(F.col("code")))
    hashed = lines.where(F.length("key") >= LEAST_POINTS).select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash"), "doc_id", "text_key", "line")
    order = [F.col("hash"), F.col("doc_id").asc_nulls_last(), F.col("text_key"), F.col("line")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    found, _ = written(hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_first_occurrences, _FOUND.format(id=kind)), "line-occurrences")
    tops = found.where(~F.col("known")).groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n"))  # two rows at most for each range: broadcast
    unsure = found.where(~F.col("known") & F.col("line").isNotNull()).join(F.broadcast(tops), "hash")
    later = unsure.where(F.when(F.col("doc_id").isNull(), F.col("n") > 0).otherwise(F.col("doc_id") != F.col("first")))
    return found.where("known").select("doc_id", "text_key", "line").unionByName(later.select("doc_id", "text_key", "line"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, counts = [], []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            keep = np.ones(n, dtype=bool)
            if gone.is_valid:
                keep[gone.values.to_numpy()] = False
            packed.append(zlib.compress(np.packbits(keep).tobytes(), 1) if not keep.all() else None)
            counts.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "text_key", "n_lines", "n_dropped", "keep"]
        )


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    r"""(doc_id, text_key, n_lines, n_dropped, keep), one row for each doc_id and text: which lines of a text stay, without the text.

    Texts are split at \n; a null or empty text is one empty line. A line whose key (white space stripped at both ends, A-Z lower-cased)
    has at least LEAST_POINTS code points and is in another document too stays only in the document of the least doc_id; there all of its
    lines stay. ``keep`` is a zlib-compressed bitmap of the lines, the first line in the highest bit; null keeps all.

    Nulls: a null doc_id is a document after all others. Repeated rows have one bitmap, rows of one doc_id are one document. Long texts are
    split whole; only their lines' places meet again by document. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    gone = repeated_lines(docs).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone"))
    size = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    every = _text_key(docs).select("doc_id", "text_key", size.alias("n_lines")).distinct()
    met = every.alias("e").join(gone.alias("g"), F.col("e.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("e.text_key") == F.col("g.text_key")), "left")
    return met.select("e.doc_id", "e.text_key", "n_lines", "gone").mapInArrow(_bitmaps, f"doc_id {kind}, text_key long, n_lines long, n_dropped long, keep binary")


def _kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, bitmaps in batches:
        out = []
        for text, keep in zip(texts, bitmaps, strict=True):
            if not keep.is_valid:
                out.append(text.as_py())
                continue
            lines = text.as_py().split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), count=len(lines)).tolist()
            out.append("\n".join(line for line, bit in zip(lines, bits, strict=True) if bit))
        yield pa.array(out, pa.string())


def kept_text(text: Column, keep: Column) -> Column:
    r"""The lines of a text that its bitmap keeps, joined by \n; a null bitmap keeps the text."""
    return F.arrow_udf(_kept, "string", ArrowUDFType.SCALAR_ITER)(text, keep)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every row of ``docs`` with the lines that its bitmap keeps; null texts are empty ones."""
    met = _text_key(docs).alias("d").join(keep_bitmaps(docs).alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_key") == F.col("b.text_key")))
    return met.select("d.doc_id", kept_text(F.col("text"), F.col("keep")).alias("text"), "n_lines", "n_dropped")


def kept_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    """The digests as SQL."""
    return rf"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as place from documents),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key from lines),
first as (select key, min(doc_id) as least from keyed where length(key) >= {LEAST_POINTS} group by key having count(distinct doc_id) > 1),
told as (select k.doc_id, k.place, k.line, f.key is not null and k.doc_id <> f.least as gone from keyed k left join first f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from told group by doc_id"""
