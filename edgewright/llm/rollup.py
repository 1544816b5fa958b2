"""Delta-maintained token counts: totals by source, language and tokenizer version from signed batches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import ArrowUDFType

from edgewright.llm import bpe
from edgewright.llm import kernels as K

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = T.StructType(
    [*(T.StructField(k, T.StringType()) for k in KEYS), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())]
)


def signed(deltas: DataFrame) -> DataFrame:
    """Signed changes of rows (source, lang, tokenizer, change, tokens, old_tokens).

    ``insert`` adds a document and its tokens, ``delete`` takes both away, ``revise`` replaces old_tokens by tokens.
    Null counts are 0; null keys are groups of their own; any other change is an error, never dropped. Repeated rows count
    each; an empty table sums to nothing; other columns are left out, whatever their names.
    """
    new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("tokens", "old_tokens"))
    change = F.col("change")
    return deltas.select(
        *KEYS,
        F.when(change == "insert", 1).when(change == "delete", -1).when(change == "revise", 0).otherwise(F.raise_error(F.lit("unknown change"))).cast("long").alias("n_docs"),
        F.when(change == "insert", new).when(change == "delete", -new).otherwise(new - old).alias("n_tokens"),
    )


class TokenRollup:
    """Totals in a folder, kept up to date by signed batches.

    Each commit adds a batch's sums to the totals of the present version, writes them as a new table, and publishes it
    by renaming a small file that names the table and the batches in it. A reader sees one version or the next, never a
    part; a job that dies before the rename leaves the present version in force. A batch that is in the totals already is not
    added again. A batch's rows are summed before they are shuffled: a source with a third of all rows costs one row a task.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self._path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _version(self) -> tuple[int, str | None, list[str]]:
        """Number, totals table and batches of the version in force; 0 before the first commit."""
        folder = self._at(f"{self._path}/versions")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        newest = max((int(n) for n in names if n.isdigit()), default=0)
        if not newest:
            return 0, None, []
        held = self._held(newest)
        return newest, held["totals"], held["batches"]

    def _held(self, number: int) -> dict:
        stream = self._files.open(self._at(f"{self._path}/versions/{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, number: int, table: str, batches: list[str]) -> None:
        draft, final = self._at(f"{self._path}/drafts/{uuid.uuid4().hex}"), self._at(f"{self._path}/versions/{number}")
        self._files.mkdirs(final.getParent())
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps({"totals": table, "batches": batches}).encode()))
        stream.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise RuntimeError(f"another writer committed version {number}; commit the batch again")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch to the totals; False, and no work, if it is in them already."""
        number, table, batches = self._version()
        if batch in batches:
            return False
        sums = _summed(signed(deltas))
        if table is not None:
            sums = _summed(self._read(table).unionByName(sums))
        made = f"totals-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self._path}/{made}")
        self._publish(number + 1, made, [*batches, batch])
        return True

    def _read(self, table: str) -> DataFrame:
        return self._spark.read.schema(SCHEMA).parquet(f"{self._path}/{table}")

    def batches(self) -> list[str]:
        """Names of the batches in the totals, in order of commit."""
        return self._version()[2]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of the version in force, as they lie; none before the first commit.

        Groups whose documents are all gone are left out.
        """
        table = self._version()[1]
        if table is None:
            return self._spark.createDataFrame([], SCHEMA)
        return self._read(table).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def tidy(self) -> None:
        """Delete the totals tables of earlier versions, once nothing reads them.

        Only tables that an earlier version names go: one that a writer has made and not yet published, or that is newer than the version read
        here, is named by none of those. Tables of writers that died stay. Version files stay too: a slow writer must find its number taken.
        """
        number, table, _ = self._version()
        for older in range(1, number):
            name = self._held(older)["totals"]
            if name != table:
                self._files.delete(self._at(f"{self._path}/{name}"), True)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _bpe_counts(batches: Iterator[pa.Array], path: str) -> Iterator[pa.Array]:
    encode = bpe.encoder(path, trie=False)
    for column in batches:
        parts = []
        for _, _, buf, offs in K.chunks(column):
            slots, first = encode(buf, offs)
            parts.append(K.sums(encode.cache.lengths[slots], first))
        yield pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64))


#: Texts that sentencepiece encodes in one call.
TEXTS = 64
_pieces: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _piece_counts(batches: Iterator[pa.Array], path: str) -> Iterator[pa.Array]:
    if path not in _pieces:
        _pieces[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    for column in batches:
        counts: list[int] = []
        for a in range(0, len(column), TEXTS):
            counts += map(len, _pieces[path].encode([t or "" for t in column.slice(a, TEXTS).to_pylist()], num_threads=1))
        yield pa.array(counts, pa.int64())


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of a whole text (null: 0) by a tokenizer file, without special tokens: ``.json`` byte-level BPE or ``.model`` of sentencepiece.

    Texts are counted whole, however long; repeated rows are counted each.
    """
    count = _bpe_counts if tokenizer.endswith(".json") else _piece_counts

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return count(batches, tokenizer)

    return F.arrow_udf(counted, "long", ArrowUDFType.SCALAR_ITER)(text)
