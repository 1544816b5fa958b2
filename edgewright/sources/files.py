"""Source files as rows: discovery, language, UTF-8 gate, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright import schemas
from edgewright.functions import paths as P


def supported(files: DataFrame) -> DataFrame:
    """Rows (path) of a known language outside hidden and skipped directories, with ``language``."""
    folders = F.slice(F.split("path", "/", -1), F.lit(1), F.size(F.split("path", "/", -1)) - 1)
    skipped = F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(*schemas.SKIP_DIRS))
    return files.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/"))).where(~skipped).withColumn("language", P.language(F.col("path"))).where("language is not null")


def gate(files: DataFrame) -> DataFrame:
    """Add ``status`` and ``text`` to (path, content): content that is not UTF-8 fails and keeps its row."""
    good = F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False)) & F.col("content").isNotNull()
    return files.withColumns({"status": F.when(good, "complete").otherwise("failed"), "text": F.when(good, F.decode("content", "utf-8"))})


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, content, status, text) of the supported files below a folder, paths relative to it."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    rows = files.select(F.substring(relative, F.length(F.lit(base)) + 2, F.length("path")).alias("path"), "content")
    return gate(supported(rows))


def from_rows(spark: SparkSession, rows: list[tuple[str, str | bytes]]) -> DataFrame:
    """The same from (path, source) pairs in memory."""
    made = [(p, bytearray(s.encode() if isinstance(s, str) else s)) for p, s in rows]
    return gate(supported(spark.createDataFrame(made, "path string, content binary")))


def _without_long_strings(text: Column) -> Column:
    """Python text whose triple-quoted strings over several lines are empty ones, followed by as many line ends as they had."""
    one = lambda q: rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}"
    tokens = F.regexp_extract_all(text, F.lit(rf"""(?s)(\"{{3}}.*?(?:\"{{3}}|\z)|'{{3}}.*?(?:'{{3}}|\z)|#[^\n]*+|{one('"')}|{one("'")}|[^"'#]++|.)"""), F.lit(1))
    long = lambda t: t.rlike(r"^(?:\"{3}|'{3})") & F.contains(t, F.lit("\n"))
    return F.array_join(F.transform(tokens, lambda t: F.when(long(t), F.concat(F.lit("''"), F.repeat(F.lit("\n"), F.regexp_count(t, F.lit("\n"))))).otherwise(t)), "")


def lines(files: DataFrame, raw: bool = False) -> DataFrame:
    """(file, language, line, code) of complete files, lines from 1.

    Unless ``raw`` is wanted, Python's strings over several lines are emptied: examples in docstrings declare nothing.
    """
    ok = files.where("status = 'complete'")
    text = F.col("text") if raw else F.when((F.col("language") == "python") & F.col("text").rlike(r"\"{3}|'{3}"), _without_long_strings(F.col("text"))).otherwise(F.col("text"))
    return ok.select(F.col("path").alias("file"), "language", F.posexplode(F.split(text, "\r?\n", -1)).alias("line", "code")).withColumn("line", F.col("line") + 1)


def read_documents(spark: SparkSession, path: str, schema: str, listed: str) -> DataFrame:
    """Rows of JSON documents below a path: the entries of the list ``listed``, each with the document's other columns; documents without the list give none.

    A document may go over lines; one that is torn or of another shape is an error and not passed over.
    """
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(*(c for c in rows.columns if c != listed), F.explode(listed).alias("__one")).select(*(c for c in rows.columns if c != listed), "__one.*")
