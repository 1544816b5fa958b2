"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_made: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir of the session, emptied when the driver ends; unset, a temporary folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="edgewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    own = f"{folder.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_forget, spark, own)
    return own


_folders: set[str] = set()


def _forget(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended
        discard(spark, folder)


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no table has yet. Within ``intermediates`` it is noted, so that its table goes when the block ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Discards all tables written within the block when it ends; what is to stay is written by its own path before that."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of ``df`` as a Parquet table in the shared folder, and its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
