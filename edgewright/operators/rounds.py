"""Tables in the folder that driver and executors share: they cut the lineage of iterative joins and fix what must not be planned twice."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir of the session, removed when the driver ends; unset, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="edgewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    own = f"{folder.rstrip('/')}/rounds-{spark.sparkContext.applicationId}"
    if own not in _own:
        _own.add(own)
        atexit.register(_forget, spark, own)
    return own


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def kept(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows, written once as a Parquet table in the shared folder, so that later rounds neither repeat nor re-plan earlier ones."""
    void = {f.name: F.col(f.name).cast("string") for f in df.schema if isinstance(f.dataType, T.NullType)}
    df = df.withColumns(void) if void else df
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
