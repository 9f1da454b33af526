"""Storage between jobs."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys up to which they are broadcast; beyond, both sides of a join are shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and everything runs
    on this machine, as in tests. On a cluster an unset folder is an error: executors don't see the driver's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def saved(df: DataFrame, instead_of: DataFrame | None = None, compression: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and a lost executor costs nothing.

    `instead_of`: an earlier saved table that only df was made from; it is deleted once df is written.
    `compression`: of the files, if not the session's.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if instead_of is not None:
        discarded(instead_of)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unshuffled(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer held; else they stay until the driver happens to collect its
    garbage."""
    gc.collect()
    spark._jvm.System.gc()


def slight(df: DataFrame) -> DataFrame:
    """df, stored, to be broadcast if it is small."""
    df = df if "stored_at" in vars(df) else saved(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
