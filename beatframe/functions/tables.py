"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of this process that are still there.
_TABLES: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder is set on one machine, and an error raised on a cluster, as executors don't share one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a lost executor loses nothing of it.

    Shuffle files of the job are removed with its end, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    _TABLES.add(path)
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that stored() wrote and nothing will read any more."""
    _delete(df.sparkSession, df._table)


def forget_all(spark: SparkSession) -> None:
    """Deletes all tables that stored() has written, once the results that read them are written themselves."""
    for path in sorted(_TABLES):
        _delete(spark, path)


def _delete(spark: SparkSession, table: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _TABLES.discard(table)
