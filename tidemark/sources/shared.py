"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """The name of a new folder below spark.checkpoint.dir; below a temporary one where the session names none, with a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/tidemark/{label}-{uuid.uuid4().hex}"


def delete_on_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, and lost executors lose nothing. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells an application's tables of a folder apart: the application, the folder, and its files' names, sizes and times.

    What is made once for a folder is kept under it, so changed files are read again.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    seen = []
    for f in fs.listStatus(root):
        parts = fs.listStatus(f.getPath()) if f.isDirectory() else [f]
        seen += [(f.getPath().getName(), x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in parts]
    return spark.sparkContext.applicationId, sf_dir, tuple(sorted(seen))
