"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a session in one process that has none gets a temporary one; on a cluster a missing setting is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lemmata-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder; what is there goes when the session's JVM ends."""
    path = f"{scratch_dir(spark)}/lemmata/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def keep(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, **options)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lemmata_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that ``keep`` wrote, once nothing lazy reads it any more."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(df._lemmata_path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
