"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def checkpointed(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write as Parquet, in folders ``by`` columns, and read back: the lineage ends, and the files outlive executors.

    Shuffle files of the step go as soon as it is written.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.partitionBy(*by).parquet(path, compression="zstd")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame, part: str = "") -> None:
    """Delete the files of checkpointed tables, or those of a part (``column=value``), that no later step reads."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}".rstrip("/"))
            files = at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
            files.delete(at, True)
