"""Shared-folder tables, by which jobs cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh one on a single machine (tests), and an
    error on a cluster, whose machines would not share it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quadrille/{uuid.uuid4().hex}/{name}"


def save(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint, for small iteration states."""
    shared = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
