"""Durable intermediate results. On a cluster everything goes to the shared folder named by
``spark.checkpoint.dir``; only a local master without that setting gets a folder of its own."""
from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints and work tables, set on the context if it has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if folder is None and current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if current is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder or current


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from there with a cut lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a work table below the shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_work(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Ask for the shuffle files of finished jobs to be deleted: Spark does so once their frames are collected."""
    gc.collect()
    spark._jvm.System.gc()
