"""Cutting lineage in iterative plans, so that a lost executor costs one step."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def own_folder(spark: SparkSession, label: str) -> str:
    """A folder for a session on this machine alone; on a cluster the shared folder must be named."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=f"tilewright-{label}-")


def base_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or one folder of our own that goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not _own:
        _own.append(own_folder(spark, "work"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Checkpoint `df` in spark.checkpoint.dir, or in a folder of our own where that is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base_folder(spark))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: computed once, and read by the columns that are needed."""
    spark = df.sparkSession
    path = f"{base_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of an iteration: each step is written once, those that no later step reads are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{base_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """A folder that executors and driver share, as a plain path."""
    base = base_folder(spark)
    if not base.startswith(("file:", "/")):
        raise ValueError(f"files need a mounted folder; spark.checkpoint.dir is {base}")
    path = "/" + base.removeprefix("file:").lstrip("/")
    os.makedirs(path, exist_ok=True)
    return path
