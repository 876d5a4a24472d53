"""What the corpus operators share: table access and scratch tables."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import own_folder
from ..shipping import ship  # noqa: F401  for the operators

#: Characters that separate words: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of an input folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables: spark.checkpoint.dir, or one of our own where that is unset, in local runs only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if "own" not in _local:
        _local["own"] = own_folder(spark, "scratch")
        atexit.register(shutil.rmtree, _local["own"], ignore_errors=True)
    return _local["own"]


class Scratch:
    """Tables that cut lineage: Parquet files in the shared checkpoint folder.

    Unlike DataFrame.checkpoint(), a saved table is computed once and is
    compressed. Any executor can read it again after another one is lost.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame) -> DataFrame:
        """Write `df` and return the written table."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(freed, None)
        self.spark.conf.set(freed, "true")  # shuffle files go once the table is written
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(freed, before) if before is not None else self.spark.conf.unset(freed)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        _, path = self.paths.pop(id(df), (None, None))
        if path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def sweep(self, *kept: DataFrame) -> None:
        """Delete all tables but these; later plans read no others."""
        live = {id(df) for df in kept}
        for key, (df, _) in list(self.paths.items()):
            if key not in live:
                self.drop(df)


def slices(batches, rows: int = 512):
    """Arrow batches cut into pieces of few rows, so that long texts are decoded a few at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
