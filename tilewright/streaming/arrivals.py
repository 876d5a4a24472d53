"""Files that arrive: a stream of TIFF files kept as a table of tiles.

Each new file is parsed when it comes; its rows take the place of those that an
earlier file of the same path left. The batch number makes a repeated batch
harmless: it writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import tiff


def watch(spark: SparkSession, folder: str, pattern: str = "*.tif*", per_batch: int = 1000) -> DataFrame:
    """A stream of rows (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str, table: str = "tiles", once: bool = True) -> StreamingQuery:
    """Append the rows of arriving files to `target`, a folder of Parquet batches."""

    def write(batch: DataFrame, number: int) -> None:
        rows = tiff.from_binary(batch, table, permissive=True)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = watch(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The rows of the latest batch of each path."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(target)
    w = Window.partitionBy("path")
    return rows.withColumn("_last", F.max("batch").over(w)).where("batch = _last").drop("_last")
