"""Operators over directory tables: entries, tile indexes and image chains.

Tables: ifds (path, main_index, offset, ...), tiles (path, ifd, k, offset,
byte_count), entries (path, ifd, tag, type, count, value_offset, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_links(tiles: DataFrame, by: list[str], offset: str = "offset", k: str = "k") -> DataFrame:
    """Adds previous_same, next_same: the tiles before and after with the same offset (-1: none), and duplicate."""
    w = Window.partitionBy(*by, offset).orderBy(k)
    before, after = F.coalesce(F.lag(k).over(w), F.lit(-1)), F.coalesce(F.lead(k).over(w), F.lit(-1))
    return tiles.withColumns({"previous_same": before, "next_same": after}).withColumn("duplicate", F.col("previous_same") >= 0)


def data_size(tiles: DataFrame, by: list[str], offset: str = "offset", size: str = "byte_count") -> DataFrame:
    """Bytes that tiles take: each offset counts once, with its largest byte count."""
    once = tiles.groupBy(*by, offset).agg(F.max(size).alias("_n"))
    return once.groupBy(*by).agg(F.sum("_n").alias("data_bytes"), F.count("*").alias("stored_tiles")) if by else once.agg(F.sum("_n").alias("data_bytes"), F.count("*").alias("stored_tiles"))


def image_data_size(tiles: DataFrame, by: list[str], length: Column, *, big: Column | bool = False, taken: Column | None = None, offset: str = "offset", size: str = "byte_count", k: str = "k") -> DataFrame:
    """What the stored tiles of an image take in its file of `length` bytes: data_bytes, aligned, outside.

    Tiles that begin at one place count once, by the first of them (smallest k). A classic file whose data begin at 16
    counts 8 bytes more, which its longer header left. If the last tile ends at an odd place that is free, the byte
    after it counts, as directories begin at even places (aligned); it is not free at the end of the file or where
    `taken`, an array of places of tag values, says so. outside: tiles that end beyond the file. Length, big and taken
    are columns that the rows of an image share.
    """
    rows = tiles.select(*by, F.col(offset).alias("_at"), F.col(k).alias("_k"), F.col(size).alias("_n"), length.alias("_length"), (F.lit(big) if isinstance(big, bool) else big).alias("_big"), (taken if taken is not None else F.array().cast("array<bigint>")).alias("_taken"))
    once = rows.groupBy(*by, "_at").agg(F.min_by("_n", "_k").alias("_n"), F.max_by("_n", "_k").alias("_last"), F.sum((F.col("_at") + F.col("_n") > F.col("_length")).cast("bigint")).alias("_outside"), F.first("_length").alias("_length"), F.first("_big").alias("_big"), F.first("_taken").alias("_taken"))
    image = once.groupBy(*by).agg(F.sum("_n").alias("_sum"), F.min("_at").alias("_first"), F.max_by(F.col("_at") + F.col("_last"), "_at").alias("_end"), F.sum("_outside").alias("outside"), F.first("_length").alias("_length"), F.first("_big").alias("_big"), F.first("_taken").alias("_taken"))
    end = F.col("_end")
    aligned = (end % 2 != 0) & (end != F.col("_length")) & (end + 1 != F.col("_length")) & ~F.array_contains("_taken", end)
    total = F.col("_sum") + F.when(~F.col("_big") & (F.col("_first") == 16), 8).otherwise(0) + F.when(aligned, 1).otherwise(0)
    return image.select(*by, total.alias("data_bytes"), aligned.alias("aligned"), "outside")


def chain(ifds: DataFrame, by: list[str], offset: str = "offset", order: str = "main_index") -> DataFrame:
    """Adds next_offset (0 after the last) and last_in_chain."""
    w = Window.partitionBy(*by).orderBy(order)
    return ifds.withColumn("next_offset", F.lead(offset, 1, 0).over(w)).withColumn("last_in_chain", F.col("next_offset") == 0)


def allocate(tiles: DataFrame, by: list[str], start: int, size: str = "byte_count", order: str = "k") -> DataFrame:
    """Adds file_offset: tiles follow each other, each on an even offset."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    even = F.col(size) + F.col(size) % 2
    return tiles.withColumn("file_offset", F.coalesce(F.sum(even).over(w), F.lit(0)) + start)


def alignment_gaps(entries: DataFrame, by: list[str], offset: str = "value_offset", size: str = "value_bytes") -> DataFrame:
    """Adds gap: bytes between the end of the value before and this one."""
    w = Window.partitionBy(*by).orderBy(offset)
    end = F.lag(F.col(offset) + F.col(size)).over(w)
    return entries.withColumn("gap", F.coalesce(F.col(offset) - end, F.lit(0)))


def all_equal(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Whether the values of each group are one, and which."""
    return rows.groupBy(*by).agg((F.min(value) == F.max(value)).alias("equal"), F.when(F.min(value) == F.max(value), F.min(value)).alias("common"))


def accounting(parts: DataFrame, by: list[str], length: str, size: str, header: int = 8) -> DataFrame:
    """Bytes of a file that its parts use, and what is lost or beyond its end."""
    s = parts.groupBy(*by).agg((F.sum(size) + header).alias("used"), F.max(length).alias("length"))
    return s.withColumns({"lost": F.greatest(F.col("length") - F.col("used"), F.lit(0)), "extra": F.greatest(F.col("used") - F.col("length"), F.lit(0))})


def pyramid_ratio(dim: Column, next_dim: Column, r: Column) -> Column:
    """Whether `next_dim` is `dim` over r, rounded down or up."""
    q = F.floor(dim / r)
    return (next_dim == q) | (next_dim == q + 1)


def find_ratio(w: Column, h: Column, next_w: Column, next_h: Column, low: int = 2, high: int = 32) -> Column:
    """The first ratio in low..high that both axes allow, else -1."""
    fits = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda r: pyramid_ratio(w, next_w, r) & pyramid_ratio(h, next_h, r))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(-1))


def layer_chain(layers: DataFrame, by: list[str], order: str = "layer", ratio: int = 2) -> DataFrame:
    """Adds in_pyramid: whether all layers up to this one shrink by the same ratio."""
    w = Window.partitionBy(*by).orderBy(order)
    ok = F.coalesce(pyramid_ratio(F.lag("w").over(w), F.col("w"), F.lit(ratio)) & pyramid_ratio(F.lag("h").over(w), F.col("h"), F.lit(ratio)), F.lit(True))
    return layers.withColumn("_ok", ok.cast("int")).withColumn("in_pyramid", F.min("_ok").over(w) == 1).drop("_ok")


def latest(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Of rows with equal keys the one of highest rank: tiles put over others."""
    w = Window.partitionBy(*keys).orderBy(F.desc(rank))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
