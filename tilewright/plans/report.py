"""What a file holds and how much of it is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import TYPES
from ..operators import index


def usage(files: DataFrame, entries: DataFrame, tiles: DataFrame) -> DataFrame:
    """Bytes of header, directories and image data against the length of each file."""
    sizes = F.create_map(*[F.lit(x) for code, size in TYPES.values() for x in (code, size)])
    e = entries.join(files.select("path", "is_big"), "path").withColumn("bytes", F.col("count") * F.coalesce(sizes[F.col("type")], F.lit(1)))
    outside = F.when(~F.col("embedded"), F.col("bytes") + F.col("bytes") % 2).otherwise(0)
    per = e.groupBy("path", "global_index", "is_big").agg(F.count("*").alias("n"), F.sum(outside).alias("values"))
    tables = per.withColumn("ifd_bytes", F.when(F.col("is_big"), 16 + 20 * F.col("n")).otherwise(6 + 12 * F.col("n")) + F.col("values"))
    ifds = tables.groupBy("path").agg(F.sum("ifd_bytes").alias("ifd_bytes"), F.count("*").alias("directories"))
    data = index.data_size(tiles.where("byte_count > 0"), ["path"])
    out = files.select("path", "length", "is_big", "images").join(ifds, "path", "left").join(data, "path", "left").na.fill(0, ["ifd_bytes", "directories", "data_bytes", "stored_tiles"])
    out = out.withColumn("used", F.when(F.col("is_big"), 16).otherwise(8) + F.col("ifd_bytes") + F.col("data_bytes"))
    return out.withColumn("lost", F.greatest(F.col("length") - F.col("used"), F.lit(0)))


def as_json(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Each directory as a JSON object from tag names to values, tags ascending."""
    v = F.coalesce(F.to_json("value.i"), F.to_json("value.d"), F.to_json("value.s"), F.to_json("value.r"), F.concat(F.lit('"'), F.base64("value.b"), F.lit('"')))
    named = entries.join(F.broadcast(names), F.col("tag") == F.col("code"), "left")  # at most a few hundred names
    pair = F.concat(F.to_json(F.array(F.coalesce("name", F.concat(F.lit("tag"), F.col("tag").cast("string"))))), F.lit(":"), v)
    pair = F.regexp_replace(pair, r'^\["((?:[^"\\]|\\.)*)"\]', '"$1"')
    rows = named.groupBy("path", "global_index").agg(F.array_sort(F.collect_list(F.struct("tag", pair.alias("pair")))).alias("p"))
    return rows.select("path", "global_index", F.concat(F.lit("{"), F.array_join(F.transform("p", lambda s: s["pair"]), ","), F.lit("}")).alias("json"))
