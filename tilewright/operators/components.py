"""Connected objects of a raster, and their numbers.

A row's run of set samples is a vertex, within blocks of `BLOCK` columns, so
that neither a long row nor a row of many runs lands in one task: runs meet
those of the row above within their block and at its edges, and the next block
of their own row at the edge they share. Objects are then found on the edges by
alternating star steps, whose number grows with the logarithm of an object's
runs; every step is written and read again. Objects are numbered by ranges,
not in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Tables

#: Columns of a block: a run meets at most half as many others of the row above in one.
BLOCK = 256
MOST_ROUNDS = 100


def dense_numbers(keys: DataFrame, order: list[str], name: str = "label") -> DataFrame:
    """`keys` with their rank from 1 by `order`; keys must differ. One row a range of keys is all that one task sorts."""
    tables = Tables(keys.sparkSession)
    placed = tables.save(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = F.broadcast(counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_size"))  # a row a partition
    out = placed.join(counts, part == F.col("_part"))
    return out.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_part", "_first", "_before")


def block_runs(px: DataFrame) -> DataFrame:
    """Maximal runs of the set samples (y, x) within blocks of columns: y, block, a, b."""
    w = Window.partitionBy("y", "block").orderBy("x")
    cells = px.select(F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x")).distinct().withColumn("block", F.floor(F.col("x") / BLOCK))
    marked = cells.withColumn("g", F.col("x") - F.row_number().over(w))
    return marked.groupBy("y", "block", "g").agg(F.min("x").alias("a"), F.max("x").alias("b")).drop("g")


def touching(runs: DataFrame) -> DataFrame:
    """Pairs of runs (y, block, a, b, id) that touch, diagonally too: u, v."""
    low, high = F.col("block") * BLOCK, F.col("block") * BLOCK + BLOCK - 1
    # a run at the edge of its block also meets the neighbouring block's runs of the next row
    reach = F.concat(F.array("block"), F.when(F.col("a") == low, F.array(F.col("block") - 1)).otherwise(F.array().cast("array<bigint>")), F.when(F.col("b") == high, F.array(F.col("block") + 1)).otherwise(F.array().cast("array<bigint>")))
    above = runs.select((F.col("y") + 1).alias("y"), F.explode(reach).alias("block"), F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("id").alias("v"))
    down = runs.join(above, ["y", "block"]).where("a1 <= b + 1 and b1 >= a - 1").select(F.col("id").alias("u"), "v")
    left = runs.where(F.col("b") == high).select("y", (F.col("block") + 1).alias("block"), F.col("id").alias("v"))
    across = runs.where(F.col("a") == low).join(left, ["y", "block"]).select(F.col("id").alias("u"), "v")
    return down.union(across)


def smallest(edges: DataFrame, tables: Tables) -> DataFrame:
    """From edges (u, v): v and root, the smallest vertex of its component, for every vertex of an edge."""
    e = tables.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tables.save(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = tables.save(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        tables.drop(e, large)
        e = after
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def connected_components(px: DataFrame, min_area: int = 1) -> DataFrame:
    """The set samples (y, x) with the smallest y, x of their 8-connected object, its area and its number.

    Objects below `min_area` samples go; the others are numbered from 1 in the order of their smallest sample.
    Repeated samples count once; x is not negative.
    """
    tables = Tables(px.sparkSession)
    runs = block_runs(px)
    width = (px.agg(F.max("x")).first()[0] or 0) + 1
    runs = tables.save(runs.withColumn("id", F.col("y") * int(width) + F.col("a")))
    roots = smallest(touching(runs), tables)
    labelled = tables.save(runs.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    size = labelled.groupBy("root").agg(F.sum(F.col("b") - F.col("a") + 1).alias("area")).where(F.col("area") >= min_area)
    size = dense_numbers(size, ["root"])
    out = labelled.join(size, "root")
    root_y = F.floor(F.col("root") / int(width))
    return out.select("y", F.explode(F.sequence("a", "b")).alias("x"), root_y.alias("root_y"), (F.col("root") - root_y * int(width)).alias("root_x"), "area", "label")
