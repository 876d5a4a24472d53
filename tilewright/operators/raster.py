"""Rasters as tables: one row a sample, keyed by y, x and, where there are several, channel c.

A raster of any size is partitioned by its rows; tiles are integer keys
computed from coordinates. Everything here is DataFrame expressions, so filters
on coordinates reach the scan and aggregations combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components  # noqa: F401  an operator over rasters too


def div_floor(a: Column, b: int) -> Column:
    """Floor division, also of negative numbers."""
    a = a.cast("bigint")
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("bigint")), F.lit(b).cast("bigint"))


def from_vectors(vectors: DataFrame, y: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """y, x, u in 0..255 from rows of float vectors."""
    cells = vectors.select(F.col(y).cast("bigint").alias("y"), F.posexplode(vec).alias("x", "v"))
    return cells.select("y", F.col("x").cast("bigint").alias("x"), (F.floor(F.abs(F.col("v").cast("double")) * 255) % 256).cast("bigint").alias("u"))


def with_channel(px: DataFrame, channels: int) -> DataFrame:
    """Adds c: samples of a row in turn belong to the channels (interleaved order)."""
    return px.withColumn("c", F.col("x") % channels)


def channel_totals(px: DataFrame, value: str = "u") -> DataFrame:
    """Sum and number of samples of each channel; their quotient is the mean."""
    return px.groupBy("c").agg(F.sum(value).alias("total"), F.count(value).alias("samples"))


def channel_maxima(px: DataFrame, value: str = "u") -> DataFrame:
    """The largest sample of each channel."""
    return px.groupBy("c").agg(F.max(value).alias("high"))


def merge_channels(px: DataFrame, value: str = "u") -> DataFrame:
    """Samples (y, x, c) as one array a pixel, by channel."""
    each = px.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("c", value))).alias("s"))
    return each.select("y", "x", F.transform("s", lambda s: s[value]).alias("channels"))


def split_channels(px: DataFrame, value: str = "u") -> DataFrame:
    """Arrays of a pixel's channels as samples: y, x, c."""
    return px.select("y", "x", F.posexplode("channels").alias("c", value)).withColumn("c", F.col("c").cast("bigint"))


def unpack_bytes(px: DataFrame, bits: int, value: str = "u") -> DataFrame:
    """Bytes as the samples of 1, 2 or 4 bits that they hold, the highest first; x counts those samples."""
    many = 8 // bits
    parts = F.array(*[F.shiftright(value, 8 - bits * (i + 1)).bitwiseAND((1 << bits) - 1) for i in range(many)])
    return px.select("y", "x", F.posexplode(parts).alias("_i", value)).select("y", (F.col("x") * many + F.col("_i")).alias("x"), value)


def bit_to_byte(bit: Column) -> Column:
    """Single bits as the darkest and brightest byte."""
    return F.when(bit != 0, 255).otherwise(0)


def tile_index(px: DataFrame, tile_w: int, tile_h: int, grid_w: int) -> DataFrame:
    """Adds tile coordinates, coordinates inside the tile, and the linear tile number."""
    tx, ty = div_floor(F.col("x"), tile_w), div_floor(F.col("y"), tile_h)
    return px.withColumns({"tx": tx, "ty": ty, "in_x": F.col("x") - tx * tile_w, "in_y": F.col("y") - ty * tile_h, "linear": ty * grid_w + tx})


def tile_grid(spark, width: int, height: int, tile_w: int, tile_h: int, planes: int = 1, crop: bool = False) -> DataFrame:
    """Every tile of an image: plane, ty, tx, linear, from_x, from_y, w, h (cropped to the image, if asked)."""
    gw, gh = -(-width // tile_w), -(-height // tile_h)
    t = spark.range(planes * gw * gh).withColumnRenamed("id", "linear")
    t = t.withColumns({"plane": F.expr(f"linear div {gw * gh}"), "ty": F.expr(f"(linear % {gw * gh}) div {gw}"), "tx": F.expr(f"linear % {gw}")})
    t = t.withColumns({"from_x": F.col("tx") * tile_w, "from_y": F.col("ty") * tile_h})
    w, h = F.lit(tile_w).cast("bigint"), F.lit(tile_h).cast("bigint")
    if crop:
        w, h = F.least(w, F.lit(width) - F.col("from_x")), F.least(h, F.lit(height) - F.col("from_y"))
    return t.withColumns({"w": w, "h": h})


def linear_number(plane: Column, ty: Column, tx: Column, gw: Column, gh: Column) -> Column:
    """A tile's number in the order of planes, rows and columns."""
    return (plane * gh + ty) * gw + tx


def tile_grids(images: DataFrame, tile_w: int, tile_h: int, planes: int = 1, crop: bool = False) -> DataFrame:
    """Every tile of images (..., width, height): linear, plane, ty, tx, from_x, from_y, w, h (cropped to the image, if asked)."""
    gw, gh = F.ceil(F.col("width") / tile_w), F.ceil(F.col("height") / tile_h)
    t = images.withColumns({"_gw": gw, "_gh": gh}).withColumn("linear", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_gw") * F.col("_gh") * planes - 1)))
    t = t.withColumns({"plane": F.expr("linear div (_gw * _gh)"), "ty": F.expr("(linear % (_gw * _gh)) div _gw"), "tx": F.expr("linear % _gw")}).drop("_gw", "_gh")
    t = t.withColumns({"from_x": F.col("tx") * tile_w, "from_y": F.col("ty") * tile_h})
    w, h = F.lit(tile_w).cast("bigint"), F.lit(tile_h).cast("bigint")
    if crop:
        w, h = F.least(w, F.col("width") - F.col("from_x")), F.least(h, F.col("height") - F.col("from_y"))
    return t.withColumns({"w": w, "h": h})


def tiles_of_region(x0: int, y0: int, w: int, h: int, tile_w: int, tile_h: int, gw: int, gh: int) -> tuple[int, int, int, int]:
    """First and last tile column and row that a rectangle meets, within the grid; empty if first > last."""
    return max(0, x0 // tile_w), min(gw - 1, (x0 + w - 1) // tile_w), max(0, y0 // tile_h), min(gh - 1, (y0 + h - 1) // tile_h)


def rectangles_on_grid(rects: DataFrame, tile_w: int, tile_h: int, gw: int, gh: int) -> DataFrame:
    """For rectangles (..., x0, y0, w, h) the tiles that each meets: ty, tx, and whether it covers the tile whole.

    Each rectangle makes a row for each tile of its range on the grid, so the join with tiles is one of equal keys;
    empty rectangles meet nothing. A tile's part beyond the rectangle counts even where it lies beyond the image.
    """
    edges = {a: (div_floor(F.col(f"{a}0"), s), div_floor(F.col(f"{a}0") + F.col(n) - 1, s), last) for a, n, s, last in (("x", "w", tile_w, gw - 1), ("y", "h", tile_h, gh - 1))}
    out = rects.where((F.col("w") > 0) & (F.col("h") > 0))
    for axis, (first, last, end) in edges.items():
        low, high = F.greatest(first, F.lit(0).cast("bigint")), F.least(last, F.lit(end).cast("bigint"))
        out = out.where(low <= high).withColumn(f"t{axis}", F.explode(F.sequence(low, F.greatest(low, high))))
    covered = F.lit(True)
    for axis, n, size in (("x", "w", tile_w), ("y", "h", tile_h)):
        start = F.col(f"t{axis}") * size
        covered = covered & (F.col(f"{axis}0") <= start) & (F.col(f"{axis}0") + F.col(n) >= start + size)
    return out.withColumn("covered", covered)


def region(px: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """The samples of a rectangle, in its own coordinates."""
    inside = px.where((F.col("y") >= y0) & (F.col("y") < y0 + h) & (F.col("x") >= x0) & (F.col("x") < x0 + w))
    return inside.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def region_filled(px: DataFrame, x0: int, y0: int, w: int, h: int, filler: int = 0, value: str = "u") -> DataFrame:
    """The rectangle in full; where the raster has no sample, the filler."""
    cells = px.sparkSession.range(w * h).select(F.expr(f"id div {w}").alias("y"), F.expr(f"id % {w}").alias("x"))
    return cells.join(region(px, x0, y0, w, h), ["y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(filler).cast("bigint")))


def tile_coverage(px: DataFrame, tile_w: int, tile_h: int, grid_w: int) -> DataFrame:
    """For each tile touched: samples set, samples unset, and whether it is complete."""
    t = tile_index(px.select("y", "x").distinct(), tile_w, tile_h, grid_w)
    return t.groupBy("linear").agg(F.count("*").alias("set_area")).withColumns({"unset_area": F.lit(tile_w * tile_h) - F.col("set_area"), "completed": F.col("set_area") == tile_w * tile_h})


def predictor_encode(px: DataFrame, stride: int = 1, bits: int = 8, value: str = "u") -> DataFrame:
    """Horizontal differences modulo 2**bits, each row and channel for itself (bits up to 32)."""
    w = Window.partitionBy("y").orderBy("x")
    before = F.coalesce(F.lag(value, stride).over(w), F.lit(0))
    return px.withColumn("delta", F.pmod(F.col(value) - before, F.lit(1 << bits)))


def predictor_decode(px: DataFrame, stride: int = 1, bits: int = 8, value: str = "delta") -> DataFrame:
    """Running sums modulo 2**bits: the inverse of predictor_encode."""
    w = Window.partitionBy("y", F.col("x") % stride).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return px.withColumn("restored", F.pmod(F.sum(value).over(w), F.lit(1 << bits)))


def downscale(px: DataFrame, width: int, height: int, ratio: int, value: str = "u") -> DataFrame:
    """Sum and number of samples of each ratio x ratio block; incomplete blocks at the edges are cut off."""
    cut = px.where((F.col("x") < width // ratio * ratio) & (F.col("y") < height // ratio * ratio))
    return cut.groupBy(F.expr(f"y div {ratio}").alias("y"), F.expr(f"x div {ratio}").alias("x")).agg(F.sum(value).alias("total"), F.count("*").alias("samples"))


def overlay_grid(px: DataFrame, tile_w: int, tile_h: int, gap: int, colour: int, value: str = "u") -> DataFrame:
    """Tile borders, `gap` samples wide, drawn in one colour."""
    x, y = F.col("x") % tile_w, F.col("y") % tile_h
    edge = (x < gap) | (x >= tile_w - gap) | (y < gap) | (y >= tile_h - gap)
    return px.withColumn(value, F.when(edge, F.lit(colour).cast("bigint")).otherwise(F.col(value)))


def patch(px: DataFrame, update: DataFrame, value: str = "u") -> DataFrame:
    """Samples of `update` take the place of those in `px`; new ones are added."""
    both = px.select("y", "x", F.struct(F.lit(0).alias("o"), F.col(value).alias("v")).alias("s")).unionByName(update.select("y", "x", F.struct(F.lit(1).alias("o"), F.col(value).alias("v")).alias("s")))
    return both.groupBy("y", "x").agg(F.max_by("s.v", "s.o").alias(value))


def runs(px: DataFrame, value: str = "u") -> DataFrame:
    """Maximal runs of equal samples in each row: y, start, length, value."""
    w = Window.partitionBy("y").orderBy("x")
    changed = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    marked = px.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy("y", "run", value).agg(F.min("x").alias("start"), F.count("*").alias("length")).drop("run")


def rescale(v: Column, bits: int, to_bits: int) -> Column:
    """Values of `bits` bits spread over `to_bits` bits by an integer factor."""
    return v * F.lit(((1 << to_bits) - 1) // ((1 << bits) - 1))


def invert(v: Column, bits: int) -> Column:
    return F.lit((1 << bits) - 1) - v


def contrast(v: Column, factor: float, shift: float, high: int = (1 << 32) - 1) -> Column:
    """round(factor * v + shift), halves upwards, within 0..high."""
    return F.greatest(F.lit(0), F.least(F.lit(high), F.floor(v * factor + shift + 0.5))).cast("bigint")


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luma of a colour, its own value if all channels agree."""
    return F.when((r == g) & (g == b), r).otherwise(F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)).cast("bigint")


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Full-range conversion with the usual coefficients, rounded and kept in 0..255."""
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5))).cast("bigint")
    return clamp(y + 1.402 * (cr - 128)), clamp(y - 0.34414 * (cb - 128) - 0.71414 * (cr - 128)), clamp(y + 1.772 * (cb - 128))


def interleave_position(x: Column, channels: int, width: int) -> Column:
    """Place in the row of separated channels (all of channel 0, then 1, ...) of interleaved sample x."""
    return (x % channels) * width + F.floor(x / channels)
