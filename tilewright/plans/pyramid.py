"""Which images of a slide file are layers, thumbnail, label or macro."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import index

#: Largest sides of a thumbnail and of label and macro images.
THUMBNAIL, SMALL = 2048, 2048
#: The macro image of a slide is about three times as wide as high.
ASPECT, TOLERANCE = 3.0, 0.2


def classify(ifds: DataFrame) -> DataFrame:
    """Adds image_kind and layer to rows of `ifds` (one file: one pyramid).

    The first image is the base. The second is the thumbnail if it is small and
    does not continue the base by a whole ratio. Following images are layers
    while they are tiled and each shrinks the one before by the ratio (2 to 32)
    by which the first of them shrinks the base; the first that does not ends the pyramid. Of the last images, small ones in strips are
    label and macro: by a word in the description, by compression (LZW, JPEG), or
    by shape.
    """
    by = Window.partitionBy("path").orderBy("main_index")
    whole = Window.partitionBy("path")
    d = ifds.where("main_index is not null").withColumn("images", F.count("*").over(whole))
    words = F.lower(F.coalesce("description", F.lit("")))
    small = (F.col("width") <= SMALL) & (F.col("height") <= SMALL) & ~F.col("tiled") & (F.col("main_index") > 0) & (F.col("main_index") >= F.col("images") - 2)
    wide = F.abs(F.col("width") / F.col("height") / ASPECT - 1) <= TOLERANCE
    special = F.when(small & words.rlike(r"\blabel\b"), "LABEL").when(small & words.rlike(r"\bmacro\b"), "MACRO").when(small & (F.col("compression") == 5), "LABEL").when(small & ((F.col("compression") == 7) | wide), "MACRO")
    thumb = (F.col("main_index") == 1) & (F.col("width") <= THUMBNAIL) & (F.col("height") <= THUMBNAIL) & ~F.col("tiled")
    d = d.withColumns({"special": special, "thumb": thumb})
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"{n}_before": F.last(F.when(~F.col("thumb"), F.col(n)), ignorenulls=True).over(before) for n in ("width", "height", "main_index")})
    first = (F.col("main_index_before") == 0) & ~F.col("thumb")
    ratio = index.find_ratio(F.col("width_before"), F.col("height_before"), F.col("width"), F.col("height"), 2, 32)
    d = d.withColumn("ratio", F.first(F.when(first, ratio), ignorenulls=True).over(whole))
    shrinks = index.pyramid_ratio(F.col("width_before"), F.col("width"), F.col("ratio")) & index.pyramid_ratio(F.col("height_before"), F.col("height"), F.col("ratio"))
    goes_on = F.col("thumb") | F.col("tiled") & ((F.col("main_index") == 0) | (F.col("ratio") > 0) & shrinks)
    d = d.withColumn("chained", F.min(F.coalesce(goes_on, F.lit(False)).cast("int")).over(by) == 1)
    kind = F.when(F.col("main_index") == 0, "BASE").when(F.col("special").isNotNull(), F.col("special")).when(F.col("thumb"), "THUMBNAIL").when(F.col("chained"), "LAYER").otherwise("ORDINARY")
    d = d.withColumn("image_kind", kind)
    is_layer = F.col("image_kind").isin("BASE", "LAYER")
    layer = F.when(is_layer, F.sum(is_layer.cast("int")).over(by) - 1)
    return d.withColumn("layer", layer).drop("images", "special", "thumb", "width_before", "height_before", "main_index_before", "ratio", "chained")


def image_of_layer(layer: Column, thumbnail: Column) -> Column:
    """The image that holds a layer, where `thumbnail` is the thumbnail's image (null: none); also beyond the last layer."""
    return layer + F.when(thumbnail.isNotNull() & (layer >= thumbnail), 1).otherwise(0)


def layer_of_image(image: Column, thumbnail: Column, layers: Column) -> Column:
    """The layer that an image holds, of `layers` in all; -1 for the thumbnail and other images."""
    layer = image - F.when(thumbnail.isNotNull() & (image > thumbnail), 1).otherwise(0)
    return F.when((image == F.coalesce(thumbnail, F.lit(-1))) | (layer >= layers), -1).otherwise(layer)


def main_description(ifds: DataFrame) -> DataFrame:
    """Of each file the first image's description that is a slide's with magnification or pixel size: path, main_index, description."""
    from ..functions import text

    d = F.col("description")
    main = ifds.where(F.col("main_index").isNotNull() & text.is_svs(d) & F.exists(text.svs_attributes(d), lambda p: p["key"].isin("AppMag", "MPP")))
    return main.groupBy("path").agg(F.min(F.struct("main_index", "description")).alias("m")).select("path", "m.*")
