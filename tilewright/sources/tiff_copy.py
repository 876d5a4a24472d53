"""Copying images between files, whole, cropped or encoded anew, without moving a sample through the driver.

The driver reads directories. Encoded tiles are read by the tasks that write
them; tiles that share their bytes share them in the copy. Other copies are a
join of tiles by place: every stored tile is decoded once and cut along the new
grid into blocks, and blocks meet at their new tile.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, jpeg, kernels
from ..functions.tags import TAGS
from ..shipping import ship
from . import tiff
from . import tiff_format as fmt
from .tiff_layout import INDEX as INDEX_ROWS
from .tiff_layout import Sheet, encoded, paint_blocks, pieces, save, stored_bodies

#: Tags that must fit the stored samples: sizes, depths, compression, layout, places.
STORED = {256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284, 292, 293, 317, 322, 323, 324, 325, 339, 347, *range(512, 522), 530}
INDEX = ("TileOffsets", "StripOffsets", "TileByteCounts", "StripByteCounts")
BLOCKS = "path string, image int, k bigint, width bigint, height bigint, channels int, y bigint, x bigint, h int, w int, raw binary"
JPEG_CODES = (6, 7, 34892)


def first_entries(d: fmt.Directory) -> dict[int, tuple[int, object]]:
    """Type and value of every tag; of duplicates the first counts."""
    out: dict[int, tuple[int, object]] = {}
    for e in d.entries:
        out.setdefault(e.tag, (e.type, e.value))
    return out


def own_tags(d: fmt.Directory) -> dict[int, tuple[int, object]]:
    """The tags that a copy takes over: neither places nor links to other directories."""
    gone = {TAGS[t] for t in INDEX} | set(fmt.LINKED.values())
    return {t: v for t, v in first_entries(d).items() if t not in gone}


def index_tags(tiled: bool, big: bool, offsets: list[int], sizes: list[int]) -> dict[int, tuple[int, object]]:
    kind = 16 if big else 4
    names = ("TileOffsets", "TileByteCounts") if tiled else ("StripOffsets", "StripByteCounts")
    return {TAGS[names[0]]: (kind, offsets), TAGS[names[1]]: (kind, sizes)}


def decoded(t: dict, data: bytes) -> np.ndarray:
    """A stored tile's samples as they are: no inversion, no rescaling; colours of JPEG data as RGB."""
    bits = t["bits"][:1] if t["planar"] else t["bits"]
    if t["compression"] in JPEG_CODES:
        out = jpeg.decode_old(data, t["jpeg_tables"]) if t["compression"] == 6 else jpeg.decode(data, t["jpeg_tables"])
        return jpeg.to_rgb(out) if t["photometric"] == 6 and out.shape[2] == 3 else out
    return kernels.decode_tile(data, compression=t["compression"], predictor=t["predictor"], width=t["w"], height=t["h"], bits=bits, kind=t["sample_format"], order="<" if t["byte_order"] == "II" else ">", fill_order=t["fill_order"], options=t["options"])


def new_sheet(g: fmt.Geometry, order: str, width: int, height: int, compression: int, filler: float) -> Sheet:
    """How an image is stored that is decoded from `g` and encoded anew; whole bytes but for single bits."""
    t = kernels.sample_type(g.bits, [g.kind])
    bits = 1 if set(g.bits) == {1} else t.itemsize * 8
    tile_w, tile_h = (g.tile_w, g.tile_h) if g.tiled else (width, min(g.tile_h, height))
    return Sheet(width, height, g.channels, t.str, bits, tile_w, tile_h, g.tiled, g.planar, compression, 1 if compression == 7 else g.predictor, order, g.fill_order, 0.75 if compression == 7 else 0.5, filler, options=g.options)


def blocks(tiles: DataFrame, sheets: dict[int, Sheet], at: dict[int, tuple[int, int]], target: str) -> DataFrame:
    """Stored tiles cut along the grid of the new images: BLOCKS. `at` is where a new image begins in the old one."""
    ship(tiles.sparkSession)
    registered = codecs.added()
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def cut_up(t: dict, tile: np.ndarray):
        s, (y0, x0) = sheets[t["image"]], at[t["image"]]
        top, left = t["ty"] * t["tile_h"] - y0, t["tx"] * t["tile_w"] - x0
        bottom, right = min(top + t["h"], t["height"] - y0, s.height), min(left + t["w"], t["width"] - x0, s.width)
        for row in range(max(top, 0) // s.tile_h, -(-bottom // s.tile_h) if bottom > max(top, 0) else 0):
            for column in range(max(left, 0) // s.tile_w, -(-right // s.tile_w) if right > max(left, 0) else 0):
                a, b = max(top, row * s.tile_h, 0), min(bottom, (row + 1) * s.tile_h)
                c, d = max(left, column * s.tile_w, 0), min(right, (column + 1) * s.tile_w)
                k = ((t["plane"] if s.planar else 0) * s.rows + row) * s.columns + column
                raw = np.ascontiguousarray(tile[a - top : b - top, c - left : d - left].astype(np.dtype(s.dtype))).tobytes()
                yield (target, t["image"], k, s.width, s.height, s.channels, a, c, b - a, d - c, raw)

    def run(batches):
        codecs.adopt(registered)
        for b in batches:
            for t in b.to_pylist():
                with open(t["path"].removeprefix("file:"), "rb") as f:
                    f.seek(t["offset"])
                    data = f.read(t["byte_count"])
                found = list(cut_up(t, decoded(t, data)))
                if found:
                    columns = zip(*found, strict=True)
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return tiles.mapInArrow(run, BLOCKS)


def copy_images(source: str, target: str, images: list[int] | None = None, *, crop: tuple[int, int, int, int] | None = None, compression: int | None = None, append: bool = False, filler: float = 0, customise: Callable[[int, dict], dict] | None = None, spark: SparkSession | None = None) -> int:
    """Copy main images, whole or a rectangle (x, y, w, h), to `target`; returns how many.

    Without crop or another compression the encoded bytes are copied; tiles that
    share their bytes share them in the copy. Offsets of linked directories are
    dropped. With append the images follow those that `target` has. `customise(i, tags)` gives the tags, {tag: (type,
    value)}, of the i-th copy from those it would have; what says how and where samples are stored stays as it is.
    """
    if os.path.abspath(source) == os.path.abspath(target):
        raise ValueError("source and target are one file; use compact")
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    data = tiff.open_bytes(source)
    h = fmt.header(data)
    offsets = fmt.chain(data, h)[0]
    chosen = list(range(len(offsets))) if images is None else [range(len(offsets))[i] for i in images]
    if append and os.path.exists(target):
        old = fmt.header(tiff.open_bytes(target))
        if (old.order, old.big) != (h.order, h.big):
            raise ValueError("byte order and offset size of the files differ")
    mains = {i: fmt.directory(data, h, offsets[i]) for i in set(chosen)}
    shapes = {i: fmt.geometry(d) for i, d in mains.items()}
    del data
    stored = tiff.scan(spark, source, "tiles", linked="", sparse="true").drop("image")
    pairs = spark.createDataFrame(list(enumerate(chosen)), "image int, global_index int")
    tiles = stored.join(F.broadcast(pairs), "global_index")
    size = [F.col("width"), F.col("height"), F.col("channels")]

    def changed_by_caller(image: int, found: dict) -> dict:
        if customise is None:
            return found
        fixed = {t: v for t, v in found.items() if t in STORED}
        return {t: v for t, v in customise(image, dict(found)).items() if t not in STORED} | fixed

    if crop is None and compression is None:
        there = tiles.where("byte_count > 0")
        firsts = there.groupBy("image", "offset", "byte_count").agg(F.min("k").alias("body"), F.first("path").alias("source"))
        bodies = firsts.select(F.lit(target).alias("path"), "image", F.col("body").alias("k"), "source", "offset", F.col("byte_count").alias("size"))
        index = tiles.join(firsts.drop("source"), ["image", "offset", "byte_count"], "left").select(F.lit(target).alias("path"), "image", "k", "body", *size)

        def entries(image, width, height, channels, places, add, order, big):
            g, last = shapes[chosen[image]], shapes[chosen[image]].grid
            listed = [places.get(k, (0, 0)) for k in range(last[0] * last[1] * g.planes)]
            return changed_by_caller(image, own_tags(mains[chosen[image]]) | index_tags(g.tiled, big, [a for a, _ in listed], [b for _, b in listed]))

        out, _ = pieces(stored_bodies(bodies), entries, order=h.order, big=h.big, append=append, index=index)
    else:
        x0, y0, w, h_ = crop or (0, 0, 0, 0)
        sheets, at = {}, {}
        for image, i in enumerate(chosen):
            g = shapes[i]
            at[image] = y0, x0
            sheets[image] = new_sheet(g, h.order, w if crop else g.width, h_ if crop else g.height, compression or g.compression, filler)

        def entries(image, width, height, channels, places, add, order, big):
            s, g, d = sheets[image], shapes[chosen[image]], mains[chosen[image]]
            changed = {256: (4, s.width), 257: (4, s.height), 258: (3, [s.bits] * s.channels), 259: (3, s.compression)}
            kept = own_tags(d)
            if not g.tiled:
                changed[278] = (4, s.tile_h)
            if g.compression in JPEG_CODES:  # tables and subsampling belonged to the old streams
                kept = {t: v for t, v in kept.items() if t not in (TAGS["JPEGTables"], *range(512, 522), TAGS["YCbCrSubSampling"], TAGS["YCbCrCoefficients"], TAGS["ReferenceBlackWhite"])}
                if g.photometric == 6:
                    changed[262] = (3, 2)
            if s.compression == 7:
                kept.pop(TAGS["Predictor"], None)
                if s.channels == 3 and not s.planar:
                    changed |= {262: (3, 6), 530: (3, [1, 1])}
            if s.compression not in (3, 4):
                kept = {t: v for t, v in kept.items() if t not in (292, 293)}
            return changed_by_caller(image, kept | changed | index_tags(g.tiled, big, *s.listed(places, add)))

        # an image that no stored tile meets still has a directory
        index = spark.createDataFrame([(target, i, None, None, s.width, s.height, s.channels) for i, s in sheets.items()], INDEX_ROWS)
        cut = blocks(tiles.where("byte_count > 0"), sheets, at, target)
        fresh = encoded(cut, lambda image, width, height, channels: sheets[image], paint_blocks)
        own = fresh.select("path", "image", "k", F.col("k").alias("body"), "width", "height", "channels")
        out, _ = pieces(fresh, entries, order=h.order, big=h.big, append=append, index=own.unionByName(index))
    save(out)
    return len(chosen)


def compact(path: str, spark: SparkSession | None = None) -> int:
    """Drop the bytes that no directory uses; returns how many."""
    before = os.path.getsize(path)
    temp = f"{path}.compact"
    copy_images(path, temp, spark=spark)
    os.replace(temp, path)
    return before - os.path.getsize(path)
