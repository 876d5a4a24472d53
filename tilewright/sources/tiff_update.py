"""Changing samples of an image inside its file.

Only tiles that the new samples meet are touched. A tile that they cover whole
is not read; others are decoded and painted over. The new bodies are encoded in
parallel and kept before a byte of the file changes, so a repeated task finds
what it found before. Then each body gets a place (`allocate`), bodies are
written, and after them the entries of the tile index, by all tasks; every other
byte of the file stays as it is.

Memory: a tile for the tasks that encode, the changed part of a file's index
for the one that allocates.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, kernels
from ..functions.tags import TAGS
from ..plans.lineage import kept
from ..shipping import ship
from . import tiff
from . import tiff_format as fmt
from .positioned import PIECES
from .tiff_copy import decoded, new_sheet
from .tiff_layout import CLASSIC_DATA, paint_samples, save
from .tiff_sink import update_ifd

NEW = "k bigint, old_at bigint, old_size bigint, shared boolean, size bigint, data binary"
PLACED = "k bigint, action string, place bigint, size bigint, " + PIECES
IN_PLACE, AT_END, APPENDED = "in place", "at the end", "appended"


def allocate(bodies: Iterable[tuple[int, int, int, bool, int]], length: int, always_at_end: bool = False) -> tuple[list[tuple[int, str, int, int]], int]:
    """Places for new bodies (k, old offset, old size, shared, size) of a file of `length` bytes, in the order of k.

    A body takes its old place if it fits, or if that place ends the file, which then ends with the new body; a
    place that several tiles share, or none, is left, and the body goes to the end. Returns (k, action, offset, size)
    and the file's new length.
    """
    out = []
    for k, at, capacity, shared, size in sorted(bodies):
        own = capacity > 0 and not shared and not always_at_end
        if own and at + capacity == length:
            out.append((k, AT_END, at, size))
            length = at + size
        elif own and size <= capacity:
            out.append((k, IN_PLACE, at, size))
        else:
            out.append((k, APPENDED, length, size))
            length += size
    return out, length


def tile_number(g: fmt.Geometry, c: Column, y: Column, x: Column) -> Column:
    gw, gh = g.grid
    plane = c if g.planar else F.lit(0)
    return ((plane * gh + F.floor(y / g.tile_h)) * gw + F.floor(x / g.tile_w)).cast("bigint")


def update(path: str, main_index: int, px: DataFrame, *, outside: str = "error", always_at_end: bool = False, spark: SparkSession | None = None) -> DataFrame:
    """Put samples (c, y, x, v) into a stored image; returns k, action, place, size of the tiles that were written.

    Samples beyond the image are an error, or are left out (outside="crop"). Of several samples for one place the
    largest counts. Tiles without data are filled with zeros first.
    """
    spark = spark or px.sparkSession
    data = tiff.open_bytes(path)
    h = fmt.header(data)
    d = fmt.directory(data, h, fmt.chain(data, h)[0][main_index])
    g = fmt.geometry(d)
    length = len(data)
    sheet = new_sheet(g, h.order, g.width, g.height, g.compression, 0)
    if set(g.bits) != {sheet.bits} or g.photometric == 6:
        raise ValueError(f"tiles of {g.bits} bits, photometric {g.photometric}, cannot be encoded")
    places = {e.tag: e for e in reversed(d.entries)}
    offsets, sizes = (places[TAGS[("Tile" if d.get("TileOffsets") is not None else "Strip") + n]] for n in ("Offsets", "ByteCounts"))
    del data

    inside = (F.col("c") >= 0) & (F.col("c") < g.channels) & (F.col("y") >= 0) & (F.col("y") < g.height) & (F.col("x") >= 0) & (F.col("x") < g.width)
    rows = px.select(F.col("c").cast("int").alias("c"), F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "v")
    if outside == "error":
        rows = rows.where(F.when(inside, True).otherwise(F.raise_error(F.lit(f"samples outside the image of {g.width} x {g.height}")).cast("boolean")))
    else:
        rows = rows.where(inside)
    rows = rows.withColumn("k", tile_number(g, F.col("c"), F.col("y"), F.col("x")))
    tiles = tiff.scan(spark, path, "tiles", linked="", sparse="true").where(F.col("global_index") == main_index)
    common = tiles.where("byte_count > 0").groupBy("offset").agg((F.count(F.lit(1)) > 1).alias("shared")).where("shared")
    touched = tiles.join(rows.select("k").distinct(), "k", "left_semi").join(common, "offset", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    ship(spark)
    registered = codecs.added()

    def merge(key, new, old):
        codecs.adopt(registered)
        k = key[0].as_py()
        (t,) = old.to_pylist()
        tile = sheet.blank(k)
        y0, x0 = sheet.origin(k)
        b = new.sort_by([(n, "ascending") for n in ("c", "y", "x", "v")]).combine_chunks().to_batches()[0]
        real = min(g.tile_h, g.height - y0) * min(g.tile_w, g.width - x0) * tile.shape[2]
        whole = b.num_rows >= real and np.unique(np.stack([b.column(n).to_numpy() for n in ("c", "y", "x")]), axis=1).shape[1] == real
        if t["byte_count"] and not whole:
            with open(t["path"].removeprefix("file:"), "rb") as f:
                f.seek(t["offset"])
                tile = decoded(t, f.read(t["byte_count"])).astype(np.dtype(sheet.dtype))
        paint_samples(tile, y0, x0, b)
        body = sheet.encode(tile, k)
        return pa.table({"k": [k], "old_at": [t["offset"]], "old_size": [t["byte_count"]], "shared": [t["shared"]], "size": [len(body)], "data": pa.array([body], pa.binary())})

    new = kept(rows.groupBy("k").cogroup(touched.groupBy("k")).applyInArrow(merge, NEW))

    def assign(key, table):
        found, end = allocate(zip(*(table.column(n).to_pylist() for n in ("k", "old_at", "old_size", "shared", "size")), strict=True), length, always_at_end)
        if not h.big and end > CLASSIC_DATA:
            raise ValueError("the file outgrows 32-bit offsets")
        out = []
        for k, action, at, size in found:
            out += [(k, action, at, size, path, length, e.value_offset + k * width_of(e.type), number(h, e.type, v), False) for e, v in ((offsets, at), (sizes, size))]
        if end < length:
            out.append((None, None, None, None, path, length, end, None, True))
        columns = zip(*out, strict=True)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PLACED.split(", ")])

    placed = kept(new.drop("data").withColumn("file", F.lit(path)).groupBy("file").applyInArrow(assign, PLACED))
    report = placed.where("k is not null").select("k", "action", "place", "size").distinct()
    bodies = new.select("k", "data").join(report, "k").select(F.lit(path).alias("path"), F.lit(length).cast("bigint").alias("start"), F.col("place").alias("at"), "data", F.lit(False).alias("last"))
    save(bodies)
    gw, gh = g.grid
    if offsets.count == sizes.count == gw * gh * g.planes and not placed.where("k is not null and data is null").head(1):
        save(placed)
    else:
        _rewrite(path, main_index, d, g, report, placed.where("last").select("at").collect())
    return report


def width_of(kind: int) -> int:
    return fmt.CODES[kind][1]


def number(h: fmt.Header, kind: int, value: int) -> bytes | None:
    """A value of the tile index in the index's own type, or None if it does not fit."""
    size = width_of(kind)
    return struct.pack(h.order + fmt.FORMATS[kind], value) if value < 1 << 8 * size else None


def _rewrite(path: str, main_index: int, d: fmt.Directory, g: fmt.Geometry, report: DataFrame, ends: list) -> None:
    """The directory anew at the end of the file: its index had no room for the values. The index of one image is in memory."""
    if ends:
        os.truncate(path, ends[0][0])
    found = {r.k: (r.place, r.size) for r in report.collect()}
    with open(path, "rb") as f:
        length = os.fstat(f.fileno()).st_size
    old = {p.k: (p.offset, p.size) for p in fmt.places(d, g, 1 << 62, sparse=True)}
    listed = [found.get(k, old[k]) for k in range(len(old))]
    big = fmt.header(tiff.open_bytes(path)).big
    if not big and length > CLASSIC_DATA:
        raise ValueError("the file outgrows 32-bit offsets")
    names = ("Tile" if d.get("TileOffsets") is not None else "Strip",) * 2
    kind = 16 if big else 4
    update_ifd(path, main_index, {TAGS[names[0] + "Offsets"]: (kind, [a for a, _ in listed]), TAGS[names[1] + "ByteCounts"]: (kind, [b for _, b in listed])})
