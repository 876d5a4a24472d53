"""Writing rasters as TIFF files, and editing directories in place.

Writing: samples are dealt to tiles, encoded in parallel, and written in
parallel into the files at places known beforehand (tiff_layout.py). Editing a
directory touches a few bytes of one file and needs no Spark.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import TAGS
from . import tiff_format as fmt
from .tiff_copy import compact, copy_images  # noqa: F401  editing of whole files, beside that of directories
from .tiff_layout import CLASSIC_DATA, CLASSIC_IFD, INDEX, TILES, Sheet, encoded, padded, pieces, save


@dataclass
class Options:
    """How images are written."""

    dtype: str = "u1"
    tile_w: int = 0  # 0: strips
    tile_h: int = 16
    planar: bool = False
    compression: int = 1
    predictor: int = 1
    little: bool = True
    big: bool = False
    level: float = 0.5
    fill_order: int = 1
    sparse: bool = False
    one_bit: bool = False
    photometric: int | None = None
    filler: float = 0
    append: bool = False
    fax: int = 0  # options of CCITT T.4 and T.6: tags 292 and 293
    sampling: tuple[int, int] = (1, 1)  # JPEG: pixels across and down for one pair of colour differences
    tags: dict[int, tuple[int, object]] = field(default_factory=dict)

    @property
    def order(self) -> str:
        return "<" if self.little else ">"


def sheet(o: Options, width: int, height: int, channels: int) -> Sheet:
    """How an image of this size is stored under `o`."""
    t = np.dtype(o.dtype)
    return Sheet(width, height, channels, o.dtype, 1 if o.one_bit else t.itemsize * 8, o.tile_w or width, o.tile_h, bool(o.tile_w), o.planar, o.compression, o.predictor, o.order, o.fill_order, o.level, o.filler, o.sparse, o.fax, o.photometric in (None, 6), o.sampling)


def tags(o: Options, s: Sheet, offsets: list[int], sizes: list[int], big: bool) -> dict[int, tuple[int, object]]:
    """The directory of an image whose tiles stand at these places."""
    n, t = s.channels, np.dtype(o.dtype)
    mixed = o.compression == 7 and n == 3 and not o.planar and s.mixed
    out: dict[int, tuple[int, object]] = {
        256: (4, s.width), 257: (4, s.height), 258: (3, [s.bits] * n), 259: (3, o.compression), 262: (3, o.photometric if o.photometric is not None else 6 if mixed else 2 if n >= 3 else 1),
        277: (3, n), 284: (3, 2 if o.planar else 1), 339: (3, [{"u": 1, "i": 2, "f": 3}[t.kind]] * n),
    }
    if n > 3 or n == 2:
        out[338] = (3, [0] * (n - (3 if n > 3 else 1)))
    if o.predictor != 1:
        out[317] = (3, o.predictor)
    if o.fill_order != 1:
        out[266] = (3, o.fill_order)
    if o.compression in (3, 4):
        out[292 if o.compression == 3 else 293] = (4, o.fax)
    if mixed:
        out[530] = (3, list(o.sampling))
    kind = 16 if big else 4
    if s.tiled:
        out |= {322: (4, s.tile_w), 323: (4, s.tile_h), 324: (kind, offsets), 325: (kind, sizes)}
    else:
        out |= {278: (4, s.tile_h), 273: (kind, offsets), 279: (kind, sizes)}
    return out | o.tags


def with_tiles(px: DataFrame, o: Options) -> DataFrame:
    """Samples (path, image, c, y, x, v) with the number k of their tile; dimensions are the largest coordinates."""
    dims = px.groupBy("path", "image").agg((F.max("x") + 1).cast("bigint").alias("width"), (F.max("y") + 1).cast("bigint").alias("height"), (F.max("c") + 1).cast("int").alias("channels"))
    t = px.join(dims, ["path", "image"])
    tile_w = F.lit(o.tile_w) if o.tile_w else F.col("width")
    gw = F.ceil(F.col("width") / tile_w)
    gh = F.ceil(F.col("height") / o.tile_h)
    plane = F.col("c") if o.planar else F.lit(0)
    k = (plane * gh + F.floor(F.col("y") / o.tile_h)) * gw + F.floor(F.col("x") / tile_w)
    return t.select("path", F.col("image").cast("int").alias("image"), k.cast("bigint").alias("k"), "width", "height", "channels", F.col("c").cast("int").alias("c"), F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "v")


def layout(px: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """The pieces (format "tiff" writes them) of the files of samples (path, image, c, y, x, v), and a report.

    With o.append the images follow those of a file that is there.
    """

    tiles = encoded(with_tiles(px, o), lambda image, width, height, channels: sheet(o, width, height, channels))
    return pieces(tiles, _entries_of(o), order=o.order, big=o.big, append=o.append)


def write(px: DataFrame, o: Options) -> DataFrame:
    """Write samples (path, image, c, y, x, v) as files; returns path, images, bytes for each file.

    All tasks write into the same files, each the tiles that it encoded; a file appears, or an extended one
    gets its new images, when all of them are done.
    """
    out, report = layout(px, o)
    save(out)
    return report


def blank(spark: SparkSession, path: str, width: int, height: int, channels: int, o: Options) -> None:
    """Write an image of o.filler alone: one stored tile (or, of strips, one of each height) that all share."""
    none = spark.createDataFrame([], TILES)
    image = spark.createDataFrame([(path, 0, None, None, width, height, channels)], INDEX)
    save(pieces(none, _entries_of(o), order=o.order, big=o.big, append=o.append, index=image)[0])


def repeat_tile(spark: SparkSession, path: str, tile: np.ndarray, width: int, height: int, o: Options) -> None:
    """Write an image all of whose tiles are `tile` (rows, columns, channels), stored once, or once a plane."""
    h, w, channels = tile.shape
    s = sheet(replace(o, tile_w=w, tile_h=h), width, height, channels)
    planes = [tile[..., i : i + 1] for i in range(channels)] if o.planar else [tile]
    rows, ahead = [], 0
    for i, plane in enumerate(planes):
        data = s.encode(plane.astype(np.dtype(o.dtype)))
        rows.append((path, 0, i, width, height, channels, 0, ahead, len(data), bytearray(data)))
        ahead += padded(len(data))
    each = s.rows * s.columns
    index = spark.range(s.count).select(F.lit(path).alias("path"), F.lit(0).alias("image"), F.col("id").alias("k"), F.floor(F.col("id") / each).alias("body"), F.lit(width).cast("bigint").alias("width"), F.lit(height).cast("bigint").alias("height"), F.lit(channels).alias("channels"))
    save(pieces(spark.createDataFrame(rows, TILES), _entries_of(replace(o, tile_w=w, tile_h=h)), order=o.order, big=o.big, append=o.append, index=index)[0])


def _entries_of(o: Options):
    def entries(image, width, height, channels, places, add, order, big):
        s = sheet(o, width, height, channels)
        return tags(o, s, *s.listed(places, add), big)

    return entries


class FileWriter:
    """One file written by one process, for files as small as a test's: tiles image by image; `finish` writes the directories."""

    def __init__(self, path: str, o: Options):
        self.path, self.temp, self.o = path, f"{path}.{os.getpid()}.tmp", o
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        self.f = open(self.temp, "wb")
        self.f.write(fmt.file_header(o.order, o.big, 0))
        self.images: list[dict] = []

    def _append(self, data: bytes) -> int:
        at = self.f.tell()
        if at % 2:
            self.f.write(b"\0")
            at += 1
        if not self.o.big and at + len(data) > CLASSIC_DATA:
            raise ValueError("the file outgrows 32-bit offsets; write BigTIFF")
        self.f.write(data)
        return at

    def tile(self, image: int, k: int, width: int, height: int, channels: int, data: bytes) -> None:
        if not self.images or self.images[-1]["image"] != image:
            self.images.append({"image": image, "width": width, "height": height, "channels": channels, "places": {}})
        self.images[-1]["places"][k] = (self._append(data), len(data))

    def entries(self, im: dict) -> dict[int, tuple[int, object]]:
        form = sheet(self.o, im["width"], im["height"], im["channels"])
        return tags(self.o, form, *form.listed(im["places"], self._append), self.o.big)

    def finish(self) -> tuple[int, int]:
        """Write directories and header; returns images and bytes."""
        o = self.o
        link = fmt.first_offset_at(o.big)
        for im in self.images:
            entries = self.entries(im)
            at = self.f.tell() + self.f.tell() % 2
            if not o.big and at > CLASSIC_IFD:
                raise ValueError("the file outgrows 32-bit offsets; write BigTIFF")
            self.f.seek(at)
            self.f.write(fmt.pack_directory(o.order, o.big, at, entries))
            end = self.f.tell()
            self.f.seek(link)
            self.f.write(struct.pack(o.order + ("Q" if o.big else "I"), at))
            self.f.seek(end)
            link = at + (8 + 20 * len(entries) if o.big else 2 + 12 * len(entries))
        size = self.f.tell()
        self.f.close()
        os.replace(self.temp, self.path)
        return len(self.images), size


# Editing one file. These patch bytes under the file's path.


def _patch(path: str, at: int, raw: bytes) -> None:
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(raw)


def _load(path: str):
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _entries(d: fmt.Directory) -> dict[int, tuple[int, object]]:
    out: dict[int, tuple[int, object]] = {}
    for e in d.entries:
        out.setdefault(e.tag, (e.type, e.value))
    return out


def relink(path: str, main_index: int, new_offset: int) -> None:
    """Make the pointer that leads to main directory `main_index` lead to `new_offset`."""
    data = _load(path)
    h = fmt.header(data)
    offsets, _ = fmt.chain(data, h)
    at = fmt.first_offset_at(h.big) if main_index == 0 else fmt.next_offset_at(data, h, offsets[main_index - 1])
    _patch(path, at, struct.pack(h.order + ("Q" if h.big else "I"), new_offset))


def update_ifd(path: str, main_index: int, changes: dict[int, tuple[int, object] | None] | Callable[[dict], dict]) -> str:
    """Put (type, value) or remove (None) tags: UNCHANGED, OVERWRITE_IN_PLACE, or CHANGED (written anew at the end).

    A function in place of the changes gets all tags, {tag: (type, value)}, and returns the changes.
    """
    data = _load(path)
    h = fmt.header(data)
    d = fmt.directory(data, h, fmt.chain(data, h)[0][main_index])
    old = _entries(d)
    changes = changes(dict(old)) if callable(changes) else changes
    new = {t: v for t, v in (old | changes).items() if v is not None}
    if new == old:
        return "UNCHANGED"
    first = {}
    for e in d.entries:
        first.setdefault(e.tag, e)
    fits = set(new) == set(old)
    packed = {}
    for tag in changes if fits else ():
        kind, value = new[tag]
        count, raw = fmt.pack_value(h.order, h.big, kind, value)
        e = first[tag]
        if kind != e.type or count != e.count:
            fits = False
            break
        packed[e.value_offset] = raw
    if fits:
        for at, raw in packed.items():
            _patch(path, at, raw)
        return "OVERWRITE_IN_PLACE"
    at = len(data) + len(data) % 2
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(fmt.pack_directory(h.order, h.big, at, new, d.next_offset))
    relink(path, main_index, at)
    return "CHANGED"


def update_description(path: str, main_index: int, text: str) -> str:
    """Change the description; in place if it is not longer, with the new length in its entry."""
    data = _load(path)
    h = fmt.header(data)
    offset = fmt.chain(data, h)[0][main_index]
    d = fmt.directory(data, h, offset)
    tag = TAGS["ImageDescription"]
    old = next(((i, e) for i, e in enumerate(d.entries) if e.tag == tag and e.type == 2), None)
    if old and not old[1].embedded:
        count, raw = fmt.pack_value(h.order, h.big, 2, text)
        if fmt.fits_outside(h.big, len(raw)) and count < old[1].count:
            _patch(path, old[1].value_offset, raw.ljust(old[1].count, b"\0"))
            _patch(path, fmt.count_at(h.big, offset, old[0]), struct.pack(h.order + ("Q" if h.big else "I"), count))
            return "OVERWRITE_IN_PLACE"
    return update_ifd(path, main_index, {tag: (2, text)})


def delete_ifd(path: str, main_index: int) -> None:
    """Take an image out of the chain; the only image stays."""
    data = _load(path)
    h = fmt.header(data)
    offsets, _ = fmt.chain(data, h)
    if len(offsets) < 2:
        raise ValueError("a file keeps at least one image")
    relink(path, main_index, fmt.directory(data, h, offsets[main_index]).next_offset)


def repair_loop(path: str) -> bool:
    """End the chain where it leads back into itself; whether it did."""
    data = _load(path)
    h = fmt.header(data)
    offsets, loop = fmt.chain(data, h)
    if loop is None:
        return False
    _patch(path, fmt.next_offset_at(data, h, offsets[-1]), struct.pack(h.order + ("Q" if h.big else "I"), 0))
    return True
