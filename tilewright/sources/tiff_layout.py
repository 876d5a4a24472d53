"""From tiles to the pieces of TIFF files.

Samples are dealt out by ranges of (file, image, tile) and encoded where they
land, in order. A partition's tiles of a file are one run of bytes; runs follow
each other by a sum over partitions, so every tile's place is known before a
byte is written, and all tasks write into the same file. The directories of a
file come from its tile index alone, in a task of its own: memory is one tile
for the tasks that encode, and the index of one file for that one.

Encoded tiles are written to the checkpoint folder once. Tasks that are
repeated read them there, so they write the same bytes at the same places.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs, jpeg_write, kernels
from ..plans.lineage import kept
from ..shipping import ship
from . import tiff_format as fmt
from .positioned import COLUMNS, PIECES

#: Largest end of tile data, and largest directory offset, in a file with 32-bit offsets.
CLASSIC_DATA, CLASSIC_IFD = 0xFFFFFFF0, 4_000_000_000
#: Encoded tiles of one file: `part` and `ahead` say which run of bytes holds one and how far in.
TILES = "path string, image int, k bigint, width bigint, height bigint, channels int, part int, ahead bigint, size bigint, data binary"
#: Tiles by the body that they share: see `pieces`.
INDEX = "path string, image int, k bigint, body bigint, width bigint, height bigint, channels int"
#: Bytes of encoded tiles in an Arrow batch.
BATCH = 1 << 22


@dataclass
class Sheet:
    """How the tiles of one image are stored."""

    width: int
    height: int
    channels: int
    dtype: str = "u1"
    bits: int = 8
    tile_w: int = 0
    tile_h: int = 16
    tiled: bool = True
    planar: bool = False
    compression: int = 1
    predictor: int = 1
    order: str = "<"
    fill_order: int = 1
    level: float = 0.5
    filler: float = 0
    sparse: bool = False
    options: int = 0
    mixed: bool = True  # JPEG: three channels as brightness and colour
    sampling: tuple[int, int] = (1, 1)

    @property
    def columns(self) -> int:
        return -(-self.width // self.tile_w) if self.width else 0

    @property
    def rows(self) -> int:
        return -(-self.height // self.tile_h)

    @property
    def count(self) -> int:
        return self.columns * self.rows * (self.channels if self.planar else 1)

    def origin(self, k: int) -> tuple[int, int]:
        """The coordinates of a tile's first sample."""
        row, column = divmod(k % (self.columns * self.rows), self.columns)
        return row * self.tile_h, column * self.tile_w

    def blank(self, k: int) -> np.ndarray:
        """A tile without samples; strips end with the image."""
        height = self.tile_h if self.tiled else min(self.tile_h, self.height - self.origin(k)[0])
        return np.full((height, self.tile_w, 1 if self.planar else self.channels), self.filler, np.dtype(self.dtype))

    def encode(self, tile: np.ndarray, k: int | None = None) -> bytes:
        """The stored bytes of tile k (None: of a filler)."""
        if self.compression == 7:
            if k is not None:  # beyond the image the edge goes on: a jump there would show inside
                y0, x0 = self.origin(k)
                real = tile[: self.height - y0, : self.width - x0]
                tile = np.pad(real, [(0, a - b) for a, b in zip(tile.shape, real.shape, strict=True)], mode="edge")
            return jpeg_write.encode(tile, self.level, ycc=self.mixed, sampling=self.sampling)
        return kernels.encode_tile(tile, compression=self.compression, predictor=self.predictor, bits=[self.bits] * tile.shape[2], order=self.order, fill_order=self.fill_order, level=self.level, options=self.options)

    def listed(self, places: dict[int, tuple[int, int]], add: Callable[[bytes], int]) -> tuple[list[int], list[int]]:
        """Offsets and sizes of all tiles; those that are missing share one filler of their height, or are none in a sparse image."""
        shared: dict[int, tuple[int, int]] = {}
        out = []
        for k in range(self.count):
            place = places.get(k)
            if place is None and self.sparse and self.tiled:
                place = 0, 0
            elif place is None:
                empty = self.blank(k)
                if len(empty) not in shared:
                    data = self.encode(empty)
                    shared[len(empty)] = add(data), len(data)
                place = shared[len(empty)]
            out.append(place)
        return [a for a, _ in out], [b for _, b in out]


#: image, width, height, channels -> its sheet.
SheetOf = Callable[[int, int, int, int], Sheet]


def padded(size):
    """Bytes that a body takes: the next one begins at an even place."""
    return size + size % 2


def groups(batches, keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Slices of sorted batches by equal keys."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        edge = np.zeros(b.num_rows - 1, bool)
        for name in keys:
            c = pa.array(b.column(name)).dictionary_encode().indices.to_numpy()
            edge |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), b.num_rows]
        for a, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(b.column(n)[a].as_py() for n in keys)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(b.slice(a, e - a))
    if held:
        yield now, held


def paint_samples(tile: np.ndarray, y0: int, x0: int, b: pa.RecordBatch) -> None:
    """Rows (c, y, x, v): one sample each."""
    y, x, c, v = (b.column(n).to_numpy(zero_copy_only=False) for n in ("y", "x", "c", "v"))
    tile[y - y0, x - x0, np.zeros_like(c) if tile.shape[2] == 1 else c] = v.astype(tile.dtype)


def paint_blocks(tile: np.ndarray, y0: int, x0: int, b: pa.RecordBatch) -> None:
    """Rows (y, x, h, w, raw): rectangles of all the tile's channels, in the tile's own type."""
    for y, x, h, w, raw in zip(*(b.column(n).to_pylist() for n in ("y", "x", "h", "w", "raw")), strict=True):
        tile[y - y0 : y - y0 + h, x - x0 : x - x0 + w] = np.frombuffer(raw, tile.dtype).reshape(h, w, tile.shape[2])


def encoded(rows: DataFrame, sheet: SheetOf, paint=paint_samples) -> DataFrame:
    """TILES from rows (path, image, k, width, height, channels, ...) that `paint` puts into the tiles of a sheet."""
    ship(rows.sparkSession)
    registered = codecs.added()
    keys = ["path", "image", "k"]

    def run(batches):
        from pyspark import TaskContext

        codecs.adopt(registered)
        part = TaskContext.get().partitionId()
        ahead: dict[str, int] = {}
        out: list[tuple] = []
        for (path, image, k), parts in groups(batches, keys):
            width, height, channels = (parts[0].column(n)[0].as_py() for n in ("width", "height", "channels"))
            form = sheet(image, width, height, channels)
            tile = form.blank(k)
            for b in parts:
                paint(tile, *form.origin(k), b)
            data = form.encode(tile, k)
            at = ahead.get(path, 0)
            ahead[path] = at + padded(len(data))
            out.append((path, image, k, width, height, channels, part, at, len(data), data))
            if sum(len(t[-1]) for t in out) > BATCH:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return kept(ordered.mapInArrow(run, TILES))


KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], [c.split()[0] for c in TILES.split(", ")])


def stored_bodies(bodies: DataFrame) -> DataFrame:
    """TILES from rows (path, image, k, source, offset, size): bytes that stand in other files, copied as they are."""
    ship(bodies.sparkSession)
    keys = ["path", "image", "k"]

    def run(batches):
        from pyspark import TaskContext

        part, ahead, out = TaskContext.get().partitionId(), {}, []
        for b in batches:
            for r in b.to_pylist():
                with open(r["source"].removeprefix("file:"), "rb") as f:
                    f.seek(r["offset"])
                    data = f.read(r["size"])
                at = ahead.get(r["path"], 0)
                ahead[r["path"]] = at + padded(len(data))
                out.append((r["path"], r["image"], r["k"], 0, 0, 0, part, at, len(data), data))
                if sum(len(t[-1]) for t in out) > BATCH:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return kept(bodies.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, TILES))


HEAD = PIECES + ", images int, bytes bigint"


def file_state(path: str, order: str, big: bool, append: bool) -> tuple[int, int, str, bool]:
    """Old length and first free place of a file, its byte order and offset size; a new file begins after its header."""
    if append and os.path.exists(path):
        with open(path, "rb") as f:
            h = fmt.header(f.read(64))
        length = os.path.getsize(path)
        return length, padded(length), h.order, h.big
    return 0, 16 if big else 8, order, big


def pieces(tiles: DataFrame, entries: Callable, *, order: str, big: bool, append: bool = False, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pieces of all files, and a report: path, images, bytes.

    `tiles` are TILES. `index` lists further tiles of the images: (path, image, k, body, width, height, channels),
    where body is the k of the stored body that tile k shares (null: none stored; k null: the image only);
    without it every tile is its own body. `entries(image, width, height, channels, places, append)` gives a
    directory's tags from places {k: (offset, size)}; `append(bytes)` stores bytes and returns their offset.
    With `append` the images follow those that a file has.
    """
    spark = tiles.sparkSession
    ship(spark)
    registered = codecs.added()

    def look(batches):
        for b in batches:
            paths = b.column(0).to_pylist()
            found = [file_state(p.removeprefix("file:"), order, big, append) for p in paths]
            if any(f[2] != order for f in found):
                raise ValueError("the byte order of a file that is appended to differs")
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))], ["path", "start", "free", "order", "big"])

    narrow = tiles.drop("data")
    paths = narrow.select("path").distinct() if index is None else narrow.select("path").union(index.select("path")).distinct()
    # written before anything else is: an extended file's length changes as soon as a task writes
    starts = kept(paths.mapInArrow(look, "path string, start bigint, free bigint, order string, big boolean"))
    runs = narrow.groupBy("path", "part").agg(F.max(F.col("ahead") + F.col("size") + F.col("size") % 2).alias("length"))
    before = F.sum("length").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0)))
    places = runs.join(starts, "path").select("path", "part", "start", (F.col("free") + F.col("before")).alias("base"))
    placed = tiles.join(places, ["path", "part"]).withColumn("at", F.col("base") + F.col("ahead"))

    listed = placed.select("path", "image", F.col("k") if index is None else F.lit(None).cast("bigint").alias("k"), F.col("k").alias("body"), "width", "height", "channels", "at", "size")
    if index is not None:
        listed = listed.unionByName(index.select("path", "image", "k", "body", "width", "height", "channels", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("size")))
    listed = listed.join(starts, "path")

    def finish(key, table):
        codecs.adopt(registered)
        return head(key[0].as_py(), table, entries)

    heads = kept(listed.groupBy("path").applyInArrow(finish, HEAD))
    bodies = placed.select("path", "start", "at", "data", F.lit(False).alias("last"))
    out = bodies.unionByName(heads.where("images is null").select(*COLUMNS))
    return out, heads.where("images is not null").select("path", "images", "bytes")


def head(path: str, table: pa.Table, entries: Callable) -> pa.Table:
    """The header and directories of one file from its tile index, and a row of the report."""
    start, free, order, big = (table.column(n)[0].as_py() for n in ("start", "free", "order", "big"))
    offset = order + ("Q" if big else "I")
    image, k, body, at, size = (table.column(n).to_pylist() for n in ("image", "k", "body", "at", "size"))
    shape = dict(zip(image, zip(*(table.column(n).to_pylist() for n in ("width", "height", "channels")), strict=True), strict=True))
    shape |= {i: s for i, s in zip(image, zip(*(table.column(n).to_pylist() for n in ("width", "height", "channels")), strict=True), strict=True) if s[0]}
    stored: dict[int, dict[int, tuple[int, int]]] = {i: {} for i in shape}
    for i, b, a, s in zip(image, body, at, size, strict=True):
        if a is not None:
            stored[i][b] = (a, s)
    linked: dict[int, dict[int, tuple[int, int]]] = {i: {} for i in shape}
    for i, n, b in zip(image, k, body, strict=True):
        if n is not None and b is not None:
            linked[i][n] = stored[i][b]
    first = end = max([free, *(padded(a + s) for p in stored.values() for a, s in p.values())])
    if not big and end > CLASSIC_DATA:
        raise ValueError("the file outgrows 32-bit offsets; write BigTIFF")
    blob = bytearray()

    def add(data: bytes) -> int:
        blob.extend(b"\0" * (len(blob) % 2))
        blob.extend(data)
        return first + len(blob) - len(data)

    rows: list[tuple] = []
    if start:
        with open(path.removeprefix("file:"), "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            h = fmt.header(data)
            mains, loop = fmt.chain(data, h)
            if loop is not None:
                raise fmt.Damaged("the chain of directories is a loop; repair it before images are appended")
            link = fmt.next_offset_at(data, h, mains[-1]) if mains else fmt.first_offset_at(big)
    else:
        rows.append((path, 0, 0, fmt.file_header(order, big, 0), False))
        link = fmt.first_offset_at(big)
    links: list[tuple[int, int]] = []
    for i in sorted(shape):
        tags = entries(i, *shape[i], linked[i], add, order, big)
        blob.extend(b"\0" * (len(blob) % 2))
        here = first + len(blob)
        if not big and here > CLASSIC_IFD:
            raise ValueError("the file outgrows 32-bit offsets; write BigTIFF")
        links.append((link, here))
        blob.extend(fmt.pack_directory(order, big, here, tags))
        link = here + (8 + 20 * len(tags) if big else 2 + 12 * len(tags))
    # the first link brings the new images to life: it waits for the commit
    for place, to in links[1:]:
        struct.pack_into(offset, blob, place - first, to)
    rows.append((path, start, first, bytes(blob), False))
    rows.append((path, start, links[0][0], struct.pack(offset, links[0][1]), True))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)]
    empty = [pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64())]
    pieces_ = pa.table([*columns, *empty], names=[*COLUMNS, "images", "bytes"])
    report = pa.table([pa.array([path]), *(pa.nulls(1, c.type) for c in columns[1:]), pa.array([len(shape)], pa.int32()), pa.array([first + len(blob)], pa.int64())], names=pieces_.column_names)
    return pa.concat_tables([pieces_, report])


def save(out: DataFrame, folder: str = "/", overwrite: bool = True) -> None:
    """Write pieces; paths are below `folder`, or absolute."""
    from .tiff import register

    register(out.sparkSession)
    out.select(*COLUMNS).write.format("tiff").mode("overwrite" if overwrite else "append").save(folder)
