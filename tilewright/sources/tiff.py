"""TIFF files as tables.

`register(spark)` adds the format "tiff"; the option `table` says which rows:

- files: one row a file: header, number of images, a loop's target, error text
- ifds: one row a directory with its geometry
- entries: one row a tag with its value
- tiles: one row a stored tile or strip: place in the image and in the file

Files are opened by the executors under their path, so they must lie in a
folder that all of them mount. `from_binary` parses the rows of Spark's
binaryFile source instead, for stores that only Spark reads. Each file is a
task of its own for directories, which are chains of pointers; samples are
decoded with a tile a row, wherever the tile rows are.

Filters on the place of tiles (global_index, k, plane, ty, tx) and on the path are pushed
into the scan, which then reads the index entries of those tiles alone; so does the option
region="x,y,w,h", a rectangle that each image turns into a range of its own tiles. Large
files are several tasks, each with a range of tiles; so are smaller ones where there are
fewer files than tasks wanted (option tasks; `scan` asks for three a core).

mode=FAILFAST (default) raises on a damaged file, PERMISSIVE gives no rows for
it (table files: a row with the error).
"""

from __future__ import annotations

import glob
import mmap
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import codecs, jpeg, kernels, logluv
from ..operators.raster import tiles_of_region
from ..shipping import ship
from . import tiff_format as fmt
from .positioned import COLUMNS, PIECES, PositionedWriter

FILES = "path string, length bigint, is_tiff boolean, is_valid boolean, is_big boolean, byte_order string, first_ifd_offset bigint, images int, loop_offset bigint, error string"
GEOMETRY = "width bigint, height bigint, channels int, bits array<int>, sample_format int, tile_w bigint, tile_h bigint, tiled boolean, planar boolean, compression int, predictor int, photometric int, fill_order int, chroma_w int, chroma_h int"
IFDS = "path string, global_index int, main_index int, kind string, offset bigint, next_offset bigint, entries int, in_order boolean, " + GEOMETRY + ", description string, error string"
ENTRIES = "path string, global_index int, position int, tag int, type int, count bigint, value_offset bigint, embedded boolean, value struct<i:array<bigint>,d:array<double>,s:array<string>,b:binary,r:array<struct<num:bigint,den:bigint>>>"
TILES = "path string, global_index int, byte_order string, k bigint, plane int, ty int, tx int, offset bigint, byte_count bigint, w int, h int, " + GEOMETRY + ", jpeg_tables binary, luma array<double>, reference array<double>, options bigint"
SCHEMAS = {"files": FILES, "ifds": IFDS, "entries": ENTRIES, "tiles": TILES}


def _geometry_row(g: fmt.Geometry) -> tuple:
    return (g.width, g.height, g.channels, g.bits, g.kind, g.tile_w, g.tile_h, g.tiled, g.planar, g.compression, g.predictor, g.photometric, g.fill_order, *g.subsampling)


def _tagged(kind: int, value) -> tuple:
    """The value struct: integers, doubles, strings, bytes or rationals, the others null."""
    if kind not in fmt.CODES:
        return ([int(v) for v in value], None, None, None, None)
    if kind == 2:
        return (None, None, [value] if isinstance(value, str) else list(value), None, None)
    if kind == 7:
        return (None, None, None, bytes(value), None)
    if kind in (5, 10):
        return (None, None, None, None, [value] if isinstance(value, tuple) else list(value))
    items = value if isinstance(value, (list, fmt.Numbers)) else [value]
    if kind in (11, 12):
        return (None, [float(v) for v in items], None, None, None)
    return ([int(v) for v in items], None, None, None, None)


#: Bounds on columns that a scan of tiles prunes by: column -> (least, most), inclusive.
Bounds = dict[str, tuple[int, int]]
PRUNED = ("global_index", "k", "plane", "ty", "tx")
NO_BOUND = (0, 1 << 62)
#: Bytes of a file below which it is not cut for the sake of more tasks.
LEAST_PART = 1 << 16
#: Rows of an Arrow batch of small files' tables, and bytes of the files that it holds.
FILE_ROWS, FILE_BYTES = 1024, 1 << 22
#: Tiles in an Arrow batch, and its schema (workers have no session to derive it).
TILE_ROWS = 8192
KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
TILE_ARROW = pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in TILES.split(", "))])


def wanted_tiles(g: fmt.Geometry, bounds: Bounds, region: tuple[int, int, int, int] | None, part: tuple[int, int]) -> np.ndarray | None:
    """The numbers of an image's tiles within the bounds, the rectangle and the part (i, of n); None: all."""
    gw, gh = g.grid
    n = gw * gh * g.planes
    if not region and part == (0, 1) and not set(bounds) & {"k", "plane", "ty", "tx"}:
        return None
    low, high = {}, {}
    for axis, size in (("plane", g.planes), ("ty", gh), ("tx", gw)):
        a, b = bounds.get(axis, NO_BOUND)
        low[axis], high[axis] = max(0, a), min(size - 1, b)
    if region:
        x0, x1, y0, y1 = tiles_of_region(*region, g.tile_w, g.tile_h, gw, gh) if region[2] > 0 and region[3] > 0 else (1, 0, 1, 0)
        low["tx"], high["tx"], low["ty"], high["ty"] = max(low["tx"], x0), min(high["tx"], x1), max(low["ty"], y0), min(high["ty"], y1)
    plane, ty, tx = (np.arange(low[a], max(low[a], high[a] + 1)) for a in ("plane", "ty", "tx"))
    k = ((plane[:, None, None] * gh + ty[:, None]) * gw + tx).ravel()
    a, b = bounds.get("k", NO_BOUND)
    a, b = max(a, n * part[0] // part[1]), min(b, n * (part[0] + 1) // part[1] - 1)
    return k[(k >= a) & (k <= b)]


def tile_batches(path: str, data, *, permissive: bool = False, linked: tuple[str, ...] = ("sub",), sparse: bool = False, bounds: Bounds | None = None, region: tuple[int, int, int, int] | None = None, part: tuple[int, int] = (0, 1)) -> Iterator[pa.RecordBatch]:
    """The rows of the table tiles as Arrow batches."""
    bounds = bounds or {}
    schema = TILE_ARROW
    try:
        h = fmt.header(data)
        found = fmt.directories(data, h, linked)
    except ValueError:
        if not permissive:
            raise
        return
    first, last = bounds.get("global_index", NO_BOUND)
    for d in found:
        if not first <= d.global_index <= last:
            continue
        try:
            g = fmt.geometry(d)
        except ValueError:
            continue
        try:
            p = fmt.place_arrays(d, g, len(data), sparse, wanted_tiles(g, bounds, region, part))
            heads = {int(x): fmt.old_jpeg_head(data, d, g, int(x)) for x in np.unique(p["h"])} if g.compression == 6 else {}
        except ValueError:
            if not permissive:
                raise
            continue
        same = dict(zip((f.name for f in schema), [path, d.global_index, "II" if h.order == "<" else "MM", *[None] * 6, g.tile_w, None, *_geometry_row(g), d.get("JPEGTables"), fmt.ratios(d.numbers("YCbCrCoefficients")), fmt.whole_levels(d.numbers("ReferenceBlackWhite")), g.options], strict=True))
        for at in range(0, len(p["k"]), TILE_ROWS):
            own = {("byte_count" if c == "size" else c): v[at : at + TILE_ROWS] for c, v in p.items()}
            n = len(own["k"])
            columns = []
            for f in schema:
                if f.name in own:
                    columns.append(pa.array(own[f.name]).cast(f.type))
                elif f.name == "jpeg_tables" and heads:
                    columns.append(pa.array([heads[x] for x in own["h"].tolist()], f.type))
                else:  # one value, repeated
                    columns.append(pa.array([same[f.name]], f.type).take(pa.array(np.zeros(n, np.int32))))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def rows(table: str, path: str, data, *, permissive: bool = False, linked: tuple[str, ...] = ("sub",), sparse: bool = False) -> Iterator[tuple]:
    """The rows of a table for one file's bytes."""
    if table == "tiles":
        for b in tile_batches(path, data, permissive=permissive, linked=linked, sparse=sparse):
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)
        return
    length = len(data)
    if table == "files":
        try:
            h = fmt.header(data)
            offsets, loop = fmt.chain(data, h)
            yield (path, length, True, True, h.big, "II" if h.order == "<" else "MM", h.first, len(offsets), loop, None)
        except ValueError as e:
            if not permissive:
                raise
            yield (path, length, not isinstance(e, fmt.NotTiff), False, None, None, None, None, None, str(e))
        return
    try:
        h = fmt.header(data)
        found = fmt.directories(data, h, linked)
    except ValueError:
        if not permissive:
            raise
        return
    for d in found:
        if table == "entries":
            for i, e in enumerate(d.entries):
                yield (path, d.global_index, i, e.tag, e.type, e.count, e.value_offset, e.embedded, _tagged(e.type, e.value))
            continue
        g, error = None, None
        try:
            g = fmt.geometry(d)
        except ValueError as e:
            error = str(e)
        if table == "ifds":
            text = d.get("ImageDescription")
            text = "\n".join(text) if isinstance(text, list) else text
            shape = _geometry_row(g) if g else (None,) * 15
            yield (path, d.global_index, d.main_index, d.kind, d.offset, d.next_offset, len(d.entries), d.sorted, *shape, text, error)


def open_bytes(path: str):
    """A file's bytes without reading them all."""
    path = path.removeprefix("file:")
    if os.path.getsize(path) == 0:
        return b""
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class OneFile(InputPartition):
    """A file, or the tiles of its images in the `part`-th of `parts` ranges."""

    def __init__(self, path: str, part: int = 0, parts: int = 1):
        self.path, self.part, self.parts = path, part, parts


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "files")
        self.pattern = options["path"]
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.linked = tuple(x for x in options.get("linked", "sub").split(",") if x)
        self.sparse = options.get("sparse", "false").lower() == "true"
        self.split = int(options.get("splitbytes", options.get("splitBytes", 1 << 30)))
        self.tasks = int(options.get("tasks", 1))
        region = options.get("region")
        self.region = tuple(int(v) for v in region.split(",")) if region else None
        if self.region and len(self.region) != 4:
            raise ValueError("a region is x,y,w,h")
        self.bounds: Bounds = {}
        self.paths: set[str] | None = None

    def pushFilters(self, filters):
        """Take over what bounds the place of tiles, and the choice of paths; the rest is left to Spark."""
        for f in filters:
            name, value = f.attribute[0] if hasattr(f, "attribute") else None, getattr(f, "value", None)
            if name == "path" and isinstance(f, (EqualTo, In)):
                chosen = set(value if isinstance(f, In) else [value])
                self.paths = chosen if self.paths is None else self.paths & chosen
                yield f  # a file may be listed under another form of its path
                continue
            if self.table != "tiles" or name not in PRUNED or not isinstance(value, int):
                if self.table == "tiles" and name in PRUNED and isinstance(f, In) and all(isinstance(v, int) for v in value):
                    self.bound(name, min(value, default=0), max(value, default=-1))
                yield f
            elif isinstance(f, EqualTo):
                self.bound(name, value, value)
            elif isinstance(f, GreaterThan):
                self.bound(name, value + 1, NO_BOUND[1])
            elif isinstance(f, GreaterThanOrEqual):
                self.bound(name, value, NO_BOUND[1])
            elif isinstance(f, LessThan):
                self.bound(name, 0, value - 1)
            elif isinstance(f, LessThanOrEqual):
                self.bound(name, 0, value)
            else:
                yield f

    def bound(self, name: str, least: int, most: int) -> None:
        a, b = self.bounds.get(name, NO_BOUND)
        self.bounds[name] = max(a, least), min(b, most)

    def partitions(self):
        pattern = self.pattern.removeprefix("file:")
        paths = sorted(glob.glob(pattern)) if glob.has_magic(pattern) else [pattern]
        found = []
        for p in paths:
            found += [os.path.join(p, n) for n in sorted(os.listdir(p)) if n[:1] not in "._"] if os.path.isdir(p) else [p]
        if self.paths is not None:
            found = [p for p in found if p in self.paths]
        if self.table != "tiles":
            return [OneFile(p) for p in found]
        out = []
        for p in found:
            size = os.path.getsize(p) if os.path.exists(p) else 0
            parts = max(1, -(-size // self.split), min(self.tasks // len(found), size // LEAST_PART))
            out += [OneFile(p, i, parts) for i in range(parts)]
        return out

    def read(self, partition):
        data = open_bytes(partition.path)
        if self.table == "tiles":
            yield from tile_batches(partition.path, data, permissive=self.permissive, linked=self.linked, sparse=self.sparse, bounds=self.bounds, region=self.region, part=(partition.part, partition.parts))
        else:
            yield from rows(self.table, partition.path, data, permissive=self.permissive, linked=self.linked, sparse=self.sparse)


class TiffSource(DataSource):
    @classmethod
    def name(cls):
        return "tiff"

    def schema(self):
        return SCHEMAS[self.options.get("table", "files")]

    def reader(self, schema):
        return TiffReader(dict(self.options))

    def writer(self, schema, overwrite):
        if schema.names != COLUMNS:
            raise ValueError(f"the format writes pieces ({PIECES}), as tiff_sink.layout gives them")
        return PositionedWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)


def scan(spark: SparkSession, path: str, table: str = "files", **options) -> DataFrame:
    """A table of the files at `path` (a file, a folder or a pattern)."""
    register(spark)
    options = {"tasks": 3 * spark.sparkContext.defaultParallelism} | options
    return spark.read.format("tiff").options(table=table, **options).load(path)


def from_binary(files: DataFrame, table: str = "files", **options) -> DataFrame:
    """A table from rows (path, content), as binaryFile gives them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMAS[table])
    arrow = to_arrow_schema(schema)

    ship(files.sparkSession)

    def run(batches):
        yield from file_batches(batches, table, arrow, **options)

    return files.select("path", "content").mapInArrow(run, schema)


def file_batches(batches, table: str, arrow: pa.Schema, **options) -> Iterator[pa.RecordBatch]:
    """The rows of a table for batches of (path, content): many small files in one batch, since a batch costs more than a small file."""

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([_named(v, f.type) for v in c], f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], arrow.names)

    found, size = [], 0
    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            data = content.as_py()
            for r in rows(table, path.as_py(), data, **options):
                found.append(r)
                if len(found) >= FILE_ROWS:
                    yield batch(found)
                    found, size = [], 0
            size += len(data)
            if found and size >= FILE_BYTES:
                yield batch(found)
                found, size = [], 0
    if found:
        yield batch(found)


def _named(v, t: pa.DataType):
    if pa.types.is_struct(t) and isinstance(v, tuple):
        return {f.name: _named(x, f.type) for f, x in zip(t, v, strict=True)}
    if pa.types.is_list(t) and pa.types.is_struct(t.value_type) and v is not None:
        return [_named(x, t.value_type) for x in v]
    return v


def decode_rows(t: dict, data: bytes | None, *, rescale: bool = False, invert: bool = True, filler: float = 0) -> Iterator[tuple]:
    """Rows (c, y, x0, samples) of one tile, cut to the image."""
    bits = t["bits"][:1] if t["planar"] else t["bits"]
    order = "<" if t["byte_order"] == "II" else ">"
    if not data:
        tile = np.full((t["h"], t["w"], len(bits)), filler)
    elif t["compression"] == 34676:
        size = 4 if t["photometric"] == 32845 else 2
        codes = logluv.unpack_planes(data, t["w"], t["h"], size)
        tile = logluv.luv32_to_rgb(codes) if size == 4 else logluv.log16_to_grey(codes)[..., None]
    elif t["compression"] in (6, 7, 34892):
        tile = jpeg.decode_old(data, t["jpeg_tables"]) if t["compression"] == 6 else jpeg.decode(data, t["jpeg_tables"])
        if t["photometric"] == 6 and tile.shape[2] == 3:
            tile = jpeg.to_rgb(tile)
        elif invert and t["photometric"] == 0 and tile.shape[2] == 1:
            tile = ~tile
    elif t["photometric"] == 6 and t["compression"] not in (6, 7, 34892) and not t["planar"]:
        size = kernels.ycbcr_size(t["w"], t["h"], t["chroma_w"], t["chroma_h"])
        raw = codecs.decode(t["compression"], data, codecs.Info(0, size, width=t["w"], height=t["h"]))
        levels = {"luma": t["luma"][:3]} if len(t["luma"] or ()) >= 3 else {}
        levels |= {"reference": t["reference"]} if t["reference"] else {}
        tile = kernels.ycbcr_tile(raw, t["w"], t["h"], t["chroma_w"], t["chroma_h"], **levels)
    else:
        inverted = invert and t["photometric"] in (0, 5) and t["compression"] in (1, 2, 3, 4, 5, 8, 32773, 32809, 32946, 34925, 50000)
        scaled = rescale and t["photometric"] not in (3, 4)
        tile = kernels.decode_tile(data, compression=t["compression"], predictor=t["predictor"], width=t["w"], height=t["h"], bits=bits, kind=t["sample_format"], order=order, fill_order=t["fill_order"], invert=inverted, rescale=scaled, options=t["options"])
    y0, x0 = t["ty"] * t["tile_h"], t["tx"] * t["tile_w"]
    tile = tile[: t["height"] - y0, : t["width"] - x0]
    for c in range(tile.shape[2]):
        for y, line in enumerate(tile[:, :, c]):
            yield (t["plane"] if t["planar"] else c, y0 + y, x0, line.astype(float))


SAMPLES = "path string, global_index int, c int, y bigint, x0 bigint, samples array<double>"


def samples(tiles: DataFrame, *, rescale: bool = False, invert: bool = True, filler: float = 0) -> DataFrame:
    """Decoded rows of tiles: path, global_index, c, y, x0 and the samples from x0 on.

    Filter the tile rows first (tiles_of_region in operators.raster): only the
    bytes of the tiles that are left are read.
    """

    ship(tiles.sparkSession)
    registered = codecs.added()

    def run(batches):
        codecs.adopt(registered)
        for b in batches:
            for t in b.to_pylist():
                data = None
                if t["byte_count"]:
                    with open(t["path"].removeprefix("file:"), "rb") as f:
                        f.seek(t["offset"])
                        data = f.read(t["byte_count"])
                c, y, x, s = zip(*decode_rows(t, data, rescale=rescale, invert=invert, filler=filler), strict=True)
                n = len(c)
                ends = np.concatenate([[0], np.cumsum([len(v) for v in s])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([t["path"]] * n), pa.array([t["global_index"]] * n, pa.int32()), pa.array(c, pa.int32()), pa.array(y, pa.int64()), pa.array(x, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(s)))], ["path", "global_index", "c", "y", "x0", "samples"])

    return tiles.mapInArrow(run, SAMPLES)


def pixels(tiles: DataFrame, **options) -> DataFrame:
    """One row a sample: path, global_index, c, y, x, v."""
    s = samples(tiles, **options).select("path", "global_index", "c", "y", "x0", F.posexplode("samples").alias("i", "v"))
    return s.select("path", "global_index", "c", "y", (F.col("x0") + F.col("i")).alias("x"), "v")


def region(spark: SparkSession, path: str, x0: int, y0: int, w: int, h: int, *, filler: float | None = None, **options) -> DataFrame:
    """The samples of a rectangle of every image at `path`, in its own coordinates: path, global_index, c, y, x, v.

    Only tiles that meet it are read. Where the image has no samples there are no rows, or the filler.
    """
    tiles = scan(spark, path, "tiles", region=f"{x0},{y0},{w},{h}", **options)
    inside = pixels(tiles).where((F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h))
    inside = inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
    if filler is None:
        return inside
    images = scan(spark, path, "ifds", **options).where("width is not null").select("path", "global_index", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)).alias("c"))
    cells = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    cells = cells.withColumns({"y": F.col("y").cast("bigint"), "x": F.col("x").cast("bigint")})
    return cells.join(inside, ["path", "global_index", "c", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(float(filler))))
