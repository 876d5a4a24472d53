"""The TIFF and BigTIFF container: bytes to directories and back.

Pure functions over a `bytes`-like object; nothing here knows of Spark.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..functions.tags import TAGS, TYPES

CODES = {code: (name, size) for name, (code, size) in TYPES.items()}
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "q", 17: "q", 18: "q"}
MAX_ENTRIES = 1_000_000
#: Longer lists of numbers stay in the file's bytes until they are asked for.
LONG = 64
LINKED = {"sub": 330, "exif": 34665, "gps": 34853, "interop": 40965}


class NotTiff(ValueError):
    """The bytes are not a TIFF file."""


class Damaged(ValueError):
    """The file contradicts the format."""


class Numbers(Sequence):
    """Many numbers of one entry: a view of the file's bytes, of which only what is read is loaded."""

    def __init__(self, array: np.ndarray):
        self.array = array

    def __len__(self) -> int:
        return len(self.array)

    def __getitem__(self, i):
        return self.array[i].tolist()

    def __iter__(self):
        return iter(self.array.tolist())

    def __eq__(self, other) -> bool:
        if isinstance(other, Numbers):
            return bool(np.array_equal(self.array, other.array))
        return isinstance(other, (list, tuple)) and len(other) == len(self) and list(self) == list(other)

    def __hash__(self):
        return id(self)

    def __array__(self, dtype=None, copy=None):
        return self.array.astype(dtype or self.array.dtype)


@dataclass
class Entry:
    tag: int
    type: int
    count: int
    value_offset: int
    embedded: bool
    value: Any


@dataclass
class Directory:
    offset: int
    entries: list[Entry]
    next_offset: int
    global_index: int = 0
    main_index: int | None = None
    kind: str = "main"
    sorted: bool = True
    values: dict[int, Any] = field(default_factory=dict)

    def get(self, tag: int | str, default=None):
        v = self.values.get(TAGS[tag] if isinstance(tag, str) else tag, default)
        return v

    def numbers(self, tag: int | str, default=()) -> list:
        v = self.get(tag)
        return list(default) if v is None else v if isinstance(v, Numbers) else list(v) if isinstance(v, (list, tuple)) else [v]


@dataclass
class Header:
    order: str
    big: bool
    first: int


def header(data) -> Header:
    """Byte order, variant and first directory offset."""
    if len(data) < 8:
        raise NotTiff("shorter than a TIFF header")
    mark = bytes(data[:2])
    if mark not in (b"II", b"MM"):
        raise NotTiff("no byte-order mark")
    order = "<" if mark == b"II" else ">"
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic == 42:
        first = struct.unpack_from(order + "I", data, 4)[0]
    elif magic == 43:
        if len(data) < 16:
            raise Damaged("too short for a BigTIFF header")
        size, zero, first = struct.unpack_from(order + "HHq", data, 4)
        if size != 8 or zero:
            raise NotTiff("unknown offset size")
    else:
        raise NotTiff("no TIFF magic number")
    if len(data) <= (16 if magic == 43 else 8):
        raise Damaged("nothing follows the header")
    return Header(order, magic == 43, first)


def ascii_pieces(raw: bytes) -> list[str]:
    parts = raw.decode("utf-8", "replace").split("\0")
    return parts[:-1] if parts[-1] == "" and len(parts) > 1 else parts


def value_of(data, h: Header, kind: int, count: int, at: int):
    """A value: a scalar if the count is one, else a list; text as a string or a list of strings."""
    if kind == 2:
        pieces = ascii_pieces(bytes(data[at : at + count]))
        return pieces[0] if len(pieces) == 1 else pieces
    if kind == 7:
        return bytes(data[at : at + count])
    if kind in (5, 10):
        flat = struct.unpack_from(f"{h.order}{2 * count}{'I' if kind == 5 else 'i'}", data, at)
        out = list(zip(flat[::2], flat[1::2], strict=True))
    elif count > LONG:
        return Numbers(np.frombuffer(data, np.dtype(h.order + FORMATS[kind]), count, at))
    else:
        out = list(struct.unpack_from(f"{h.order}{count}{FORMATS[kind]}", data, at))
    return out[0] if count == 1 else out


def directory(data, h: Header, at: int, with_next: bool = True) -> Directory:
    """The directory at an offset. Of duplicate tags the first counts; order is reported."""
    n_size, e_size, inline = (8, 20, 8) if h.big else (2, 12, 4)
    if at < 8 or at + n_size > len(data):
        raise Damaged(f"directory offset {at} outside the file")
    n = struct.unpack_from(h.order + ("Q" if h.big else "H"), data, at)[0]
    if n > MAX_ENTRIES or at + n_size + n * e_size > len(data):
        raise Damaged(f"{n} entries at {at} do not fit the file")
    entries, values, last, in_order = [], {}, -1, True
    for i in range(n):
        p = at + n_size + i * e_size
        tag, kind, count = struct.unpack_from(h.order + ("HHq" if h.big else "HHI"), data, p)
        place = p + (12 if h.big else 8)
        size = CODES.get(kind, ("", 1))[1]
        bytes_needed = count * size
        embedded = bytes_needed <= inline
        offset = place if embedded else struct.unpack_from(h.order + ("q" if h.big else "I"), data, place)[0]
        if kind in CODES:
            if count < 0 or offset < 0 or offset + bytes_needed > len(data):
                raise Damaged(f"value of tag {tag} outside the file")
            value = value_of(data, h, kind, count, offset)
        else:
            value = (kind, count, struct.unpack_from(h.order + ("q" if h.big else "I"), data, place)[0])
        in_order &= tag > last
        last = tag
        entries.append(Entry(tag, kind, count, offset, embedded, value))
        values.setdefault(tag, value)
    follow = 0
    end = at + n_size + n * e_size
    if with_next:
        if end + (8 if h.big else 4) > len(data):
            raise Damaged("the offset of the next directory is outside the file")
        follow = struct.unpack_from(h.order + ("q" if h.big else "I"), data, end)[0]
    return Directory(at, entries, follow, sorted=in_order, values=values)


def chain(data, h: Header) -> tuple[list[int], int | None]:
    """Offsets of the main directories, and the offset a loop leads back to (None: no loop)."""
    out, seen, at = [], set(), h.first
    n_size, e_size = (8, 20) if h.big else (2, 12)
    while at:
        if at in seen:
            return out, at
        if at < 8 or at + n_size > len(data):
            raise Damaged(f"directory offset {at} outside the file")
        seen.add(at)
        out.append(at)
        n = struct.unpack_from(h.order + ("Q" if h.big else "H"), data, at)[0]
        end = at + n_size + n * e_size
        if n > MAX_ENTRIES or end + (8 if h.big else 4) > len(data):
            raise Damaged(f"{n} entries at {at} do not fit the file")
        at = struct.unpack_from(h.order + ("q" if h.big else "I"), data, end)[0]
    return out, None


def directories(data, h: Header | None = None, linked: tuple[str, ...] = ("sub",)) -> list[Directory]:
    """All directories: each main one, then those it links to."""
    h = h or header(data)
    out: list[Directory] = []
    for i, at in enumerate(chain(data, h)[0]):
        main = directory(data, h, at)
        main.main_index = i
        out.append(main)
        for kind in linked:
            for offset in main.numbers(LINKED[kind]):
                child = directory(data, h, offset, with_next=False)
                child.kind = kind
                out.append(child)
    for i, d in enumerate(out):
        d.global_index = i
    return out


@dataclass
class Geometry:
    """What a directory says of its image."""

    width: int
    height: int
    channels: int
    bits: list[int]
    kind: int
    tile_w: int
    tile_h: int
    tiled: bool
    planar: bool
    compression: int
    predictor: int
    photometric: int
    fill_order: int
    subsampling: tuple[int, int] = (1, 1)
    options: int = 0

    @property
    def planes(self) -> int:
        return self.channels if self.planar else 1

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.width // self.tile_w), -(-self.height // self.tile_h)

    def plane_bits(self) -> list[int]:
        return self.bits[:1] if self.planar else self.bits


def fits_outside(big: bool, size: int) -> bool:
    """Whether a value of this size is stored outside its entry."""
    return size > (8 if big else 4)


def count_at(big: bool, offset: int, entry: int) -> int:
    """Where the count of an entry stands."""
    return offset + 8 + 20 * entry + 4 if big else offset + 2 + 12 * entry + 4


def ratios(values: list) -> list[float] | None:
    """Rationals as numbers; None: there are none."""
    out = [(v[0] / v[1] if v[1] else 0.0) if isinstance(v, tuple) else float(v) for v in values if isinstance(v, (tuple, int, float))]
    return out or None


def whole_levels(values: list) -> list[float] | None:
    """The six black and white levels, as whole numbers; those that are not given keep their usual values."""
    given = [float(int(v)) for v in ratios(values) or ()][:6]
    return given + [0.0, 255.0, 128.0, 255.0, 128.0, 255.0][len(given) :] if given else None


def method_options(d: Directory) -> int:
    """What tags 292 and 293 state for the facsimile methods."""
    v = d.get({3: 292, 4: 293}.get(d.get("Compression", 1), 0), 0)
    return v if isinstance(v, int) else 0


def old_jpeg_head(data, d: Directory, g: Geometry, height: int) -> bytes:
    """The stream that old-style JPEG strips of this height continue: tables and headers from tags 513 to 521."""

    def at(offset: int, size: int) -> bytes:
        if not 0 < offset <= len(data) - size:
            raise Damaged("a JPEG table lies outside the file")
        return bytes(data[offset : offset + size])

    def segment(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    start = d.get("JPEGInterchangeFormat", 0)
    if start:
        raw = at(start, min(d.get("JPEGInterchangeFormatLength", 0) or len(data) - start, len(data) - start))
        scan = raw.find(b"\xff\xda")
        if raw[:2] != b"\xff\xd8":
            raise Damaged("no JPEG stream where tag 513 points")
        return raw if scan < 0 else raw[: scan + 2 + int.from_bytes(raw[scan + 2 : scan + 4], "big")]
    n = g.channels
    quant, dc, ac = (d.numbers(t) for t in ("JPEGQTables", "JPEGDCTables", "JPEGACTables"))
    if min(len(quant), len(dc), len(ac)) < n:
        raise Damaged("JPEG tables are missing")
    out = b"\xff\xd8"
    for i in range(n):
        out += segment(0xDB, bytes([i]) + at(quant[i], 64))
        for kind, place in ((0, dc[i]), (1, ac[i])):
            counts = at(place, 16)
            out += segment(0xC4, bytes([kind << 4 | i]) + counts + at(place + 16, sum(counts)))
    if d.get("JPEGRestartInterval"):
        out += segment(0xDD, int(d.get("JPEGRestartInterval")).to_bytes(2, "big"))
    first = g.subsampling[0] << 4 | g.subsampling[1] if n == 3 and g.photometric == 6 else 0x11
    parts = b"".join(bytes([i + 1, first if i == 0 else 0x11, i]) for i in range(n))
    out += segment(0xC0, b"\x08" + height.to_bytes(2, "big") + g.tile_w.to_bytes(2, "big") + bytes([n]) + parts)
    return out + segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, i * 0x11]) for i in range(n)) + b"\x00\x3f\x00")


def geometry(d: Directory) -> Geometry:
    """What a directory says; an image with a side of 0 has no tiles, and must list none."""
    width, height = d.get("ImageWidth"), d.get("ImageLength")
    if not isinstance(width, int) or not isinstance(height, int) or width < 0 or height < 0:
        raise Damaged("no image dimensions")
    channels = int(d.get("SamplesPerPixel", 1))
    if not 1 <= channels <= 128:
        raise Damaged(f"{channels} channels")
    bits = d.numbers("BitsPerSample", [1])
    bits = (bits + bits[:1] * channels)[:channels]
    formats = d.numbers("SampleFormat", [1])
    if len(set(formats)) > 1:
        raise Damaged("channels of different sample formats")
    tiled = d.get("TileWidth") is not None and d.get("TileLength") is not None
    rows = d.numbers("RowsPerStrip", [height])
    if len(set(rows)) > 1:
        raise Damaged("strips of different heights")
    tile_w, tile_h = (d.get("TileWidth"), d.get("TileLength")) if tiled else (width, min(rows[0] or height, height) if rows[0] > 0 else height)
    if not width or not height:
        if d.numbers("TileOffsets") or d.numbers("StripOffsets"):
            raise Damaged("no image dimensions")
        tile_w, tile_h = max(tile_w, 1), max(tile_h, 1)
    if tile_w <= 0 or tile_h <= 0:
        raise Damaged("empty tiles")
    photometric = d.get("PhotometricInterpretation", 1 if channels < 3 else 2)
    sub = tuple(d.numbers("YCbCrSubSampling", [2, 2])) if photometric == 6 else (1, 1)
    if len(sub) != 2 or not all(v in (1, 2, 4) for v in sub):
        raise Damaged(f"subsampling {sub}")
    return Geometry(width, height, channels, bits, formats[0], tile_w, tile_h, tiled, d.get("PlanarConfiguration", 1) == 2 and channels > 1, d.get("Compression", 1), d.get("Predictor", 1), photometric, d.get("FillOrder", 1), sub, method_options(d))


@dataclass
class Place:
    """A stored tile: linear number, plane, coordinates, range in the file, size in samples."""

    k: int
    plane: int
    ty: int
    tx: int
    offset: int
    size: int
    w: int
    h: int


#: The columns of a tile index, as arrays: number, plane, coordinates, range in the file, height.
PLACE_COLUMNS = ("k", "plane", "ty", "tx", "offset", "size", "h")


def place_arrays(d: Directory, g: Geometry, length: int, sparse: bool = False, wanted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The tile index of an image, or of its tiles `wanted`; strips are cropped to the image, tiles are not.

    Of long indexes only the entries of wanted tiles are read.
    """
    tiles = d.get("TileOffsets") is not None
    offsets = d.numbers("TileOffsets" if tiles else "StripOffsets")
    sizes = d.numbers("TileByteCounts" if d.get("TileByteCounts") is not None else "StripByteCounts")
    gw, gh = g.grid
    n = gw * gh * g.planes
    alone = len(sizes) == 1 and len(offsets) > 1
    if len(offsets) < n or (len(sizes) < n and not alone):
        raise Damaged(f"{min(len(offsets), len(sizes))} of {n} tiles are listed")
    k = np.arange(n) if wanted is None else wanted

    def chosen(values) -> np.ndarray:
        return (values.array[k] if isinstance(values, Numbers) else np.array(values)[k]).astype(np.int64)

    offset = chosen(offsets)
    size = np.full(len(k), sizes[0], np.int64) if alone else chosen(sizes)
    plane, rest = np.divmod(k, gw * gh)
    ty, tx = np.divmod(rest, gw)
    h = np.full(len(k), g.tile_h) if g.tiled else np.minimum(g.tile_h, g.height - ty * g.tile_h)
    if n == 1 and len(k) and size[0] == 0 and offset[0] and not d.next_offset:
        rest_of_file = length - int(offset[0])  # a lone strip without a size takes the rest of the file
        whole = g.tile_w * int(h[0]) * -(-sum(g.plane_bits()) // 8)
        size[0] = rest_of_file if rest_of_file <= 2 * whole + 1000 else 0
    empty = (size <= 0) | (offset <= 0)
    if empty.any() and not (sparse and g.tiled):
        raise Damaged(f"tile {int(k[empty][0])} has no data")
    offset, size = np.where(empty, 0, offset), np.where(empty, 0, size)
    beyond = offset > length - size
    if beyond.any():
        raise Damaged(f"tile {int(k[beyond][0])} ends beyond the file")
    return dict(zip(PLACE_COLUMNS, (k, plane, ty, tx, offset, size, h), strict=True))


def places(d: Directory, g: Geometry, length: int, sparse: bool = False) -> list[Place]:
    """The tile index of an image, a row a tile."""
    p = place_arrays(d, g, length, sparse)
    return [Place(k, plane, ty, tx, offset, size, g.tile_w, h) for k, plane, ty, tx, offset, size, h in zip(*(p[c].tolist() for c in PLACE_COLUMNS), strict=True)]


def pack_value(order: str, big: bool, kind: int, value) -> tuple[int, bytes]:
    """Count and bytes of a value to be written as type `kind`."""
    if kind == 2:
        texts = [value] if isinstance(value, str) else list(value)
        raw = b"".join(t.encode("utf-8") + b"\0" for t in texts)
        return len(raw), raw
    if kind == 7:
        return len(value), bytes(value)
    if isinstance(value, Numbers):
        value = list(value)
    items = list(value) if isinstance(value, (list, tuple)) and not (kind in (5, 10) and isinstance(value, tuple)) else [value]
    if kind in (5, 10):
        flat = [x for pair in items for x in pair]
        return len(items), struct.pack(f"{order}{len(flat)}{'I' if kind == 5 else 'i'}", *flat)
    return len(items), struct.pack(f"{order}{len(items)}{FORMATS[kind]}", *items)


def pack_directory(order: str, big: bool, at: int, entries: dict[int, tuple[int, Any]], next_offset: int = 0) -> bytes:
    """A directory for offset `at` from tag -> (type, value): entries ascending, long values after the table."""
    inline = 8 if big else 4
    head = struct.pack(order + ("Q" if big else "H"), len(entries))
    table_end = at + len(head) + len(entries) * (20 if big else 12) + inline
    table, extra = bytearray(head), bytearray()
    for tag in sorted(entries):
        kind, value = entries[tag]
        count, raw = pack_value(order, big, kind, value)
        table += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, count)
        if len(raw) <= inline:
            table += raw.ljust(inline, b"\0")
        else:
            place = table_end + len(extra)
            table += struct.pack(order + ("Q" if big else "I"), place)
            extra += raw + b"\0" * (len(raw) % 2)
    table += struct.pack(order + ("Q" if big else "I"), next_offset)
    return bytes(table + extra)


def file_header(order: str, big: bool, first: int) -> bytes:
    mark = b"II" if order == "<" else b"MM"
    return mark + (struct.pack(order + "HHHQ", 43, 8, 0, first) if big else struct.pack(order + "HI", 42, first))


#: Position in the header of the offset of the first directory.
def first_offset_at(big: bool) -> int:
    return 8 if big else 4


def next_offset_at(data, h: Header, at: int) -> int:
    """Where in the file the directory at `at` names the next one."""
    n = struct.unpack_from(h.order + ("Q" if h.big else "H"), data, at)[0]
    return at + (8 + 20 * n if h.big else 2 + 12 * n)
