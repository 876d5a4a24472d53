import os
import struct

import numpy as np
import pytest

from tilewright.sources import tiff, tiff_sink
from tilewright.sources import tiff_format as fmt


def by_hand(order="<", big=False, next_offset=0):
    """A 4x3 grey image of one strip, written literally."""
    pixels = bytes(range(12))
    tags = [(256, 3, 4), (257, 3, 3), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 3, 3), (279, 3, 12)]
    mark = b"II" if order == "<" else b"MM"
    if big:
        head = mark + struct.pack(order + "HHHQ", 43, 8, 0, 16)
        at = 16 + 8 + 20 * len(tags) + 8
    else:
        head = mark + struct.pack(order + "HI", 42, 8)
        at = 8 + 2 + 12 * len(tags) + 4
    body = struct.pack(order + ("Q" if big else "H"), len(tags))
    for tag, kind, value in tags:
        value = at if tag == 273 else value
        raw = struct.pack(order + ("H" if kind == 3 else "I"), value)
        body += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, 1) + raw.ljust(8 if big else 4, b"\0")
    return head + body + struct.pack(order + ("Q" if big else "I"), next_offset) + pixels


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_literal_files(tmp_path, order, big):
    data = by_hand(order, big)
    h = fmt.header(data)
    (d,) = fmt.directories(data, h)
    g = fmt.geometry(d)
    assert (h.order, h.big, g.width, g.height, g.bits, g.tiled) == (order, big, 4, 3, [8], False)
    (p,) = fmt.places(d, g, len(data))
    assert data[p.offset : p.offset + p.size] == bytes(range(12))
    path = tmp_path / "a.tif"
    path.write_bytes(data)
    (row,) = tiff.rows("tiles", str(path), data)
    names = [c.split()[0] for c in tiff.TILES.split(", ")]
    t = dict(zip(names, row, strict=True))
    lines = list(tiff.decode_rows(t, data[p.offset : p.offset + p.size]))
    assert [list(s) for _, _, _, s in lines] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]


def test_bad_files():
    for data in (b"", b"II*\0", b"this is a text file, not an image", b"II" + struct.pack("<HI", 44, 8)):
        with pytest.raises(fmt.NotTiff):
            fmt.header(data)
    with pytest.raises(fmt.Damaged):
        fmt.header(b"II" + struct.pack("<HI", 42, 8))
    (row,) = tiff.rows("files", "x", b"no", permissive=True)
    assert row[2] is False and row[-1]
    assert list(tiff.rows("tiles", "x", b"no", permissive=True)) == []
    with pytest.raises(fmt.Damaged):
        fmt.directories(b"II" + struct.pack("<HI", 42, 4000) + bytes(10))


def test_loop(tmp_path):
    data = by_hand(next_offset=8)
    assert fmt.chain(data, fmt.header(data)) == ([8], 8)
    path = tmp_path / "loop.tif"
    path.write_bytes(data)
    assert tiff_sink.repair_loop(str(path)) and not tiff_sink.repair_loop(str(path))
    assert fmt.chain(path.read_bytes(), fmt.header(data)) == ([8], None)


def test_values_of_every_type():
    values = {
        1: [200, 3, 4, 5, 6], 2: "some text", 3: [1, 65535, 7], 4: 1 << 31, 5: [(1, 3), (4294967295, 2)], 6: [-1, 2], 7: b"\x01\x02\x03\x04\x05\x06\x07\x08\x09", 8: [-3, 4],
        9: -5, 10: (-1, 2), 11: 1.5, 12: [2.5, -1.0], 13: 8, 16: 1 << 40, 17: -(1 << 40), 18: 9,
    }
    for order in "<>":
        for big in (False, True):
            packed = fmt.pack_directory(order, big, 16, {1000 + k: (k, v) for k, v in values.items()})
            data = fmt.file_header(order, big, 16).ljust(16, b"\0") + packed
            d = fmt.directory(data, fmt.header(data), 16)
            assert {k - 1000: v for k, v in d.values.items()} == values and d.sorted


def test_first_duplicate_counts_and_text_pieces():
    entry = struct.Struct("<HHI4s")
    body = struct.pack("<H", 3) + entry.pack(300, 3, 1, b"\1\0\0\0") + entry.pack(300, 3, 1, b"\2\0\0\0") + entry.pack(200, 2, 4, b"a\0b\0") + bytes(4)
    data = b"II" + struct.pack("<HI", 42, 8) + body
    d = fmt.directory(data, fmt.header(data), 8)
    assert d.get(300) == 1 and not d.sorted and d.get(200) == ["a", "b"]
    assert fmt.ascii_pieces(b"abc") == ["abc"] and fmt.ascii_pieces(b"a\0\0") == ["a", ""]


def image(path, o, array):
    """Write an array (height, width, channels) with the file writer."""
    w = tiff_sink.FileWriter(str(path), o)
    height, width, channels = array.shape
    from tilewright.functions import kernels

    tw = o.tile_w or width
    for plane in range(channels if o.planar else 1):
        for y in range(0, height, o.tile_h):
            for x in range(0, width, tw):
                h = o.tile_h if o.tile_w else min(o.tile_h, height - y)
                block = np.zeros((h, tw, 1 if o.planar else channels), array.dtype)
                part = array[y : y + h, x : x + tw, plane : plane + 1] if o.planar else array[y : y + h, x : x + tw]
                block[: part.shape[0], : part.shape[1]] = part
                k = (plane * -(-height // o.tile_h) + y // o.tile_h) * -(-width // tw) + x // tw
                w.tile(0, k, width, height, channels, kernels.encode_tile(block, compression=o.compression, predictor=o.predictor, bits=[array.dtype.itemsize * 8] * block.shape[2], order=o.order))
    return w.finish()


def load(path, index=0):
    data = open(path, "rb").read()
    d = [x for x in fmt.directories(data) if x.main_index == index][0]
    g = fmt.geometry(d)
    names = [c.split()[0] for c in tiff.TILES.split(", ")]
    out = np.zeros((g.height, g.width, g.channels))
    mine = [dict(zip(names, r, strict=True)) for r in tiff.rows("tiles", str(path), data)]
    for t in mine:
        if t["global_index"] == d.global_index:
            for c, y, x, s in tiff.decode_rows(t, data[t["offset"] : t["offset"] + t["byte_count"]]):
                out[y, x : x + len(s), c] = s
    return out


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("tile_w", [0, 16])
def test_copy_crop_compact(spark, tmp_path, compression, planar, tile_w):
    array = np.random.default_rng(3).integers(0, 255, (37, 41, 3), dtype=np.uint8)
    a, b = tmp_path / "a.tif", tmp_path / "b.tif"
    image(a, tiff_sink.Options(tile_w=tile_w, tile_h=16, planar=planar, compression=compression, big=tile_w > 0), array)
    assert (load(a) == array).all()
    assert tiff_sink.copy_images(str(a), str(b)) == 1
    assert (load(b) == array).all()
    tiff_sink.copy_images(str(a), str(b), crop=(5, 7, 20, 30), compression=50000)
    assert (load(b) == array[7:37, 5:25]).all()
    tiff_sink.copy_images(str(a), str(b), append=True)
    assert (load(b, 1) == array).all() and (load(b, 0) == array[7:37, 5:25]).all()
    tiff_sink.delete_ifd(str(b), 0)
    assert (load(b) == array).all()
    with pytest.raises(ValueError):
        tiff_sink.delete_ifd(str(b), 0)
    assert tiff_sink.compact(str(b)) > 0 and (load(b) == array).all()
    with pytest.raises(ValueError):
        tiff_sink.copy_images(str(a), str(a))


def test_updates(tmp_path):
    path = str(tmp_path / "a.tif")
    array = np.zeros((8, 8, 1), np.uint8)
    image(path, tiff_sink.Options(tags={270: (2, "old text")}), array)
    size = os.path.getsize(path)
    assert tiff_sink.update_description(path, 0, "old text") == "UNCHANGED"
    assert tiff_sink.update_description(path, 0, "new text") == "OVERWRITE_IN_PLACE" and os.path.getsize(path) == size
    assert tiff_sink.update_description(path, 0, "a longer text") == "CHANGED"
    (d,) = fmt.directories(open(path, "rb").read())
    assert d.get(270) == "a longer text" and (load(path) == array).all()


def test_missing_tiles_share_a_filler_and_sparse_tiles_none(tmp_path):
    from tilewright.functions import kernels

    for sparse in (False, True):
        path = tmp_path / f"{sparse}.tif"
        o = tiff_sink.Options(tile_w=16, tile_h=16, sparse=sparse, filler=9)
        w = tiff_sink.FileWriter(str(path), o)
        w.tile(0, 0, 40, 40, 1, kernels.encode_tile(np.ones((16, 16, 1), np.uint8), compression=1, predictor=1, bits=[8], order="<"))
        w.finish()
        data = path.read_bytes()
        (d,) = fmt.directories(data)
        places = fmt.places(d, fmt.geometry(d), len(data), sparse)
        assert len(places) == 9 and len({p.offset for p in places}) == 2
        if sparse:
            assert places[5].size == 0
            with pytest.raises(fmt.Damaged):
                fmt.places(d, fmt.geometry(d), len(data))
        else:
            assert (load(path)[16:] == 9).all()


def test_source_and_sink(spark, tmp_path):
    rows = [(str(tmp_path / f"f{i % 2}.tif"), i % 3, c, y, x, float(i + c + y * x)) for i in range(6) for c in range(2) for y in range(5) for x in range(7)]
    px = spark.createDataFrame(rows, "path string, image int, c int, y long, x long, v double").dropDuplicates(["path", "image", "c", "y", "x"])
    written = {tuple(r) for r in px.collect()}
    report = tiff_sink.write(spark.createDataFrame(list(written), px.schema), tiff_sink.Options(tile_w=16, compression=8, predictor=2)).collect()
    assert {r.images for r in report} == {3}
    files = tiff.scan(spark, str(tmp_path)).collect()
    assert {(f.images, f.is_valid) for f in files} == {(3, True)}
    ifds = tiff.scan(spark, str(tmp_path), "ifds")
    assert {(r.width, r.height, r.channels) for r in ifds.collect()} == {(7, 5, 2)}
    got = {(r.path, r.global_index, r.c, r.y, r.x, r.v) for r in tiff.pixels(tiff.scan(spark, str(tmp_path), "tiles")).collect()}
    assert got == written
    binary = tiff.from_binary(spark.read.format("binaryFile").load(str(tmp_path)), "entries")
    direct = tiff.scan(spark, str(tmp_path), "entries")
    assert binary.count() == direct.count() > 0
    (w,) = {r.value.i[0] for r in binary.where("tag = 256").collect()}
    assert w == 7


def test_ycbcr_tiles():
    from tilewright.functions import kernels

    grey = bytes([10, 20, 30, 40, 128, 128, 50, 60, 70, 80, 128, 128])
    out = kernels.ycbcr_tile(grey, 4, 2, 2, 2)
    assert out[..., 0].tolist() == [[10, 20, 50, 60], [30, 40, 70, 80]] and (out[..., 0] == out[..., 2]).all()
    assert kernels.ycbcr_size(5, 3, 2, 2) == 3 * 2 * 6
    red = kernels.ycbcr_tile(bytes([76, 85, 255]), 1, 1, 1, 1)[0, 0]
    assert abs(int(red[0]) - 254) <= 2 and red[1] <= 2 and red[2] <= 2


def test_log_luminance_tile():
    data = bytes([128 + 0, 64, 128 + 0, 0])  # two pixels of code 0x4000: one
    names = [c.split()[0] for c in tiff.TILES.split(", ")]
    t = dict.fromkeys(names, 0) | dict(compression=34676, photometric=32844, w=2, h=1, width=2, height=1, tile_w=2, tile_h=1, planar=False, bits=[16], byte_order="II")
    ((_, _, _, s),) = list(tiff.decode_rows(t, data))
    assert np.allclose(s, 1.0, rtol=0.005)


def test_many_small_files_share_a_batch():
    import pyarrow as pa

    data = fmt.file_header("<", False, 8) + fmt.pack_directory("<", False, 8, {256: (4, 7), 257: (4, 5), 270: (2, "said")})
    arrow = pa.schema([("path", pa.string()), ("length", pa.int64()), ("is_tiff", pa.bool_()), ("is_valid", pa.bool_()), ("is_big", pa.bool_()), ("byte_order", pa.string()), ("first_ifd_offset", pa.int64()), ("images", pa.int32()), ("loop_offset", pa.int64()), ("error", pa.string())])
    given = [pa.RecordBatch.from_arrays([pa.array([f"{i}-{j}" for j in range(300)]), pa.array([data] * 300)], ["path", "content"]) for i in range(10)]
    out = list(tiff.file_batches(given, "files", arrow))
    assert [r for b in out for r in b.column(0).to_pylist()] == [f"{i}-{j}" for i in range(10) for j in range(300)]
    assert len(out) == 3 and {tuple(r.values())[1:4] for b in out for r in b.to_pylist()} == {(len(data), True, True)}
    assert list(tiff.file_batches([], "files", arrow)) == []


def test_parts_are_made_into_files_by_many_tasks(spark):
    from tilewright import catalog

    files = catalog._part_files(spark, "/root/testdata/sf0.001")
    assert files.rdd.getNumPartitions() >= 64


def test_tiles_of_one_file_are_several_tasks(spark, tmp_path):
    px = spark.range(256 * 512).selectExpr(f"'{tmp_path}/a.tif' as path", "0 as image", "0 as c", "id div 512 as y", "id % 512 as x", "cast(id * 7 % 251 as double) as v")
    tiff_sink.write(px, tiff_sink.Options(tile_w=16, tile_h=16)).collect()
    tiles = tiff.scan(spark, str(tmp_path / "a.tif"), "tiles")
    assert tiles.rdd.getNumPartitions() == 2  # at least 64 KB each
    assert sorted(r.k for r in tiles.select("k").collect()) == list(range(16 * 32))
    assert tiff.scan(spark, str(tmp_path / "a.tif"), "tiles", tasks=1).rdd.getNumPartitions() == 1
    assert tiff.pixels(tiles).where("v <> (y * 512 + x) * 7 % 251").count() == 0
