"""Files that many tasks write, and tiles changed inside files."""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest

from tests.test_tiff import image, load
from tilewright.sources import positioned, tiff, tiff_sink, tiff_update
from tilewright.sources import tiff_format as fmt


def raster(spark, path, array, images=1):
    """Samples of an array (height, width, channels), image i being array + i."""
    rows = [(str(path), i, c, y, x, int(array[y, x, c]) + i) for i in range(images) for y in range(array.shape[0]) for x in range(array.shape[1]) for c in range(array.shape[2])]
    return spark.createDataFrame(rows, "path string, image int, c int, y long, x long, v long")


def piece_batches(df, n):
    """The rows of pieces in `n` parts, as the writer's tasks get them."""
    rows = [r for r in df.select(*positioned.COLUMNS).collect()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    return [[pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[i::n], strict=True), kinds, strict=True)], positioned.COLUMNS)] for i in range(n) if rows[i::n]]


def test_one_file_by_many_tasks(spark, tmp_path):
    """64 tiles of 4 images; tasks in any order, some of them twice, one killed halfway."""
    array = np.random.default_rng(0).integers(0, 200, (64, 64, 1))
    path = tmp_path / "a.tif"
    pieces, report = tiff_sink.layout(raster(spark, path, array, 4).repartition(7), tiff_sink.Options(tile_w=8, tile_h=8, compression=8))
    assert pieces.rdd.getNumPartitions() > 1
    tasks = piece_batches(pieces, 8)
    assert len(tasks) == 8
    w = positioned.PositionedWriter("/", True)
    w.write(iter([tasks[3][0].slice(0, 5)]))  # died after five pieces
    messages = [w.write(iter(t)) for t in reversed(tasks)]
    w.write(iter(tasks[2]))  # a copy of a task that ended later
    assert not path.exists()
    w.commit(messages)
    for i in range(4):
        assert (load(path, i) == array + i).all()
    assert [tuple(r) for r in report.collect()] == [(str(path), 4, os.path.getsize(path))]
    data = path.read_bytes()
    places = [p for d in fmt.directories(data) for p in fmt.places(d, fmt.geometry(d), len(data))]
    assert [p.offset for p in places] == sorted(p.offset for p in places) and len(places) == 256
    assert os.listdir(tmp_path) == ["a.tif"]


def test_appending(spark, tmp_path):
    array = np.random.default_rng(1).integers(0, 200, (20, 30, 1))
    path, o = tmp_path / "a.tif", dict(tile_w=16, tile_h=16, compression=5)
    for k in range(3):  # the first run creates the file
        report = tiff_sink.write(raster(spark, path, array + k), tiff_sink.Options(**o, append=True))
        assert report.first().bytes == os.path.getsize(path)
    for k in range(3):
        assert (load(path, k) == array + k).all()
    before = path.read_bytes()
    pieces, _ = tiff_sink.layout(raster(spark, path, array, 2), tiff_sink.Options(**o, append=True))
    w = positioned.PositionedWriter("/", True)
    messages = [w.write(iter(t)) for t in piece_batches(pieces, 3)]
    assert len(fmt.directories(path.read_bytes())) == 3  # not linked yet
    w.abort(messages[:1] + [None])
    assert path.read_bytes() == before
    with pytest.raises(Exception, match="byte order"):
        tiff_sink.write(raster(spark, path, array), tiff_sink.Options(**o, little=False, append=True))


def test_replacing_and_refusing(spark, tmp_path):
    array = np.full((4, 4, 1), 7)
    path = tmp_path / "deep" / "a.tif"
    o = tiff_sink.Options()
    pieces, _ = tiff_sink.layout(raster(spark, "deep/a.tif", array), o)
    tiff.register(spark)
    pieces.write.format("tiff").mode("append").save(str(tmp_path))
    assert (load(path) == 7).all()
    with pytest.raises(Exception, match="FileExistsError"):
        pieces.write.format("tiff").mode("append").save(str(tmp_path))
    tiff_sink.layout(raster(spark, "deep/a.tif", array + 1), o)[0].write.format("tiff").mode("overwrite").save(str(tmp_path))
    assert (load(path) == 8).all() and os.listdir(path.parent) == ["a.tif"]
    with pytest.raises(Exception, match="writes pieces"):
        spark.range(3).write.format("tiff").mode("append").save(str(tmp_path))
    w = positioned.PositionedWriter(str(tmp_path), True)
    messages = [w.write(iter(t)) for t in piece_batches(pieces, 1)]
    w.abort(messages)
    assert os.listdir(path.parent) == ["a.tif"] and (load(path) == 8).all()


@pytest.mark.parametrize("o", [dict(tile_w=16, tile_h=16, compression=8), dict(tile_h=5, compression=32773, big=True), dict(tile_w=16, tile_h=16, planar=True, compression=5, little=False), dict(tile_h=7, compression=1)])
def test_update(spark, tmp_path, o):
    rng = np.random.default_rng(4)
    array = rng.integers(0, 3, (40, 50, 3)).astype(np.uint8)
    path = str(tmp_path / "a.tif")
    image(path, tiff_sink.Options(**o), array)
    before = open(path, "rb").read()
    (d,) = fmt.directories(before)
    old = {p.k: p for p in fmt.places(d, fmt.geometry(d), len(before))}
    changed = array.copy()
    changed[10:30, 5:33] = rng.integers(0, 255, (20, 28, 3))
    rows = [(c, y, x, int(changed[y, x, c])) for c in range(3) for y in range(10, 30) for x in range(5, 33)]
    report = {r.k: r for r in tiff_update.update(path, 0, spark.createDataFrame(rows, "c int, y long, x long, v int")).collect()}
    assert (load(path) == changed).all()
    after = open(path, "rb").read()
    (d,) = fmt.directories(after)
    new = {p.k: p for p in fmt.places(d, fmt.geometry(d), len(after))}
    for k, p in old.items():
        if k not in report:
            assert new[k] == p and after[p.offset : p.offset + p.size] == before[p.offset : p.offset + p.size]
        else:
            assert (new[k].offset, new[k].size) == (report[k].place, report[k].size)
    want, length = tiff_update.allocate([(k, old[k].offset, old[k].size, False, r.size) for k, r in report.items()], len(before))
    assert sorted((r.k, r.action, r.place, r.size) for r in report.values()) == want and length == len(after)


def test_update_of_shared_and_missing_tiles(spark, tmp_path):
    """Shared tiles get a place of their own; the others that shared it keep theirs."""
    for sparse in (False, True):
        path = str(tmp_path / f"{sparse}.tif")
        o = tiff_sink.Options(tile_w=16, tile_h=16, filler=9, sparse=sparse)
        w = tiff_sink.FileWriter(path, o)
        w.tile(0, 0, 40, 40, 1, bytes([1]) * 256)
        w.finish()
        px = spark.createDataFrame([(0, 39, 39, 5), (0, 0, 20, 6), (0, 0, 20, 4)], "c int, y long, x long, v int")
        assert {(r.k, r.action) for r in tiff_update.update(path, 0, px).collect()} == {(8, "appended"), (1, "appended")}
        got = tiff.pixels(tiff.scan(spark, path, "tiles", sparse="true"), filler=9).collect()
        want = {(r.y, r.x): r.v for r in got}
        assert want[39, 39] == 5 and want[0, 20] == 6 and want[0, 21] == (0 if sparse else 9) and want[20, 20] == 9 and want[3, 3] == 1
        assert len(want) == 1600


def test_update_of_odd_requests(spark, tmp_path):
    path = str(tmp_path / "a.tif")
    image(path, tiff_sink.Options(tile_w=16, tile_h=16), np.zeros((20, 20, 1), np.uint8))
    digest = hashlib.sha256(open(path, "rb").read()).hexdigest()
    px = spark.createDataFrame([(0, 19, 20, 1)], "c int, y long, x long, v int")
    with pytest.raises(Exception, match="outside the image"):
        tiff_update.update(path, 0, px)
    assert tiff_update.update(path, 0, px, outside="crop").count() == 0
    assert hashlib.sha256(open(path, "rb").read()).hexdigest() == digest
    # an index of 16-bit sizes has no room: the directory moves to the end
    tiff_sink.update_ifd(path, 0, {325: (3, [256] * 4), 324: (3, [p.offset for p in fmt.places(*_geometry(path), sparse=False)])})
    size = os.path.getsize(path)
    with open(path, "r+b") as f:
        f.truncate(70_000)
    assert {r.action for r in tiff_update.update(path, 0, spark.createDataFrame([(0, 1, 1, 7)], px.schema), always_at_end=True).collect()} == {"appended"}
    assert load(path)[1, 1, 0] == 7 and load(path).sum() == 7 and os.path.getsize(path) > 70_256 > size


def _geometry(path):
    data = open(path, "rb").read()
    (d,) = fmt.directories(data)
    return d, fmt.geometry(d), len(data)


def test_allocation():
    # fits; too long; shared; missing; and the last body of the file, which shrinks it
    rows = [(0, 8, 10, False, 10), (1, 18, 10, False, 11), (2, 28, 10, True, 4), (3, 0, 0, False, 5), (4, 60, 40, False, 3)]
    assert tiff_update.allocate(rows, 200) == ([(0, "in place", 8, 10), (1, "appended", 200, 11), (2, "appended", 211, 4), (3, "appended", 215, 5), (4, "in place", 60, 3)], 220)
    assert tiff_update.allocate([(4, 60, 40, False, 3), (5, 8, 10, False, 20)], 100) == ([(4, "at the end", 60, 3), (5, "appended", 63, 20)], 83)
    assert tiff_update.allocate([(4, 60, 40, False, 90)], 100) == ([(4, "at the end", 60, 90)], 150)
    assert tiff_update.allocate([(4, 60, 40, False, 3)], 100, always_at_end=True) == ([(4, "appended", 100, 3)], 103)


@pytest.mark.parametrize("planar", [False, True])
def test_repeating_tile_and_blank_image(spark, tmp_path, planar):
    tile = np.arange(16 * 16 * 3).reshape(16, 16, 3) % 251
    path = tmp_path / "r.tif"
    tiff_sink.repeat_tile(spark, str(path), tile, 40, 50, tiff_sink.Options(compression=5, planar=planar))
    assert (load(path) == np.tile(tile, (4, 3, 1))[:50, :40]).all()
    data = path.read_bytes()
    (d,) = fmt.directories(data)
    assert len({p.offset for p in fmt.places(d, fmt.geometry(d), len(data))}) == (3 if planar else 1)
    tiff_sink.blank(spark, str(tmp_path / "b.tif"), 100, 75, 3, tiff_sink.Options(filler=7, planar=planar, compression=8))
    assert (load(tmp_path / "b.tif") == 7).all() and load(tmp_path / "b.tif").shape == (75, 100, 3)
    tiff_sink.blank(spark, str(tmp_path / "b.tif"), 10, 10, 1, tiff_sink.Options(filler=9, append=True))
    assert (load(tmp_path / "b.tif", 1) == 9).all()


def test_suppliers(spark, tmp_path):
    from tilewright.sources import supplier

    path = str(tmp_path / "a.tif")
    w = tiff_sink.FileWriter(path, tiff_sink.Options(tile_w=16, tile_h=16, sparse=True))
    w.tile(0, 0, 20, 20, 1, bytes([1]) * 256)
    w.tile(0, 3, 20, 20, 1, bytes([2]) * 256)
    w.finish()
    tiles = tiff.scan(spark, path, "tiles", sparse="true")
    some = lambda t: np.full((16, 16, 1), 50 + t["k"]) if t["k"] != 2 and t["k"] != 3 else None
    for mode, want in (("absent", {0: 1, 1: 51, 2: 9, 3: 2}), ("always", {0: 50, 1: 51, 2: 9, 3: 2})):
        got = {}
        for r in supplier.supplied(tiles, some, mode, filler=9).collect():
            for i, v in enumerate(r.samples):
                got[r.y, r.x0 + i] = v
        assert len(got) == 400 and all(v == want[y // 16 * 2 + x // 16] for (y, x), v in got.items())
    with pytest.raises(ValueError):
        supplier.supplied(tiles, some, "sometimes")


def test_customised_copies_and_updates(spark, tmp_path):
    a, b = str(tmp_path / "a.tif"), str(tmp_path / "b.tif")
    array = np.random.default_rng(6).integers(0, 255, (20, 30, 1)).astype(np.uint8)
    image(a, tiff_sink.Options(tags={270: (2, "old"), 305: (2, "soft")}), array)

    def other(i, tags):
        return {t: v for t, v in tags.items() if t != 305} | {270: (2, f"copy {i}"), 256: (4, 5)}

    for options in ({}, {"crop": (2, 3, 10, 10)}):
        tiff_sink.copy_images(a, b, [0, 0], customise=other, **options)
        found = fmt.directories(open(b, "rb").read())
        assert [(d.get(270), d.get(305), d.get(256)) for d in found] == [(f"copy {i}", None, 10 if options else 30) for i in range(2)]
        assert (load(b, 1) == (array[3:13, 2:12] if options else array)).all()
    assert tiff_sink.update_ifd(b, 1, lambda tags: {270: (2, tags[270][1] + "!"), 266: None}) == "CHANGED"
    assert fmt.directories(open(b, "rb").read())[1].get(270) == "copy 1!"
    assert tiff_sink.update_ifd(b, 0, lambda tags: {}) == "UNCHANGED"
