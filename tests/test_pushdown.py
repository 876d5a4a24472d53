"""Scans of tiles that read only what a filter or a rectangle asks for."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from tests.test_tiff import image
from tilewright.sources import tiff, tiff_sink
from tilewright.sources import tiff_format as fmt


def reader(path, **options):
    return tiff.TiffReader({"path": str(path), "table": "tiles", **options})


def numbers(r):
    return [(i, k) for p in r.partitions() for b in r.read(p) for i, k in zip(b.column("global_index").to_pylist(), b.column("k").to_pylist())]


def grid(tmp_path, planar=False, tiled=True):
    """A file of 5 x 4 tiles."""
    path = tmp_path / f"{planar}{tiled}.tif"
    image(path, tiff_sink.Options(tile_w=16 if tiled else 0, tile_h=16, planar=planar), np.arange(75 * 61 * 3).reshape(61, 75, 3).astype(np.uint8))
    return path


def test_bounds(tmp_path):
    path = grid(tmp_path, planar=True)
    cases = {
        (EqualTo(("tx",), 2), EqualTo(("ty",), 1)): [7, 27, 47],
        (GreaterThan(("tx",), 3), LessThan(("ty",), 2), EqualTo(("plane",), 1)): [24, 29],
        (GreaterThanOrEqual(("k",), 58), LessThanOrEqual(("tx",), 3)): [58],
        (EqualTo(("k",), 60),): [], (LessThan(("tx",), 0),): [], (EqualTo(("global_index",), 1),): [],
        (LessThan(("k",), 2), GreaterThan(("tx",), -5)): [0, 1],
    }
    for filters, want in cases.items():
        r = reader(path)
        assert list(r.pushFilters(list(filters))) == []
        assert [k for _, k in numbers(r)] == want, filters
    r = reader(path)
    left = [In(("k",), (3, 9)), IsNotNull(("tx",)), EqualTo(("width",), 75), In(("path",), (str(path), "other"))]
    assert list(r.pushFilters(left)) == left  # Spark checks these again
    assert [k for _, k in numbers(r)] == list(range(3, 10))
    r = reader(tmp_path)
    list(r.pushFilters([EqualTo(("path",), "elsewhere")]))
    assert r.partitions() == []


@pytest.mark.parametrize("tiled", [True, False])
def test_rectangles(tmp_path, tiled):
    path = grid(tmp_path, tiled=tiled)
    (d,) = fmt.directories(path.read_bytes())
    g = fmt.geometry(d)
    for x, y, w, h in [(0, 0, 1, 1), (15, 15, 2, 2), (-10, -10, 11, 11), (70, 60, 100, 100), (200, 0, 5, 5), (3, 3, 0, 5), (16, 16, 16, 16), (-50, 0, 20, 20)]:
        want = [p.k for p in fmt.places(d, g, 1 << 40) if w and h and p.tx * g.tile_w < x + w and (p.tx + 1) * g.tile_w > x and p.ty * g.tile_h < y + h and (p.ty + 1) * g.tile_h > y]
        assert [k for _, k in numbers(reader(path, region=f"{x},{y},{w},{h}"))] == want
    with pytest.raises(ValueError):
        reader(path, region="1,2,3")


def test_parts_of_a_file(tmp_path):
    path = grid(tmp_path)
    whole = numbers(reader(path))
    r = reader(path, splitBytes=str(path.stat().st_size // 4))
    assert len(r.partitions()) in (4, 5) and numbers(r) == whole == [(0, k) for k in range(20)]


def test_only_wanted_entries_are_read(tmp_path):
    """Of an index of a million tiles the entries of nine are looked at."""
    n = 1000 * 1000
    tags = {256: (4, 16_000), 257: (4, 16_000), 258: (3, 8), 259: (3, 1), 262: (3, 1), 277: (3, 1), 322: (4, 16), 323: (4, 16), 324: (4, [8] * n), 325: (4, [256] * n)}
    data = fmt.file_header("<", False, 512) + bytes(504) + fmt.pack_directory("<", False, 512, tags)
    d = fmt.directory(data, fmt.header(data), 512)
    seen = []

    class Watched(fmt.Numbers):
        def __init__(self, numbers):
            self.numbers = numbers

        @property
        def array(self):
            class Cells:
                def __getitem__(_, k):
                    seen.append(len(k))
                    return self.numbers.array[k]

            return Cells()

        def __len__(self):
            return len(self.numbers)

    d.values |= {t: Watched(d.values[t]) for t in (324, 325)}
    g = fmt.geometry(d)
    k = tiff.wanted_tiles(g, {}, (100, 100, 33, 33), (0, 1))
    p = fmt.place_arrays(d, g, len(data), wanted=k)
    assert len(p["k"]) == 9 and seen == [9, 9]


def test_numbers():
    raw = fmt.file_header("<", False, 8) + fmt.pack_directory("<", False, 8, {324: (4, list(range(5000))), 700: (12, [0.5] * 100), 300: (3, [1] * 64)})
    d = fmt.directory(raw, fmt.header(raw), 8)
    v = d.numbers(324)
    assert isinstance(v, fmt.Numbers) and v == list(range(5000)) and v[17] == 17 and list(v[3:5]) == [3, 4] and len(v) == 5000 and v != [1] and v == d.get(324)
    assert sum(d.numbers(700)) == 50 and d.get(300) == [1] * 64
    assert fmt.pack_directory("<", False, 8, {e.tag: (e.type, e.value) for e in d.entries}) == raw[8:]
    assert np.asarray(v).sum() == sum(range(5000))


def test_plan_and_region(spark, tmp_path):
    path = grid(tmp_path)
    tiles = tiff.scan(spark, str(path), "tiles").where("tx between 1 and 2 and ty = 3 and byte_count > 0")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        tiles.explain("formatted")
    assert "PushedFilters: [GreaterThanOrEqual(tx,1), LessThanOrEqual(tx,2), EqualTo(ty,3)]" in shown.getvalue()
    assert sorted(r.k for r in tiles.collect()) == [16, 17]
    array = np.arange(75 * 61 * 3).reshape(61, 75, 3).astype(np.uint8)
    got = {(r.c, r.y, r.x): r.v for r in tiff.region(spark, str(path), 60, 50, 30, 30, filler=9).collect()}
    assert len(got) == 3 * 900
    assert all(v == (array[y + 50, x + 60, c] if y < 11 and x < 15 else 9) for (c, y, x), v in got.items())
    assert tiff.region(spark, str(path), 60, 50, 30, 30).count() == 3 * 11 * 15
