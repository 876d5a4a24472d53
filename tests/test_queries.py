import os

import pytest

import __spark_entry__ as entry
from tilewright import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(rel.columns)
    names = sorted(got.columns)
    order = [rel.columns.index(n) for n in names]
    assert plain(got.select(*names).collect()) == plain([[r[i] for i in order] for r in rel.fetchall()])


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_components(spark):
    from tilewright.operators import raster

    art = ["##..#", "..#.#", ".....", "#.###", "#...."]
    px = spark.createDataFrame([(y, x) for y, line in enumerate(art) for x, c in enumerate(line) if c == "#"], "y long, x long")
    got = {(r.y, r.x): (r.root_y, r.root_x, r.area) for r in raster.connected_components(px).collect()}
    assert got[1, 2] == (0, 0, 3) and got[1, 4] == (0, 4, 2) and got[4, 0] == (3, 0, 2) and got[3, 3] == (3, 2, 3)
    assert len(got) == 10
    assert raster.connected_components(px, min_area=3).count() == 6


def test_components_across_blocks(spark, monkeypatch):
    """Objects that cross the edges of blocks, repeated samples, one long spiral, and numbers without gaps."""
    import random

    from tilewright.operators import components

    monkeypatch.setattr(components, "BLOCK", 3)
    rng = random.Random(5)
    spiral, y, x, dy, dx = set(), 0, 0, 0, 1
    for leg in range(12):
        for _ in range(24 - 2 * leg):
            spiral.add((y, x))
            y, x = y + dy, x + dx
        dy, dx = dx, -dy
    noise = {(rng.randrange(40), rng.randrange(40)) for _ in range(520)}
    for cells in (spiral, noise, {(0, x) for x in range(20)}, set()):
        px = spark.createDataFrame([(y, x) for y, x in cells] + [(y, x) for y, x in list(cells)[:5]], "y long, x long")
        got = {(r.y, r.x): (r.root_y, r.root_x, r.area, r.label) for r in components.connected_components(px).collect()}
        want, left, label = {}, set(cells), 0
        while left:
            first = min(left)
            label += 1
            found, todo = {first}, [first]
            while todo:
                y, x = todo.pop()
                for n in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if n in left and n not in found:
                        found.add(n)
                        todo.append(n)
            left -= found
            want |= {c: (*first, len(found), label) for c in found}
        assert got == want
