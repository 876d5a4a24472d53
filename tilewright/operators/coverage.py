"""What rectangles leave of tiles, as rectangles.

Rectangles meet tiles by equal keys, not by pixels. In each tile they are
painted on a map of bits, which is as large as a tile however many rectangles
there are; rectangles of a tile are dealt to `SALT` maps first, so that no task
takes all rectangles of one tile, and the maps are laid over one another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .raster import rectangles_on_grid

SALT = 16


def free_rectangles(covered: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Disjoint rectangles (y, x, h, w) of the cells that are not covered: equal gaps of following rows are one."""
    out, open_ = [], {}
    height = len(covered)
    for y in range(height + 1):
        gaps = set()
        if y < height:
            edges = np.flatnonzero(np.diff(np.concatenate([[1], covered[y], [1]]).astype(np.int8)))
            gaps = set(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        for gap in sorted(open_.keys() - gaps):
            first = open_.pop(gap)
            out.append((first, gap[0], y - first, gap[1] - gap[0]))
        for gap in gaps - open_.keys():
            open_[gap] = y
    return out


def unset_rectangles(rects: DataFrame, tile_w: int, tile_h: int, gw: int, gh: int) -> DataFrame:
    """The parts of tiles that no rectangle (x0, y0, w, h) covers: ty, tx, y0, x0, h, w, of tiles that some rectangle meets.

    Tiles covered whole give no row; tiles that none meets are unset as they are and give none either. Rectangles may
    overlap, repeat and reach beyond the grid.
    """
    ship(rects.sparkSession)
    met = rectangles_on_grid(rects.select(*(F.col(c).cast("bigint").alias(c) for c in ("x0", "y0", "w", "h"))), tile_w, tile_h, gw, gh)
    left, top = F.col("tx") * tile_w, F.col("ty") * tile_h
    inside = met.select(
        "ty", "tx", F.greatest(F.col("x0") - left, F.lit(0)).cast("int").alias("a"), F.least(F.col("x0") + F.col("w") - left, F.lit(tile_w)).cast("int").alias("b"),
        F.greatest(F.col("y0") - top, F.lit(0)).cast("int").alias("c"), F.least(F.col("y0") + F.col("h") - top, F.lit(tile_h)).cast("int").alias("d"),
    ).distinct()

    def paint(key, table):
        covered = np.zeros((tile_h, tile_w), bool)
        for a, b, c, d in zip(*(table.column(n).to_pylist() for n in "abcd"), strict=True):
            covered[c:d, a:b] = True
        return pa.table({"ty": pa.array([key[0].as_py()], pa.int64()), "tx": pa.array([key[1].as_py()], pa.int64()), "map": pa.array([np.packbits(covered).tobytes()], pa.binary())})

    def finish(key, table):
        whole = np.zeros(-(-tile_w * tile_h // 8), np.uint8)
        for bits in table.column("map").to_pylist():
            whole |= np.frombuffer(bits, np.uint8)
        ty, tx = key[0].as_py(), key[1].as_py()
        found = free_rectangles(np.unpackbits(whole)[: tile_w * tile_h].reshape(tile_h, tile_w))
        rows = [(ty, tx, ty * tile_h + y, tx * tile_w + x, h, w) for y, x, h, w in found]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["ty", "tx", "y0", "x0", "h", "w"])

    dealt = inside.withColumn("salt", F.pmod(F.xxhash64("a", "b", "c", "d"), F.lit(SALT)))
    maps = dealt.groupBy("ty", "tx", "salt").applyInArrow(paint, "ty bigint, tx bigint, map binary")
    return maps.groupBy("ty", "tx").applyInArrow(finish, "ty bigint, tx bigint, y0 bigint, x0 bigint, h bigint, w bigint")
