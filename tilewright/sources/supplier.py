"""Tiles whose samples come from a function instead of, or beside, the file.

A supplier sees a tile's row (place, size, format) and gives its samples, or
None. It runs as a table function joined laterally to the tile index, so only
the tiles that a query asks for are made, wherever their rows are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import codecs
from ..shipping import ship
from . import tiff

#: ABSENT: the supplier is asked for tiles without data. ALWAYS: for all; None leaves a tile to the file.
ABSENT, ALWAYS = "absent", "always"
ROWS = "c int, y bigint, x0 bigint, samples array<double>"


def supplied(tiles: DataFrame, supply: Callable[[dict], np.ndarray | None], mode: str = ABSENT, *, filler: float = 0) -> DataFrame:
    """Rows of samples as `tiff.samples` gives them: path, global_index, c, y, x0, samples.

    `supply(tile)` returns an array (rows, columns, channels) for the tile's row as a dict, of one channel if planes
    are stored apart; what lies beyond the image is cut off. Tiles that neither it nor the file gives hold the filler.
    """
    if mode not in (ABSENT, ALWAYS):
        raise ValueError(f"mode {mode}")
    ship(tiles.sparkSession)
    registered = codecs.added()
    names = tiles.columns

    class Supply:
        def eval(self, row):
            codecs.adopt(registered)
            t = dict(zip(names, row, strict=True))
            own = supply(t) if mode == ALWAYS or not t["byte_count"] else None
            if own is not None:
                y0, x0 = t["ty"] * t["tile_h"], t["tx"] * t["tile_w"]
                own = np.asarray(own)[: t["height"] - y0, : t["width"] - x0]
                for c in range(own.shape[2]):
                    for y, line in enumerate(own[:, :, c]):
                        yield t["plane"] if t["planar"] else c, y0 + y, x0, line.astype(float).tolist()
                return
            data = None
            if t["byte_count"]:
                with open(t["path"].removeprefix("file:"), "rb") as f:
                    f.seek(t["offset"])
                    data = f.read(t["byte_count"])
            for c, y, x0, line in tiff.decode_rows(t, data, filler=filler):
                yield c, y, x0, line.tolist()

    made = udtf(Supply, returnType=ROWS)
    t = tiles.withColumn("_tile", F.struct(*names))
    return t.lateralJoin(made(F.col("_tile").outer())).select("path", "global_index", "c", "y", "x0", "samples")
