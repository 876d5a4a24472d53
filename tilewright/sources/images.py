"""Other image formats: into TIFF from whatever Spark's image source reads, out of it as PNG."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import tiff, tiff_sink


def pixels(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Samples (path, image, c, y, x, v) of JPEG, PNG, BMP and GIF files, in the order red, green, blue.

    `path` in the result is the file of the same name with ".tif" in the folder `target`.
    """
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    ship(spark)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                h, w, n = r["height"], r["width"], r["nChannels"]
                a = np.frombuffer(r["data"], np.uint8).reshape(h, w, n)
                a = a[..., [2, 1, 0, 3][:n]] if n >= 3 else a
                y, x, c = np.mgrid[0:h, 0:w, 0:n].reshape(3, -1)
                name = os.path.splitext(os.path.basename(r["origin"]))[0] + ".tif"
                k = len(y)
                yield pa.RecordBatch.from_arrays([pa.array([f"{target}/{name}"] * k), pa.array(np.zeros(k, np.int32)), pa.array(c.astype(np.int32)), pa.array(y), pa.array(x), pa.array(a.reshape(-1).astype(float))], ["path", "image", "c", "y", "x", "v"])

    return raw.mapInArrow(run, "path string, image int, c int, y bigint, x bigint, v double")


def to_tiff(spark: SparkSession, path: str, target: str, options: tiff_sink.Options | None = None) -> DataFrame:
    """Convert image files to TIFF files; returns path, images, bytes. Use the result to start the work."""
    return tiff_sink.write(pixels(spark, path, target), options or tiff_sink.Options(compression=8, predictor=2))


def png(array: np.ndarray) -> bytes:
    """A PNG stream of 8 or 16-bit samples (height, width, 1 to 4)."""
    h, w, n = array.shape
    if array.dtype not in (np.uint8, np.uint16) or n > 4:
        raise ValueError(f"PNG cannot hold {n} channels of {array.dtype}")
    lines = np.ascontiguousarray(array.astype(array.dtype.newbyteorder(">"))).view(np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), lines], 1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, array.dtype.itemsize * 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def to_png(tiles: DataFrame, target: str, dtype: str = "u1") -> DataFrame:
    """Write each image of tile rows as `target`/<name>-<index>.png; returns path, bytes. An image is one task's work."""
    rows = tiff.samples(tiles).join(tiles.groupBy("path", "global_index").agg(F.max("width").alias("w"), F.max("height").alias("h"), F.max("channels").alias("n")), ["path", "global_index"])

    def run(key, group):
        first = {c: group.column(c)[0].as_py() for c in ("w", "h", "n")}
        a = np.zeros((first["h"], first["w"], first["n"]), dtype)
        for c, y, x0, s in zip(*(group.column(k).to_pylist() for k in ("c", "y", "x0", "samples")), strict=True):
            a[y, x0 : x0 + len(s), c] = s
        name = os.path.splitext(os.path.basename(key[0].as_py()))[0]
        path = f"{target}/{name}-{key[1].as_py()}.png"
        os.makedirs(target, exist_ok=True)
        data = png(a)
        with open(f"{path}.tmp", "wb") as f:
            f.write(data)
        os.replace(f"{path}.tmp", path)
        return pa.table({"path": [path], "bytes": pa.array([len(data)], pa.int64())})

    return rows.groupBy("path", "global_index").applyInArrow(run, "path string, bytes bigint")
