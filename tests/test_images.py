import numpy as np
from pyspark.sql import functions as F

from tilewright.operators import tagged
from tilewright.sources import images, tiff, tiff_sink


def test_there_and_back(spark, tmp_path):
    a = np.random.default_rng(8).integers(0, 256, (9, 14, 3), dtype=np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.png(a))
    (report,) = images.to_tiff(spark, str(tmp_path / "in"), str(tmp_path / "tif"), tiff_sink.Options(tile_w=16, compression=5)).collect()
    assert report.images == 1
    tiles = tiff.scan(spark, str(tmp_path / "tif"), "tiles")
    got = np.zeros_like(a)
    for r in tiff.pixels(tiles).collect():
        got[r.y, r.x, r.c] = r.v
    assert (got == a).all()
    (out,) = images.to_png(tiles, str(tmp_path / "png")).collect()
    assert open(out.path, "rb").read() == images.png(a)


def test_typed_values(spark, tmp_path):
    o = tiff_sink.Options(tags={270: (2, ["one\r\ntwo", "three"]), 282: (5, (300, 7)), 283: (5, (1, 0))})
    from tests.test_tiff import image

    image(tmp_path / "a.tif", o, np.zeros((4, 6, 1), np.uint8))
    e = tiff.scan(spark, str(tmp_path), "entries")
    c = tagged.columns(e, width="ImageWidth", about="ImageDescription", rx="XResolution", ry="YResolution", none="Artist")
    r = c.select(tagged.required(F.col("width"), "ImageWidth").alias("w"), tagged.text(F.col("about")).alias("t"), tagged.ratio(F.col("rx")).alias("x"), tagged.ratio(F.col("ry")).alias("y"), tagged.number(F.col("none"), 5).alias("n")).first()
    assert (r.w, r.t, r.n) == (6, "one\ntwo\nthree", 5) and abs(r.x - 300 / 7) < 1e-12 and r.y == float("inf")
    s = spark.range(1).select(F.array(F.lit(1.0), F.lit(255.0), F.lit(16.0)).alias("s"))
    assert s.select(tagged.formatted(F.col("s"), most=2)).first()[0] == "1, 255, ..."
    assert s.select(tagged.formatted(F.col("s"), "hex")).first()[0] == "1, FF, 10"
