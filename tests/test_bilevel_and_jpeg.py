"""CCITT, JPEG writing, progressive and old-style JPEG: literal bytes, round trips, and the JVM's own codecs."""

import struct

import numpy as np
import pytest

from tests.test_jpeg import encoded, smooth
from tests.test_tiff import image, load
from tilewright.functions import ccitt, codecs, jpeg, jpeg_write
from tilewright.sources import tiff, tiff_sink
from tilewright.sources import tiff_format as fmt

MODES = [(2, 0), (3, 0), (3, 1), (3, 4), (3, 5), (4, 0)]


def test_code_words():
    for codes in ccitt.CODES:
        words = sorted(codes.values())
        assert len(set(words)) == 104 and not any(b.startswith(a) for a, b in zip(words, words[1:]))
        assert sum(2.0 ** -len(w) for w in words) == 1 - 2**-8  # all but the prefix of the ends of lines


def test_literal_rows():
    row = bytes([0b00011100])  # three white, three black, two white
    assert ccitt.encode(row, 2, 8).hex() == "89c0"  # 1000 10 0111
    assert ccitt.encode(row, 3, 8).hex() == "00189c"  # after 000000000001
    assert ccitt.encode(row, 3, 8, ccitt.ALIGNED).hex() == "000189c0"
    assert ccitt.encode(bytes(4), 4, 8).hex() == "f0010010"  # four times "as above", end of block
    # 001 1000 10: horizontal; 1: the edge of the image lies where the one above does
    assert ccitt.encode(row, 4, 8).hex() == "3140040040"
    assert ccitt.decode(bytes.fromhex("89c0"), 2, 8, 1) == row
    assert ccitt.decode(bytes.fromhex("00189c"), 2, 8, 1) == row  # not what the tag says
    assert ccitt.decode(bytes.fromhex("f0010010"), 4, 8, 6) == bytes(6)


def drawn(kind, h, w):
    rng = np.random.default_rng(w)
    x = (rng.random((h, w)) < kind).astype(np.uint8) if isinstance(kind, float) else np.zeros((h, w), np.uint8)
    if kind == "walk":
        for y in range(h):
            x[y, 10 + y // 2 : 17 + y] = 1
    return x


@pytest.mark.parametrize(("code", "options"), MODES)
@pytest.mark.parametrize(("kind", "h", "w"), [(0.5, 3, 1), (0.5, 20, 37), (0.05, 40, 64), (0.0002, 4, 9000), ("none", 5, 2561), ("walk", 30, 80), (1.0, 4, 6000)])
def test_rows_come_back(code, options, kind, h, w):
    x = drawn(kind, h, w)
    packed = np.packbits(x, axis=1).tobytes()
    assert ccitt.decode(ccitt.encode(packed, code, w, options), code, w, h, options) == packed


def test_damaged_rows():
    with pytest.raises(ValueError):
        ccitt.decode(bytes(10), 2, 8, 2)
    with pytest.raises(ValueError):
        ccitt.decode(bytes.fromhex("89c0"), 2, 4, 1)
    with pytest.raises(codecs.UnsupportedCompression):
        codecs.encode(4, bytes(6), codecs.Info(row=6, size=6, width=6, height=1))


def jvm_tiff(spark, array, method):
    """A bilevel TIFF made by the JVM."""
    jvm = spark._jvm
    h, w = array.shape
    im = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_BYTE_BINARY)
    for y, x in zip(*np.nonzero(array)):
        im.getRaster().setSample(int(x), int(y), 0, 1)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    out = jvm.java.io.ByteArrayOutputStream()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionType(method)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(im, None, None), param)
    stream.close()
    return bytes(out.toByteArray())


def jvm_pixels(spark, data):
    """The samples of any image that the JVM reads."""
    im = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(data))
    h, w, n = im.getHeight(), im.getWidth(), im.getRaster().getNumBands()
    flat = im.getRaster().getPixels(0, 0, w, h, spark.sparkContext._gateway.new_array(spark._jvm.int, w * h * n))
    return np.array(list(flat)).reshape(h, w, n)


@pytest.mark.parametrize(("method", "code"), [("CCITT RLE", 2), ("CCITT T.4", 3), ("CCITT T.6", 4)])
def test_rows_of_another_writer(spark, tmp_path, method, code):
    x = drawn(0.1, 23, 61)
    path = tmp_path / "a.tif"
    path.write_bytes(jvm_tiff(spark, x, method))
    (d,) = fmt.directories(path.read_bytes())
    assert d.get("Compression") == code
    assert (load(path)[..., 0] == x).all()


@pytest.mark.parametrize(("code", "options"), MODES)
def test_rows_for_another_reader(spark, tmp_path, code, options):
    x = drawn("walk", 20, 60)
    path = tmp_path / "a.tif"
    w = tiff_sink.FileWriter(str(path), tiff_sink.Options(one_bit=True, compression=code, fax=options, tile_h=20, photometric=1))
    w.tile(0, 0, 60, 20, 1, ccitt.encode(np.packbits(x, axis=1).tobytes(), code, 60, options))
    w.finish()
    assert (load(path)[..., 0] == x).all()
    assert (jvm_pixels(spark, path.read_bytes())[..., 0] == x).all()


@pytest.mark.parametrize("shape", [(8, 8, 1), (21, 35, 1), (21, 35, 3), (16, 40, 4), (1, 1, 3), (9, 17, 2)])
@pytest.mark.parametrize("sampling", [(1, 1), (2, 2), (2, 1)])
def test_jpeg_writing(spark, shape, sampling):
    array = smooth(*shape)
    data = jpeg_write.encode(array, 0.9, sampling=sampling)
    out = jpeg.decode(data)
    assert out.shape == array.shape
    got = jpeg.to_rgb(out) if shape[2] == 3 else out
    assert np.abs(got.astype(int) - array).max() <= (20 if sampling != (1, 1) and shape[2] == 3 else 6)
    if shape[2] in (1, 3):
        theirs = jvm_pixels(spark, data)
        assert np.abs(theirs - got.astype(int)).max() <= (24 if sampling != (1, 1) else 3)


def test_jpeg_writing_of_noise():
    """All sizes of values, long runs and full blocks; code words of 16 bits."""
    rng = np.random.default_rng(0)
    for array in (rng.integers(0, 256, (64, 72, 3), dtype=np.uint8), (rng.random((64, 64, 1)) < 0.01).astype(np.uint8) * 255, np.zeros((8, 8, 3), np.uint8)):
        rgb = jpeg.decode(jpeg_write.encode(array, 1.0, ycc=False))
        assert np.abs(rgb.astype(int) - array).max() <= 2
    counts = np.array([2**i for i in range(30)] + [0] * 226)  # a plain Huffman code would take 30 bits
    words, lengths, table = jpeg_write.code_words(counts)
    assert lengths.max() <= 16 and sum(2.0 ** -int(n) for n in lengths[:30]) < 1 and sum(table[:16]) == 30
    assert [jpeg.lookup(table[:16], table[16:])[1][int(words[s]) << 16 - int(lengths[s])] for s in range(30)] == list(range(30))
    with pytest.raises(jpeg.BadJpeg):
        jpeg_write.encode(np.zeros((8, 8, 1), np.uint16))
    with pytest.raises(jpeg.BadJpeg):
        jpeg_write.encode(np.zeros((8, 8, 3), np.uint8), sampling=(3, 1))


def progressive(spark, array):
    jvm = spark._jvm
    h, w, n = array.shape
    im = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if n == 1 else jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(h):
        for x in range(w):
            if n == 1:
                im.getRaster().setSample(x, y, 0, int(array[y, x, 0]))
            else:
                im.setRGB(x, y, int(array[y, x, 0]) << 16 | int(array[y, x, 1]) << 8 | int(array[y, x, 2]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    out = jvm.java.io.ByteArrayOutputStream()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(im, None, None), param)
    stream.close()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("noise", [False, True])
def test_progressive(spark, n, noise):
    """The same coefficients in several scans give the same samples as in one."""
    array = smooth(29, 43, n)
    if noise:
        array = np.random.default_rng(1).integers(0, 256, array.shape, dtype=np.uint8)
    data = progressive(spark, array)
    assert b"\xff\xc2" in data and data.count(b"\xff\xda") > 3
    assert (jpeg.decode(data) == jpeg.decode(encoded(spark, array))).all()


def old_style(path, data, shape, whole):
    """A TIFF of compression 6 around a JPEG stream: with tables in the file (tags 519 to 521), or with the stream itself (513)."""
    h, w, n = shape
    tables, at, scan, parts = {}, 2, b"", {}
    while not scan:
        size = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        marker, body = data[at + 1], data[at + 4 : at + size]
        at += size
        if marker == 0xDB:
            while body:
                tables[0xDB, body[0] & 15] = body[1:65]
                body = body[65:]
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                tables[0xC4, body[0]] = body[1 : 17 + many]
                body = body[17 + many :]
        elif marker == 0xC0:
            frame = body
        elif marker == 0xDA:
            order, scan = body, data[at:-2]
    out = bytearray(fmt.file_header("<", False, 0))

    def add(raw):
        out.extend(b"\0" * (len(out) % 2) + raw)
        return len(out) - len(raw)

    tags = {256: (4, w), 257: (4, h), 258: (3, [8] * n), 259: (3, 6), 262: (3, 6 if n == 3 else 1), 277: (3, n), 278: (4, h)}
    if n == 3:
        tags[530] = (3, [frame[7] >> 4, frame[7] & 15])
    if whole:
        tags |= {513: (4, add(data)), 514: (4, len(data))}
        tags |= {273: (4, len(out) - len(scan) - 2), 279: (4, len(scan))}
    else:
        quant = [add(tables[0xDB, frame[8 + 3 * i]]) for i in range(n)]
        dc = [add(tables[0xC4, order[2 + 2 * i] >> 4]) for i in range(n)]
        ac = [add(tables[0xC4, 0x10 | order[2 + 2 * i] & 15]) for i in range(n)]
        tags |= {512: (3, 1), 519: (4, quant), 520: (4, dc), 521: (4, ac), 273: (4, add(scan)), 279: (4, len(scan))}
    at = len(out) + len(out) % 2
    out.extend(b"\0" * (at - len(out)) + fmt.pack_directory("<", False, at, tags))
    struct.pack_into("<I", out, 4, at)
    path.write_bytes(out)


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("whole", [False, True])
def test_old_style(spark, tmp_path, n, whole):
    array = smooth(24, 40, n)
    for data in (encoded(spark, array), jpeg_write.encode(array, 0.8)):
        path = tmp_path / "a.tif"
        old_style(path, data, array.shape, whole)
        want = jpeg.decode(data)
        assert (load(path) == (jpeg.to_rgb(want) if n == 3 else want)).all()
    # cropped, it becomes JPEG of the present kind
    tiff_sink.copy_images(str(path), str(tmp_path / "b.tif"), crop=(8, 8, 16, 8), compression=7)
    (d,) = fmt.directories((tmp_path / "b.tif").read_bytes())
    assert d.get("Compression") == 7 and d.get(519) is None and d.get(513) is None
    assert np.abs(load(tmp_path / "b.tif") - array[8:16, 8:24]).max() < 16


def test_old_style_damage(tmp_path):
    path = tmp_path / "a.tif"
    image(path, tiff_sink.Options(tags={259: (3, 6)}), np.zeros((8, 8, 1), np.uint8))
    with pytest.raises(fmt.Damaged):
        list(tiff.rows("tiles", str(path), path.read_bytes()))
    assert list(tiff.rows("tiles", str(path), path.read_bytes(), permissive=True)) == []


@pytest.mark.parametrize("o", [dict(compression=7, tile_w=16, tile_h=16), dict(compression=7, tile_h=8, sampling=(2, 2)), dict(compression=7, tile_w=16, tile_h=16, planar=True), dict(compression=7, photometric=2)])
def test_jpeg_files(spark, tmp_path, o):
    array = smooth(20, 30, 3)
    path = tmp_path / "a.tif"
    px = spark.createDataFrame([(str(path), 0, c, y, x, int(array[y, x, c])) for c in range(3) for y in range(20) for x in range(30)], "path string, image int, c int, y long, x long, v int")
    tiff_sink.write(px, tiff_sink.Options(level=0.9, **o))
    assert np.abs(load(path) - array).max() <= 12
    assert np.abs(jvm_pixels(spark, path.read_bytes()) - array).max() <= 16 if not o.get("planar") else True
    tiff_sink.copy_images(str(path), str(tmp_path / "b.tif"), crop=(3, 5, 20, 10))
    assert np.abs(load(tmp_path / "b.tif") - array[5:15, 3:23]).max() <= 20
    tiff_sink.copy_images(str(path), str(tmp_path / "c.tif"), compression=8)
    assert (load(tmp_path / "c.tif") == load(path)).all()
