import numpy as np
import pytest

from tilewright.functions import jpeg


def encoded(spark, array):
    """A JPEG stream made by the JVM."""
    jvm = spark._jvm
    h, w, n = array.shape
    kind = jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if n == 1 else jvm.java.awt.image.BufferedImage.TYPE_INT_RGB
    im = jvm.java.awt.image.BufferedImage(w, h, kind)
    for y in range(h):
        for x in range(w):
            if n == 1:
                im.getRaster().setSample(x, y, 0, int(array[y, x, 0]))
            else:
                r, g, b = (int(v) for v in array[y, x])
                im.setRGB(x, y, (r << 16 | g << 8 | b))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(im, "jpg", out)
    return bytes(out.toByteArray())


def smooth(h, w, n):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([np.clip(40 + 3 * x + 2 * y + 20 * i, 0, 255) for i in range(n)], -1).astype(np.uint8)


@pytest.mark.parametrize("n", [1, 3])
def test_sequential(spark, n):
    array = smooth(21, 35, n)
    out = jpeg.decode(encoded(spark, array))
    assert out.shape == array.shape
    out = jpeg.to_rgb(out) if n == 3 else out
    assert np.abs(out.astype(int) - array).mean() < 4 and np.abs(out.astype(int) - array).max() < 32


def test_tables_apart(spark):
    data = encoded(spark, smooth(16, 16, 1))
    at, tables, rest = 2, b"\xff\xd8", b"\xff\xd8"
    while data[at + 1] != 0xDA:
        size = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] in (0xDB, 0xC4):
            tables += data[at : at + size]
        else:
            rest += data[at : at + size]
        at += size
    rest += data[at:]
    assert (jpeg.decode(rest, tables + b"\xff\xd9") == jpeg.decode(data)).all()
    with pytest.raises((jpeg.BadJpeg, KeyError)):
        jpeg.decode(rest)


def test_lossless():
    """Sizes 0..8 as 4-bit codes; samples written literally with predictor 1."""
    samples = np.array([[100, 101, 99, 99], [103, 90, 200, 10]])
    dht = bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
    head = b"\xff\xd8\xff\xc3" + bytes([0, 11, 8, 0, 2, 0, 4, 1, 1, 0x11, 0])
    head += b"\xff\xc4" + (2 + 1 + len(dht)).to_bytes(2, "big") + b"\0" + dht
    head += b"\xff\xda" + bytes([0, 8, 1, 1, 0, 1, 0, 0])
    bits = ""
    for y in range(2):
        for x in range(4):
            guess = samples[y, x - 1] if x else samples[y - 1, 0] if y else 128
            d = int(samples[y, x] - guess)
            size = abs(d).bit_length()
            bits += f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
    bits += "1" * (-len(bits) % 8)
    raw = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    out = jpeg.decode(head + raw + b"\xff\xd9")
    assert out[..., 0].tolist() == samples.tolist()


def test_other_processes_are_named():
    with pytest.raises(jpeg.BadJpeg):
        jpeg.decode(b"\xff\xd8\xff\xc2" + bytes([0, 11, 8, 0, 2, 0, 4, 1, 1, 0x11, 0]))
