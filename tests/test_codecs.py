import random

import numpy as np
import pytest

from tilewright.functions import codecs, kernels


@pytest.mark.parametrize("code", [1, 5, 8, 32946, 32773, 34925, 50000])
def test_round_trip(code):
    rnd = random.Random(code)
    for n in (1, 2, 127, 128, 129, 130, 4000, 20000):
        for data in (bytes(n), rnd.randbytes(n), bytes(rnd.choice(b"ab") for _ in range(n)), b"abc" * n):
            info = codecs.Info(row=max(1, n // 7), size=len(data))
            assert codecs.decode(code, codecs.encode(code, data, info), info) == data


def test_pack_bits_known_bytes():
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    plain = bytes([0xAA, 0xAA, 0xAA, 0x80, 0x00, 0x2A, 0xAA, 0xAA, 0xAA, 0xAA, 0x80, 0x00, 0x2A, 0x22] + [0xAA] * 10)
    assert codecs.unpack_bits(packed, codecs.Info(size=len(plain))) == plain
    assert codecs.unpack_bits(b"\x80" + packed, codecs.Info(size=len(plain))) == plain  # -128 does nothing


def test_lzw_known_codes():
    # clear, 7, 8, end: 9-bit codes, highest bit first
    bits = "".join(f"{c:09b}" for c in (256, 7, 8, 257))
    data = int(bits.ljust(40, "0"), 2).to_bytes(5, "big")
    assert codecs.lzw_decode(data, codecs.Info(size=2)) == b"\x07\x08"
    assert codecs.lzw_encode(b"\x07\x08") == data


def test_thunder_scan():
    # raw 5, run of 2, deltas +1 +1 0, three-bit deltas +2 -3
    data = bytes([0xC5, 0x02, 0x40 | 0b010100, 0x80 | 0b010101])
    out = codecs.decode(32809, data, codecs.Info(size=4))
    assert out == bytes([0x55, 0x56, 0x77, 0x96])


def test_unknown_and_unsupported():
    for code in (6, 34712, 999):
        with pytest.raises(codecs.UnsupportedCompression):
            codecs.decode(code, b"", codecs.Info())


def test_registered_codec():
    codecs.register(40157, lambda d, i: d[::-1], lambda d, i: d[::-1])
    assert codecs.decode(40157, codecs.encode(40157, b"abc", codecs.Info()), codecs.Info()) == b"abc"


@pytest.mark.parametrize("dtype", ["u1", "i1", "u2", "i2", "u4", "i4", "f4", "f8"])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiles(dtype, order, predictor):
    t = np.dtype(dtype)
    tile = np.random.default_rng(157).integers(0, 256, (9, 13, 3 * t.itemsize), dtype=np.uint8).view(t)
    if t.kind == "f":
        tile = np.nan_to_num(tile)
    bits = [t.itemsize * 8] * 3
    kind = {"u": 1, "i": 2, "f": 3}[t.kind]
    for fill_order in (1, 2):
        data = kernels.encode_tile(tile, compression=8, predictor=predictor, bits=bits, order=order, fill_order=fill_order)
        back = kernels.decode_tile(data, compression=8, predictor=predictor, width=13, height=9, bits=bits, kind=kind, order=order, fill_order=fill_order)
        assert back.dtype == t and (back == tile).all()


def test_one_bit_tiles():
    tile = np.random.default_rng(1).integers(0, 2, (5, 11, 1), dtype=np.uint8)
    for predictor in (1, 2):
        data = kernels.encode_tile(tile, compression=1, predictor=predictor, bits=[1], order="<")
        assert len(data) == 10
        assert (kernels.decode_tile(data, compression=1, predictor=predictor, width=11, height=5, bits=[1], kind=1, order="<") == tile).all()


def test_odd_depths():
    args = dict(compression=1, predictor=1, width=2, height=1, kind=1, order="<")
    assert kernels.decode_tile(bytes([0xA5]), bits=[4], **args).tolist() == [[[10], [5]]]
    assert kernels.decode_tile(bytes([0xA5]), bits=[4], rescale=True, **args).tolist() == [[[170], [85]]]
    assert kernels.decode_tile(bytes([0xA5]), bits=[4], invert=True, **args).tolist() == [[[5], [10]]]
    assert kernels.decode_tile(bytes([0xAB, 0xCD, 0xEF]), bits=[12], **args).tolist() == [[[0xABC], [0xDEF]]]
    assert kernels.decode_tile(bytes([0b11111000, 0b00011111] * 2), bits=[5, 6, 5], **args).tolist() == [[[31, 0, 31]] * 2]
    assert kernels.decode_tile(bytes([1, 2, 3, 4, 5, 6]), bits=[24], **args).tolist() == [[[0x030201], [0x060504]]]
    half = np.array([1.5, -2.0], "<f2").tobytes()
    assert kernels.decode_tile(half, bits=[16], **args | dict(kind=3)).tolist() == [[[1.5], [-2.0]]]
    one, minus = 63 << 16, 1 << 23 | 64 << 16 | 0x8000
    raw = one.to_bytes(3, "little") + minus.to_bytes(3, "little")
    assert kernels.decode_tile(raw, bits=[24], **args | dict(kind=3)).tolist() == [[[1.0], [-3.0]]]


def test_depths_refused():
    with pytest.raises(codecs.UnsupportedCompression):
        kernels.sample_type([8, 16], [1])
    with pytest.raises(codecs.UnsupportedCompression):
        kernels.sample_type([64], [1])
    with pytest.raises(codecs.UnsupportedCompression):
        kernels.decode_tile(bytes(4), compression=1, predictor=3, width=1, height=1, bits=[32], kind=3, order="<")


def test_png_streams():
    """Rows of all five filters, worked out by hand, a palette, and what is refused."""
    import struct
    import zlib

    import numpy as np

    from tilewright.functions import png

    rows = [(0, [10, 20, 30]), (1, [5, 1, 255]), (2, [1, 1, 1]), (3, [2, 4, 6]), (4, [1, 2, 3])]
    body = b"".join(bytes([m, *v]) for m, v in rows)
    data = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 0, 0, 0, 0)) + png.chunk(b"tEXt", b"x") + png.chunk(b"IDAT", zlib.compress(body)) + png.chunk(b"IEND", b"")
    # left: 5, 6, 5; up: 6, 7, 6; average: 2 + 3, 4 + 6, 6 + 8; nearest of left, up, corner: 1 + 5, 2 + 10, 3 + 14
    assert png.decode(data)[..., 0].tolist() == [[10, 20, 30], [5, 6, 5], [6, 7, 6], [5, 10, 14], [6, 12, 17]]
    coloured = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 3, 0, 0, 0)) + png.chunk(b"PLTE", bytes(range(6))) + png.chunk(b"IDAT", zlib.compress(bytes([0, 1, 0]))) + png.chunk(b"IEND", b"")
    assert png.decode(coloured).tolist() == [[[3, 4, 5], [0, 1, 2]]]
    for n in (1, 2, 3, 4):
        a = np.random.default_rng(n).integers(0, 256, (7, 5, n), dtype=np.uint8)
        assert (png.decode(png.encode(a.tobytes(), 5, 7, n)) == a).all()
    for bad in (b"", data[8:], data.replace(struct.pack(">IIBB", 3, 5, 8, 0), struct.pack(">IIBB", 3, 5, 16, 0))):
        with pytest.raises(ValueError):
            png.decode(bad)
