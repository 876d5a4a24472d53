"""What happens to a tile between its stored bytes and its samples.

Reading: fill order, codec, predictor, unpacking of unusual depths, inversion,
separation of channels. Writing is the reverse. All on numpy arrays.
"""

from __future__ import annotations

import numpy as np

from . import codecs

REVERSED = np.array([int(f"{b:08b}"[::-1], 2) for b in range(256)], np.uint8)


def sample_type(bits: list[int], formats: list[int]) -> np.dtype | None:
    """The type of decoded samples by bits and sample format (1 unsigned, 2 signed, 3 float, 4 void)."""
    if len(set(formats)) > 1:
        raise codecs.UnsupportedCompression("channels of different sample formats")
    if any(b < 1 for b in bits) or len({-(-b // 8) for b in bits}) > 1:
        raise codecs.UnsupportedCompression(f"bits per sample {bits}")
    size = -(-bits[0] // 8)
    kind = formats[0] if formats else 1
    if kind == 3:
        if len(set(bits)) > 1 or bits[0] not in (16, 24, 32, 64):
            raise codecs.UnsupportedCompression(f"float samples of {bits} bits")
        return np.dtype("f8" if bits[0] == 64 else "f4")
    if size > 4:
        raise codecs.UnsupportedCompression(f"integer samples of {bits} bits")
    return np.dtype({1: "u1", 2: "u2", 3: "u4", 4: "u4"}[size] if kind in (1, 4) else {1: "i1", 2: "i2", 3: "i4", 4: "i4"}[size])


def predict(rows: np.ndarray, stride: int, back: bool) -> np.ndarray:
    """Horizontal differences (or their running sums) along the last axis; overflow wraps."""
    h, w = rows.shape
    full = w // stride * stride
    view = rows[:, :full].reshape(h, -1, stride)
    if back:
        view = np.cumsum(view, axis=1, dtype=rows.dtype)
    else:
        view = np.concatenate([view[:, :1], view[:, 1:] - view[:, :-1]], axis=1)
    return np.concatenate([view.reshape(h, full), rows[:, full:]], axis=1)


def float24(raw: np.ndarray) -> np.ndarray:
    """Floats of 1 sign, 7 exponent and 16 fraction bits, given as 32-bit integers."""
    sign, exponent, fraction = raw >> 23 & 1, raw >> 16 & 0x7F, raw & 0xFFFF
    value = np.where(exponent == 0, fraction / 65536.0 * 2.0**-62, (1 + fraction / 65536.0) * 2.0 ** (exponent.astype(int) - 63))
    value = np.where(exponent == 127, np.where(fraction == 0, np.inf, np.nan), value)
    return np.where(sign == 1, -value, value).astype("f4")


def unpack(data: np.ndarray, width: int, height: int, samples: int, bits: list[int], order: str, kind: int) -> np.ndarray:
    """Samples (height, width, samples) of a chunky tile with whole-byte or packed samples."""
    t = sample_type(bits, [kind])
    if all(b == bits[0] for b in bits) and bits[0] in (8, 16, 32, 64) and not (kind == 3 and bits[0] == 16):
        return data.view(t.newbyteorder(order)).reshape(height, width, samples).astype(t)
    if kind == 3 and bits[0] == 16:
        return data.view(np.dtype("f2").newbyteorder(order)).reshape(height, width, samples).astype("f4")
    if all(b == 24 for b in bits):
        b3 = data.reshape(height, width, samples, 3).astype(np.uint32)
        b3 = b3 if order == ">" else b3[..., ::-1]
        raw = b3[..., 0] << 16 | b3[..., 1] << 8 | b3[..., 2]
        if kind == 3:
            return float24(raw)
        return np.where(raw >= 1 << 23, raw.astype(np.int64) - (1 << 24), raw).astype(t) if kind == 2 else raw.astype(t)
    row = sum(bits) * width
    lines = np.unpackbits(data.reshape(height, -1), axis=1)[:, :row].reshape(height, width, sum(bits))
    out, at = np.empty((height, width, samples), np.int64), 0
    for i, b in enumerate(bits):
        weights = 1 << np.arange(b - 1, -1, -1, dtype=np.int64)
        v = lines[:, :, at : at + b].astype(np.int64) @ weights
        out[:, :, i] = np.where(v >= 1 << (b - 1), v - (1 << b), v) if kind == 2 else v
        at += b
    return out.astype(t)


def row_bytes(width: int, bits: list[int]) -> int:
    return -(-width * sum(bits) // 8)


def decode_tile(data: bytes, *, compression: int, predictor: int, width: int, height: int, bits: list[int], kind: int, order: str, fill_order: int = 1, invert: bool = False, rescale: bool = False, options: int = 0) -> np.ndarray:
    """Samples (height, width, channels) of an encoded tile."""
    samples = len(bits)
    row = row_bytes(width, bits)
    size = row * height
    if fill_order == 2:
        data = REVERSED[np.frombuffer(data, np.uint8)].tobytes()
    raw = codecs.decode(compression, data, codecs.Info(row, size, width=width, height=height, options=options))[:size]
    flat = np.frombuffer(raw.ljust(size, b"\0"), np.uint8)
    if predictor == 2:
        flat = predict_bytes(flat, height, samples, bits, order, True)
    elif predictor not in (0, 1):
        raise codecs.UnsupportedCompression(f"predictor {predictor}")
    out = unpack(flat, width, height, samples, bits, order, kind)
    if kind in (1, 4) and (invert or rescale):
        for i, b in enumerate(bits):
            v = out[..., i].astype(np.uint64)
            if invert:
                v = np.uint64((1 << b) - 1) - v
            if rescale and b % 8:
                v = v * np.uint64(((1 << out.dtype.itemsize * 8) - 1) // ((1 << b) - 1))
            out[..., i] = v.astype(out.dtype)
    return out


def predict_bytes(flat: np.ndarray, height: int, samples: int, bits: list[int], order: str, back: bool) -> np.ndarray:
    if len(set(bits)) > 1 or bits[0] not in (1, 8, 16, 32, 64):
        raise codecs.UnsupportedCompression(f"predictor with {bits} bits")
    if bits[0] == 1:
        lines = np.unpackbits(flat.reshape(height, -1), axis=1)
        lines = np.bitwise_xor.accumulate(lines, axis=1) if back else np.concatenate([lines[:, :1], lines[:, 1:] ^ lines[:, :-1]], axis=1)
        return np.packbits(lines, axis=1).reshape(-1)
    t = np.dtype(f"u{bits[0] // 8}")
    rows = flat.view(t.newbyteorder(order)).astype(t).reshape(height, -1)
    return predict(rows, samples, back).astype(t.newbyteorder(order)).view(np.uint8).reshape(-1)


def encode_tile(tile: np.ndarray, *, compression: int, predictor: int, bits: list[int], order: str, fill_order: int = 1, level: float = 0.5, options: int = 0) -> bytes:
    """The stored bytes of samples (height, width, channels)."""
    height, width, samples = tile.shape
    if all(b == 1 for b in bits):
        flat = np.packbits((tile != 0).reshape(height, -1), axis=1).reshape(-1)
    else:
        flat = np.ascontiguousarray(tile.astype(tile.dtype.newbyteorder(order))).view(np.uint8).reshape(-1)
    if predictor == 2:
        flat = predict_bytes(flat, height, samples, bits, order, False)
    elif predictor not in (0, 1):
        raise codecs.UnsupportedCompression(f"predictor {predictor}")
    data = codecs.encode(compression, flat.tobytes(), codecs.Info(row_bytes(width, bits), flat.size, level, width, height, options))
    return REVERSED[np.frombuffer(data, np.uint8)].tobytes() if fill_order == 2 else data


def ycbcr_size(width: int, height: int, cw: int, ch: int) -> int:
    """Bytes of a tile whose chroma has one sample for cw x ch pixels."""
    return -(-width // cw) * -(-height // ch) * (cw * ch + 2)


def ycbcr_tile(data: bytes, width: int, height: int, cw: int, ch: int, luma=(0.299, 0.587, 0.114), reference=(0, 255, 128, 255, 128, 255)) -> np.ndarray:
    """RGB samples of units of cw * ch luma values followed by Cb and Cr."""
    across, down = -(-width // cw), -(-height // ch)
    raw = np.frombuffer(data.ljust(across * down * (cw * ch + 2), b"\0"), np.uint8, across * down * (cw * ch + 2)).reshape(down, across, cw * ch + 2).astype(float)
    y = raw[..., : cw * ch].reshape(down, across, ch, cw).transpose(0, 2, 1, 3).reshape(down * ch, across * cw)[:height, :width]
    spread = lambda v: np.repeat(np.repeat(v, ch, 0), cw, 1)[:height, :width]
    cb, cr = spread(raw[..., -2]), spread(raw[..., -1])
    spans = [(b - a) or None for a, b in (reference[:2], reference[2:4], reference[4:])]  # an empty span does not scale
    y = (y - reference[0]) * (255 / spans[0] if spans[0] else 1)
    cb = (cb - reference[2]) * (127 / spans[1] if spans[1] else 1)
    cr = (cr - reference[4]) * (127 / spans[2] if spans[2] else 1)
    r = cr * (2 - 2 * luma[0]) + y
    b = cb * (2 - 2 * luma[2]) + y
    g = (y - luma[2] * b - luma[0] * r) / luma[1]
    return np.clip(np.floor(np.stack([r, g, b], -1) + 0.5), 0, 255).astype(np.uint8)
