"""PNG streams as tiles: 8-bit grey, grey with alpha, RGB, RGBA and palette images without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: its first bytes, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: bytes, width: int, height: int, channels: int, level: float = 0.5) -> bytes:
    """A stream of 8-bit samples; rows are stored as differences to the row above."""
    kind = next((t for t, n in CHANNELS.items() if n == channels and t != 3), None)
    if kind is None:
        raise ValueError(f"no image of {channels} channels")
    rows = np.frombuffer(pixels, np.uint8).reshape(height, width * channels)
    up = rows.copy()
    up[1:] -= rows[:-1]
    packed = zlib.compress(np.concatenate([np.full((height, 1), 2, np.uint8), up], 1).tobytes(), 1 + round(8 * level))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """Samples (height, width, channels); palettes become colours."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG stream")
    at, head, packed, palette = 8, None, [], b""
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in CHANNELS:
        raise ValueError("only 8-bit images without interlacing are read")
    width, height, _, kind, *_ = head
    n = CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.uint8)
    for y in range(height):
        above = out[y] = restored(int(raw[y, 0]), raw[y, 1:], above, n)
    out = out.reshape(height, width, n)
    return np.frombuffer(palette, np.uint8).reshape(-1, 3)[out[..., 0]] if kind == 3 else out


def restored(method: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """A row without its filter: none, left, up, average or the nearest of three."""
    if method == 0:
        return row
    if method == 2:
        return row + above
    if method == 1:
        return np.cumsum(row.reshape(-1, n), 0, dtype=np.uint8).reshape(-1)
    if method not in (3, 4):
        raise ValueError(f"unknown filter {method}")
    out, up = [0] * n, [0] * n + above.tolist()
    for i, v in enumerate(row.tolist(), n):
        left, over, corner = out[i - n], up[i], up[i - n]
        if method == 3:
            guess = (left + over) // 2
        else:
            p = left + over - corner
            guess = min((left, over, corner), key=lambda c, p=p: abs(p - c))  # of equal ones the first
        out.append((v + guess) & 255)
    return np.array(out[n:], np.uint8)
