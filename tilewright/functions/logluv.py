"""High-dynamic-range samples: 16-bit LogL, 24-bit and 32-bit LogLuv, and their run-length streams."""

from __future__ import annotations

import math

import numpy as np

# Fixed values of the format: scales of the u and v fields, and the neutral chromaticity.
UV_SCALE = 410.0
NEUTRAL = (0.210526316, 0.473684211)
#: XYZ to red, green, blue by CCIR-709 primaries.
XYZ_TO_RGB = np.array([[2.690, -1.276, -0.414], [-1.022, 1.978, 0.044], [0.061, -0.224, 1.163]])


def log16_to_y(p: np.ndarray) -> np.ndarray:
    """Luminance of 16-bit log codes; code 0 and codes with the sign bit are zero."""
    code = p.astype(np.int64)
    y = np.exp(math.log(2) / 256 * (code + 0.5) - math.log(2) * 64)
    return np.where((code == 0) | (code & 0x8000 != 0), 0.0, y)


def shown(linear: np.ndarray) -> np.ndarray:
    """Samples for display: a gamma of two, nothing below zero."""
    return np.sqrt(np.maximum(linear, 0.0)).astype("f4")


def log16_to_grey(p: np.ndarray) -> np.ndarray:
    """Samples of 16-bit log codes."""
    return shown(log16_to_y(p))


def xyz(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """CIE XYZ from luminance and u', v'."""
    s = 1.0 / (6.0 * u - 16.0 * v + 12.0)
    cx, cy = 9.0 * u * s, 4.0 * v * s
    out = np.stack([cx / cy * y, y, (1.0 - cx - cy) / cy * y], -1)
    return np.where((y <= 0)[..., None], 0.0, out)


def luv32_to_xyz(p: np.ndarray) -> np.ndarray:
    """32-bit codes: 16 bits of luminance, 8 of u', 8 of v'."""
    p = p.astype(np.int64)
    return xyz(log16_to_y(p >> 16), ((p >> 8 & 0xFF) + 0.5) / UV_SCALE, ((p & 0xFF) + 0.5) / UV_SCALE)


def luv32_to_rgb(p: np.ndarray) -> np.ndarray:
    """Red, green, blue samples of 32-bit codes."""
    return shown(luv32_to_xyz(p) @ XYZ_TO_RGB.T)


def unpack_planes(data: bytes, width: int, height: int, size: int) -> np.ndarray:
    """Rows whose bytes are stored plane by plane, highest first, in runs: integers (height, width).

    A control byte of 128 or more repeats the next byte (control - 126) times;
    a smaller one is followed by that many bytes.
    """
    out = np.zeros((height, width), np.int64)
    at = 0
    for y in range(height):
        for plane in range(size):
            x = 0
            shift = 8 * (size - 1 - plane)
            while x < width and at < len(data):
                c = data[at]
                at += 1
                if c >= 128:
                    n = min(c - 126, width - x)
                    out[y, x : x + n] |= data[at] << shift
                    at += 1
                else:
                    n = min(c, width - x)
                    out[y, x : x + n] |= np.frombuffer(data, np.uint8, n, at).astype(np.int64) << shift
                    at += c
                x += n
    return out
