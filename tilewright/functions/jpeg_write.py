"""JPEG encoding: baseline Huffman images of 8-bit samples.

The cosine transform, quantisation and the list of symbols are array
operations over a whole component; code words come from the symbols' own counts
and are packed as arrays of bits. No table of code words is built in.
"""

from __future__ import annotations

import heapq

import numpy as np

from .jpeg import ZIGZAG, BadJpeg

# The example quantisation tables of ITU-T T.81, annex K, for brightness and colour.
BRIGHTNESS = """
16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99
"""
COLOUR = """
17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99
"""
END_OF_BLOCK, SIXTEEN_ZEROS = 0x00, 0xF0


def quantisers(quality: float) -> list[np.ndarray]:
    """Both tables for a quality of 0 to 1: the example's at 0.5, all ones at 1."""
    q = min(max(100 * quality, 1), 100)
    scale = 50 / q if q < 50 else 2 - q / 50
    return [np.clip(np.floor(np.array(t.split(), float) * scale + 0.5), 1, 255) for t in (BRIGHTNESS, COLOUR)]


def from_rgb(rgb: np.ndarray) -> np.ndarray:
    """Full-range YCbCr of RGB, not rounded."""
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128], -1)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a prefix code for symbols by their counts: 16 bits at most, and no word of ones alone."""
    used = np.flatnonzero(counts)
    # one more symbol, the rarest, takes the word of ones
    heap = [(int(counts[s]), i, [s]) for i, s in enumerate(used, 1)] + [(0, 0, [256])]
    length = np.zeros(257, int)
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], order, a[2] + b[2]))
        order += 1
    own = np.append(used, 256)
    length[own] = np.minimum(length[own], 16)
    # words cut to 16 bits are too many: others, the rarest first, become longer
    by_count = sorted(own, key=lambda s: counts[s] if s < 256 else -1)
    while sum(2.0 ** -int(length[s]) for s in own) > 1:
        s = next(s for s in by_count if length[s] < 16)
        length[s] += 1
    return length


def code_words(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Word and length of each symbol, and the table as a stream states it."""
    length = code_lengths(counts)
    longest = int(length.max())
    length[256] = longest  # it is last of the longest, so it is all ones or beyond
    symbols = sorted(np.flatnonzero(length[:256]), key=lambda s: (length[s], s))
    words, word, at = np.zeros(256, np.int64), 0, 0
    for s in symbols:
        word <<= int(length[s]) - at
        at = int(length[s])
        words[s] = word
        word += 1
    per_length = np.bincount(length[symbols], minlength=17)[1:17]
    return words, length[:256], bytes(per_length.astype(np.uint8)) + bytes(int(s) for s in symbols)


def magnitude(v: np.ndarray) -> np.ndarray:
    """How many bits the absolute values have."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def low_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, v, v + (1 << size) - 1)


def transformed(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of the blocks of a plane, in zigzag order: (rows, columns, 64)."""
    k, n = np.mgrid[0:8, 0:8]
    basis = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    h, w = plane.shape
    blocks = (plane - 128).reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)
    return np.rint((basis @ blocks @ basis.T).reshape(h // 8, w // 8, 64) / table).astype(np.int64)[..., ZIGZAG]


def symbols_of(zigzag: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, kind, symbol, bits, number of bits) for blocks (n, 64) that stand at `place` in the stream.

    kind is 0 for the first coefficient of a block, 1 for others; order sorts a stream's symbols.
    """
    turn = np.argsort(place)
    zigzag, place = zigzag[turn], place[turn]
    n = len(zigzag)
    diff = np.diff(zigzag[:, 0], prepend=0)
    size = magnitude(diff)
    parts = [(place * 256, np.zeros(n, np.int64), size, low_bits(diff, size), size)]
    block, k = np.nonzero(zigzag[:, 1:])
    k = k + 1
    v = zigzag[block, k]
    first = np.diff(block, prepend=-1) != 0
    before = np.where(first, 0, np.concatenate([[0], k[:-1]]))
    run, size = k - before - 1, magnitude(v)
    parts.append((place[block] * 256 + 4 * k, np.ones(len(k), np.int64), (run % 16) << 4 | size, low_bits(v, size), size))
    for more in range(1, 4):  # up to three times sixteen zeros before a value
        m = run >= 16 * more
        zero = np.zeros(int(m.sum()), np.int64)
        parts.append((place[block[m]] * 256 + 4 * k[m] - more, zero + 1, zero + SIXTEEN_ZEROS, zero, zero))
    last = np.zeros(n, np.int64)
    np.maximum.at(last, block, k)
    m = last < 63
    zero = np.zeros(int(m.sum()), np.int64)
    parts.append((place[m] * 256 + 255, zero + 1, zero + END_OF_BLOCK, zero, zero))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def packed(words: np.ndarray, lengths: np.ndarray) -> bytes:
    """Words one after the other, the rest of the last byte ones; bytes of ones are marked."""
    ends = np.cumsum(lengths)
    bits = np.ones(-(-int(ends[-1]) // 8) * 8, np.uint8)
    for j in range(int(lengths.max())):
        m = lengths > j
        bits[ends[m] - 1 - j] = words[m] >> j & 1
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(samples: np.ndarray, quality: float = 0.75, *, ycc: bool = True, sampling: tuple[int, int] = (1, 1)) -> bytes:
    """A stream of samples (height, width, 1 to 4).

    Three channels are stored as brightness and colour differences, the latter one for `sampling` (1 or 2 across and
    down) samples, or as they are (ycc=False).
    """
    height, width, n = samples.shape
    if samples.dtype != np.uint8 or not 1 <= n <= 4:
        raise BadJpeg(f"{n} channels of {samples.dtype} cannot be encoded")
    mixed = ycc and n == 3
    h, v = sampling if mixed else (1, 1)
    if h not in (1, 2) or v not in (1, 2):
        raise BadJpeg(f"sampling {sampling}")
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    whole = np.pad(samples, ((0, down * 8 * v - height), (0, across * 8 * h - width), (0, 0)), mode="edge")
    planes = np.moveaxis(from_rgb(whole) if mixed else whole.astype(float), 2, 0)
    tables = quantisers(quality)
    per_unit = h * v + n - 1
    streams, use = [], []
    for i, plane in enumerate(planes):
        small = mixed and i > 0
        if small:
            plane = plane.reshape(plane.shape[0] // v, v, plane.shape[1] // h, h).mean((1, 3))
        use.append(int(small))
        z = transformed(plane, tables[int(small)])
        rows, columns = z.shape[:2]
        y, x = np.mgrid[0:rows, 0:columns]
        dv, dh = (v, h) if i == 0 else (1, 1)
        inside = y % dv * dh + x % dh if i == 0 else h * v + i - 1
        streams.append(symbols_of(z.reshape(-1, 64), ((y // dv * across + x // dh) * per_unit + inside).ravel()))
    head, parts = b"", []
    for number in sorted(set(use)):
        head += segment(0xDB, bytes([number]) + bytes(tables[number][ZIGZAG].astype(np.uint8)))
    body = height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n])
    for i in range(n):
        body += bytes([i + 1, (h << 4 | v) if i == 0 else 0x11, use[i]])
    head += segment(0xC0, b"\x08" + body)
    if n == 3 and not ycc:
        head = segment(0xEE, b"Adobe\x00\x64" + bytes(5)) + head  # no change of colours
    for number in sorted(set(use)):
        own = [s for s, u in zip(streams, use, strict=True) if u == number]
        for kind in (0, 1):
            counts = sum(np.bincount(s[2][s[1] == kind], minlength=256) for s in own)
            words, lengths, table = code_words(counts)
            head += segment(0xC4, bytes([kind << 4 | number]) + table)
            for order, kinds, symbol, low, size in own:
                m = kinds == kind
                parts.append((order[m], words[symbol[m]] << size[m] | low[m], lengths[symbol[m]] + size[m]))
    order, words, lengths = (np.concatenate(c) for c in zip(*parts, strict=True))
    turn = np.argsort(order, kind="stable")
    scan = segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, use[i] * 0x11]) for i in range(n)) + b"\x00\x3f\x00")
    return b"\xff\xd8" + head + scan + packed(words[turn], lengths[turn]) + b"\xff\xd9"
