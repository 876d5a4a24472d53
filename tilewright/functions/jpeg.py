"""JPEG decoding: sequential and progressive Huffman images (8 and 12 bits) and lossless ones (2 to 16 bits).

Blocks are entropy-decoded one by one; dequantisation, the inverse cosine
transform and upsampling run on whole components. Chroma is repeated, not
smoothed. Streams without tables ("abbreviated") take them from a tables
stream, as tiles of one image share theirs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# The zigzag order, by its rule.
ZIGZAG = [r * 8 + c for s in range(15) for r, c in sorted(((r, s - r) for r in range(8) if 0 <= s - r < 8), key=lambda p: p[0] if s % 2 else p[1])]


class BadJpeg(ValueError):
    """The stream is damaged, or of a kind that is not decoded."""


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    dc: int = 0
    ac: int = 0
    data: np.ndarray | None = None


@dataclass
class State:
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[tuple[int, int], tuple[list[int], list[int]]] = field(default_factory=dict)
    restart: int = 0
    precision: int = 8
    width: int = 0
    height: int = 0
    lossless: bool = False
    progressive: bool = False
    components: list[Component] = field(default_factory=list)


def lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Length and symbol for each value of the next 16 bits (length 0: no code)."""
    lengths, values = [0] * 65536, [0] * 65536
    code = k = 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            first, many = code << 16 - n, 1 << 16 - n
            if first + many > 65536:
                raise BadJpeg("Huffman table overflows")
            lengths[first : first + many] = [n] * many
            values[first : first + many] = [symbols[k]] * many
            code += 1
            k += 1
        code <<= 1
    return lengths, values


class Bits:
    """Bits of an interval between restart markers; past its end there are zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 6]
        self.at += 6
        self.hold = self.hold << 48 | int.from_bytes(part.ljust(6, b"\0"), "big")
        self.n += 48
        if self.at > len(self.data) + 4096:
            raise BadJpeg("the data ends too early")

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        if self.n < 16:
            self.fill()
        peek = self.hold >> self.n - 16 & 0xFFFF
        length = table[0][peek]
        if not length:
            raise BadJpeg("no such Huffman code")
        self.n -= length
        self.hold &= (1 << self.n) - 1
        return table[1][peek]

    def raw(self, size: int) -> int:
        """The next `size` bits as a number."""
        if self.n < size:
            self.fill()
        self.n -= size
        v = self.hold >> self.n
        self.hold &= (1 << self.n) - 1
        return v

    def value(self, size: int) -> int:
        """A signed number of `size` bits."""
        if not size:
            return 0
        v = self.raw(size)
        return v if v >> size - 1 else v - (1 << size) + 1


def tables_of(data: bytes, s: State) -> None:
    """Read marker segments up to the first scan or the end; decode scans as they come."""
    at = 2
    if data[:2] != b"\xff\xd8":
        raise BadJpeg("no start of image")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xD9:
            return
        if marker in (0xFF, 0x01, 0x00) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                s.quant[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(float)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                s.huffman[body[0] >> 4, body[0] & 15] = lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            s.restart = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1, 0xC2, 0xC3):
            s.lossless, s.progressive = marker == 0xC3, marker == 0xC2
            s.precision, s.height, s.width = body[0], int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            s.components = [Component(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(body[5]))]
        elif 0xC5 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise BadJpeg(f"JPEG process {marker - 0xC0} is not decoded")
        elif marker == 0xDA:
            chosen = []
            for i in range(body[0]):
                c = next(c for c in s.components if c.id == body[1 + 2 * i])
                c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                chosen.append(c)
            tail = body[1 + 2 * body[0] :]
            end = at
            while end + 1 < len(data) and not (data[end] == 0xFF and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
                end = data.find(b"\xff", end + 1)
                if end < 0:
                    end = len(data)
            scan(s, chosen, data[at:end], tail)
            at = end


def intervals(data: bytes):
    """The parts between restart markers."""
    begin = at = 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            yield data[begin:]
            return
        if 0xD0 <= data[at + 1] <= 0xD7:
            yield data[begin:at]
            begin = at + 2
        at += 2


def scan(s: State, chosen: list[Component], data: bytes, tail: bytes) -> None:
    if s.lossless:
        lossless_scan(s, chosen, data, tail[0], tail[2] & 15)
        return
    hm, vm = max(c.h for c in s.components), max(c.v for c in s.components)
    across, down = -(-s.width // (8 * hm)), -(-s.height // (8 * vm))
    for c in chosen:
        if c.data is None or not s.progressive:
            c.data = np.zeros((down * c.v, across * c.h, 64), np.int32)
    if len(chosen) == 1:  # a scan of one component goes block by block over its own size
        c = chosen[0]
        w, h = -(--(-s.width * c.h // hm) // 8), -(--(-s.height * c.v // vm) // 8)
        units = [[(c, y, x)] for y in range(h) for x in range(w)]
    else:
        units = [[(c, y * c.v + j, x * c.h + i) for c in chosen for j in range(c.v) for i in range(c.h)] for y in range(down) for x in range(across)]
    per = s.restart or len(units)
    if s.progressive:
        first, end, high, low = tail[0], tail[1], tail[2] >> 4, tail[2] & 15
        for n, part in enumerate(intervals(data)):
            refine(s, Bits(part), units[n * per : (n + 1) * per], first, end, high, low)
        return
    for n, part in enumerate(intervals(data)):
        bits = Bits(part)
        last = {c.id: 0 for c in chosen}
        for unit in units[n * per : (n + 1) * per]:
            for c, y, x in unit:
                block = c.data[y, x]
                last[c.id] += bits.value(bits.symbol(s.huffman[0, c.dc]))
                block[0] = last[c.id]
                ac, k = s.huffman[1, c.ac], 1
                while k < 64:
                    rs = bits.symbol(ac)
                    if rs & 15:
                        k += rs >> 4
                        if k > 63:
                            raise BadJpeg("a block holds too many values")
                        block[ZIGZAG[k]] = bits.value(rs & 15)
                        k += 1
                    elif rs == 0xF0:
                        k += 16
                    else:
                        break


def refine(s: State, bits: Bits, units: list, first: int, end: int, high: int, low: int) -> None:
    """One scan of a progressive image: coefficients `first` to `end` down to bit `low`, new ones or their next bit."""
    last: dict[int, int] = {}
    one, skip = 1 << low, 0  # skip: blocks, this one included, that have nothing new in this band
    for c, y, x in (u for unit in units for u in unit):
        block = c.data[y, x]
        if first == 0:
            if high:
                block[0] |= bits.raw(1) << low
            else:
                last[c.id] = last.get(c.id, 0) + bits.value(bits.symbol(s.huffman[0, c.dc]))
                block[0] = last[c.id] << low
            continue
        k, table = first, s.huffman[1, c.ac]
        while k <= end and not skip:
            rs = bits.symbol(table)
            zeros, size = rs >> 4, rs & 15
            if not size and zeros < 15:
                skip = (1 << zeros) + bits.raw(zeros)
                break
            if not high:
                k += zeros
                if k > 63:
                    raise BadJpeg("a block holds too many values")
                if size:
                    block[ZIGZAG[k]] = bits.value(size) << low
                k += 1
                continue
            new = (one if bits.raw(1) else -one) if size else 0
            while k <= end:
                at = ZIGZAG[k]
                k += 1
                if block[at]:
                    next_bit(block, at, bits, one)
                elif zeros:
                    zeros -= 1
                else:
                    block[at] = new
                    break
        if skip:
            if high:
                for at in ZIGZAG[k : end + 1]:
                    if block[at]:
                        next_bit(block, at, bits, one)
            skip -= 1


def next_bit(block: np.ndarray, at: int, bits: Bits, one: int) -> None:
    """Refine a coefficient that is already known not to be zero."""
    if bits.raw(1) and not abs(int(block[at])) & one:
        block[at] += one if block[at] > 0 else -one


def lossless_scan(s: State, chosen: list[Component], data: bytes, predictor: int, point: int) -> None:
    if any(c.h != 1 or c.v != 1 for c in chosen):
        raise BadJpeg("lossless images with subsampling are not decoded")
    half = 1 << s.precision - point - 1
    out = [[[0] * s.width for _ in range(s.height)] for _ in chosen]
    per = s.restart or s.width * s.height
    for n, part in enumerate(intervals(data)):
        bits = Bits(part)
        first = n * per
        for k in range(first, min(first + per, s.width * s.height)):
            y, x = divmod(k, s.width)
            top = y == first // s.width
            for c, plane in zip(chosen, out, strict=True):
                size = bits.symbol(s.huffman[0, c.dc])
                diff = 32768 if size == 16 else bits.value(size)
                row = plane[y]
                if x == 0:
                    guess = half if top else plane[y - 1][0]
                elif top:
                    guess = row[x - 1]
                else:
                    a, b, d = row[x - 1], plane[y - 1][x], plane[y - 1][x - 1]
                    guess = (a, b, d, a + b - d, a + (b - d >> 1), b + (a - d >> 1), a + b >> 1)[predictor - 1]
                row[x] = guess + diff & 0xFFFF
    for c, plane in zip(chosen, out, strict=True):
        c.data = np.array(plane, np.int64) << point


def inverse_dct(blocks: np.ndarray) -> np.ndarray:
    """Samples of blocks (..., 64)."""
    k, n = np.mgrid[0:8, 0:8]
    basis = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return basis.T @ blocks.reshape(*blocks.shape[:-1], 8, 8) @ basis


def decode(data: bytes, tables: bytes | None = None) -> np.ndarray:
    """Samples (height, width, components), without colour conversion."""
    s = State()
    if tables:
        tables_of(tables, s)
    tables_of(data, s)
    if not s.components or any(c.data is None for c in s.components):
        raise BadJpeg("no image data")
    if s.lossless:
        return np.stack([c.data for c in s.components], -1).astype(np.uint8 if s.precision <= 8 else np.uint16)
    hm, vm = max(c.h for c in s.components), max(c.v for c in s.components)
    planes = []
    for c in s.components:
        order = np.empty(64)
        order[ZIGZAG] = s.quant[c.table]
        samples = inverse_dct(c.data * order) + (1 << s.precision - 1)
        rows, columns = samples.shape[:2]
        plane = samples.transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        plane = np.repeat(np.repeat(plane, vm // c.v, 0), hm // c.h, 1)[: s.height, : s.width]
        planes.append(np.clip(np.floor(plane + 0.5), 0, (1 << s.precision) - 1))
    return np.stack(planes, -1).astype(np.uint8 if s.precision <= 8 else np.uint16)


def decode_old(data: bytes, head: bytes) -> np.ndarray:
    """An old-style strip: whole streams as they are, others after the headers that the directory gave."""
    if data[:2] == b"\xff\xd8":
        return decode(data, None if b"\xff\xdb" in data else head)
    return decode(head + data + b"\xff\xd9")


def to_rgb(ycc: np.ndarray) -> np.ndarray:
    """Full-range YCbCr to RGB."""
    y, cb, cr = (ycc[..., i].astype(float) for i in range(3))
    out = np.stack([y + 1.402 * (cr - 128), y - 0.34414 * (cb - 128) - 0.71414 * (cr - 128), y + 1.772 * (cb - 128)], -1)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)
