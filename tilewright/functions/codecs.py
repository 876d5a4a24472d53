"""Compression of tiles: a registry from compression code to a pair of functions.

encode(data, info) and decode(data, info) work on bytes; `info` has what a
method may need: row (bytes of a pixel row), size (bytes expected), level in
0..1, width and height, and options that the directory states for the method. Further methods can be registered under their code.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from . import ccitt, png
from .tags import COMPRESSIONS


class UnsupportedCompression(ValueError):
    """The compression is unknown, or known but has no codec here."""


@dataclass
class Info:
    row: int = 0
    size: int = 0
    level: float = 0.5
    width: int = 0
    height: int = 0
    options: int = 0


Coder = Callable[[bytes, Info], bytes]
_codecs: dict[int, tuple[Coder | None, Coder | None]] = {}


def register(code: int, encode: Coder | None, decode: Coder | None) -> None:
    """Make `code` known; None stands for a direction that is not supported."""
    _codecs[code] = (encode, decode)


def added() -> dict[int, tuple[Coder | None, Coder | None]]:
    """What was registered besides this module's own codecs: workers import the module afresh, so jobs carry it along."""
    return {c: pair for c, pair in _codecs.items() if _own.get(c) != pair}


def adopt(pairs: dict[int, tuple[Coder | None, Coder | None]]) -> None:
    """Make known what added() gave in another process."""
    _codecs.update(pairs)


def name_of(code: int) -> str:
    return next((n for n, (c, _, _) in COMPRESSIONS.items() if c == code), f"unknown ({code})")


def encode(code: int, data: bytes, info: Info) -> bytes:
    f = _codecs.get(code, (None, None))[0]
    if f is None:
        raise UnsupportedCompression(f"cannot write compression {name_of(code)}")
    return f(data, info)


def decode(code: int, data: bytes, info: Info) -> bytes:
    f = _codecs.get(code, (None, None))[1]
    if f is None:
        raise UnsupportedCompression(f"cannot read compression {name_of(code)}")
    return f(data, info)


def pack_bits_row(row: bytes) -> bytes:
    """Runs of at least three become (1 - n, byte), the rest literals of up to 128 bytes."""
    out, i, n = bytearray(), 0, len(row)
    literal = 0  # where the pending literal begins
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and row[j] == row[i]:
            j += 1
        if j - i >= 3:
            for a in range(literal, i, 128):
                part = row[a : min(i, a + 128)]
                out.append(len(part) - 1)
                out += part
            out += bytes(((1 - (j - i)) & 0xFF, row[i]))
            literal = j
        i = j
    for a in range(literal, n, 128):
        part = row[a : a + 128]
        out.append(len(part) - 1)
        out += part
    return bytes(out)


def pack_bits(data: bytes, info: Info) -> bytes:
    step = info.row or len(data) or 1
    return b"".join(pack_bits_row(data[i : i + step]) for i in range(0, len(data), step))


def unpack_bits(data: bytes, info: Info) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and (not info.size or len(out) < info.size):
        c = data[i]
        i += 1
        if c < 128:
            if i + c + 1 > n:
                break  # a literal that goes beyond the end is left out
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128 and i < n:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out)


CLEAR, END, FIRST = 256, 257, 258


def lzw_encode(data: bytes, info: Info | None = None) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early."""
    out = bytearray()
    hold, bits = CLEAR, 9
    width, following = 9, FIRST
    table: dict[tuple[int, int], int] = {}
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = table.get((prefix, byte))
        if code is not None:
            prefix = code
            continue
        hold, bits = hold << width | prefix, bits + width
        table[prefix, byte] = following
        following += 1
        if following == 1 << width and width < 12 or following == 4094:
            if following == 4094:
                hold, bits = hold << width | CLEAR, bits + width
                table.clear()
                following, width = FIRST, 9
            else:
                width += 1
        prefix = byte
        if bits >= 64:
            whole, bits = bits // 8, bits % 8
            out += (hold >> bits).to_bytes(whole, "big")
            hold &= (1 << bits) - 1
    if prefix >= 0:
        hold, bits = hold << width | prefix, bits + width
        following += 1
        if following == 1 << width and width < 12:
            width += 1
    hold, bits = hold << width | END, bits + width
    pad = -bits % 8
    out += (hold << pad).to_bytes((bits + pad) // 8, "big")
    return bytes(out)


def lzw_decode(data: bytes, info: Info) -> bytes:
    if len(data) > 1 and data[0] == 0 and data[1] & 1:
        raise UnsupportedCompression("LZW with lowest bit first, as older writers made it")
    out = bytearray()
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table = list(base)
    width, before = 9, b""
    hold = bits = at = 0
    n = len(data)
    while not info.size or len(out) < info.size:
        while bits < width and at < n:
            hold = (hold << 8 | data[at]) & 0xFFFFFFFF
            at += 1
            bits += 8
        if bits < width:
            break
        code = hold >> bits - width & (1 << width) - 1
        bits -= width
        if code == END:
            break
        if code == CLEAR:
            table, width, before = list(base), 9, b""
            continue
        if not before:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = before + before[:1]
            else:
                raise ValueError("damaged LZW data")
            table.append(before + entry[:1])
        out += entry
        before = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def deflate(data: bytes, info: Info) -> bytes:
    return zlib.compress(data, round(9 * info.level))


def inflate(data: bytes, info: Info) -> bytes:
    return zlib.decompressobj().decompress(data, info.size or 0)


def lzma_encode(data: bytes, info: Info) -> bytes:
    return lzma.compress(data, lzma.FORMAT_XZ, lzma.CHECK_NONE, preset=round(9 * info.level))


def zstd_encode(data: bytes, info: Info) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


def zstd_decode(data: bytes, info: Info) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data, max_output_size=info.size or 1 << 30)


#: ThunderScan's two-bit and three-bit deltas; None: no sample.
TWO_BIT = (0, 1, None, -1)
THREE_BIT = (0, 1, 2, 3, None, -3, -2, -1)


def thunder_decode(data: bytes, info: Info) -> bytes:
    """Four-bit samples from runs, deltas and raw values."""
    want = info.size * 2 if info.size else 1 << 62
    samples, last = [], 0
    for c in data:
        kind, v = c >> 6, c & 63
        if kind == 0:
            samples += [last] * v
        elif kind == 1:
            for s in (4, 2, 0):
                d = TWO_BIT[v >> s & 3]
                if d is not None:
                    last = last + d & 15
                    samples.append(last)
        elif kind == 2:
            for s in (3, 0):
                d = THREE_BIT[v >> s & 7]
                if d is not None:
                    last = last + d & 15
                    samples.append(last)
        else:
            last = v & 15
            samples.append(last)
        if len(samples) >= want:
            break
    samples = samples[: min(want, len(samples))]
    samples += [0] * (len(samples) % 2)
    return bytes(a << 4 | b for a, b in zip(samples[::2], samples[1::2], strict=True))


register(1, lambda d, i: d, lambda d, i: d)
register(5, lzw_encode, lzw_decode)
register(8, deflate, inflate)
register(32946, deflate, inflate)
register(32773, pack_bits, unpack_bits)
register(32809, None, thunder_decode)
register(34925, lzma_encode, lambda d, i: lzma.decompress(d))
register(50000, zstd_encode, zstd_decode)

def _png_encode(data: bytes, info: Info) -> bytes:
    return png.encode(data, info.width, len(data) // max(info.row, 1), info.row // max(info.width, 1), info.level)


register(34933, _png_encode, lambda data, info: png.decode(data).tobytes())


def _fax(code: int) -> tuple[Coder, Coder]:
    """Writing and reading of a bi-level compression; info.options are those of tags 292 and 293."""

    def checked(info: Info) -> Info:
        if info.row != -(-info.width // 8):
            raise UnsupportedCompression(f"{name_of(code)} holds one channel of single bits")
        return info

    return (
        lambda data, info: ccitt.encode(data, code, checked(info).width, info.options),
        lambda data, info: ccitt.decode(data, code, checked(info).width, info.height, info.options),
    )


for _code in (ccitt.RLE, ccitt.T4, ccitt.T6):
    register(_code, *_fax(_code))

#: The codecs of this module.
_own = dict(_codecs)
