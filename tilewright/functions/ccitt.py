"""Bi-level facsimile coding: ITU-T T.4 and T.6, and the run lengths of TIFF compression 2.

A row is the list of its changing elements: the columns where the colour
differs from the one before, beginning with white. One-dimensional coding
writes the distances between them; two-dimensional coding writes where they lie
relative to the changing elements of the row above.

Rows are packed one bit a sample, 1 for black. White is 0 whatever the
photometric interpretation; inversion is the reader's.
"""

from __future__ import annotations

import numpy as np

# The code words of ITU-T T.4, tables 2 and 3. Run lengths 0 to 63, then multiples of 64 to 1728.
WHITE = """
00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101
011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011
""".split()
BLACK = """
0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100
0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101
""".split()
# Of both colours: 1792 to 2560.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
# Modes of two-dimensional coding: pass, horizontal, and vertical by a1 - b1.
PASS, HORIZONTAL = "0001", "001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
END_OF_LINE = "000000000001"

RLE, T4, T6 = 2, 3, 4
#: Bits of the options of T.4: two-dimensional rows, ends of lines that end with a byte.
TWO_DIMENSIONAL, ALIGNED = 1, 4
#: Rows from one that is coded by itself to the next, in two-dimensional T.4.
SPACING = 4
LONGEST = 13


def lengths() -> list[int]:
    return [*range(64), *range(64, 1729, 64), *range(1792, 2561, 64)]


def lookup(codes: dict) -> list:
    """For every `LONGEST` bits the code word that they begin with: (value, length), or None."""
    out: list = [None] * (1 << LONGEST)
    for value, word in codes.items():
        first = int(word, 2) << (LONGEST - len(word))
        out[first : first + (1 << (LONGEST - len(word)))] = [(value, len(word))] * (1 << (LONGEST - len(word)))
    return out


CODES = [dict(zip(lengths(), words + LONG, strict=True)) for words in (WHITE, BLACK)]
RUNS = [lookup(c) for c in CODES]
MODES = lookup({"pass": PASS, "horizontal": HORIZONTAL, **VERTICAL})


def changes(row: np.ndarray) -> list[int]:
    """The changing elements of a row of 0 and 1."""
    return np.flatnonzero(np.diff(row, prepend=0)).tolist()


def run_word(length: int, colour: int) -> str:
    """The code words of a run: long ones as many as it takes, then a multiple of 64, then the rest."""
    words = ""
    while length > 2560 + 63:
        words += CODES[colour][2560]
        length -= 2560
    if length > 63:
        words += CODES[colour][length // 64 * 64]
    return words + CODES[colour][length % 64]


def alone(own: list[int], width: int) -> str:
    """A row coded by itself."""
    edges = [0, *own, width]
    return "".join(run_word(b - a, i % 2) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))


def beside(own: list[int], above: list[int], width: int) -> str:
    """A row coded by the one above."""
    out, at, colour, i = [], -1, 0, 0
    j = 0
    while at < width:
        while j > 0 and j - 1 < len(above) and above[j - 1] > at:
            j -= 1
        while j < len(above) and (above[j] <= at or j % 2 != colour):
            j += 1
        b1, b2 = (above[j + d] if j + d < len(above) else width for d in (0, 1))
        a1, a2 = (own[i + d] if i + d < len(own) else width for d in (0, 1))
        if b2 < a1:
            out.append(PASS)
            at = b2
        elif abs(a1 - b1) <= 3:
            out.append(VERTICAL[a1 - b1])
            at, colour, i = a1, 1 - colour, i + 1
        else:
            out += [HORIZONTAL, run_word(a1 - max(at, 0), colour), run_word(a2 - a1, 1 - colour)]
            at, i = a2, i + 2
    return "".join(out)


def pack(bits: str) -> bytes:
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def encode(data: bytes, code: int, width: int, options: int = 0) -> bytes:
    """Packed rows as compression `code` stores them, the highest bit first."""
    row = -(-width // 8)
    lines = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, row), axis=1)[:, :width].astype(np.int8)
    out: list[str] = []
    size, above = 0, []
    for y, line in enumerate(lines):
        own = changes(line)
        if code == RLE:
            words = alone(own, width)
            words += "0" * (-len(words) % 8)
        elif code == T6:
            words = beside(own, above, width)
        else:
            end = END_OF_LINE
            if options & ALIGNED:
                end = "0" * (-(size + len(end)) % 8) + end
            by_itself = not options & TWO_DIMENSIONAL or y % SPACING == 0
            tag = ("1" if by_itself else "0") if options & TWO_DIMENSIONAL else ""
            words = end + tag + (alone(own, width) if by_itself else beside(own, above, width))
        out.append(words)
        size += len(words)
        above = own
    if code == T6:
        out.append(END_OF_LINE * 2)
    return pack("".join(out))


class Bits:
    """Bits of a stream from the highest of each byte; zeros follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 4], "big") >> (32 - (self.at & 7) - n) & ((1 << n) - 1)

    def word(self, table: list):
        found = table[self.peek(LONGEST)]
        if found is None or self.at >= self.end:
            raise ValueError(f"no code word at bit {self.at}")
        self.at += found[1]
        return found[0]

    def run(self, colour: int) -> int:
        total = 0
        while True:
            n = self.word(RUNS[colour])
            total += n
            if n < 64:
                return total

    def line_ended(self) -> bool:
        """Pass over the end of a line with the zeros before it, if one is here."""
        here = self.at
        while self.at < self.end and not self.peek(1):
            self.at += 1
        if self.at < self.end and self.at - here >= 11:
            self.at += 1
            return True
        self.at = here
        return False


def read_alone(bits: Bits, width: int) -> list[int]:
    at, colour, own = 0, 0, []
    while at < width:
        at += bits.run(colour)
        own.append(at)
        colour = 1 - colour
    return own


def read_beside(bits: Bits, above: list[int], width: int) -> list[int]:
    at, colour, own, j = -1, 0, [], 0
    while at < width:
        while j > 0 and j - 1 < len(above) and above[j - 1] > at:
            j -= 1
        while j < len(above) and (above[j] <= at or j % 2 != colour):
            j += 1
        b1, b2 = (above[j + d] if j + d < len(above) else width for d in (0, 1))
        mode = bits.word(MODES)
        if mode == "pass":
            at = b2
        elif mode == "horizontal":
            for c in (colour, 1 - colour):
                at = max(at, 0) + bits.run(c)
                own.append(at)
        else:
            if b1 + mode < max(at, 0):
                raise ValueError("a changing element lies before the one it follows")
            at = b1 + mode
            own.append(at)
            colour = 1 - colour
    return own


def decode(data: bytes, code: int, width: int, height: int, options: int = 0) -> bytes:
    """Packed rows of a stream; rows that it lacks are white."""
    bits = Bits(data)
    if code == RLE and bits.peek(12) == 1:
        code = T4  # ends of lines: the stream is not what the tag says
    out = np.zeros((height, width), np.uint8)
    above: list[int] = []
    for y in range(height):
        if bits.at >= bits.end:
            break
        if code == T6:
            if bits.peek(24) == 0x001001:
                break
            own = read_beside(bits, above, width)
        elif code == RLE:
            own = read_alone(bits, width)
            bits.at += -bits.at % 8
        else:
            ended = bits.line_ended()
            by_itself = True
            if options & TWO_DIMENSIONAL and ended:
                by_itself = bool(bits.peek(1))
                bits.at += 1
            if ended and bits.peek(12) == 1:
                break  # six ends of lines: no row follows
            own = read_alone(bits, width) if by_itself else read_beside(bits, above, width)
        if own and own[-1] > width:
            raise ValueError("a row is longer than the image")
        for a, b in zip(own[::2], [*own[1::2], width], strict=False):
            out[y, a:b] = 1
        above = changes(out[y].astype(np.int8))
    return np.packbits(out, axis=1).tobytes()
