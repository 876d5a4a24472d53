"""Byte-level BPE encoding and decoding.

Encoding compiles the merge ranks into a finite-state transducer over bytes.
Its nondeterministic states are the prefixes of vocabulary entries; a
deterministic state is the set of live hypotheses "a token began here", each
with the token before it. States are built when a text first reaches them and
kept up to a limit. A token is written as soon as every live hypothesis agrees
on it, so the lookahead is bounded by the vocabulary's longest entries. A
hypothesis may be completed by a token only if the merge rules leave the pair
(previous token, token) as it is; exactly one hypothesis can be completed at
each byte, which makes the result that of the merge procedure.

Texts are first cut at spaces between words, where no pre-token can continue;
the ids of such chunks are remembered, so that frequent words cost one lookup.

Decoding feeds the token bytes to an incremental UTF-8 state machine, so that
a text can be decoded token by token; bytes that no character can contain
become U+FFFD.

Defined results: a null text is encoded as the empty text (no ids); rows with
equal texts get equal results; other input columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

#: Deterministic states, and remembered pieces, kept by one worker before it starts anew.
MAX_STATES = 150_000
MAX_PIECES = 150_000
#: Pieces longer than this are seldom seen again and go through the transducer every time.
LONG_PIECE = 64


#: Keys of a state besides bytes: what is growing, and the token that ends at a byte (plus the byte).
GROWING, ONLY_END = -1, 256
#: Bits of a trie node's number within a hypothesis, and of a token's within a pair.
NODE_BITS = 24
NODE = (1 << NODE_BITS) - 1
#: Fixed value: patterns that begin so take letters, with a space before them or not, as one pre-token, and what is neither letter, digit nor space as another.
LETTERS_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
#: The characters with Unicode's White_Space property.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file: base64 token, space, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def merge_encode(ranks: dict[bytes, int], data: bytes, least: int = 1) -> list[int]:
    """The defining procedure: merge the adjacent pair of lowest rank until none, or `least` parts, are left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > least:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """The lazily determinised transducer for one vocabulary.

    A state holds, for each token that may still be growing, the bytes read of
    it and the token before it. Each move also says which token ends at the
    byte just read if the text is cut there; following those tokens backwards
    from the end gives the ids.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.sizes = {r: len(t) for t, r in ranks.items()}
        self.lookahead = max(self.sizes.values(), default=1)
        self._halves: dict[int, tuple[int, int]] = {}
        self._whole: dict[int, bool] = {}
        self._apart: dict[int, bool] = {}
        # the vocabulary as a trie: node << 8 | byte -> node, and of each node its depth, token (or -1) and whether it goes on
        self.child: dict[int, int] = {}
        self.depth, self.token, self.inner = [0], [-1], [False]
        for data, rank in ranks.items():
            node = 0
            for byte in data:
                self.inner[node] = True
                at = node << 8 | byte
                node = self.child.get(at) or self._node(at)
            self.token[node] = rank
        self._reset()

    def _node(self, at: int) -> int:
        node = self.child[at] = len(self.depth)
        self.depth.append(self.depth[at >> 8] + 1)
        self.token.append(-1)
        self.inner.append(False)
        return node

    def _reset(self) -> None:
        # a state is a dict: byte -> (next state, token that ends there), ONLY_END + byte -> that token alone
        self.index: dict[tuple, dict] = {}
        self.start = self._state((0,))

    def _state(self, growing: tuple) -> dict:
        """The state of hypotheses "a token grows": (token before it + 1) << NODE_BITS | its node so far."""
        state = self.index.get(growing)
        if state is None:
            state = self.index[growing] = {GROWING: growing}
        return state

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes `token`; a single byte is its own halves."""
        halves = self._halves.get(token)
        if halves is None:
            data = self.bytes_of[token]
            if len(data) == 1:
                halves = (token, token)
            else:
                parts = merge_encode(self.ranks, data, 2)
                halves = (parts[0], parts[1]) if len(parts) == 2 else (-1, -1)
            self._halves[token] = halves
        return halves

    def _is_whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        ok = self._whole.get(token)
        if ok is None:
            ok = self._whole[token] = merge_encode(self.ranks, self.bytes_of[token]) == [token]
        return ok

    def _stays(self, before: int, token: int) -> bool:
        """Whether merging leaves the two tokens apart.

        Undo their merges from the latest rank on. At each step the tokens that
        touch at the seam would have merged, if their joint rank is lower than
        that of the merge just undone.
        """
        ok = self._apart.get(before << NODE_BITS | token)
        if ok is not None:
            return ok
        left, right, limit, ok = before, token, 1 << 60, True
        while True:
            joint = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joint is not None and joint < limit:
                ok = False
                break
            l_half, r_half = self._split(left)[1], self._split(right)[0]
            if l_half == left and r_half == right:
                break
            # equal ranks: the merge further left happened first, so the right one is undone first
            if r_half == right or (l_half != left and left > right):
                limit, left = left, l_half
            else:
                limit, right = right + 1, r_half
        if len(self._apart) > 4 * MAX_STATES:
            self._apart.clear()
        self._apart[before << NODE_BITS | token] = ok
        return ok

    def _ended(self, state: dict, byte: int) -> int:
        """The token that ends at `byte` if the text is cut there."""
        child, tokens = self.child, self.token
        for h in state[GROWING]:
            node = child.get((h & NODE) << 8 | byte)
            if node is not None:
                token = tokens[node]
                if token >= 0 and self._is_whole(token) and (h <= NODE or self._stays((h >> NODE_BITS) - 1, token)):
                    state[ONLY_END + byte] = token
                    return token
        raise ValueError("the vocabulary lacks single bytes that the text holds")

    def _move(self, state: dict, byte: int) -> tuple[dict, int]:
        child, inner, growing = self.child, self.inner, []
        for h in state[GROWING]:
            node = child.get((h & NODE) << 8 | byte)
            if node is not None and inner[node]:
                growing.append(h & ~NODE | node)
        ended = self._ended(state, byte)
        growing.append(ended + 1 << NODE_BITS)
        step = state[byte] = (self._state(tuple(growing)), ended)
        return step

    def _settled(self, ends: list[int], state: dict, base: int) -> int:
        """The last position up to which every growing token agrees on the boundaries."""
        n = base + len(ends)
        starts = {n - self.depth[h & NODE] for h in state[GROWING]}
        while len(starts) > 1:
            latest = max(starts)
            starts.remove(latest)
            starts.add(latest - self.sizes[ends[latest - base - 1]] if latest > base else latest)
            if min(starts) <= base:
                return base
        return starts.pop()

    def _walk(self, ends: list[int], upto: int) -> list[int]:
        out, at, sizes = [], upto, self.sizes
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def stream(self, data: bytes):
        """Lists of ids of one pre-token, each as soon as no later byte can change it."""
        state, ends, base, due = self.start, [], 0, 64 * self.lookahead
        for byte in data:
            state, end = state.get(byte) or self._move(state, byte)
            ends.append(end)
            if len(ends) >= due:
                settled = self._settled(ends, state, base) - base
                if settled:
                    yield self._walk(ends, settled)
                    del ends[:settled]
                    base += settled
        yield self._walk(ends, len(ends))

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        if len(self.index) > MAX_STATES:
            self._reset()
            gc.collect()  # states refer to each other
        if len(piece) >= 64 * self.lookahead:
            return [i for part in self.stream(piece) for i in part]
        state, ends = self.start, []
        for byte in piece[:-1]:
            step = state.get(byte)
            if step is None:
                step = self._move(state, byte)
            state, end = step
            ends.append(end)
        last = piece[-1]
        end = state.get(ONLY_END + last)  # the state after the last byte is not needed
        ends.append(self._ended(state, last) if end is None else end)
        return self._walk(ends, len(ends))


class Memory(dict):
    """Packed ids (little-endian 32-bit) by chunk of text, made by `make` when first met.

    At MAX_PIECES entries it begins anew, but keeps the old ones aside until
    then again, so that chunks in use are only moved.
    """

    def __init__(self, make):
        self.make = make
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        packed = self.old.get(chunk)
        if packed is None:
            packed = self.make(chunk)
        if len(chunk) <= LONG_PIECE:
            self[chunk] = packed
        return packed

    def trim(self) -> None:
        if len(self) > MAX_PIECES:
            self.old = dict(self)
            self.clear()


class Utf8Machine:
    """Incremental UTF-8 decoding: the state is the unfinished character's bytes."""

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def _need(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0

    @staticmethod
    def _follows(lead: int, n: int, byte: int) -> bool:
        """Whether `byte` may be the n-th (from 1) continuation after `lead`."""
        low, high = 0x80, 0xBF
        if n == 1:
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
        return low <= byte <= high

    def feed(self, data: bytes) -> str:
        """The characters completed by `data`."""
        if not self.pending:
            try:
                return data.decode("utf-8")
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        state = self.pending
        for byte in data:
            if state and not self._follows(state[0], len(state), byte):
                out.append("�")
                state = b""
            state += bytes((byte,))
            need = self._need(state[0])
            if not need:
                out.append("�")
                state = b""
            elif len(state) == need:
                out.append(state.decode("utf-8"))
                state = b""
        self.pending = state
        return "".join(out)

    def close(self) -> str:
        """What is left at the end of the stream."""
        left, self.pending = self.pending, b""
        return "�" if left else ""


class Codec:
    """Encoder and decoder for a vocabulary file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.letters = pattern.startswith(LETTERS_FIRST)
        # cutting at a space before a word is safe if pre-tokens may begin, but not go on, with it
        self.chunks = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall if self.split("a b") == ["a", " b"] else self.split
        self.transducer = Transducer(ranks)
        self.pieces = Memory(self._piece)
        self.words = Memory(self._chunk)
        # the bytes of all tokens one after another, and where each one's are
        tokens = [self.transducer.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array(list(map(len, tokens)))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode("utf-8"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if self.letters:
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():  # the empty word is not
                return self._piece(chunk)
            if word[-1:] and word[-1] in ".,;:!?" and word[:-1].isalpha():  # one such mark is never part of what precedes it
                return self.words[chunk[:-1]] + self.words[chunk[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(chunk)))

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        self.pieces.trim()
        self.words.trim()
        return b"".join(map(self.words.__getitem__, self.chunks(text)))

    def encode(self, text: str | None) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode_stream(self, ids, chunk: int = 4096):
        """The text of `ids`, in pieces; each piece ends at a character's end."""
        machine, ids = Utf8Machine(), np.asarray(ids, np.int64)
        for i in range(0, len(ids), chunk):
            part = ids[i : i + chunk]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            yield machine.feed(self.table[np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        yield machine.close()

    def decode(self, ids) -> str:
        return "".join(self.decode_stream(ids))


@contextlib.contextmanager
def uncollected():
    """No search for garbage cycles meanwhile: it would walk through all states again and again."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: `id_col`, ids array<int>."""
    ship(docs.sparkSession)

    def run(batches):
        c = codec(vocabulary, pattern)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of token ids: `id_col`, text. Null ids give the empty text."""
    ship(tokens.sparkSession)

    def run(batches):
        c = codec(vocabulary, pattern)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    source = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"id {tokens.schema[id_col].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass over the texts, keeping digests instead of the text.

    Returns `id_col`, n_tokens long, ids_sha256 string, decoded_sha256 string,
    and with `with_ids` also ids array<int>.
    """
    ship(docs.sparkSession)

    def run(batches):
        c = codec(vocabulary, pattern)
        for b in slices(batches):
            n, ids_sha, text_sha, kept = [], [], [], []
            done: dict[str | None, tuple] = {}  # of this slice: a mix repeats texts, and puts them side by side
            with uncollected():
                for t in b.column(1).to_pylist():
                    row = done.get(t)
                    if row is None:
                        packed = c.encode_packed(t)
                        ids = np.frombuffer(packed, "<u4")
                        digest = hashlib.sha256()
                        for part in c.decode_stream(ids):
                            digest.update(part.encode("utf-8"))
                        row = done[t] = len(ids), hashlib.sha256(packed).hexdigest(), digest.hexdigest(), packed if with_ids else b""
                    for column, value in zip((n, ids_sha, text_sha, kept), row, strict=True):
                        column.append(value)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(kept), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)
