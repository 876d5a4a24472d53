"""URL filters with a cascade of Bloom filters.

A rule is a host and a path prefix; it fits the host itself and all its
subdomains. Its key is host + path. A url's candidate keys are the suffixes of
its host at label boundaries, each with the prefixes of its path of the rules'
lengths. The universe is the set of candidate keys of all urls of the corpus.

The first level of a cascade encodes the listed keys. The second encodes the
keys of the universe that pass the first though they are not listed; the third
the listed keys that pass the second, and so on with the two sets of false
positives until none are left. A key of the universe is listed if and only if
the first level that rejects it is an even one (counting from one), or none
rejects it and their number is odd. So membership is exact for the whole
corpus, and the filters that workers get are a few bits a listed key.

There is one cascade for allowing rules and one for blocking rules. A url
takes the verdict of its longest listed key; if there is none, the default.

Rules are a list that a person or a feed maintains: at most `MAX_RULES` keys of
`MAX_BYTES` together, which is checked before they are broadcast. False positives
of the first level are its rate times the keys of the universe; if there are more
than `MAX_RULES` of them, it is built again with 1/64 of the rate, which scans the
urls again.

Defined results: a null url, or one without "://", has empty host and path and
gets the default verdict; an empty list of rules gives every url the default;
repeated rows get equal results; only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

MAX_RULES, MAX_BYTES = 5_000_000, 1 << 28
#: Fixed value: the capital letters that hosts are folded from.
FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Bloom:
    """A Bloom filter over byte strings."""

    def __init__(self, keys, rate: float, salt: int):
        n = max(1, len(keys))
        self.salt = salt
        self.size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / n * math.log(2)))
        self.hashes = min(self.hashes, 30)
        self.bits = np.zeros(-(-self.size // 8), np.uint8)
        for k in keys:
            for p in self._places(k):
                self.bits[p >> 3] |= 1 << (p & 7)

    def _places(self, key: bytes):
        h = xxhash.xxh3_128_intdigest(key, self.salt)
        a, b = h & ((1 << 64) - 1), (h >> 64) | 1
        return [(a + i * b) % self.size for i in range(self.hashes)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Cascade:
    """Levels that alternate between listed keys and false positives."""

    def __init__(self, first: Bloom, listed: list[bytes], false_positives: list[bytes]):
        self.levels = [first]
        inside, outside = sorted(set(listed)), sorted(set(false_positives))
        while outside:
            level = Bloom(outside, 0.5, len(self.levels))
            self.levels.append(level)
            inside, outside = outside, [k for k in inside if k in level]

    def __contains__(self, key: bytes) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def parse(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(FOLD), path


class Shape:
    """What candidate keys the rules call for: lengths of paths, labels of hosts."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.lengths = sorted({len(p) for _, p in rules}, reverse=True)
        self.labels = max((h.count(".") + 1 for h, _ in rules), default=0)

    def candidates(self, host: str, path: str) -> list[tuple[str, str]]:
        """(host suffix, path prefix) pairs, longest together first, then longest host."""
        if not host or not self.lengths:
            return []
        hosts, at = [], len(host)
        for _ in range(self.labels):
            at = host.rfind(".", 0, at)
            hosts.append(host[at + 1 :])
            if at < 0:
                break
        found = [(h, path[:n]) for h in hosts for n in self.lengths if n <= len(path)]
        return sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))


def key_of(rule: tuple[str, str]) -> bytes:
    return f"{rule[0]}\x00{rule[1]}".encode("utf-8", "surrogatepass")


def build(urls: DataFrame, rules: list[tuple[str, str]], shape: Shape, salt: int) -> Cascade:
    """A cascade for `rules`, exact on all candidate keys of the column url."""
    listed = sorted({key_of(r) for r in rules})
    if len(listed) > MAX_RULES:
        raise ValueError(f"{len(listed)} rules; at most {MAX_RULES} are supported")
    if sum(map(len, listed)) > MAX_BYTES:
        raise ValueError(f"rules of more than {MAX_BYTES} bytes")
    rate = 0.01
    while True:
        first = Bloom(listed, rate, salt)
        sent = urls.sparkSession.sparkContext.broadcast((first, frozenset(listed)))

        def passing(batches, sent=sent):
            first, known = sent.value
            for b in slices(batches, 8192):
                out, seen = set(), set()
                for u in b.column(0).to_pylist():
                    for c in shape.candidates(*parse(u)):
                        if c not in seen:
                            seen.add(c)
                            k = key_of(c)
                            if k in first and k not in known:
                                out.add(k)
                yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.binary())], ["key"])

        if not listed:
            return Cascade(first, [], [])
        wrong = urls.mapInArrow(passing, "key binary").distinct()
        rows = wrong.limit(MAX_RULES + 1).collect()  # the limit is a guard: beyond it the level is rebuilt
        if len(rows) <= MAX_RULES:
            return Cascade(first, listed, [bytes(r[0]) for r in rows])
        rate /= 64


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The verdict on every url by `rules` of (verdict, host, path).

    Returns `id_col`, host, path, rule string, verdict string.
    """
    ship(pages.sparkSession)
    shape = Shape([(h, p) for _, h, p in rules])
    urls = pages.select(F.col(url_col).cast("string").alias("url"))
    verdicts = sorted({v for v, _, _ in rules})
    sent = pages.sparkSession.sparkContext.broadcast([(v, build(urls, [(h, p) for w, h, p in rules if w == v], shape, 1000 * i)) for i, v in enumerate(verdicts)])

    def run(batches):
        cascades = sent.value
        for b in slices(batches, 4096):
            hosts, paths, fits, says = [], [], [], []
            for u in b.column(1).to_pylist():
                host, path = parse(u)
                rule, verdict = None, default
                for c in shape.candidates(host, path):
                    k = key_of(c)
                    hit = next((v for v, cascade in cascades if k in cascade), None)
                    if hit is not None:
                        rule, verdict = c[0] + c[1], hit
                        break
                hosts.append(host)
                paths.append(path)
                fits.append(rule)
                says.append(verdict)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, fits, says))], ["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
