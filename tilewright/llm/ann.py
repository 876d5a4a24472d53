"""Approximate nearest neighbours by multi-index hashing.

A vector's code is the signs of a learned rotation of it, `BITS` bits. Codes are
split into substrings of about `SUB_BITS` bits, each with an index from the
values that occur to their rows. By the pigeonhole principle, if two codes
differ in at most r = s * m + a bits of m substrings (a < m), they differ in at
most s bits of one of the first a + 1 substrings, or in at most s - 1 bits of
one of the others. Probing every value within that distance so retrieves all
codes within r; those are reranked by the distance of the original vectors.
The values to probe are enumerated where they are fewer than the values that
occur, else the occurring ones are tested.

The rotation minimises the quantisation error by alternating between codes and
rotation (orthogonal Procrustes). It and the radius are fitted on a bounded
sample of `SAMPLE` rows, the smallest by hash of the id; the radius holds
`RADIUS_RECALL` of the sample's true neighbours. Every row is indexed.

A piece of candidates (blocks.py) is indexed where it is searched: the index is
as long as the piece, so it need not be stored or shuffled. If a query has fewer
than k neighbours when the radius has been searched, the radius grows for that
query and piece until it has, so every query gets k where the table has as many.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those without an id; ties go to the smaller id;
rows that share an id are queries and candidates each for itself, and a query
leaves out only its own row; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import Scratch

#: Rows that the rotations and the radius are fitted on, at most.
SAMPLE = 8192
#: Queries of the sample for the radius.
SAMPLE_QUERIES = 256
BITS, SUB_BITS = 64, 32
RADIUS_RECALL = 0.95
ITERATIONS = 20
#: Values of a substring that are enumerated at most; beyond, the occurring values are tested.
ENUMERATED = 1024


def fit_rotations(x: np.ndarray, bits: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The centre, and rotations side by side (width x bits), learned one after another."""
    rng = np.random.default_rng(seed)
    centre = x.mean(0)
    z, d = x - centre, x.shape[1]
    out = []
    for _ in range(-(-bits // d)):
        r, _ = np.linalg.qr(rng.normal(size=(d, d)))
        for _ in range(ITERATIONS):
            u, _, vt = np.linalg.svd(z.T @ np.where(z @ r >= 0, 1.0, -1.0))
            r = u @ vt
        out.append(r)
    return centre, np.concatenate(out, 1)[:, :bits]


def encode(x: np.ndarray, model) -> np.ndarray:
    """Codes as 64-bit integers."""
    centre, rotation = model
    bits = (x - centre) @ rotation >= 0
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, 8 - packed.shape[1]))).view(np.uint64)[:, 0]


def hamming(code, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(code ^ codes)


def fit(x: np.ndarray, k: int, bits: int = BITS):
    """Rotations and radius from sample rows."""
    model = fit_rotations(x, bits)
    codes = encode(x, model)
    rng = np.random.default_rng(2)
    chosen = rng.permutation(len(x))[:SAMPLE_QUERIES]
    seen = []
    for i in chosen:
        dist = ((x - x[i]) ** 2).sum(1)
        dist[i] = np.inf
        near = np.argsort(dist, kind="stable")[: min(k, len(x) - 1)]
        seen.append(hamming(codes[i], codes[near]))
    flat = np.concatenate(seen) if seen else np.zeros(1)
    radius = int(np.quantile(flat, RADIUS_RECALL)) if len(flat) else bits
    return model, radius


@lru_cache(maxsize=64)
def masks(bits: int, reach: int) -> np.ndarray:
    """Every value of `bits` bits with at most `reach` ones."""
    return np.array([sum(1 << b for b in c) for n in range(reach + 1) for c in combinations(range(bits), n)], np.uint64)


class Index:
    """Substring indexes of codes: for each value that occurs, the rows that have it."""

    def __init__(self, codes: np.ndarray, bits: int = BITS, sub_bits: int = SUB_BITS):
        self.codes = codes
        m = max(1, round(bits / sub_bits))
        cuts = [bits * i // m for i in range(m + 1)]
        self.subs = [(np.uint64(a), b - a, np.uint64((1 << b - a) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.tables = []
        for shift, _, mask in self.subs:
            value = codes >> shift & mask
            order = np.argsort(value, kind="stable")
            values, starts = np.unique(value[order], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    def probe(self, sub: int, value: np.uint64, reach: int) -> np.ndarray:
        """The rows whose substring is within `reach` bits of `value`."""
        values, starts, order = self.tables[sub]
        bits = self.subs[sub][1]
        if sum(comb(bits, n) for n in range(reach + 1)) <= min(ENUMERATED, len(values)):
            wanted = value ^ masks(bits, reach)
            at = np.searchsorted(values, wanted)
            at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == wanted)]
        else:
            at = np.flatnonzero(np.bitwise_count(values ^ value) <= reach)
        return np.concatenate([order[starts[i] : starts[i + 1]] for i in at]) if len(values) < len(order) else order[starts[at]]

    def probed(self, code: np.uint64, radius: int) -> np.ndarray:
        """The rows that probing retrieves: all within `radius`, and others."""
        s, a = divmod(radius, len(self.subs))
        hit = np.zeros(len(self.codes), bool)
        for i, (shift, _, mask) in enumerate(self.subs):
            reach = s if i <= a else s - 1
            if reach >= 0 and len(self.codes):
                hit[self.probe(i, code >> shift & mask, reach)] = True
        return np.flatnonzero(hit)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code differs in at most `radius` bits, and nothing else."""
        found = self.probed(code, radius)
        return found[hamming(code, self.codes[found]) <= radius]


def nearest_block(q, x, own, last, k: int, model, radius: int):
    """The rows of the piece that the index retrieves for each query, at most k, and not beyond its k-th distance so far."""
    index, codes = Index(encode(x, model)), encode(q, model)
    out_q, out_v, out_s = [], [], []
    for i, code in enumerate(codes):
        r = radius
        while True:
            found = index.within(code, r)
            found = found[~own[i, found]]
            # with k neighbours from earlier pieces the radius need not grow
            if len(found) >= k or r >= BITS or last[i] < np.inf:
                break
            r = min(BITS, r + max(4, r // 4))
        dist = np.sqrt(((x[found] - q[i]) ** 2).sum(1))
        first = np.argsort(dist, kind="stable")[:k]  # rows are in order of ids: ties go to the smaller
        first = first[dist[first] <= last[i]]
        out_q.append(np.full(len(first), i))
        out_v.append(found[first])
        out_s.append(dist[first])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def nearest(vectors: DataFrame, *, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`, the k nearest rows found.

    Returns query_id long, rank int, vec_id long, score double (the Euclidean
    distance of the original vectors).
    """
    v = blocks.numbered(blocks.usable(vectors, id_col, vec_col, nonzero=True), Scratch(vectors.sparkSession, "nearest"))
    sample = v.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE).select("vec").toPandas()["vec"]
    if not len(sample):
        return v.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = max(map(len, sample))
    x = np.zeros((len(sample), width))
    for i, row in enumerate(sample):
        x[i, : len(row)] = row
    (centre, rotation), radius = fit(x, k)

    def run(q, y, own, last):
        if y.shape[1] < width:
            q, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, y))
        model = (centre, rotation)
        if y.shape[1] > width:  # components that the sample never showed do not enter the codes
            model = (np.pad(centre, (0, y.shape[1] - width)), np.pad(rotation, ((0, y.shape[1] - width), (0, 0))))
        return nearest_block(q, y, own, last, k, model, radius)

    return blocks.search(v.where(F.col("id") % every == 0), v, k, False, run, "double")
