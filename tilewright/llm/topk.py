"""Exact top-k search by inner product with multi-resolution segment statistics.

Every vector is cut into 4, 8, then 16 segments, each described by its mean
and standard deviation. For a query q and a candidate x with segments of
width w,

    |q - x|^2 >= w * sum((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

and since q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, the lower bound on the
distance is an upper bound on the inner product:

    q.x <= w * sum(mean_q * mean_x + dev_q * dev_x).

A query's threshold is its k-th best exact product so far, over all pieces of
candidates that a task has read (see blocks.py); in each piece the exact
products of the k candidates that promise most may raise it first. Candidates
whose bound falls below it are dropped, from coarse to fine, and the exact
product is computed for the survivors. Nothing is estimated: the result is that
of a full scan.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do those without an id; ties go to the smaller id; rows that
share an id are queries and candidates each for itself, and a query leaves out
only its own row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import Scratch

#: Segments of the resolutions, coarse to fine.
LEVELS = (4, 8, 16)
#: Queries handled together, so that a block's matrices stay small.
AT_ONCE = 64
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations side by side, scaled so that their product is the bound."""
    n, d = x.shape
    parts = x.reshape(n, segments, d // segments)
    return np.sqrt(d // segments) * np.concatenate([parts.mean(2), parts.std(2)], 1)


def top_block(q, x, own, least, k: int):
    """The k largest exact inner products of each query with the piece's rows, of those that reach `least`."""
    d = x.shape[1]
    if d % LEVELS[-1]:
        q, x = (np.pad(m, ((0, 0), (0, -d % LEVELS[-1]))) for m in (q, x))
    big = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * d >= 2**52
    levels = [(statistics(q, s), statistics(x, s)) for s in LEVELS]
    out_q, out_v, out_s = [], [], []
    for a in range(0, len(q), AT_ONCE):
        mine = slice(a, a + AT_ONCE)
        live = np.arange(len(x))
        alive = ~own[mine]
        threshold = least[mine].copy()
        if big:
            threshold -= 1e-6 * np.abs(np.where(np.isfinite(threshold), threshold, 0))
        for sq, sx in levels:
            bound = sq[mine] @ sx[live].T
            slack = 1e-9 * (1 + np.abs(bound)) if not big else 1e-6 * (1 + np.abs(bound))
            bound = np.where(alive, bound + slack, -np.inf)
            if len(live) > k:
                seeds = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                exact = np.einsum("qd,qkd->qk", q[mine], x[live[seeds]])
                exact[~np.take_along_axis(alive, seeds, 1)] = -np.inf
                margin = 0 if not big else 1e-6 * np.abs(exact)
                threshold = np.maximum(threshold, (exact - margin).min(1))
            alive = alive & (bound >= threshold[:, None])
            keep = alive.any(0)
            live, alive = live[keep], alive[:, keep]
        if not len(live):
            continue
        products = None if big else np.where(alive, q[mine] @ x[live].T, -np.inf)
        for i, row in enumerate(alive):
            at = live[row]
            if not len(at):
                continue
            if big:
                own_q = [int(v) for v in q[a + i]]
                s = [min(max(sum(u * int(v) for u, v in zip(own_q, y, strict=True)), LONG_MIN), LONG_MAX) for y in x[at]]
                first = sorted(range(len(at)), key=lambda j: (-s[j], j))[:k]
                s = [s[j] for j in first]
            else:
                p = products[i]
                kth = np.partition(p, -k)[-k] if len(p) > k else -np.inf
                near = np.flatnonzero((p >= kth) & row)
                first = near[np.argsort(-p[near], kind="stable")[:k]]  # rows are in order of ids: ties go to the smaller
                s, at = p[first].astype(np.int64).tolist(), live
            out_q += [a + i] * len(s)
            out_v += at[first].tolist()
            out_s += s
    return np.array(out_q, np.int64), np.array(out_v, np.int64), np.array(out_s, np.int64)


def exact_top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`, the k rows of largest integer inner product.

    Components are turned into floor(scale * x). Returns query_id long, rank
    int, vec_id long, score long (beyond its range: the nearest long).
    """
    v = blocks.usable(vectors, id_col, vec_col).select("id", F.transform("vec", lambda x: _floor(x * scale)).alias("vec"))
    v = blocks.numbered(v, Scratch(vectors.sparkSession, "topk"))
    return blocks.search(v.where(F.col("id") % every == 0), v, k, True, lambda q, x, own, least: top_block(q, x, own, least, k), "bigint")


def _floor(x):
    """floor() that stays a double, so that values beyond a long do not fail."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
