"""Embedding whitening by a tall-skinny QR.

Rows are centred by exact sums of whole numbers, every partition reduces its
rows to a triangular factor, factors are merged in a tree, and the singular
values and right vectors of the last one whiten: with R = U diag(s) V', the
columns of V are the components and s**2 / n their variances. No covariance is
formed, so small variances keep their digits.

A vector c becomes the whole numbers x = floor(scale * c) + shift, with the
product in double precision, held within 2**62 where it is larger. Vectors that
are null, empty, or hold null or non-finite entries are left out; shorter ones
count as padded with zeros to the width of the longest. Rows that share an id,
or have none, are rows each for itself. Components whose variance is zero to
double precision have no whitened value and are left out; so a table of equal
rows, or an empty one, gives no rows. deviation is null where it does not fit a
decimal of 38 digits. Only the named columns are read.

What reaches the driver is of the width of a vector: the sums, one triangular
factor and one pair of moments. Partitions' factors (width ** 2 numbers each)
are merged in tasks of their own, `FAN` at a time, or as many as `BYTES` hold
(two at least).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, slices

#: Factors merged by one task, and their bytes; rows taken at once.
FAN, BYTES, ROWS = 32, 1 << 27, 2048
LIMIT = 1 << 62


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns id and vec array<double>, of the vectors that take part."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return v.where((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def whole(column: pa.Array, scale: float, shift: int, width: int = 0) -> np.ndarray:
    """The vectors of an Arrow column as rows of whole numbers, `width` at least."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    c = np.zeros((len(sizes), width))
    c[np.arange(width) < sizes[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * c), -LIMIT, LIMIT - 1024).astype(np.int64) + shift


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of columns, without overflow."""
    most = int(np.abs(x).max(initial=0))
    return x.sum(0).astype(object) if most * max(1, len(x)) < LIMIT else x.astype(object).sum(0)


def sums(v: DataFrame, scale: float, shift: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension of their whole numbers."""

    def run(batches):
        n, total = 0, np.zeros(0, object)
        for b in slices(batches, ROWS):
            x = whole(b.column(1), scale, shift, len(total))
            grown = np.zeros(x.shape[1], object)
            grown[: len(total)] = total
            # dimensions that came later are padding of the earlier rows
            grown[len(total) :] = n * shift
            total, n = grown + exact_sum(x), n + len(x)
        at = np.arange(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), n)), pa.array([str(s) for s in total], pa.string())], ["at", "n", "total"])

    parts = v.mapInArrow(run, "at bigint, n bigint, total string")
    got = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")).orderBy("at").collect()
    n = max((r.n for r in got), default=0)
    return n, [int(r.total) + (n - r.n) * shift for r in got]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x minus the mean: the whole part exactly, then the fraction."""
    floor = [s // n for s in total]
    small = max(map(abs, floor), default=0) < LIMIT
    base = np.array(floor, np.int64 if small and np.abs(x).max(initial=0) < LIMIT // 2 else object)
    return (x - base).astype(float) - np.array([(s % n) / n for s in total])


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Of each row, the exact sum of (n * x - S) ** 2."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if most < LIMIT:
        d = n * x - np.array(total, np.int64)
        low = int(np.abs(d).max(initial=0))
        if low * low * max(1, d.shape[1]) < LIMIT:
            return (d * d).sum(1).tolist()
        d = d.astype(object)
    else:
        d = n * x.astype(object) - np.array(total, object)
    return [s if s < 10**38 else None for s in (d * d).sum(1)]


def tree(parts: DataFrame, merge: Callable, scratch: Scratch, width: int) -> object | None:
    """What rows (part long, body binary) come to: groups of bodies of width ** 2 numbers merge until one row is left."""
    fan = max(2, min(FAN, BYTES // (8 * width * width)))

    def run(key, table):
        body = merge(pickle.loads(b) for b in table.column("body").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([pickle.dumps(body)], pa.binary())})

    parts = scratch.save(parts)
    while parts.count() > 1:
        group = F.floor(F.col("part") / fan).alias("group")
        parts = scratch.save(parts.select(group, "body").groupBy("group").applyInArrow(run, "part bigint, body binary"))
    row = parts.first()
    return pickle.loads(bytes(row.body)) if row else None


def reduced(v: DataFrame, start: Callable, step: Callable, scale: float, shift: int, width: int) -> DataFrame:
    """Rows (part, body): `step(state, whole numbers)` over the vectors of each partition that has any."""

    def run(batches):
        from pyspark import TaskContext

        state, seen = start(), False
        for b in slices(batches, ROWS):
            if b.num_rows:
                state, seen = step(state, whole(b.column(1), scale, shift, width)), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], ["part", "body"])

    return v.mapInArrow(run, "part bigint, body binary")


def triangle(r: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The triangular factor of the rows of both."""
    return np.linalg.qr(np.concatenate([r, more]), mode="r")


def merge_triangles(factors: Iterable[np.ndarray]) -> np.ndarray:
    out = None
    for r in factors:
        out = r if out is None else triangle(out, r)
    return out


def merge_moments(a: tuple, b: tuple) -> tuple:
    """Rows, mean and centred products of two sets of rows together."""
    (n, mean, m), (k, other, p) = a, b
    if not n or not k:
        return b if not n else a
    d = other - mean
    return n + k, mean + d * (k / (n + k)), m + p + np.outer(d, d) * (n * k / (n + k))


def moments(w: np.ndarray) -> tuple:
    mean = w.mean(0)
    return len(w), mean, (w - mean).T @ (w - mean)


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, shift: int = 100_000, components: int = 8) -> DataFrame:
    """A row for each vector that takes part and each component, numbered from 1 by falling variance.

    Columns `id_col`, component int, n long, deviation decimal(38,0) (the sum of (n * x - S) ** 2), whitened double,
    explained double (the component's share of the variance), identity_error double (the largest entry of the
    whitened rows' covariance minus the identity).
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    ship(spark)
    v = usable(vectors, id_col, vec_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, total = sums(v, scale, shift)
    width = len(total)
    r = None
    if n:
        factors = reduced(v, lambda: np.zeros((0, width)), lambda r, x: triangle(r, centred(x, n, total)), scale, shift, width)
        r = tree(factors, merge_triangles, scratch, width)
    if r is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    _, s, right = np.linalg.svd(r)
    # below this a variance is rounding of the largest one
    kept = min(components, int((s > s.max(initial=0) * max(n, width) * np.finfo(float).eps).sum()))
    variance, trace = s**2 / n, float((s**2).sum() / n)
    axes = right[:kept].T / np.sqrt(variance[:kept])
    if kept:
        blank = (0, np.zeros(kept), np.zeros((kept, kept)))
        parts = reduced(v, lambda: blank, lambda m, x: merge_moments(m, moments(centred(x, n, total) @ axes)), scale, shift, width)

        def merge(states):
            out = blank
            for m in states:
                out = merge_moments(out, m)
            return out

        _, _, products = tree(parts, merge, scratch, kept)
        error = float(np.abs(products / n - np.eye(kept)).max())
    else:
        error = 0.0
    shares = (variance[:kept] / trace).tolist() if kept else []

    def run(batches):
        for b in slices(batches, ROWS):
            if b.num_rows and kept:
                x = whole(b.column(1), scale, shift, width)
                w = centred(x, n, total) @ axes
                rows = len(x)
                deviation = np.repeat(np.array(deviations(x, n, total), object), kept)
                columns = [
                    b.column(0).take(pa.array(np.repeat(np.arange(rows), kept))), pa.array(np.tile(np.arange(1, kept + 1), rows), pa.int32()), pa.array(np.full(rows * kept, n), pa.int64()),
                    pa.array([None if d is None else str(d) for d in deviation], pa.string()), pa.array(w.ravel(), pa.float64()), pa.array(np.tile(shares, rows), pa.float64()), pa.array(np.full(rows * kept, error), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = v.mapInArrow(run, schema.replace("decimal(38,0)", "string"))
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).withColumnRenamed("id", id_col)
