"""Query vectors against all vectors, in blocks.

A stated set of queries meets every candidate, so the work is queries times
candidates whatever the method. Queries are dealt to blocks by hash, candidates
to parts; every pair of a block and a part is a key of its own, so that work
spreads over as many tasks as there are pairs, and no key holds more than
`PART_ROWS` candidates. A task reads a part in pieces of bounded size
and keeps the best rows of each query as it goes, which later pieces can prune
by; what leaves it is at most k rows a query. No side is broadcast.

A row is known by a number of its own, not by its id: rows that share an id are
queries and candidates each for itself, and a query leaves out only itself.

Vectors that are null, empty, or hold null or non-finite components are left
out, as are those without an id. Shorter vectors count as padded with zeros.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship, slices

#: Rows of a block of queries, and of a piece of candidates.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 1024
#: Candidates of a part at most (on average), and keys that small tables are spread over.
PART_ROWS, KEYS = 1 << 20, 64


def usable(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool = False) -> DataFrame:
    """Columns id long and vec array<double>, of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        fine = fine & F.exists("vec", lambda x: x != 0)
    return v.where(fine)


def numbered(v: DataFrame, scratch: Scratch) -> DataFrame:
    """`v` as a written table with `row`, a number for each row."""
    return scratch.save(v.withColumn("row", F.monotonically_increasing_id()))


def as_matrix(column: pa.Array) -> np.ndarray:
    """The lists of an Arrow column as rows, padded with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    width = int(ends.max(initial=1))
    if len(ends) and (ends == width).all():
        return np.asarray(flat, float).reshape(len(ends), width)
    out = np.zeros((len(ends), width))
    out[np.arange(width) < ends[:, None]] = flat
    return out


def longs(column) -> bytes:
    return np.asarray(column.to_numpy(), np.int64).tobytes()


PACKED = "part int, rows binary, ids binary, width int, mat binary"


def pack(vectors: DataFrame, parts: int) -> DataFrame:
    """Pieces of at most CANDIDATE_ROWS vectors, made within each partition and dealt to parts."""

    def run(batches):
        for b in slices(batches, CANDIDATE_ROWS):
            if b.num_rows:
                m, row = as_matrix(b.column(2)), np.asarray(b.column(0).to_numpy(), np.int64)
                # numbers of a partition begin at a multiple of 2**33: a spread of both halves
                part = int((row[0] // CANDIDATE_ROWS * 7 + (row[0] >> 33) * 13) % parts)
                columns = [pa.array([part], pa.int32()), pa.array([row.tobytes()], pa.binary()), pa.array([longs(b.column(1))], pa.binary()), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "rows", "ids", "width", "mat"])

    return vectors.select("row", "id", "vec").mapInArrow(run, PACKED)


def pair_up(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int) -> DataFrame:
    """Every block of queries beside every piece of candidates; the pieces of a key (block, part) follow each other."""
    n_blocks = max(1, math.ceil(n_queries / QUERY_ROWS))
    parts = max(math.ceil(KEYS / n_blocks), math.ceil(n_candidates / PART_ROWS))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))

    def gather(key, table):
        m = as_matrix(table.column("vec").combine_chunks())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "qrows": pa.array([longs(table.column("row"))], pa.binary()), "qids": pa.array([longs(table.column("id"))], pa.binary()), "qwidth": pa.array([m.shape[1]], pa.int32()), "qmat": pa.array([m.tobytes()], pa.binary())})

    q = dealt.groupBy("block").applyInArrow(gather, "block int, qrows binary, qids binary, qwidth int, qmat binary")
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c = pack(candidates, parts).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    # a number of partitions of its own: small rows, much work
    tasks = min(n_blocks * parts, max(KEYS, 4 * candidates.sparkSession.sparkContext.defaultParallelism))
    return c.repartition(tasks, "block", "part").join(q.repartition(tasks, "block", "part").hint("merge"), ["block", "part"])


class Best:
    """The k best candidates of each query so far: parallel arrays, by query, best first."""

    def __init__(self, n: int, k: int, largest: bool, dtype):
        self.n, self.k, self.largest = n, k, largest
        self.at, self.row, self.id, self.score = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, dtype))

    def add(self, at, rows, ids, scores) -> None:
        at, row, vid, score = (np.concatenate(p) for p in ((self.at, at), (self.row, rows), (self.id, ids), (self.score, np.asarray(scores, self.score.dtype))))
        # ~x orders whole numbers downwards without overflow
        order = np.lexsort((row, vid, (~score if score.dtype.kind == "i" else -score) if self.largest else score, at))
        a = at[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        order = order[rank < self.k]
        self.at, self.row, self.id, self.score = at[order], row[order], vid[order], score[order]

    def last(self) -> np.ndarray:
        """The k-th score of each query, or the worst there is where it has fewer."""
        out = np.full(self.n, -np.inf if self.largest else np.inf)
        count = np.bincount(self.at, minlength=self.n)
        full = np.flatnonzero(count == self.k)
        out[full] = self.score[np.cumsum(count)[full] - 1]
        return out


def search(queries: DataFrame, candidates: DataFrame, k: int, largest: bool, function, score: str) -> DataFrame:
    """Apply `function(q, x, own, least)` -> (query, candidate, score arrays) to every block of queries and piece of candidates.

    own tells which candidate a query is itself; least are the queries' k-th scores so far. Returns the k best rows of each query:
    query_id long, rank int, vec_id long, score.
    """
    ship(candidates.sparkSession)
    dtype = np.float64 if score == "double" else np.int64
    names = ["qrow", "query_id", "vec_id", "row", "score"]

    def told(qrows, qids, best):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (qrows[best.at], qids[best.at], best.id, best.row, best.score)], names)

    def run(batches):
        key, qrows, qids, q, best = None, None, None, None, None
        for b in batches:
            columns = {n: b.column(n) for n in b.schema.names}
            for r in range(b.num_rows):
                now = (columns["block"][r].as_py(), columns["part"][r].as_py())
                if now != key:
                    if best is not None:
                        yield told(qrows, qids, best)
                    key = now
                    qrows, qids = (np.frombuffer(columns[n][r].as_py(), np.int64) for n in ("qrows", "qids"))
                    q = np.frombuffer(columns["qmat"][r].as_py()).reshape(-1, columns["qwidth"][r].as_py())
                    best = Best(len(qrows), k, largest, dtype)
                rows, ids = (np.frombuffer(columns[n][r].as_py(), np.int64) for n in ("rows", "ids"))
                x = np.frombuffer(columns["mat"][r].as_py()).reshape(-1, columns["width"][r].as_py())
                width = max(x.shape[1], q.shape[1])
                q, x = (m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
                order = np.lexsort((rows, ids))
                rows, ids, x = rows[order], ids[order], x[order]
                at, found, scores = function(q, x, qrows[:, None] == rows[None, :], best.last())
                best.add(at, rows[found], ids[found], scores)
        if best is not None:
            yield told(qrows, qids, best)

    pairs = pair_up(queries, candidates, queries.count(), candidates.count())
    found = pairs.mapInArrow(run, f"qrow bigint, query_id bigint, vec_id bigint, row bigint, score {score}")
    w = Window.partitionBy("qrow").orderBy(F.desc("score") if largest else F.asc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
