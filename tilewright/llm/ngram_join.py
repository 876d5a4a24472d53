"""Join of near-duplicate documents: Jaccard similarity of word n-grams.

Words are runs of bytes other than ASCII white space; a document's set holds
the hashes of its `n` words in a row (of all its words, if it has fewer).

1. Each text becomes a fingerprint of its word sequence and a MinHash signature
   in bands. The number of bands and of rows a band is chosen for a target
   recall at the threshold. Documents of one fingerprint are copies; only one
   of them goes on.
2. Texts are shuffled on the hashes of their bands. Each text of a band's bucket
   is tied to the bucket's smallest, which makes as many rows as texts; the
   components of these ties hold every pair that shares a bucket.
3. A component is cut into blocks of texts by hash. Each pair of blocks is one
   task's work: it compares full n-gram sets and returns, not pairs, but the
   number of links of each text and a spanning forest of them. Thus a component
   of m texts makes m * m / BLOCK rows, and no task gets more than two blocks.
4. Components of the forests are the classes.

Every pair of different texts with a common bucket is verified; nothing is
capped. A class's id is the smallest id in it.

Defined results: null texts and texts without words are in a class of their
own, with no links; copies count in n_copies, not as links; rows that share an
id and a text are copies; documents with null ids take part as others do, and
their class id is null if no other id is in it; only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, slices
from .graph import components

THRESHOLD = 0.8
WORDS = 5
RECALL = 0.9999
#: Hashes of a signature, at most.
MAX_HASHES = 128
#: Texts of a block; a task compares two blocks.
BLOCK = 128
#: Words whose hash a worker remembers.
MAX_WORDS = 250_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows a band: the most selective ones that reach the recall at the threshold."""
    for rows in range(16, 0, -1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"{most} hashes do not reach a recall of {recall} at {threshold}")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def gram_set(hashes: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct n-gram hashes."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    g = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - k + 1 + i]
        g ^= g >> np.uint64(29)
    return np.unique(mix64(g))


def signature(grams: np.ndarray, multipliers: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band of the MinHash signature."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 1024):
        least = np.minimum(least, ((grams[i : i + 1024] * multipliers[:, None]) >> np.uint64(16)).min(1))
    rows = least.reshape(bands, -1)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for r in rows.T:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + r)
    return h.view(np.int64)


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Square matrix: whether two sets' similarity reaches the threshold."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((m, m), bool)
    if not sizes.sum():
        return out
    owner = np.repeat(np.arange(m), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(code)
    shared = df[code] > 1
    owner, code = owner[shared], code[shared]
    by_code = np.argsort(code, kind="stable")
    posting = owner[by_code]
    starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(df)))])
    begin = np.searchsorted(owner, np.arange(m + 1))
    for i in range(m):
        mine = code[begin[i] : begin[i + 1]]
        if not len(mine):
            continue
        n = df[mine]
        at = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=m)
        out[i] = both >= threshold * (sizes[i] + sizes - both) - 1e-9
    np.fill_diagonal(out, False)
    return out & (sizes > 0)[:, None] & (sizes > 0)[None, :]


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each vertex with links to the smallest of its component."""
    m = len(links)
    label = np.arange(m)
    while True:
        new = np.minimum(label, np.where(links, label[None, :], m).min(1, initial=m))
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return [(i, int(label[i])) for i in range(m) if label[i] != i]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """One row a document: `id_col`, class_id (a document's id), n_links long, n_copies long.

    n_links counts other texts whose similarity reaches `threshold`; n_copies
    counts the documents with the same words, this one included.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ngram")
    bands, rows = choose_bands(threshold, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    # ids may be shared or null: a row is found again by its id and the hash of its text
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("x"))

    def sign(batches):
        multipliers = np.random.default_rng(3).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in slices(batches, 256):
            h1, h2, sigs = [], [], []
            for t in b.column(1).to_pylist():
                w = word_hashes(t)
                if len(w):
                    d = xxhash.xxh3_128_intdigest(w.tobytes())
                    h1.append(int(np.uint64(d >> 64).view(np.int64)))
                    h2.append(int(np.uint64(d & (1 << 64) - 1).view(np.int64)))
                    sigs.append(signature(gram_set(w, n), multipliers, bands))
                else:
                    h1.append(None)
                    h2.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), b.column(2)], ["id", "h1", "h2", "bands", "x"])

    signed = scratch.save(texts.mapInArrow(sign, f"id {kind}, h1 bigint, h2 bigint, bands array<bigint>, x bigint"))
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "x"))
    copies = signed.where("h1 is not null").groupBy("h1", "h2").agg(smallest.alias("least"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
    copies = copies.select("h1", "h2", F.col("least.id").alias("first"), F.col("least.x").alias("x"), "n_copies", "bands")
    reps = scratch.save(copies.withColumn("t", F.monotonically_increasing_id()))

    # ties: each text of a bucket to the bucket's smallest
    banded = reps.select("t", F.explode("bands").alias("bucket"))
    heads = banded.groupBy("bucket").agg(F.min("t").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    ties = banded.join(heads, "bucket").where("t <> head").select(F.col("t").alias("a"), F.col("head").alias("b"))
    groups = scratch.save(components(ties, scratch))

    # pairs of blocks
    sized = groups.groupBy("root").agg(F.count("*").alias("m"))
    members = groups.join(sized, "root").join(reps.select(F.col("t").alias("v"), "first", F.col("x").alias("hash"), "h1", "h2"), "v")
    members = members.select("v", "root", "first", "hash", "h1", "h2", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    with_text = texts.join(members.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("first")) & (F.col("x") == F.col("hash"))).select("v", "root", "block", "blocks", "h1", "h2", "text")
    placed = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "v", "block", "h1", "h2", "text")

    def compare(key, group):
        i, j = key[1].as_py(), key[2].as_py()
        ids, block, sets, seen = [], [], [], set()
        for b in group.to_batches():
            for v, k, h1, h2, t in zip(*(b.column(c).to_pylist() for c in ("v", "block", "h1", "h2", "text")), strict=True):
                w = word_hashes(t)
                d = xxhash.xxh3_128_intdigest(w.tobytes())
                if v in seen or (d >> 64) != h1 % (1 << 64) or d & (1 << 64) - 1 != h2 % (1 << 64):
                    continue  # an equal row, or another text of the same id and hash
                seen.add(v)
                ids.append(v)
                block.append(k)
                sets.append(gram_set(w, n))
        links = linked(sets, threshold)
        if i != j:
            at = np.array(block)
            links &= at[:, None] != at[None, :]
        count = links.sum(1)
        edges = forest(links)
        a = [ids[x] for x in np.flatnonzero(count)] + [ids[x] for x, _ in edges]
        b = [None] * int((count > 0).sum()) + [ids[y] for _, y in edges]
        c = count[count > 0].tolist() + [0] * len(edges)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(c, pa.int64())})

    found = scratch.save(placed.groupBy("root", "i", "j").applyInArrow(compare, "a bigint, b bigint, n bigint"))
    links = found.where("b is null").groupBy(F.col("a").alias("t")).agg(F.sum("n").alias("n_links"))
    classes = components(found.where("b is not null").select("a", "b"), scratch).withColumnRenamed("v", "t")
    info = reps.select("h1", "h2", "t", "first", "n_copies").join(links, "t", "left").join(classes, "t", "left").withColumn("root", F.coalesce("root", "t"))
    names = info.groupBy("root").agg(F.min("first").alias("class_id"))
    info = scratch.save(info.join(names, "root").select("h1", "h2", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"))
    own = signed.where("h1 is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    out = signed.where("h1 is not null").select("id", "h1", "h2").join(info, ["h1", "h2"]).select("id", "class_id", "n_links", "n_copies").union(own)
    return out.withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row of each group of near-duplicates, all columns: that of the smallest id (null: last).

    Rows are told apart by a number of their own: of rows that share an id, each
    is judged by its text, and of equal rows one stays.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    rows = Scratch(docs.sparkSession, "rows").save(docs.withColumn(name, F.monotonically_increasing_id()))
    classes = near_duplicates(rows, id_col=name, **options).select(F.col(name).alias("row"), "class_id")
    ids = rows.select(F.col(name).alias("row"), F.col(f"`{id_col}`").alias("id"))
    best = classes.join(ids, "row").groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias(name))
    return rows.join(best.select(name).hint("shuffle_hash"), name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
