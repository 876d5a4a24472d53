"""Token counts from a cache of digests.

A text is known by the digest of its normalised content, a tokenizer by the
digest of its file, its library's version and the rules here. The cache is a
Parquet table of (version, digest, n_tokens). Digests that it lacks are found
by a join; one text for each of them is encoded, and the new counts are
appended before every row joins the cache.

Counting copies costs nothing, nor does counting a corpus again: a run over
known texts encodes none, and if few are new, only those few texts are moved.
Texts move once at most: they are reduced to one a digest in their own task
first. A digest that many rows share (at most `HOT_SHARE` have more than its
inverse of all rows) is joined by a broadcast of those few, so that no key
gathers rows.

Cache: each run appends a folder of its own, so runs beside each other do not
disturb one another. Counts that two runs found both are read as one. If a run
dies, the rows that it wrote hold.

Normalised content: a tokenizer that drops white space and never joins tokens
across it (`APART`) gives equal counts to texts whose words are equal, so runs
of ASCII white space are one space there; other tokenizers' content is the text
itself. With such a tokenizer a worker also encodes a word once, not whole
texts, and adds up.

Defined results: null is the empty text, with no tokens; strings of special
tokens in a text count as the library counts them by default; nothing is
truncated or padded; repeated rows get a row each; only the named columns are
read. Bytes that are not UTF-8 count as replacement characters.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship, slices

#: A normaliser and a splitting rule by which white space parts tokens and is dropped.
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Raise when what is normalised, or how it is counted, changes.
RULES = 1
HOT_SHARE = 1000
#: Bytes of text handed to the library at once, words that a worker remembers, and their bytes at most.
BATCH_BYTES, WORDS, WORD_BYTES = 1 << 18, 400_000, 64
CACHE = "digest binary, n_tokens bigint, version string, run string"


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer file, read once on the driver; its bytes travel with the jobs."""

    kind: str
    model: bytes
    version: str
    apart: bool


def load(path: str) -> Tokenizer:
    """tokenizers for .json, sentencepiece for .model."""
    with open(path, "rb") as f:
        model = f.read()
    kind = os.path.splitext(path)[1]
    apart = False
    if kind == ".json":
        import tokenizers as library

        rules = json.loads(model)
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in rules["added_tokens"])
        apart = plain and all(rules[k] == v for k, v in APART.items())
    elif kind == ".model":
        import sentencepiece as library
    else:
        raise ValueError(f"a tokenizer file ends in .json or .model: {path}")
    about = f"{library.__name__} {library.__version__} rules {RULES} "
    return Tokenizer(kind, model, hashlib.sha256(about.encode() + model).hexdigest(), apart)


@lru_cache(maxsize=2)
def library_counts(kind: str, version: str, model: bytes):
    """Counts of a list of texts by the library itself, one thread."""
    if kind == ".json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        t = Library.from_str(model.decode())
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_proto=model)
    return lambda texts: [len(ids) for ids in s.encode(texts, num_threads=1)]


def in_batches(counts, texts: list[bytes]) -> list[int]:
    """`counts` of all texts, a bounded number of bytes at a time."""
    out: list[int] = []
    batch: list[str] = []
    size = 0
    for t in texts:
        if batch and size + len(t) > BATCH_BYTES:
            out += counts(batch)
            batch, size = [], 0
        batch.append(t.decode("utf-8", "replace"))
        size += len(t)
    return out + (counts(batch) if batch else [])


class Words:
    """Counts of texts as sums over their words, each encoded by the library once."""

    def __init__(self, counts):
        self.counts, self.known = counts, {}

    def __call__(self, texts: list[bytes]) -> list[int]:
        if len(self.known) > WORDS:
            self.known = {}
        bags = [Counter(t.split()) for t in texts]  # ASCII white space, bytes as they are
        new = list({w for b in bags for w in b if w not in self.known})
        found = dict(zip(new, in_batches(self.counts, new), strict=True))
        out = [sum(n * (self.known[w] if w in self.known else found[w]) for w, n in b.items()) for b in bags]
        self.known |= {w: n for w, n in found.items() if len(w) <= WORD_BYTES}
        return out


@lru_cache(maxsize=2)
def counter(kind: str, version: str, apart: bool, model: bytes):
    """One for each tokenizer and worker process."""
    counts = library_counts(kind, version, model)
    return Words(counts) if apart else lambda texts: in_batches(counts, texts)


def normalised(text: Column, t: Tokenizer) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if t.apart else text


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; nothing where the cache is not there yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode(texts: DataFrame, t: Tokenizer) -> DataFrame:
    """digest, n_tokens for rows (digest, text)."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(t)

    def run(batches):
        t = shared.value
        counts = counter(t.kind, t.version, t.apart, t.model)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts(b.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", F.col("text").cast("binary").alias("text")).mapInArrow(run, "digest binary, n_tokens bigint")


def count(docs: DataFrame, tokenizer: str, *, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Columns `id_col`, n_bytes long, n_tokens long, over_limit boolean, for every row.

    `tokenizer` is the path of its file. `cache` is a folder that the driver and all executors reach;
    without one the counts are kept for this call alone.
    """
    spark = docs.sparkSession
    t = load(tokenizer)
    scratch = Scratch(spark, "token-counts")
    cache = cache or f"{scratch.base}/cache"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = normalised(text, t)
    digest = F.unhex(F.sha2(content, 256))
    rows = scratch.save(docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), digest.alias("digest")))
    sizes = scratch.save(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")))
    missing = sizes.join(stored(spark, cache, t.version), "digest", "left_anti").select("digest")
    texts = docs.select(digest.alias("digest"), content.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    new = encode(texts.join(missing, "digest", "left_semi"), t)
    new.write.parquet(f"{cache.rstrip('/')}/version={t.version}/run={uuid.uuid4().hex}")

    known = stored(spark, cache, t.version)
    hot = sizes.where(F.col("rows") * HOT_SHARE > rows.count()).select("digest")
    hot = F.broadcast(scratch.save(known.join(F.broadcast(hot), "digest", "left_semi")))
    counted = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(known, "digest"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
