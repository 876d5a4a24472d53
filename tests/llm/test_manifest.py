"""The Merkle manifest, token counts and whitening against plain computations."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import merkle, queries, token_counts, whitening

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shown(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes, arity):
    levels = [hashes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k : k + arity])) for k in range(0, len(below), arity)])
    return levels


def others(levels, i, arity):
    out = []
    for row in levels[:-1]:
        start = i // arity * arity
        out.append(("".join(row[start:i]), "".join(row[i + 1 : start + arity])))
        i //= arity
    return out


def plain_manifest(rows, arity):
    """rows: (id, group, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha("".join(map(shown, r)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])], arity) for g in names}
    top = tree([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for i, (there, d, h) in enumerate(sorted(groups[g])):
            out.append((d if there else None, g, i, h, trees[g][-1][0], top[-1][0], tuple(others(trees[g], i, arity) + others(top, k, arity))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "arity", "depth"), [(0, 2, 8), (1, 2, 8), (300, 2, 3), (260, 3, 2)])
def test_manifest(spark, n, arity, depth):
    """Nulls, empty texts, repeated rows, shared ids, lone leaves and lone last members, over one and several layers."""
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "", "a", "b", "b", "b", "b", "ä", "zz"]), rng.choice(["x", "", "é", None])) for _ in range(n)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "id long, lang string, t string, leaf int, proof string")
    m = merkle.manifest(df, fields=["id", "lang", "t"], group="lang", order=["id"], arity=arity, depth=depth)
    got = m.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.folded == r.root for r in got)
    assert all([s.level for s in r.proof] == list(range(len(r.proof))) for r in got)
    assert sorted(((r.id, r.lang, r["index"], r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in got), key=str) == plain_manifest(rows, arity)


def test_manifest_of_one_group_and_carried_columns(spark):
    df = spark.range(70).select(F.col("id"), F.lit("g").alias("g"))
    m = merkle.manifest(df, fields=["id"], group="g", order=["id"], carry={"twice": F.col("id") * 2}, depth=2)
    rows = m.orderBy("id").collect()
    assert [r["index"] for r in rows] == list(range(70)) and all(r.twice == 2 * r.id and r.subroot == r.root and r.group_size == 70 for r in rows)
    with pytest.raises(ValueError):
        merkle.manifest(df, fields=["id"], group="g", order=["id"], arity=1)


def test_tampering_is_found(spark, tmp_path):
    rows = [(i, f"text {i}" * (i % 3), random.Random(i).choice(["en", "de", None]), "web", None if i % 5 == 0 else i) for i in range(120)] + [(None, None, None, None, (1 << 63) - 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    import zlib

    for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect():
        touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.doc_id % 5 != 0
        assert r.verified == (not touched) == (r.folded_root == r.root)


TEXTS = [
    None, "", " ", "plain words here", "plain  words\there ", "Plain WORDS here", "<|endoftext|> inside <|ENDOFTEXT|> x<|startoftext|>y", "it's we'll DON'T", "tab\x0bvt\x0cff\x1cfs\x85nel nbsp ls",
    "a ́combining é ẖ H̱", "İstanbul ΣΟΦΟΣ straße", "日本語 text 한국어", "12345 6.7e8", "👩‍👩‍👧 emoji", "x" * 5000, "word " * 9000, "\x00\x01 control", "'s't 're", "ﬁ ligature Ａ",
]


def expected_counts(name, texts):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    import sentencepiece

    return [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(x or "")) for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    import public_tokenizers

    rng = random.Random(3)
    marks = [" ", "\t", "\n", " ", "́", "'s", "<|endoftext|>", "a", "É", "ß", "7", "，", "!?", "\x1c", "İ"]
    texts = TEXTS + ["".join(rng.choices(marks, k=rng.randrange(40))) for _ in range(400)] + TEXTS
    df = spark.createDataFrame([(i, t, i, True) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long, digest boolean")
    got = {r.doc_id: r for r in token_counts.count(df, public_tokenizers.path(name), limit=100).collect()}
    want = expected_counts(name, texts)
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(r.over_limit == (r.n_tokens > 100) for r in got.values())


def test_token_cache(spark, tmp_path):
    """Known texts are not encoded again, counts of another version are not used, and rows found twice count once."""
    import public_tokenizers

    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    docs = spark.createDataFrame([(i, f"some text {i % 7}") for i in range(3000)], "doc_id long, text string")
    first = sorted(token_counts.count(docs, path, cache=cache).collect())
    t = token_counts.load(path)
    assert token_counts.stored(spark, cache, t.version).count() == 7
    assert token_counts.stored(spark, cache, "another").count() == 0
    # a planted count shows that the cache answers; a second run's copy of it is one row
    planted = docs.limit(1).select(F.unhex(F.sha2(F.lit("known text"), 256)).alias("digest"), F.lit(77).cast("bigint").alias("n_tokens"))
    for run in ("a", "b"):
        planted.write.parquet(f"{cache}/version={t.version}/run={run}")
    more = docs.union(spark.createDataFrame([(5000, "known  text")], docs.schema))
    again = sorted(token_counts.count(more, path, cache=cache).collect())
    assert again[:-1] == first and again[-1].n_tokens == 77
    assert token_counts.stored(spark, cache, t.version).count() == 8
    assert token_counts.count(docs.limit(0), path, cache=cache).count() == 0
    with pytest.raises(ValueError):
        token_counts.load(__file__)


def test_worker_forgets_words(monkeypatch):
    asked = []
    words = token_counts.Words(lambda texts: asked.extend(texts) or [len(t) for t in texts])
    monkeypatch.setattr(token_counts, "WORDS", 2)
    assert words([b"aa b aa", b"c " + b"d" * 100]) == [5, 101]
    assert words([b"aa b"]) == [3] and asked.count("aa") == 2  # three were known, so all were forgotten
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 3)
    assert token_counts.in_batches(lambda t: [len(x) for x in t], [b"abcd", b"a", b"b", b"c", b"d"]) == [4, 1, 1, 1, 1]


def plain_whitening(x, k=8):
    """From the covariance, in whole numbers where they are exact: deviations, whitened, shares."""
    n = len(x)
    total = [sum(int(v) for v in column) for column in x.T]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]
    centred = x - np.array([s / n for s in total])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    return deviation, centred @ axes[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 1, "s") for i, r in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), "vec_id long, embedding array<float>, component int, n string")


BAD = [(1000, None, 1, "s"), (2000, [1.0, None], 1, "s"), (3000, [float("nan")] * 4, 1, "s"), (4000, [float("inf"), 1.0], 1, "s"), (5000, [], 1, "s")]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_whitening(spark, parts):
    x = (np.random.default_rng(1).normal(size=(300, 12)) * np.linspace(0.2, 3, 12) + 5).astype("f4")
    x[100:120] = x[0]
    z = np.floor(1024 * x.astype(float)) + 100_000
    deviation, w, share = plain_whitening(z)
    got = whitening.whiten(vectors(spark, x, BAD).repartition(parts)).collect()
    assert len(got) == 300 * 8
    by = np.zeros((300, 8))
    for r in got:
        by[r.vec_id, r.component - 1] = r.whitened
        assert r.n == 300 and int(r.deviation) == deviation[r.vec_id] and abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert np.abs(np.abs(by) - np.abs(w)).max() < 1e-7
    assert np.allclose(by.T @ by / 300, np.eye(8), atol=1e-9)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [], BAD)).count() == 0
    assert whitening.whiten(vectors(spark, [[1, 2, 3]])).count() == 0  # one row varies in nothing
    assert whitening.whiten(vectors(spark, [[1, 2]] * 9)).count() == 0
    flat = whitening.whiten(vectors(spark, [[1, 2], [2, 4], [3, 6.0]])).collect()
    assert {r.component for r in flat} == {1} and abs(sum(r.whitened**2 for r in flat) / 3 - 1) < 1e-9
    # shorter vectors count as padded with zeros; a null id and a shared one are rows of their own
    ragged = spark.createDataFrame([(None, [1.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [3.0, -1.0])], "vec_id long, embedding array<double>")
    z = np.array([[1, 0], [0, 1], [0, 1], [3, -1]]) * 1024 + 100_000
    got = whitening.whiten(ragged).where("component = 1").collect()
    assert sorted(int(r.deviation) for r in got) == sorted(plain_whitening(z)[0]) and sum(r.vec_id is None for r in got) == 1


def test_whitening_of_huge_values(spark):
    x = np.array([[1e300, 1.0], [-1e300, 2.0], [4e12, -3.0]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(df).where("component = 1").collect()}
    assert len(got) == 3 and got[0] is None
    z = [int(v) for v in (1 << 61, -(1 << 61), 5)]
    assert [int(v) for v in whitening.deviations(np.array([z]).T, 3, [sum(z)])] == [(3 * v - sum(z)) ** 2 for v in z] or (3 * z[0] - sum(z)) ** 2 >= 10**38
    assert whitening.exact_sum(np.full((4, 1), 1 << 62)) == [4 * (1 << 62)]
    assert whitening.centred(np.array([[1 << 61], [5]]), 3, [(1 << 61) + 6])[1, 0] == 5 - ((1 << 61) + 6) / 3


def test_whitening_query(spark):
    import pyarrow.parquet as pq

    v = pq.read_table(f"{DATA}/embeddings.parquet").to_pydict()
    z = np.floor(1024 * np.array(v["embedding"], float)) + 100_000
    deviation, w, share = plain_whitening(z)
    at = {k: i for i, k in enumerate(v["vec_id"])}
    got = queries.op13_embedding_whitening(spark, DATA).collect()
    assert len(got) == 8 * len(z)
    assert all(r.deviation == deviation[at[r.vec_id]] and abs(abs(r.whitened) - abs(w[at[r.vec_id], r.component - 1])) < 1e-6 and abs(r.explained / share[r.component - 1] - 1) < 1e-6 and r.identity_error < 1e-6 for r in got)


def test_token_query(spark):
    import pyarrow.parquet as pq

    d = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    want = dict(zip(d["doc_id"], expected_counts("word_bpe_49k.json", d["text"])))
    assert {r.doc_id: r.n_tokens for r in queries.op12_token_counts(spark, DATA).collect()} == want
