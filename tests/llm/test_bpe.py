import random

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tilewright.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_random_texts(codec, reference):
    rnd = random.Random(1)
    parts = ["a", " ", "é", "\n", "'s", "日", "😀", "1", "-", "the", "\t", "\u0301", "ing", "Z", "\x00", "\x1c", "\u2003", "\r\n", "²", "Ⅷ", "_", "  ", "<|endoftext|>"]
    for _ in range(5000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        ids = codec.encode(s)
        assert ids == reference.encode_ordinary(s)
        assert codec.decode(ids) == s


def test_bytes_agree_with_merging(codec):
    rnd = random.Random(2)
    t = codec.transducer
    for _ in range(300):
        b = rnd.randbytes(rnd.randint(1, 80))
        assert t.encode(b) == bpe.merge_encode(t.ranks, b)


def test_long_pieces_are_streamed(codec, reference):
    rnd = random.Random(3)
    s = "".join(rnd.choice("abcdefgh") for _ in range(60000))
    assert codec.encode(s) == reference.encode_ordinary(s)
    parts = list(codec.transducer.stream(s.encode()))
    assert len(parts) > 3 and max(map(len, parts)) < 20000


def test_states_are_dropped_at_the_limit(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 10)
    c = bpe.Codec(PATH, P.PATTERN)
    for s in ("some unusual words", "xyzzy plugh frobnicate", "äöü ßß ñandú"):
        assert c.encode(s) == reference.encode_ordinary(s)


def test_incremental_utf8():
    for s in ("aé日😀", "plain"):
        for cut in range(1, 5):
            m, raw = bpe.Utf8Machine(), s.encode()
            assert "".join(m.feed(raw[i : i + cut]) for i in range(0, len(raw), cut)) + m.close() == s
    rnd = random.Random(4)
    for _ in range(2000):
        raw = rnd.randbytes(rnd.randint(0, 12))
        m = bpe.Utf8Machine()
        assert m.feed(raw) + m.close() == raw.decode("utf-8", "replace")


def test_query(spark):
    rows = [(1, "Hello there", "x", 0), (2, None, "y", 1), (3, "", "z", 2), (1, "Hello there", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = {r.doc_id: r for r in bpe.round_trip(df, PATH, P.PATTERN, with_ids=True).collect()}
    assert out[2].n_tokens == out[3].n_tokens == 0 and out[2].ids_sha256 == out[3].ids_sha256 and list(out[2].ids) == []
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert texts == {1: "Hello there", 2: "", 3: ""}
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0


def test_equal_texts_are_encoded_once(spark, monkeypatch, reference):
    """The mix puts copies of a text side by side: they cost one encoding, and each row has all columns."""
    import hashlib
    import struct

    import pyarrow as pa
    from pyspark.sql import types as T

    class Docs:
        """Takes the function that the workers would run."""

        sparkSession = spark
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            self.function = function
            return self

        def withColumnRenamed(self, old, new):
            return self

    texts = [t for t in ("one text", None, "", "another text") for _ in range(20)]
    calls, plain = [], bpe.Codec.encode_packed
    monkeypatch.setattr(bpe.Codec, "encode_packed", lambda self, text: calls.append(text) or plain(self, text))
    for with_ids in (False, True):
        calls.clear()
        docs = Docs()
        bpe.round_trip(docs, PATH, P.PATTERN, with_ids=with_ids)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
        rows = [r for b in docs.function([batch]) for r in b.to_pylist()]
        assert len(calls) == 4
        assert [r["id"] for r in rows] == list(range(len(texts)))
        for r, t in zip(rows, texts, strict=True):
            ids = reference.encode_ordinary(t or "")
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
            assert not with_ids or r["ids"] == ids
