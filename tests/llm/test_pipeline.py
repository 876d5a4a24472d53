import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.count()
        if i < 4:
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "tokens"]
    assert seen["quality"] == seen["lines"] >= seen["near_duplicates"] > 0 and seen["tokens"] == seen["mixing"]
    import public_tokenizers as P

    from tilewright.llm import bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "mixing")).collect()}
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in docs.collect():
        assert codec.decode(r.ids) == (texts[r.doc_id] or "") and len(r.ids) == r.n_tokens


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, an empty text, repeated rows, columns of the stages' own names; and no rows at all."""
    from pyspark.sql import functions as F

    given = spark.read.parquet(f"{DATA}/documents.parquet")
    nothing = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, None, "en", "web", None)], given.schema)
    odd = given.union(given.limit(20)).union(nothing).withColumns({n: F.lit("x") for n in ("id", "_row", "copies", "h1", "key", "gone", "ids", "root")})
    for label, docs in (("odd", odd), ("none", odd.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / label / name)
            stage(spark, docs, DATA).write.parquet(path)
            out = spark.read.parquet(path)
            if name != "tokens":
                assert out.columns == odd.columns
            docs = out
        assert (docs.count() > 0) == (label == "odd")
