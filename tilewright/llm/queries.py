"""The queries of this subpackage, as `__spark_entry__.py` registers them.

Each applies one operator with production parameters to its whole table and
derives the columns that its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_text, line_dedup, merkle, mixing, ngram_join, pii, quality, token_counts, topk, url_filter, whitening
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


#: Verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.visible_text(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked against rows of which some were tampered with."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    # decimal: adding to the largest long must not fail
    more = F.col("n_chars").cast("decimal(20,0)") + F.when(tampered, 1).otherwise(0)
    now = merkle.digest([more if f == "n_chars" else F.col(f) for f in fields])
    m = merkle.manifest(docs, fields=fields, group="lang", order=["doc_id"], carry={"now": now})
    m = m.withColumns({"proof_sha256": F.sha2(merkle.siblings_text(F.col("proof")), 256), "folded_root": merkle.fold(F.col("now"), F.col("proof"))})
    return m.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), scale=1024.0, shift=100_000, components=8)
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_personal_data": op4_personal_data,
    "op5_url_filter": op5_url_filter,
    "op6_html_text": op6_html_text,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_quality_ranking": op10_quality_ranking,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_counts": op12_token_counts,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op5_url_filter": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
        ), h AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p
        ), rules(verdict, rhost, rpath) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), fit AS (
            SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS r
            FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        )
        SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN fit ON h.page_id = fit.page_id AND r = 1
    """,
    "op8_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS f
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.f, c.f), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    # crc32 by its table of 256 steps, the tree level by level, then the tampered leaves folded along it
    "op11_merkle_manifest": """
        WITH RECURSIVE step(v, c, k) AS (
            SELECT range, range, 0 FROM range(256)
            UNION ALL
            SELECT v, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
        ), steps AS (
            SELECT list(c ORDER BY v) AS t FROM step WHERE k = 8
        ), marked AS (
            SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS INTEGER)])), CAST(4294967295 AS BIGINT)) % 7 = 0 AS tampered
            FROM documents, steps
        ), parts AS (
            SELECT doc_id, lang,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS chars,
                CASE WHEN tampered THEN coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') END AS more,
                coalesce(strlen(text) || ':' || text, '-') AS body
            FROM marked
        ), leaves AS (
            SELECT doc_id, lang, sha256(head || chars || body) AS leaf, sha256(head || coalesce(more, chars) || body) AS now FROM parts
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
        ), node(lang, level, i, n, h) AS (
            SELECT lang, 0, i, n, leaf FROM placed
            UNION ALL
            SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, level, i // 2, (n + 1) // 2
        ), subroots AS (
            SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1
        ), upper(level, i, n, h) AS (
            SELECT 0, i, n, subroot FROM subroots
            UNION ALL
            SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 2, (n + 1) // 2
        ), path AS (
            SELECT p.lang, p.i, a.level, (p.i >> CAST(a.level AS BIGINT)) % 2 = 1 AS is_right, b.h AS sibling
            FROM placed p JOIN (SELECT DISTINCT lang, level FROM node WHERE n > 1) a ON a.lang IS NOT DISTINCT FROM p.lang
            LEFT JOIN node b ON b.lang IS NOT DISTINCT FROM p.lang AND b.level = a.level AND b.i = xor(p.i >> CAST(a.level AS BIGINT), CAST(1 AS BIGINT))
            UNION ALL
            SELECT p.lang, p.i, s.height + a.level, (s.i >> CAST(a.level AS BIGINT)) % 2 = 1, b.h
            FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) a
            LEFT JOIN upper b ON b.level = a.level AND b.i = xor(s.i >> CAST(a.level AS BIGINT), CAST(1 AS BIGINT))
        ), folded(lang, i, level, h) AS (
            SELECT lang, i, 0, now FROM placed
            UNION ALL
            SELECT f.lang, f.i, f.level + 1, sha256(CASE WHEN is_right THEN coalesce(sibling, '') || h ELSE h || coalesce(sibling, '') END)
            FROM folded f JOIN path ON path.lang IS NOT DISTINCT FROM f.lang AND path.i = f.i AND path.level = f.level
        ), ends AS (
            SELECT lang, i, arg_max(h, level) AS folded_root FROM folded GROUP BY lang, i
        ), proofs AS (
            SELECT lang, i, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM path GROUP BY lang, i
        )
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
        JOIN ends e ON e.lang IS NOT DISTINCT FROM p.lang AND e.i = p.i
        LEFT JOIN proofs o ON o.lang IS NOT DISTINCT FROM p.lang AND o.i = p.i
        CROSS JOIN (SELECT h AS root FROM upper WHERE n = 1)
    """,
}
