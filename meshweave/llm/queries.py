"""The operators as queries over the corpus tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import canon_digest, html_density, merkle_warc, mixing, nn_descent, quality_qda, sentencepiece_nbest, simhash, suffix_array, token_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    results = ("ids", "n_pieces", "scores", "nbest_sha256", "decoded_equal")
    return sentencepiece_nbest.encode_nbest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), results=results)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.link_vectors(_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_warc.audit_pages(_table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon_digest.fingerprints(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "whole", "part", "position")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.deduplicate(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_text(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece_nbest, op2_embedding_near_dedup, op3_token_counts, op4_warc_fixity, op5_quality_classifier, op6_document_fingerprints, op7_simhash_near_dedup, op8_mixing, op9_suffix_array_dedup,
        op10_html_extraction,
    )
}

#: DuckDB SQL for the queries that it can express over whole tables.
ORACLE: dict[str, str] = {
    "op8_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o
            FROM documents
        ), t AS (
            SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS k
            FROM d GROUP BY source
        ), w AS (SELECT *, CAST([5, 2, 1][k % 3 + 1] AS DOUBLE) AS w, s * 3.0 AS room FROM t
        ), l AS (
            SELECT *, ((sum(s) OVER ()) - coalesce(sum(room) OVER (ORDER BY room / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(w) OVER (ORDER BY room / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l
            FROM w
        ), lev AS (SELECT l AS lev FROM l WHERE l * w <= room ORDER BY room / w, k LIMIT 1
        ), g AS (SELECT source, s, least(room, lev * w) AS target, CAST([-0.5, 0.25, 0.75][k % 3 + 1] AS DOUBLE) AS a FROM l, lev
        ), c AS (
            SELECT d.doc_id, d.size, g.s, g.target, g.a, CASE WHEN g.s > 0 THEN floor(g.target / g.s) ELSE 0 END AS whole,
                coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
        ), p AS (
            SELECT *, greatest(0, least(size, floor(target - whole * s + 0.5) - start)) AS part, least(start / target, 1.0) AS x, (SELECT sum(target * a) / sum(target) FROM g) AS drift FROM c
        ), due AS (SELECT *, 2 * x / (1 - a + sqrt((1 - a) * (1 - a) + 4 * a * x)) AS due FROM p)
        SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target, CAST(whole * size + part AS BIGINT) AS taken,
            CAST(whole AS BIGINT) AS whole, CAST(part AS BIGINT) AS part, CASE WHEN whole * size + part > 0 THEN round(due + drift * (due * due - due), 9) END AS position
        FROM due""",
}
