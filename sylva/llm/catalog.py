"""The operators' registered queries and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import decontaminate, jaccard_join, langid, mixing, quality, secrets, token_store, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": token_store.op1_token_store,
        "op2_language_id": langid.op2_language_id,
        "op3_source_mix": mixing.op3_source_mix,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_secrets": secrets.op6_secrets,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_quality": quality.op8_quality,
        "op9_warc": warc.op9_warc,
        "op10_exact_topk": topk.op10_exact_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": WARC, "op10_exact_topk": TOPK}


TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
           FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(p.h, 5 * CAST(i // 4 AS INTEGER) + 1, 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id OR page_id IS NULL THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
