"""Queries of this subpackage for ``__spark_entry__``: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding, mixing, neardup, pieces, pii, quality, sharding, simhash, toxicity, warc
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_report(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text and the number of values replaced."""
    docs = table(spark, sf_dir, "documents")
    return pii.pseudonymise_documents(docs.withColumn("n_pii", F.coalesce(pii.count_pii("text"), F.lit(0)))).select("doc_id", "text", "n_chars", "n_pii")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_warc, op3_minhash, op4_simhash, op5_pii, op6_mixing, op7_toxicity, op8_pieces, op9_sharding, op10_embedding)}
_B32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + (i // 4) * 5 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '')"
_REACH = "reach AS (SELECT DISTINCT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"
ORACLES: dict[str, str] = {
    "op2_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), d AS (SELECT page_id, strlen(x) AS n, sha1(x) AS h, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM d""",
    "op3_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(x.n) + min(y.n) - count(*))),
{_REACH},
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.low, d.doc_id)) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id""",
    "op10_embedding": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
{_REACH},
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a), k AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id""",
}
