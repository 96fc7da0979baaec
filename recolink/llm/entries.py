"""Queries of this package and the SQL that must return the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from recolink.llm import bpe, exact_dedup, language, maxscore, ngram_join, packing, secrets, substring_dedup, toxicity, warc
from recolink.llm.shared import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query("op1_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""")
def op1(spark, sf_dir):
    """Exact duplicates of documents: which row of each group of equal texts stays."""
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


@query("op3_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d""")
def op3(spark, sf_dir):
    """pages written to WARC archives, normalised to one member per record, and read back by the index."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    """Ids of every document by the 50k ranks, as digests, and the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def remainder(id_col, modulus):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus))


@query("op5_language_id")
def op5(spark, sf_dir):
    """Predicted language of every document; rows with remainder 2 are held out of training."""
    found = language.identify(table(spark, sf_dir, "documents"), remainder("doc_id", 4) != 2)
    return found.select(F.col("id").alias("doc_id"), (remainder("id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op8_maxscore", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20""")
def op8(spark, sf_dir):
    """The 20 best inner products of every 20th vector against all others."""
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_toxicity")
def op9(spark, sf_dir):
    """Toxicity of every document; rows with remainder 1 are held out of training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, labels, remainder("__id", 3) != 1)
    return found.select(
        F.col("id").alias("doc_id"), (remainder("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op10_substring_dedup", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS place, words FROM t),
h AS (SELECT doc_id, place, sha256(array_to_string(words[place : place + 49], ' ')) AS digest FROM w),
r AS (SELECT doc_id, place FROM (SELECT doc_id, place, min(doc_id) OVER (PARTITION BY digest) AS first FROM h) WHERE doc_id > first),
gone AS (SELECT doc_id, list(DISTINCT covered) AS places FROM (SELECT doc_id, unnest(range(place, place + 50)) AS covered FROM r) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE
         list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i)), lambda i: words[i]) END, ' ')) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id)""")
def op10(spark, sf_dir):
    """Words of every document that are not covered by a passage of an earlier one."""
    return substring_dedup.dedup_passages(table(spark, sf_dir, "documents"))


@query("op7_ngram_jaccard_join", r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1),
        lambda i: array_to_string(words[i : i + 4], ' ')))) AS grams FROM t),
s AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY grams) AS set_id, grams FROM g),
c AS MATERIALIZED (SELECT set_id, len(grams) AS n, unnest(grams) AS gram FROM s WHERE doc_id = set_id),
met AS (SELECT a.set_id AS u, b.set_id AS v, a.n + b.n AS n, count(*) AS common
         FROM c a JOIN c b ON a.gram = b.gram AND a.set_id <> b.set_id GROUP BY ALL),
link AS MATERIALIZED (SELECT u, v FROM met WHERE 5 * common >= 4 * (n - common)),
reach AS (SELECT u, v FROM link UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u),
head AS (SELECT u, min(v) AS least FROM reach GROUP BY u),
deg AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT doc_id, least(set_id, coalesce(least, set_id)) AS class_id, set_id, coalesce(deg.n, 0) AS n_links
FROM s LEFT JOIN head ON s.set_id = head.u LEFT JOIN deg ON s.set_id = deg.u""")
def op7(spark, sf_dir):
    """Near-duplicate class, set and number of links of every document."""
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query("op2_secret_scan")
def op2(spark, sf_dir):
    """Every candidate secret in documents, with the forest's verdict."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "finding", "start", "length", "kind", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret"
    )
