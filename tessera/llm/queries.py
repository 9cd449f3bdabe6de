"""One query per operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, line_dedup, minhash, nn_descent, packing, sharding, suffix_dedup, tiff, warc
from .common import materialize, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), length=4096, end_id=2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), t=2, edit_chars=16)
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=5, threshold=0.8)


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), weights=(1.0,) * 40, grown=1.0)


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(warc.write_archives(table(spark, sf_dir, "pages")), "warc")
    out = warc.read_archives(archives).filter("gap_start is null")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_hilbert_packing, op4_line_dedup, op5_tiff_media, op6_minhash_dedup, op7_trie_bpe, op8_nn_descent, op9_rendezvous_sharding, op10_warc_salvage)}
#: Windows of 20 words by their text; the first of equal ones stays.
_OP1 = """
WITH doc AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM doc WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS place FROM win) WHERE place > 1),
hit AS (SELECT DISTINCT doc_id, i + k.k AS i FROM later CROSS JOIN (SELECT k FROM range(20) t(k)) k),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM doc),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM word w ANTI JOIN hit h ON h.doc_id = w.doc_id AND h.i = w.i GROUP BY w.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN lost l ON l.doc_id = d.doc_id"""
#: The largest page of equal payloads of 1,000 bytes or more is the response.
_OP10 = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS newest FROM page)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < newest THEN newest END AS refers_to FROM last"""
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op10_warc_salvage": _OP10}
