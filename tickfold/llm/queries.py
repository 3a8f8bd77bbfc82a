"""The registered queries of this package, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import token_digests
from .centroids import cluster_vectors
from .centroids import oracle as cluster_sql
from .common import LOWER, UPPER, table
from .conversation_trie import oracle as trie_sql
from .conversation_trie import prefix_trie
from .decontaminate import contamination
from .decontaminate import oracle as contamination_sql
from .html_extract import extract_text
from .licenses import scan_licenses
from .media import decode_media, texts_as_media
from .ngram_join import ngram_components
from .packing import pack_documents, with_checksums
from .quality import score_quality
from .secrets import find_secrets
from .toxicity import score_toxicity
from .url_filter import judge_urls
from .url_filter import oracle as url_sql


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


NGRAM_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join links l on l.a = r.b)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.least, w.doc_id) as component_id
from w left join n using (doc_id) left join (select a as doc_id, min(b) as least from reach group by 1) c using (doc_id)"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings; a value is given as its digest and its first four characters only."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "position",
        F.length("value").cast("long").alias("length"),
        "occurrences",
        F.substring("value", 1, 4).alias("head"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        "score",
        "is_secret",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"))
    return judged.withColumns({c: F.round(c, 7) for c in ("block_rate", "block_bound")})


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_checksums(pack_documents(table(spark, sf_dir, "documents")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = decode_media(texts_as_media(table(spark, sf_dir, "documents")))
    payload = F.col("samples")
    return files.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("dhash").alias("feature"),
    )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_url_filter": op4_url_filter,
    "op5_html_extraction": op5_html_extraction,
    "op6_decontamination": op6_decontamination,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_media": op10_media,
    "op11_bpe": op11_bpe,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_centroids": op13_centroids,
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": NGRAM_SQL,
    "op4_url_filter": url_sql(),
    "op6_decontamination": contamination_sql(),
    "op12_conversation_trie": trie_sql(),
    "op13_centroids": cluster_sql(),
}
